"""PySpark-native analytics for overlapping point-cloud strips."""
