"""Column expressions: frames, distances, angles, colours. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid_id(x: Column, y: Column, lo: tuple[Column, Column], size: tuple[Column, Column], rows: int, cols: int) -> Column:
    """Row-major cell number; points beyond the edge belong to the edge cells."""
    at = lambda v, low, step, n: F.least(F.greatest(F.floor((v - low) / step), F.lit(0)), F.lit(n - 1))
    return at(y, lo[1], size[1], rows) * cols + at(x, lo[0], size[0], cols)


def affine(x: Column, y: Column, z: Column, m: Sequence[float | Column]) -> tuple[Column, Column, Column]:
    """The first three rows of a row-major 4x4 matrix applied to (x, y, z, 1)."""
    lit = [v if isinstance(v, Column) else F.lit(float(v)) for v in m]
    return tuple(lit[4 * i] * x + lit[4 * i + 1] * y + lit[4 * i + 2] * z + lit[4 * i + 3] for i in range(3))


def dist3d(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def dist2d(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def fold_angle(dot: Column) -> Column:
    """Degrees between two directions whose sign doesn't matter."""
    a = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    return F.least(a, 180 - a)


def euler_xyz(r: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Extrinsic x, y, z angles in degrees of a row-major rotation matrix."""
    return (
        F.degrees(F.atan2(r[7], r[8])),
        F.degrees(F.atan2(-r[6], F.sqrt(r[7] * r[7] + r[8] * r[8]))),
        F.degrees(F.atan2(r[3], r[0])),
    )


def bearing(dx: Column, dy: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))


def colour_ratio(own: Column, r: Column, g: Column, b: Column) -> Column:
    total = r + g + b
    return F.when(total > 0, own / total)


def strip_number(path: Column) -> Column:
    """The first run of digits in a file's stem, 0 where there is none."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    digits = F.regexp_extract(stem, r"(\d+)", 1)
    return F.when(digits == "", F.lit(0).cast("long")).otherwise(digits.try_cast("long"))


def memory_text(mb: Column) -> Column:
    return F.when(mb < 1024, F.format_string("%.1f MB", mb)).otherwise(F.format_string("%.1f GB", mb / 1024))


