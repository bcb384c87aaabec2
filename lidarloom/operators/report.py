"""Statistical reports over points, targets and sequences, as parameterised SQL.

Each entry names its inputs in braces; ``report`` binds DataFrames to them. Aggregates are single-pass and combine on
the map side. Where a statistic needs another first (a mean, a range), that one is a one-row subquery that Spark
broadcasts. Windows without partitions run over targets or over the few rows of an aggregate only, never over points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lidarloom.functions.statistics import quantiles_by

CORR = ("intensity", "r", "g", "b")

REPORTS: dict[str, str] = {
    # -- points ---------------------------------------------------------------------------------------------------
    "agg_bounds": "SELECT strip, count(*) AS n_points, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM {points} GROUP BY strip",
    "agg_describe_intensity": """
        SELECT round(avg(v), 6) AS mean, round(percentile(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max,
          round(percentile(v, 0.25), 6) AS q25, round(percentile(v, 0.75), 6) AS q75,
          round(avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5), 6) AS skewness,
          round(avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3, 6) AS kurtosis
        FROM (SELECT intensity AS v FROM {points}) AS a CROSS JOIN (SELECT avg(intensity) AS m FROM {points}) AS b""",
    "agg_rgb_stats": "SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in "rgb") + " FROM {points}",
    "agg_spatial_stats": """
        SELECT max(x) - min(x) AS x_range, max(y) - min(y) AS y_range, round(max(z) - min(z), 6) AS z_range, round(avg(x), 6) AS x_center, round(avg(y), 6) AS y_center, round(avg(z), 6) AS z_center,
          round(count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)), 0), 6) AS point_density FROM {points}""",
    "agg_density_stats": """
        SELECT count(*) AS total_points, round((max(x) - min(x)) * (max(y) - min(y)), 6) AS xy_area, round(count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)), 0), 6) AS xy_density,
          round((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 4) AS volume, round(count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)), 0), 6) AS volume_density FROM {points}""",
    "agg_corr_matrix": "SELECT " + ", ".join(f"round(corr({a}, {b}), 6) AS {a}_{b}" for i, a in enumerate(CORR) for b in CORR[i:]) + " FROM {points}",
    "agg_spectral_corr": """
        SELECT round(corr(intensity, r), 6) AS intensity_r_corr, round(corr(intensity, g), 6) AS intensity_g_corr, round(corr(intensity, b), 6) AS intensity_b_corr, round(corr(r, g), 6) AS r_g_corr, round(corr(g, b), 6) AS g_b_corr, round(corr(r, b), 6) AS r_b_corr,
          round(avg(CASE WHEN r + g + b > 0 THEN r / (r + g + b) END), 6) AS mean_r_ratio, round(avg(CASE WHEN r + g + b > 0 THEN g / (r + g + b) END), 6) AS mean_g_ratio, round(avg(CASE WHEN r + g + b > 0 THEN b / (r + g + b) END), 6) AS mean_b_ratio FROM {points}""",
    "agg_strip_stats": """
        SELECT line, count(*) AS point_count, round(avg(intensity), 6) AS mean_intensity, round(stddev_samp(intensity), 6) AS std_intensity, round(avg(z), 6) AS mean_z, round(stddev_samp(z), 6) AS std_z, min(z) AS min_z, max(z) AS max_z, round(max(z) - min(z), 6) AS z_range,
          round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g, round(avg(b), 6) AS mean_b FROM {points} GROUP BY line""",
    "agg_strip_overlap": """
        WITH s AS (SELECT line, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {points} GROUP BY line)
        SELECT a.line AS first, b.line AS second, round(CASE WHEN a.n > 3 AND b.n > 3 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)
          THEN (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / nullif((a.x1 - a.x0) * (a.y1 - a.y0), 0) ELSE 0.0 END, 6) AS ratio
        FROM s a JOIN s b ON a.line <> b.line""",
    "jn_strip_pairs": "WITH s AS (SELECT line, count(*) AS n FROM {points} GROUP BY line) SELECT a.line AS first, b.line AS second, a.n AS n_first, b.n AS n_second FROM s a JOIN s b ON a.line <> b.line",
    "agg_hist1d_auto": """
        SELECT bin, count(*) AS n FROM (SELECT cast(least(floor((intensity - lo) * 50 / nullif(hi - lo, 0)), 49) AS bigint) AS bin FROM {points} CROSS JOIN (SELECT min(intensity) AS lo, max(intensity) AS hi FROM {points}) AS r) AS h GROUP BY bin""",
    "agg_hist2d_xy": """
        SELECT xb, yb, count(*) AS n FROM (SELECT cast(least(floor((x - x0) * 50 / nullif(x1 - x0, 0)), 49) AS bigint) AS xb, cast(least(floor((y - y0) * 50 / nullif(y1 - y0, 0)), 49) AS bigint) AS yb
          FROM {points} CROSS JOIN (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {points}) AS r) AS h GROUP BY xb, yb""",
    "agg_hist2d_xz": """
        SELECT xb, zb, count(*) AS n FROM (SELECT cast(least(floor((x - x0) * 50 / nullif(x1 - x0, 0)), 49) AS bigint) AS xb, cast(least(floor((round(z, 4) - z0) * 50 / nullif(z1 - z0, 0) + 1e-9), 49) AS bigint) AS zb
          FROM {points} CROSS JOIN (SELECT min(x) AS x0, max(x) AS x1, min(round(z, 4)) AS z0, max(round(z, 4)) AS z1 FROM {points}) AS r) AS h GROUP BY xb, zb""",
    "agg_final_point_stats": "SELECT count(*) AS total_points, round(avg(intensity), 6) AS mean_intensity, round(stddev_samp(intensity), 6) AS std_intensity, min(x) AS x_lo, max(x) AS x_hi, min(y) AS y_lo, max(y) AS y_hi, min(z) AS z_lo, max(z) AS z_hi FROM {points}",
    "prj_color_ratio": "SELECT round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(CASE WHEN r + g + b > 0 THEN r / (r + g + b) END, 6) AS r_ratio, round(CASE WHEN r + g + b > 0 THEN g / (r + g + b) END, 6) AS g_ratio, round(CASE WHEN r + g + b > 0 THEN b / (r + g + b) END, 6) AS b_ratio, count(*) AS n FROM {points} GROUP BY r, g, b",
    "prj_rgb_norm": """
        SELECT count(*) AS n, round(sum(r / s), 4) AS sum_r, round(sum(g / s), 4) AS sum_g, round(sum(b / s), 4) AS sum_b, max(r / s) AS max_r
        FROM {points} CROSS JOIN (SELECT CASE WHEN max(greatest(r, g, b)) > 1 THEN 65535.0 ELSE 1.0 END AS s FROM {points}) AS m""",
    "prj_default_intensity": "SELECT strip, round(avg(coalesce(CASE WHEN intensity % 7 = 0 THEN NULL ELSE intensity END, 100.0)), 6) AS mean_intensity, count(*) AS n FROM {points} GROUP BY strip",
    "flt_bbox": "SELECT strip, count(*) AS n FROM {points} WHERE x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 80 GROUP BY strip",
    "flt_intensity_seed": "SELECT strip, count(*) AS n, max(intensity) AS top FROM {points} WHERE intensity > 1300 GROUP BY strip",
    "flt_zmax_fallback": """
        SELECT strip, count(*) AS n, max(z) AS top FROM (SELECT strip, z, k FROM {points} CROSS JOIN (SELECT sum(CASE WHEN z < 5.5 THEN 1 ELSE 0 END) AS k FROM {points}) AS m) AS t WHERE z < 5.5 OR k = 0 GROUP BY strip""",
    "flt_percentile_cut": "SELECT count(*) AS n, max(intensity) AS top FROM {points} CROSS JOIN (SELECT percentile(intensity, 0.9) AS p FROM {points}) AS q WHERE intensity <= p",
    "out_iqr": """
        SELECT strip, sum(CASE WHEN intensity < q1 - 1.5 * (q3 - q1) OR intensity > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS intensity_outliers, sum(CASE WHEN x < x1 - 0.5 * (x3 - x1) OR x > x3 + 0.5 * (x3 - x1) THEN 1 ELSE 0 END) AS x_outliers, count(*) AS n
        FROM {points} CROSS JOIN (SELECT percentile(intensity, 0.25) AS q1, percentile(intensity, 0.75) AS q3, percentile(x, 0.25) AS x1, percentile(x, 0.75) AS x3 FROM {points}) AS q GROUP BY strip""",
    "out_combined": """
        SELECT sum(CASE WHEN i_out THEN 1 ELSE 0 END) AS intensity_outliers, sum(CASE WHEN z_out THEN 1 ELSE 0 END) AS z_outliers, sum(CASE WHEN i_out OR z_out THEN 1 ELSE 0 END) AS total_outliers, round(sum(CASE WHEN i_out OR z_out THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS outlier_ratio
        FROM (SELECT intensity > q.i9 AS i_out, x > q.x9 AS z_out FROM {points} CROSS JOIN (SELECT percentile(intensity, 0.9) AS i9, percentile(x, 0.95) AS x9 FROM {points}) AS q) AS t""",
    "agg_median_mad": """
        SELECT t.strip, round(max(m), 6) AS median, round(percentile(abs(intensity - m), 0.5), 6) AS mad
        FROM {points} AS t JOIN (SELECT strip, percentile(intensity, 0.5) AS m FROM {points} GROUP BY strip) AS q ON t.strip = q.strip GROUP BY t.strip""",
    # -- targets --------------------------------------------------------------------------------------------------
    "agg_cluster_quality": "SELECT file, round(avg(planarity), 6) AS avg_planarity, round(avg(distance_to_ref), 6) AS avg_distance_error, round(max(distance_to_ref), 6) AS max_distance_error, round(stddev_samp(distance_to_ref), 6) AS std_distance_error FROM {targets} GROUP BY file",
    "agg_accuracy_stats": """
        SELECT file, round(avg(d), 6) AS mean_distance_error, round(stddev_samp(d), 6) AS std_distance_error, round(max(d), 6) AS max_distance_error, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(e), 6) AS mean_z_error, round(stddev_samp(e), 6) AS std_z_error, round(sqrt(avg(e * e)), 6) AS rmse_z
        FROM (SELECT file, distance_to_ref AS d, center_z - ref_z AS e FROM {targets}) AS t GROUP BY file""",
    "prj_quality_score": """
        SELECT t.file, reference_id, round((1 - distance_to_ref / md) * CASE WHEN mp > 0 THEN planarity / mp ELSE 0 END * (1 - normal_angle / 90), 6) AS quality_score
        FROM {targets} AS t JOIN (SELECT file, max(distance_to_ref) AS md, max(planarity) AS mp FROM {targets} GROUP BY file) AS m ON t.file = m.file""",
    "agg_radar": """
        SELECT t.file, round(1 - avg(distance_to_ref / md), 6) AS distance_accuracy, round(avg(CASE WHEN mp > 0 THEN planarity / mp ELSE 0 END), 6) AS planarity, round(1 - avg(normal_angle / 90), 6) AS angle_accuracy, round(avg(point_count) / max(point_count), 6) AS point_density,
          round(1 / (1 + avg(distance_to_ref)), 6) AS mean_error, round(1 / (1 + max(distance_to_ref)), 6) AS max_error
        FROM {targets} AS t JOIN (SELECT file, max(distance_to_ref) AS md, max(planarity) AS mp FROM {targets} GROUP BY file) AS m ON t.file = m.file GROUP BY t.file""",
    "jn_multi_compare": """
        SELECT a.reference_id, a.file AS file1_name, b.file AS file2_name, round(b.center_x - a.center_x, 6) AS diff_x, round(b.center_y - a.center_y, 6) AS diff_y, round(b.center_z - a.center_z, 6) AS diff_z,
          round(sqrt(power(b.center_x - a.center_x, 2) + power(b.center_y - a.center_y, 2) + power(b.center_z - a.center_z, 2)), 6) AS distance_3d, round(sqrt(power(b.center_x - a.center_x, 2) + power(b.center_y - a.center_y, 2)), 6) AS distance_2d,
          round(b.planarity - a.planarity, 6) AS diff_planarity, round(b.normal_angle - a.normal_angle, 6) AS diff_angle
        FROM {targets} AS a JOIN {targets} AS b ON a.reference_id = b.reference_id AND a.file = 'customer' AND b.file = 'supplier'""",
    "jn_common_refs": "SELECT a.reference_id, a.point_count AS n_src, b.point_count AS n_dst FROM {targets} AS a JOIN {targets} AS b ON a.reference_id = b.reference_id WHERE a.file = 'customer' AND b.file = 'supplier'",
    "set_intersect": "SELECT reference_id FROM {targets} WHERE file = 'customer' INTERSECT SELECT reference_id FROM {targets} WHERE file = 'supplier'",
    "set_fill": "SELECT reference_id FROM {targets} WHERE file = 'customer' EXCEPT SELECT reference_id FROM {targets} WHERE distance_to_ref > 3",
    "set_union_all": "SELECT file, count(*) AS n FROM (SELECT file, reference_id FROM {targets} UNION ALL SELECT file, reference_id FROM {targets} WHERE normal_angle < 45) AS u GROUP BY file",
    "set_union_distinct": "SELECT reference_id FROM {targets} WHERE distance_to_ref > 3 UNION SELECT reference_id FROM {targets} WHERE normal_angle < 45",
    "set_or_masks": "SELECT file, sum(CASE WHEN distance_to_ref > 3 OR normal_angle < 45 OR planarity > 0.5 THEN 1 ELSE 0 END) AS n FROM {targets} GROUP BY file",
    "agg_comparison_stats": """
        WITH c AS (SELECT b.center_x - a.center_x AS dx, b.center_y - a.center_y AS dy, b.center_z - a.center_z AS dz FROM {targets} AS a JOIN {targets} AS b ON a.reference_id = b.reference_id AND a.file = 'customer' AND b.file = 'supplier'),
        m AS (SELECT 'diff_x' AS metric, dx AS v FROM c UNION ALL SELECT 'diff_y', dy FROM c UNION ALL SELECT 'diff_z', dz FROM c UNION ALL SELECT 'distance_2d', sqrt(dx * dx + dy * dy) FROM c UNION ALL SELECT 'distance_3d', sqrt(dx * dx + dy * dy + dz * dz) FROM c)
        SELECT metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(max(v), 6) AS max, round(min(v), 6) AS min, 'm' AS unit FROM m GROUP BY metric""",
    "agg_file_report": "SELECT file, count(*) AS detected_points, round(avg(distance_to_ref), 6) AS mean_accuracy, round(stddev_samp(distance_to_ref), 6) AS std_accuracy, round(avg(planarity), 6) AS mean_planarity, round(avg(normal_angle), 6) AS mean_normal_angle FROM {targets} GROUP BY file",
    "agg_target_accuracy": """
        SELECT count(*) AS n_common, round(avg(sqrt(dx * dx + dy * dy + dz * dz)), 6) AS mean_3d, round(avg(sqrt(dx * dx + dy * dy)), 6) AS mean_2d, round(avg(abs(dz)), 6) AS mean_z, round(avg(da), 6) AS mean_angle
        FROM (SELECT b.center_x - a.center_x AS dx, b.center_y - a.center_y AS dy, b.center_z - a.center_z AS dz, least(abs(b.normal_angle - a.normal_angle), 180 - abs(b.normal_angle - a.normal_angle)) AS da FROM {targets} AS a JOIN {targets} AS b ON a.reference_id = b.reference_id AND a.file = 'customer' AND b.file = 'supplier') AS d""",
    "win_residual": "SELECT t.file, reference_id, round(distance_to_ref - m, 6) AS residual FROM {targets} AS t JOIN (SELECT file, avg(distance_to_ref) AS m FROM {targets} GROUP BY file) AS q ON t.file = q.file",
    "agg_ecdf": "SELECT file, round(distance_to_ref, 6) AS v, round(CAST(row_number() OVER (PARTITION BY file ORDER BY distance_to_ref, reference_id) AS DOUBLE) / count(*) OVER (PARTITION BY file), 6) AS share FROM {targets}",
    "inf_box": "SELECT file, round(min(distance_to_ref), 6) AS lo, round(percentile(distance_to_ref, 0.25), 6) AS q1, round(percentile(distance_to_ref, 0.5), 6) AS med, round(percentile(distance_to_ref, 0.75), 6) AS q3, round(max(distance_to_ref), 6) AS hi FROM {targets} GROUP BY file",
    "inf_pred_interval": "SELECT file, round(avg(distance_to_ref) - 2 * stddev_samp(distance_to_ref), 6) AS lo, round(avg(distance_to_ref) + 2 * stddev_samp(distance_to_ref), 6) AS hi FROM {targets} GROUP BY file",
    "jn_cluster_label": "SELECT t.file, t.cluster_id, l.merged_label FROM {targets} AS t LEFT JOIN (SELECT cluster_id, min(reference_id) AS merged_label FROM {targets} WHERE normal_angle < 45 GROUP BY cluster_id) AS l ON t.cluster_id = l.cluster_id",
    "jn_cdist": "SELECT a.reference_id AS center, b.reference_id AS ref, round(sqrt(power(a.center_x - b.center_x, 2) + power(a.center_y - b.center_y, 2) + power(a.center_z - b.center_z, 2)), 6) AS d FROM (SELECT * FROM {targets} WHERE file = 'customer') AS a CROSS JOIN (SELECT * FROM {targets} WHERE file = 'supplier') AS b",
    "prj_dist3d": "SELECT file, reference_id, round(sqrt(power(center_x - ref_x, 2) + power(center_y - ref_y, 2) + power(center_z - ref_z, 2)), 6) AS d FROM {targets}",
    "prj_dist2d": "SELECT file, reference_id, round(sqrt(power(center_x - ref_x, 2) + power(center_y - ref_y, 2)), 6) AS d FROM {targets}",
    "prj_angle": "SELECT file, reference_id, round(least(a, 180 - a), 6) AS angle FROM (SELECT file, reference_id, degrees(acos(greatest(-1.0, least(1.0, cos(radians(normal_angle)) * (1 - planarity / 10))))) AS a FROM {targets}) AS t",
    "prj_bearing": "SELECT file, reference_id, round(CASE WHEN a < 0 THEN a + 360 ELSE a END, 6) AS bearing FROM (SELECT file, reference_id, degrees(atan2(center_y - ref_y, center_x - ref_x)) AS a FROM {targets}) AS t",
    "agg_rose": """
        WITH b AS (SELECT CASE WHEN a < 0 THEN a + 360 ELSE a END AS a, d FROM (SELECT degrees(atan2(center_y - ref_y, center_x - ref_x)) AS a, sqrt(power(center_x - ref_x, 2) + power(center_y - ref_y, 2)) AS d FROM {targets}) AS t)
        SELECT s.bin * 30 + 15 AS center, round(coalesce(m.d, 0.0), 6) AS mean_error FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11)) AS s(bin) LEFT JOIN (SELECT cast(floor(a / 30) AS int) AS bin, avg(d) AS d FROM b GROUP BY cast(floor(a / 30) AS int)) AS m ON s.bin = m.bin""",
    "mdl_ols1": "SELECT file, round(regr_slope(distance_to_ref, point_count), 8) AS slope, round(regr_intercept(distance_to_ref, point_count), 6) AS intercept, round(regr_r2(distance_to_ref, point_count), 6) AS r2 FROM {targets} GROUP BY file HAVING var_pop(point_count) > 0",
    "mdl_poly2": """
        WITH s AS (SELECT file, count(*) AS n, avg(normal_angle) AS mx FROM {targets} GROUP BY file),
        p AS (SELECT t.file, max(s.n) AS n, max(mx) AS mx, sum(u) AS s1, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS sy, sum(u * y) AS sxy, sum(u * u * y) AS sxxy
          FROM (SELECT t.file, (normal_angle - mx) / 10 AS u, planarity AS y FROM {targets} AS t JOIN s ON t.file = s.file) AS t JOIN s ON t.file = s.file GROUP BY t.file),
        d AS (SELECT p.*, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM p)
        SELECT file, round((n * (s2 * sxxy - s3 * sxy) - s1 * (s1 * sxxy - s2 * sxy) + sy * (s1 * s3 - s2 * s2)) / nullif(det, 0) / 100, 8) AS a2, round(mx, 6) AS centre FROM d WHERE n > 3""",
    "mdl_ridge": """
        WITH s AS (SELECT file, count(*) AS n, avg(point_count) AS m1, avg(planarity) AS m2, avg(normal_angle) AS m3, avg(distance_to_ref) AS my, stddev_pop(point_count) AS d1, stddev_pop(planarity) AS d2, stddev_pop(normal_angle) AS d3 FROM {targets} GROUP BY file),
        z AS (SELECT t.file, (point_count - m1) / nullif(d1, 0) AS a, (planarity - m2) / nullif(d2, 0) AS b, (normal_angle - m3) / nullif(d3, 0) AS c, distance_to_ref - my AS y FROM {targets} AS t JOIN s ON t.file = s.file),
        g AS (SELECT file, sum(a * a) + 1.0 AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) + 1.0 AS bb, sum(b * c) AS bc, sum(c * c) + 1.0 AS cc, sum(a * y) AS ay, sum(b * y) AS bq, sum(c * y) AS cy FROM z GROUP BY file),
        d AS (SELECT g.*, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM g)
        SELECT file, round((ay * (bb * cc - bc * bc) - ab * (bq * cc - bc * cy) + ac * (bq * bc - bb * cy)) / det, 6) AS w_point_count, round((aa * (bq * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - bq * ac)) / det, 6) AS w_planarity,
          round((aa * (bb * cy - bq * bc) - ab * (ab * cy - bq * ac) + ay * (ab * bc - bb * ac)) / det, 6) AS w_normal_angle FROM d""",
    "mdl_metrics": """
        WITH f AS (SELECT file, regr_slope(distance_to_ref, point_count) AS k, regr_intercept(distance_to_ref, point_count) AS c, avg(distance_to_ref) AS m FROM {targets} GROUP BY file)
        SELECT t.file, round(1 - sum(power(distance_to_ref - k * point_count - c, 2)) / nullif(sum(power(distance_to_ref - m, 2)), 0), 6) AS linear_r2, round(sqrt(avg(power(distance_to_ref - k * point_count - c, 2))), 6) AS linear_rmse, round(avg(abs(distance_to_ref - k * point_count - c)), 6) AS linear_mae
        FROM {targets} AS t JOIN f ON t.file = f.file GROUP BY t.file""",
    "win_rank_desc": "SELECT file, reference_id, row_number() OVER (PARTITION BY file ORDER BY distance_to_ref DESC, reference_id) AS selection_rank FROM {targets}",
    "win_minmax_norm": "SELECT t.file, reference_id, round((distance_to_ref - lo) / (hi - lo + 1e-8), 6) AS norm FROM {targets} AS t JOIN (SELECT file, min(distance_to_ref) AS lo, max(distance_to_ref) AS hi FROM {targets} GROUP BY file) AS q ON t.file = q.file",
    # -- sequences within a group ----------------------------------------------------------------------------------
    "win_first_diff": "SELECT event_id, round(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value, 6) AS diff FROM {events}",
    "win_second_diff": "SELECT event_id, round(abs(lag(value) OVER w - 2 * value + lead(value) OVER w), 6) AS curvature FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "win_cumsum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS total FROM {events}",
    "win_gradient": """
        SELECT event_id, round(CASE WHEN p IS NULL THEN n - value WHEN n IS NULL THEN value - p ELSE (n - p) / 2 END, 6) AS gradient
        FROM (SELECT event_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) AS t""",
    "win_local_max": """
        SELECT event_id, value FROM (SELECT event_id, user_id, value, lag(value) OVER w AS p, lead(value) OVER w AS n FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) AS t JOIN (SELECT user_id AS u, 0.5 * stddev_pop(value) AS h FROM {events} GROUP BY user_id) AS s ON user_id = u
        WHERE p < value AND n < value AND value >= h""",
    "win_rolling_std": """
        SELECT event_id, round(coalesce(s, nxt, prv), 6) AS rolling_std FROM (SELECT event_id, s, first_value(s) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt, last_value(s) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv
        FROM (SELECT event_id, user_id, ts, CASE WHEN count(value) OVER w = 5 THEN stddev_samp(value) OVER w END AS s FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS t) AS u""",
    # -- registered regions ---------------------------------------------------------------------------------------
    "flt_fitness": "SELECT grid_id, round(fitness, 6) AS fitness FROM {regions} WHERE fitness >= 0.3",
    "flt_range_translation": "SELECT grid_id FROM {regions} WHERE tx >= -1000 AND tx < 1000 AND ty BETWEEN -1000 AND 1000 AND tz BETWEEN -1000 AND 1000",
    "fus_weights": "SELECT grid_id, round(w / t, 9) AS weight FROM (SELECT grid_id, 1 / nullif(n_corr * rmse * rmse, 0) AS w FROM {regions}) AS a CROSS JOIN (SELECT sum(1 / nullif(n_corr * rmse * rmse, 0)) AS t FROM {regions}) AS b",
    "agg_weighted_mean": "SELECT round(sum(w * fitness) / sum(w), 6) AS confidence, round(sum(w * composite_score) / sum(w), 6) AS composite_confidence FROM (SELECT fitness, composite_score, 1 / nullif(n_corr * rmse * rmse, 0) AS w FROM {regions}) AS t",
    "top_min_rmse": "SELECT grid_id, round(rmse, 6) AS rmse FROM {regions} ORDER BY rmse, grid_id LIMIT 1",
    "top_max_score": "SELECT grid_id, round(composite_score, 6) AS composite_score FROM {regions} ORDER BY composite_score DESC, grid_id LIMIT 1",
    "srt_score_desc": "SELECT grid_id, row_number() OVER (ORDER BY composite_score DESC, grid_id) AS place FROM {regions}",
    "jn_pairwise_self": "SELECT a.grid_id AS first, b.grid_id AS second, round(sqrt(power(a.tx - b.tx, 2) + power(a.ty - b.ty, 2) + power(a.tz - b.tz, 2)), 6) AS d FROM {regions} AS a CROSS JOIN {regions} AS b",
}

#: Which view each report reads is written in its text; grouped here for callers that want them all.
def inputs(name: str) -> list[str]:
    return [v for v in ("points", "targets", "events", "regions") if "{" + v + "}" in REPORTS[name]]


#: Reports whose quantiles of points are counted out by ``statistics.quantiles_by``: ``percentile`` would gather a count
#: for every distinct value in one task. By report, the columns under the names they have in its text.
QUANTILES: dict[str, tuple[tuple[str, str, tuple[float, ...]], ...]] = {
    "agg_describe_intensity": (("v", "intensity", (0.25, 0.5, 0.75)),),
    "flt_percentile_cut": (("intensity", "intensity", (0.9,)),),
    "out_iqr": (("intensity", "intensity", (0.25, 0.75)), ("x", "x", (0.25, 0.75))),
    "out_combined": (("intensity", "intensity", (0.9,)), ("x", "x", (0.95,))),
}


def with_quantiles(name: str, text: str, points: DataFrame) -> str:
    """``text`` with numbers in place of its quantiles, as aggregates still, so that a row comes of them."""
    found = quantiles_by(points, {column: list(shares) for _, column, shares in QUANTILES[name]})
    for called, column, shares in QUANTILES[name]:
        for share, value in zip(shares, found.get((None, column), [None] * len(shares)), strict=True):
            text = text.replace(f"percentile({called}, {share})", "max(CAST(NULL AS DOUBLE))" if value is None else f"max(double('{value!r}'))")
    return text


def median_mad(points: DataFrame) -> DataFrame:
    """(strip, median, mad) of the intensities of each strip."""
    rows = points.where("strip IS NOT NULL").select("strip", F.col("intensity").cast("double").alias("v"))
    medians = {s: m for (s, _), (m,) in quantiles_by(rows, {"v": [0.5]}, "strip").items()}
    middle = rows.sparkSession.createDataFrame(list(medians.items()), "strip string, m double")
    off = rows.join(F.broadcast(middle), "strip").select("strip", F.abs(F.col("v") - F.col("m")).alias("off"))
    mads = {s: m for (s, _), (m,) in quantiles_by(off, {"off": [0.5]}, "strip").items()}
    # a strip without an intensity has a row all the same
    strips = rows.groupBy("strip").agg(F.lit(1)).select("strip")
    both = rows.sparkSession.createDataFrame([(s, m, mads.get(s)) for s, m in medians.items()], "strip string, m double, d double")
    return strips.join(F.broadcast(both), "strip", "left").select("strip", F.round("m", 6).alias("median"), F.round("d", 6).alias("mad"))


def report(name: str, **views: DataFrame) -> DataFrame:
    """Run one report over the given views."""
    if name == "agg_median_mad":
        return median_mad(views["points"])
    spark = next(iter(views.values())).sparkSession
    text = with_quantiles(name, REPORTS[name], views["points"]) if name in QUANTILES else REPORTS[name]
    return spark.sql(text, **{v: views[v] for v in inputs(name)})
