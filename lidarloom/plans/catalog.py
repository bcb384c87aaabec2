"""Every registered query and its SQL twin. Queries of the report layer share their text with the twin up to dialect;
the operators below have twins written on their own."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from lidarloom.operators import report
from lidarloom.plans import flow_queries, fusion_queries, strip_queries, target_queries
from lidarloom.plans.views import SQL_VIEWS, frames, with_views


#: Operators that another query computes whole: the columns of it that answer them (none: all).
PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "agg_cell_counts": ("prj_grid_id", ()),
    "agg_mi": ("agg_entropy", ("strip", "grid_id", "mutual_information")),
    "agg_nmi": ("agg_entropy", ("strip", "grid_id", "normalized_mutual_information")),
    "agg_entropy_norm": ("agg_entropy", ("strip", "grid_id", "z_entropy_norm", "intensity_entropy_norm")),
    "sel_elbow": ("sel_sizes", ("n", "k_elbow")),
    "sel_threshold": ("sel_sizes", ("n", "k_threshold")),
    "sel_gap": ("sel_sizes", ("n", "k_gap")),
    "sel_topk_dynamic": ("select_regions", ()),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strip_queries.select_regions(spark, sf_dir)


#: Reports whose rows are pairs of small inputs: these are dealt to a fixed number of partitions, as adaptive execution
#: would put either into one, and all pairs into one task.
DEALT = ("jn_pairwise_self",)


def _report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    given = frames(spark, sf_dir, report.inputs(name))
    if name in DEALT:
        given = {k: v.repartition(2 * spark.sparkContext.defaultParallelism) for k, v in given.items()}
    return report.report(name, **given)


def duck(text: str) -> str:
    """A report's text in DuckDB's dialect."""
    for view in SQL_VIEWS:
        text = text.replace("{" + view + "}", view)
    return text.replace("percentile(", "quantile_cont(").replace("first_value(s) IGNORE NULLS", "first_value(s IGNORE NULLS)").replace("last_value(s) IGNORE NULLS", "last_value(s IGNORE NULLS)")


def _part(query: Callable[[SparkSession, str], DataFrame], columns: tuple[str, ...], spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query(spark, sf_dir)
    return found.select(*columns) if columns else found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: partial(_report, name) for name in report.REPORTS}
    found |= strip_queries.queries() | fusion_queries.queries() | target_queries.queries() | flow_queries.queries()
    return found | {name: partial(_part, found[whole], columns) for name, (whole, columns) in PARTS.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: with_views(duck(text), report.inputs(name)) for name, text in report.REPORTS.items()}
    found |= strip_queries.oracle_sql() | fusion_queries.oracle_sql() | target_queries.oracle_sql() | flow_queries.oracle_sql()
    return found | {name: f"SELECT {', '.join(columns) or '*'} FROM ({found[whole]}) AS whole" for name, (whole, columns) in PARTS.items() if whole in found}
