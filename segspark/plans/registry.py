"""Query registry: name -> (Spark callable, DuckDB oracle SQL or None).

``q1_segment_cut``...). Every callable takes ``(spark, sf_dir)``, reads the
driver tables of that folder and returns a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``@register`` calls run."""
    from segspark.plans import (  # noqa: F401
        q_zones, q_serving, q_points, q_cuts, q_similarity, q_terrain_weather, q_recommend, q_status, q_stream,
        q_sources,
    )


def _in_utc(fn: QueryFn) -> QueryFn:
    """Wall-clock columns of the tables are UTC; time zones are bound when the plan is analysed."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from segspark.session import ensure_checkpoint_dir
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ensure_checkpoint_dir(spark)
        return fn(spark, sf_dir)
    run.__doc__, run.__name__ = fn.__doc__, fn.__name__
    return run


def queries() -> dict[str, QueryFn]:
    load_all()
    return {k: _in_utc(v) for k, v in QUERIES.items()}


def oracles() -> dict[str, str]:
    load_all()
    return dict(ORACLES)
