"""Registered queries, each an operator applied to the adapters' tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded to six places, as the oracle's are."""

    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            doubles = {c for c, k in df.dtypes if k in ("double", "float")}
            return df.select(*[(F.round(F.col(f"`{c}`").cast("double"), 6) + F.lit(0.0)).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return wrap
