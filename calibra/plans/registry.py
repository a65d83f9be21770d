"""Registry of named queries and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` over the test tables
(or views Spark derives from them).  ``sql`` is the equivalent SQL on the same
tables; it is written next to the query so the two stay in step.  Float
columns are rounded to 6 decimals on both sides (``round_cols``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: Sequence[str] | str = (),
          exact: Sequence[str] | str = ()):
    """Register ``fn`` under ``name``; ``rounded`` lists SQL columns to round,
    ``exact`` lists float columns compared unrounded (computed exactly on both sides)."""
    if isinstance(rounded, str):
        rounded = rounded.split()
    if isinstance(exact, str):
        exact = exact.split()

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), skip=exact)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = round_sql(sql, rounded)
        return run

    return deco


def round_doubles(df: DataFrame, digits: int = 6, skip: Sequence[str] = ()) -> DataFrame:
    """Round every top-level float column (stable cross-engine comparison)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)) and f.name not in skip:
            out.append(F.round(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def round_sql(sql: str, cols: Sequence[str], digits: int = 6) -> str:
    sql = sql.strip().rstrip(";")
    if not cols:
        return sql
    rep = ", ".join(f"round({c}::DOUBLE, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS _q"
