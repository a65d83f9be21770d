"""Small DataFrame combinators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def join_single_rows(*dfs: DataFrame) -> DataFrame:
    """Put several one-row results (global aggregates) side by side.

    Every input must be a global aggregate, i.e. exactly one row, and the
    column names must differ.  The rows are stacked (``unionByName`` with the
    other columns NULL) and folded with ``first(ignorenulls)``: no join, and
    the only exchange moves one row per input.
    """
    cols = [c for d in dfs for c in d.columns]
    if len(set(cols)) != len(cols):
        raise ValueError(f"duplicate columns in single-row inputs: {cols}")
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def scalar(df: DataFrame):
    """The single value of a one-row, one-column aggregate (an action; one number to the driver)."""
    row = df.first()
    return None if row is None else row[0]


#: types whose Python values Arrow takes as they are (not so times, which depend on a time zone)
PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.IntegralType, T.FractionalType)


def few_rows(spark: SparkSession, rows: Sequence, schema: T.StructType | str) -> DataFrame:
    """The driver's few ``rows`` as a frame, handed over by Arrow.

    ``createDataFrame`` converts a list in Python tasks: every executor then starts a second Python
    daemon with workers of its own, which stay beside those of ``mapInArrow``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = [f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType for f in schema]
    if not all(isinstance(k, PLAIN) for k in kinds):
        return spark.createDataFrame([tuple(r) for r in rows], schema)
    target = to_arrow_schema(schema)
    columns = [[bytes(r[i]) if isinstance(r[i], bytearray) else r[i] for r in rows] for i in range(len(schema))]
    return spark.createDataFrame(pa.Table.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target), schema)
