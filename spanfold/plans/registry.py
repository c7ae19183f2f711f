"""Query registry: ``name -> (spark builder, oracle SQL or None)``.

Every registered builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables. Output columns are normalised for the oracle comparison: integral
types become ``long``, booleans ``int``, floating types ``double`` rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int").cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, bigint: tuple[str, ...] = ()):
    """``bigint`` names oracle columns DuckDB types as INTEGER (0/1 flags from CASE): they are
    cast to BIGINT so both sides have the same types."""
    if sql is not None and bigint:
        casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in bigint)
        sql = f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) _oracle"

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finalize(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn

    return deco
