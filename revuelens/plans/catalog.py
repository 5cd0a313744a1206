"""All registered queries: name -> Spark function and, where there is one, SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revuelens.plans.oracle import with_ctes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Fractions to six places, so engines that add in another order agree."""
    return df.select(
        *[
            F.round(F.col(f.name).cast("double"), 6).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; ``uses`` names the SQL fixtures its oracle builds on."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf: rounded(function(spark, sf))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *uses)
        return function

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from revuelens.plans import (  # noqa: F401  (registers on import)
        queries_models,
        queries_prepare,
        queries_profile,
        queries_sources,
        queries_text,
        queries_vectors,
    )

    return QUERIES, ORACLES
