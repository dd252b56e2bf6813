"""Small helpers over DataFrames."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations"
_NAMED = re.compile(rf"\{{({TABLES})\}}")


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query in SQL that both engines read, with {table} for the tables of sf_dir."""

    def view(m: re.Match) -> str:
        name = f"{m[1]}_{hashlib.md5(sf_dir.encode()).hexdigest()[:12]}"
        table(spark, sf_dir, m[1]).createOrReplaceTempView(name)
        return name

    return spark.sql(_NAMED.sub(view, sql))


def plain(sql: str) -> str:
    """The same query for views with the tables' names."""
    return _NAMED.sub(r"\1", sql)


def small(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows (counted); otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
