"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Tables of texts, on whose rows rules and parsers spend their time.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; of texts, one small file is dealt to all cores, as a row group is read by one task only.

    Tables of many files or many splits are left as they are: no shuffle is added at scale.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in TEXTS and df.rdd.getNumPartitions() <= cores and len(df.inputFiles()) == 1:  # names are listed for small tables only
        return df.repartition(cores)
    return df
