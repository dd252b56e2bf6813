"""Archives of advisories, and the sinks of bundles and verdict caches."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import cache_evict, cache_latest


def osv_zip(spark: SparkSession, path: str) -> DataFrame:
    """(ecosystem, name, version, id, withdrawn) of the MAL- advisories in ZIP archives; other members aren't unpacked."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if not name.rpartition("/")[2].startswith("MAL-"):
                            continue
                        a = json.loads(z.read(name))
                        for x in a.get("affected", []):
                            p = x.get("package", {})
                            rows += [(p.get("ecosystem"), p.get("name"), v, a["id"], bool(a.get("withdrawn"))) for v in x.get("versions") or [None]]
            kinds = (pa.string(),) * 4 + (pa.bool_(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["ecosystem", "name", "version", "id", "withdrawn"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("content").mapInArrow(run, "ecosystem string, name string, version string, id string, withdrawn boolean")


def bundle_bytes(bundle: dict) -> bytes:
    """A bundle's bytes: equal contents give equal bytes."""
    return (json.dumps(bundle, sort_keys=True, ensure_ascii=False, separators=(",", ":")) + "\n").encode()


def next_version(today: str, last: str | None) -> str:
    """The date, with a number after it where that day has a version already."""
    if not last or not (last == today or last.startswith(f"{today}.")):
        return today
    return f"{today}.{int(last.rpartition('.')[2]) + 1 if last != today else 1}"


def read_cache(spark: SparkSession, path: str, version: str | None) -> DataFrame:
    schema = "key string, verdict string, at timestamp"
    return spark.read.schema(schema).parquet(f"{path}/{version}") if version else spark.createDataFrame([], schema)


def upsert_cache(updates: DataFrame, path: str, version: str | None, most: int = 2000) -> str:
    """A new version of the cache at path with updates(key, verdict, at), the oldest entries beyond `most` left out.

    Readers of the version before are not disturbed; the new version's name is returned. Suits foreachBatch.
    """
    spark = updates.sparkSession
    both = read_cache(spark, path, version).withColumn("id", F.lit(0)).unionByName(updates.select("key", "verdict", "at").withColumn("id", F.lit(1)))
    new = uuid.uuid4().hex
    cache_evict(cache_latest(both), most).write.parquet(f"{path}/{new}")
    return new
