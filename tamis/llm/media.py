"""Media columns: texts kept as lossless WebP images of 8-bit samples, read back and described.

A payload is the text's UTF-8 with spaces added up to a positive multiple of 192; it becomes the green samples
of an image 192 wide, or of several frames of ROWS rows in one file where it is longer, so a text of any length
is held in memory as such a few times over, and one frame as working space. The stored bytes are then decoded
into pixels; the payload, its length and all features come from those pixels alone. Null is the empty text: one
row of spaces. Equal texts have equal files.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp
from .common import small_batches, table

UNIT, ROWS = 192, 2048


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def store(payload: bytes) -> bytes:
    return webp.encode_gray(payload, UNIT, ROWS)


def read_back(stored: bytes) -> np.ndarray:
    parts = [(image >> np.uint32(8)).astype(np.uint8).ravel() for image in webp.frames(stored)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def feature(samples: np.ndarray) -> str:
    """Average hash over 64 equal parts, mean sample, number of different samples."""
    edges = np.arange(64) * len(samples) // 64
    means = np.add.reduceat(samples, edges, dtype=np.int64) / np.diff(edges, append=len(samples))
    mean = float(samples.mean())
    return f"{np.packbits(means > mean).tobytes().hex()}:{mean:.3f}:{np.count_nonzero(np.bincount(samples, minlength=256))}"


def describe(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: bool = True) -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) and, with keep, media binary."""
    small_batches(docs.sparkSession)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep

    def run(batches):
        for batch in batches:
            rows, media = [], []
            for s in batch.column(1):
                n, payload = payload_of(s.as_py())
                stored = store(payload)
                back = read_back(stored)
                raw = back.tobytes()
                rows.append((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back)))
                if keep:
                    media.append(stored)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns] + [pa.array(media, pa.binary())] * keep, names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep)

    return docs.select(key, text).mapInArrow(run, schema)


def op3_media_columns(spark, sf_dir):
    return describe(table(spark, sf_dir, "documents"), keep=False)


QUERIES = {"op3_media_columns": op3_media_columns}
SQL: dict[str, str] = {}
