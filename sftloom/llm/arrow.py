"""Arrow helpers that the operators of this subpackage share.

Every operator has a function over an iterator of record batches; ``run`` chains several of them in
one Python pass, so that texts cross the border between JVM and Python once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]
Step = Callable[[Batches], Batches]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(df: DataFrame, schema: str, *steps: Step) -> DataFrame:
    """Apply ``steps`` one after the other to the batches of each partition."""

    def chained(batches: Batches) -> Batches:
        for step in steps:
            batches = step(batches)
        return batches

    return df.mapInArrow(chained, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and offsets (int64, one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def strings(raw: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A string array over bytes and offsets, without a copy of the bytes."""
    if len(raw) < 2**31:
        return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def pieces(column: pa.Array, most: int = 512 << 10) -> Iterator[pa.Array]:
    """Slices of a column with about so many bytes, for bounded temporary arrays; a text is never cut."""
    raw, ends = utf8(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield column.slice(at, to - at)
        at = to


def sliced(most: int, column: str = "text") -> Step:
    """Cut batches into ones with about so many bytes of text, for bounded temporary arrays."""

    def step(batches: Batches) -> Batches:
        for batch in batches:
            at = 0
            for part in pieces(batch.column(column).fill_null(""), most):
                yield batch.slice(at, len(part))
                at += len(part)

    return step


def filtered(df: DataFrame, keep: Callable[[pa.Array], np.ndarray], most: int = 512 << 10) -> DataFrame:
    """Rows of ``df``, with all their columns, whose text ``keep`` says to keep; texts pass in slices of about ``most`` bytes."""

    def step(batches: Batches) -> Batches:
        for batch in batches:
            good = [keep(part) for part in pieces(batch.column("text").fill_null(""), most)]
            if good:
                yield batch.filter(pa.array(np.concatenate(good)))

    return df.mapInArrow(step, df.schema)


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, the same ones for the same data: those whose key hashes lowest."""
    return df.orderBy(F.xxhash64(key), key).limit(rows)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, set to one of our own only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, path: str, *by: str) -> None:
    """Write a table, and let go of the shuffle files of its own plan at once; a lost executor costs a rerun of this plan only while it runs."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        conf.set(key, before)


class Store:
    """Tables written one after the other in a folder of their own that the executors share."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.count = spark, 0
        self.folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        written(df, path)
        return self.spark.read.schema(df.schema).parquet(path)


def data_path(name: str) -> str:
    """The tokenizers' public vocabulary files."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
