"""Rules and exact deduplication on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sftloom.functions import text as T
from sftloom.operators.quality import Rule, apply_rules


def read_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "json", **options: object) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).options(**options).load(path)


def filter_stream(rows: DataFrame, rules: Rule) -> DataFrame:
    """Rules have no state, so a stream is filtered like a table."""
    return apply_rules(rows, rules)


def dedup_stream(rows: DataFrame, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """One row of each fingerprint. With an event time, a fingerprint is forgotten ``delay`` after it, which bounds the state; without one all are remembered."""
    keyed = rows.withColumn("fingerprint", T.fingerprint("instruction", "output"))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["fingerprint"])
    return keyed.dropDuplicates(["fingerprint"])


def windowed_counts(rows: DataFrame, event_time: str, window: str = "5 minutes", delay: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Rows and mean value in each tumbling window; late rows count until the watermark passes."""
    return rows.withWatermark(event_time, delay).groupBy(F.window(event_time, window), by).agg(F.count("*").alias("n"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, kind: str = "parquet"):
    """Exactly-once file sink."""
    return rows.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
