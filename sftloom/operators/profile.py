"""Dataset statistics: exact distributions by index, histograms, frequencies, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dedup

QUARTILES = {"p25": (1, 4), "p75": (3, 4), "p90": (9, 10), "p95": (95, 100)}


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, min, max, mean, median and percentiles at 0-based index n * a // b of the sorted values; nulls left out.

    Values are counted before anything is sorted, and the running counts are made in two steps (within ranges of values, and over
    the ranges' totals), so no task holds all values of a group.
    """
    keys = list(by)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    dedup.checkpoints(df.sparkSession)
    ranged = counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()).checkpoint()  # both uses see the same ranges
    within = Window.partitionBy(*keys, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("here", F.sum("c").over(within))
    totals = ranged.groupBy(*keys, "part").agg(F.sum("c").alias("t"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    whole = totals.groupBy(*keys).agg(F.sum("t").alias("n"))

    def match(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        if not on:
            return a.crossJoin(F.broadcast(b))  # one row
        renamed = b.select(*[F.col(k).alias(f"_{k}") for k in on], *[c for c in b.columns if c not in on])
        cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in on]
        return a.join(renamed, cond).drop(*[f"_{k}" for k in on])

    placed = match(match(running, offsets, [*keys, "part"]), whole, keys)
    last = F.col("before") + F.col("here") - 1
    first = last - F.col("c") + 1

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index <= last), F.col("v")))

    n = F.col("n")
    middle = (at(F.floor((n - 1) / 2)).cast("double") + at(F.floor(n / 2)).cast("double")) / 2
    parts = [at(F.least(n - 1, F.floor(n * a / b))).alias(name) for name, (a, b) in QUARTILES.items()]
    return placed.groupBy(*keys).agg(
        F.sum("c").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v").cast("double") * F.col("c")) / F.sum("c")).alias("mean"), middle.alias("median"), *parts
    )


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin, low, high and count of equal-width bins that are not empty.

    One bin for constant values; no more bins than distinct values; where the range is smaller than the number of bins,
    max(2, int(range) + 1) of them; the right edge belongs to the last bin.
    """
    v = F.col(value).cast("double")
    rows = df.where(F.col(value).isNotNull())
    counted = rows.groupBy(v.alias("v")).agg(F.count("*").alias("c"))
    edge = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count_distinct(F.round("v", 6)).alias("kinds"))
    spread = F.col("hi") - F.col("lo")
    count = F.least(F.lit(bins), F.col("kinds"))
    count = F.when(spread < count, F.least(count, F.greatest(F.lit(2), F.floor(spread) + 1))).otherwise(count).cast("int")
    edge = edge.withColumn("bins", F.when(spread == 0, 1).otherwise(F.greatest(F.lit(1), count))).withColumn("width", F.when(spread == 0, 1.0).otherwise(spread / F.col("bins")))
    placed = counted.crossJoin(F.broadcast(edge))  # one row
    bin_ = F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")).cast("int"), F.col("bins") - 1)
    out = placed.groupBy(bin_.alias("bin"), "lo", "width").agg(F.sum("c").alias("count"))
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "count")


def frequency(df: DataFrame, value: str, order: str = "_ord", top: int | None = None) -> DataFrame:
    """Values by descending count; ties keep the order in which they came first."""
    out = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("count"), F.min(order).alias("first"))
    out = out.orderBy(F.desc("count"), "first")
    return out.limit(top) if top else out


def plan_breakdown(plan: DataFrame) -> DataFrame:
    """Items of a plan by topic and sub-topic; missing ones have names in brackets."""
    topic = F.coalesce("topic", F.lit("(unknown)"))
    sub = F.coalesce(F.nullif("sub_topic", F.lit("")), F.lit("(unnamed)"))
    return plan.groupBy(topic.alias("topic"), sub.alias("sub_topic")).agg(F.count("*").alias("items"))


def format_counts(df: DataFrame) -> DataFrame:
    """Rows by shape, and empty fields."""
    many = F.size(F.coalesce("messages", F.array())) > 0 if "messages" in df.columns else F.lit(False)
    return df.agg(
        F.count("*").alias("total"), F.count_if(many).alias("multi_turn"), F.count_if(~many).alias("single_turn"),
        F.count_if(F.length(F.coalesce("instruction", F.lit(""))) == 0).alias("empty_instruction"), F.count_if(F.length(F.coalesce("output", F.lit(""))) == 0).alias("empty_output"),
    )


def repetition_summary(df: DataFrame, text: str = "output") -> DataFrame:
    """Greatest and mean repetition, and how many texts repeat much."""
    from sftloom.functions import text as T

    measured = df.select(T.word_repetition_ratio(text).alias("w"), T.char_repetition_ratio(text).alias("c"))
    return measured.agg(F.max("w").alias("max_word"), F.avg("w").alias("mean_word"), F.count_if(F.col("w") > 0.1).alias("high_word"), F.max("c").alias("max_char"), F.avg("c").alias("mean_char"), F.count_if(F.col("c") > 0.02).alias("high_char"))


def score_values(df: DataFrame, scores: str = "scores") -> DataFrame:
    """dimension and value of every score."""
    return df.select(F.explode(scores).alias("dimension", "value")).where("value is not null")


def score_distributions(df: DataFrame, scores: str = "scores") -> DataFrame:
    return distribution(score_values(df, scores), "value", ["dimension"])


def near_duplicate_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(F.count_if("near_duplicate").alias("near_duplicates"), (F.count_if("near_duplicate") / F.greatest(F.lit(1), F.count("*"))).alias("ratio"))


def preview(df: DataFrame, rows: int, order: str = "_ord", longest: int = 120) -> DataFrame:
    """The first rows, long strings cut."""
    head = df.orderBy(order).limit(rows)
    cut = [F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return head.select(*cut)


def retention(kept: int, dropped: int) -> float:
    return round(kept / (kept + dropped), 3) if kept + dropped else 0.0
