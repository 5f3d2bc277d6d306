"""Judges' scores: rubrics, one judge, several judges, aggregation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGGREGATIONS = ("mean", "min", "max", "median")


@dataclass(frozen=True)
class Dimension:
    name: str
    label: str = ""
    max_score: int = 10
    rubric: tuple[str, ...] = ()


def default_rubric(max_score: int, lang: str = "en") -> tuple[str, ...]:
    """Four tiers from best to worst."""
    step = max_score // 4
    words = {"en": ("excellent", "good", "fair", "poor"), "zh": ("优秀", "良好", "一般", "较差")}[lang if lang in ("en", "zh") else "en"]
    tops = [max_score, max_score - step - 1 if step else max_score - 1, max_score - 2 * step - 1, max_score - 3 * step - 1] if step else [max_score, 1, 1, 1]
    lows = [max_score - step, max_score - 2 * step, max_score - 3 * step, 0] if step else [max_score, 0, 0, 0]
    return tuple(f"{max(a, b)}-{b}: {w}" for a, b, w in zip(tops, lows, words))


def total(scores: Column) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda s, x: s + x)


def with_scores(df: DataFrame, scores: Column) -> DataFrame:
    """scores and total_score; rows whose judge failed keep a null map and no total."""
    return df.withColumn("scores", scores).withColumn("total_score", total(F.col("scores")))


def aggregate_judges(judged: DataFrame, key: str = "_ord", how: str = "mean", min_judges: int = 1) -> DataFrame:
    """One row for each sample from rows (key, judge, scores map or null).

    A dimension is aggregated over the judges that gave it; total_score is the sum over dimensions, judge_disagreement the greatest range of
    a dimension. With fewer than ``min_judges`` answers the sample fails: no scores, a total of 0. Sums by dimension are folded before
    the shuffle; only the median needs the values of one sample together.
    """
    if how not in AGGREGATIONS:
        raise ValueError(f"aggregation must be one of {AGGREGATIONS}")
    answered = judged.groupBy(key).agg(F.count("scores").alias("judge_count"))
    merge = {"mean": F.avg, "min": F.min, "max": F.max, "median": F.median}[how]
    by_dimension = judged.select(key, F.explode("scores").alias("dimension", "value")).groupBy(key, "dimension").agg(merge("value").alias("value"), (F.max("value") - F.min("value")).alias("range"))
    entry = F.struct(F.col("dimension").alias("k"), F.col("value").cast("double").alias("v"))
    merged = by_dimension.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scores"), F.sum(F.col("value").cast("double")).alias("total_score"), F.max("range").alias("judge_disagreement"))
    failed = F.col("judge_count") < max(1, min_judges)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return answered.join(merged, key, "left").select(
        key, F.when(failed, none).otherwise(F.coalesce("scores", none)).alias("scores"), F.when(failed, 0.0).otherwise(F.coalesce("total_score", F.lit(0.0))).alias("total_score"),
        "judge_count", F.when(failed, 0.0).otherwise(F.coalesce("judge_disagreement", F.lit(0.0))).alias("judge_disagreement"), failed.alias("cross_validation_failed"),
    )


def judge_scores(judged: DataFrame, key: str = "_ord") -> DataFrame:
    """Map of judge to scores for each sample, for the record."""
    entry = F.struct(F.col("judge").alias("k"), F.col("scores").alias("v"))
    return judged.where("scores is not null").groupBy(key).agg(F.map_from_entries(F.collect_list(entry)).alias("judge_scores"))
