"""Samples out of model replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftloom.functions import json as J
from sftloom.functions import text as T

MESSAGES = "array<struct<role:string,content:string>>"


def _field(item: Column, name: str) -> Column:
    return T.strip(F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit("")))


def explode_items(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """One row for each object of a reply; replies without JSON give none."""
    return replies.select("*", F.posexplode(J.items(reply)).alias("item_no", "item")).where("item is not null").drop(reply)


def parse_samples(replies: DataFrame) -> DataFrame:
    """instruction, output, reasoning, system and messages; messages come before flat fields, blank instructions are left out."""
    rows = explode_items(replies)
    item = F.col("item")
    messages = F.filter(F.try_variant_get(item, "$.messages", MESSAGES), lambda m: m["role"].isNotNull())
    out = rows.withColumns({c: _field(item, c) for c in ("instruction", "output", "reasoning", "system")}).withColumn("messages", messages)
    out = out.drop("item")
    return out.where((F.size(F.coalesce("messages", F.array().cast(MESSAGES))) > 0) | (F.length("instruction") > 0))


def parse_backtranslation(replies: DataFrame, source: str = "text") -> DataFrame:
    """The reply's instruction with the source as its output, whatever the model says besides."""
    rows = explode_items(replies).where(F.length(T.strip(source)) > 0)
    item = F.col("item")
    out = rows.withColumns({"instruction": _field(item, "instruction"), "output": T.strip(source), "task_type": T.task_type(_field(item, "task_type"))})
    return out.drop("item").where(F.length("instruction") > 0)


def parse_document_qa(replies: DataFrame) -> DataFrame:
    item = F.col("item")
    out = explode_items(replies).withColumns({"instruction": _field(item, "instruction"), "output": _field(item, "output"), "task_type": T.task_type(_field(item, "task_type"))})
    return out.drop("item").where(F.length("instruction") > 0)


def parse_plan(replies: DataFrame, dimensions: dict[str, list[str]]) -> DataFrame:
    """sub_topic, angle and dimensions of each planned item; a missing dimension takes its first value."""
    item = F.col("item")
    dims = {d: F.coalesce(F.nullif(_field(item, d), F.lit("")), F.lit(values[0] if values else "")) for d, values in dimensions.items()}
    return explode_items(replies).withColumns({"sub_topic": _field(item, "sub_topic"), "angle": _field(item, "angle"), **dims}).drop("item")
