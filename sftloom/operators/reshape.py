"""Record shapes: flat rows, chat messages and ShareGPT conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftloom.functions import text as T

FORMATS = ("alpaca", "chatml", "sharegpt")
SHAREGPT = {"system": "system", "user": "human", "assistant": "gpt"}
MESSAGES = "array<struct<role:string,content:string>>"


def map_fields(df: DataFrame, field_map: dict[str, str], replace: bool = True) -> DataFrame:
    """Source to canonical names: ``replace`` drops what is not mapped, else the mapped fields are added or overwritten."""
    mapped = {new: F.coalesce(F.col(f"`{old}`").cast("string"), F.lit("")) if old in df.columns else F.lit("") for old, new in field_map.items()}
    if replace:
        return df.select(*[c for c in df.columns if c.startswith("_")], *[v.alias(k) for k, v in mapped.items()])
    return df.withColumns({new: F.col(f"`{old}`") for old, new in field_map.items() if old in df.columns})


def with_output(df: DataFrame) -> DataFrame:
    """output, or response where output is missing or empty."""
    have = [F.nullif(F.col(c), F.lit("")) for c in ("output", "response") if c in df.columns]
    return df.withColumn("output", F.coalesce(*have, F.lit("")))


def of_role(messages: Column, role: str) -> Column:
    return F.transform(F.filter(messages, lambda m: m["role"] == role), lambda m: F.coalesce(m["content"], F.lit("")))


def from_sharegpt(conversations: Column) -> Column:
    """Messages of ShareGPT turns."""
    role = F.create_map(*[F.lit(x) for a, b in SHAREGPT.items() for x in (b, a)])
    return F.transform(conversations, lambda c: F.struct(F.coalesce(role[c["from"]], c["from"]).alias("role"), c["value"].alias("content")))


def collect_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row of messages, in order, for each conversation of a table of turns."""
    turn = F.struct(F.col(order), "role", F.col("text").alias("content"))
    got = turns.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("m"))
    return got.select(key, F.transform("m", lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def normalize_messages(df: DataFrame, messages: str = "messages") -> DataFrame:
    """instruction, output and system of each conversation: parts joined by newlines, the last system message wins; nothing to say, no row."""
    m = F.col(messages)
    out = df.withColumns({"instruction": F.array_join(of_role(m, "user"), "\n"), "output": F.array_join(of_role(m, "assistant"), "\n"), "system": F.coalesce(F.get(F.reverse(of_role(m, "system")), F.lit(0)), F.lit(""))})
    return out.where((F.length("instruction") > 0) | (F.length("output") > 0))


def tool_call_text(calls: Column) -> Column:
    """Names and arguments of an assistant's tool calls."""
    return F.array_join(F.transform(calls, lambda c: F.concat_ws(" ", c["function"]["name"], c["function"]["arguments"])), "\n")


def dedup_text(df: DataFrame) -> Column:
    """What duplicates are judged by: the messages' contents, else instruction and output."""
    flat = F.concat_ws(" ", "instruction", "output")
    if "messages" not in df.columns:
        return flat
    many = F.size(F.coalesce("messages", F.array().cast(df.schema["messages"].dataType))) > 0
    return F.when(many, F.array_join(F.transform("messages", lambda m: F.coalesce(m["content"], F.lit(""))), " ")).otherwise(flat)


def validator_texts(messages: Column) -> tuple[Column, Column]:
    """Instruction and output that a conversation is validated by."""
    return F.array_join(of_role(messages, "user"), " "), F.array_join(of_role(messages, "assistant"), " ")


def transcript(messages: Column) -> Column:
    """Lines of [role]: content."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]: "), F.coalesce(m["content"], F.lit("")))), "\n")


def seed_pair(messages: Column) -> tuple[Column, Column]:
    """First user and first assistant message."""
    return F.get(of_role(messages, "user"), F.lit(0)), F.get(of_role(messages, "assistant"), F.lit(0))


def public_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: ~k.startswith("_"))


def rebuild_messages(df: DataFrame, key: str = "_ord") -> DataFrame:
    """Messages with normalised contents, other fields kept; normalisation runs over exploded rows, since it is a UDF in part."""
    turns = df.select(key, F.posexplode("messages").alias("at", "m")).withColumn("content", T.normalize_text(F.col("m")["content"]))
    back = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("m").withField("content", F.col("content")).alias("m")))).alias("r"))
    return df.drop("messages").join(back.select(key, F.transform("r", lambda r: r["m"]).alias("messages")), key, "left")


def format_records(df: DataFrame, kind: str = "alpaca") -> DataFrame:
    """A struct column ``record`` in the wanted format.

    Multi-turn rows (with messages) keep their messages in alpaca and chatml and become conversations in sharegpt, where
    unknown roles are left out; single-turn chatml and sharegpt carry no metadata.
    """
    if kind not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    none = F.lit(None).cast("string")
    empty = F.array().cast(MESSAGES)
    have = {c: F.col(c) if c in df.columns else none for c in ("instruction", "output", "system", "reasoning")}
    messages = F.coalesce(F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))), empty) if "messages" in df.columns else empty

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    single = F.array(message("user", have["instruction"]), message("assistant", have["output"]))
    single = F.when(F.length(have["system"]) > 0, F.concat(F.array(message("system", have["system"])), single)).otherwise(single)
    turns = F.when(F.size(messages) > 0, messages).otherwise(single)
    if kind == "chatml":
        return df.withColumn("record", F.struct(turns.alias("messages")))
    if kind == "sharegpt":
        names = F.create_map(*[F.lit(x) for pair in SHAREGPT.items() for x in pair])
        known = F.filter(turns, lambda m: m["role"].isin(*SHAREGPT))
        return df.withColumn("record", F.struct(F.transform(known, lambda m: F.struct(names[m["role"]].alias("from"), m["content"].alias("value"))).alias("conversations")))
    optional = [F.nullif(have[c], F.lit("")).alias(c) for c in ("system", "reasoning")]
    extra = [F.when(F.size(messages) > 0, messages).alias("messages"), *([F.col("metadata")] if "metadata" in df.columns else [])]
    return df.withColumn("record", F.struct(have["instruction"].alias("instruction"), have["output"].alias("output"), *optional, *extra))
