"""Reading JSON lines, JSON, Markdown, text and Parquet.

Every reader gives rows an ``_ord`` that follows the files' order (file name, then line), from 0 without gaps before any row is
left out: splits are counted once, and a row's number is its split's first number and its place in the split. JSON is read as variants, so one
malformed line is a row with ``raw`` null, which can be counted, and never fails a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sftloom.functions import text as T
from sftloom.operators import chunking
from sftloom.operators.reshape import from_sharegpt

MESSAGE = "struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>"
SUFFIXES = (".md", ".markdown", ".txt", ".jsonl", ".json")
FLAT = ("instruction", "output", "response", "system", "reasoning", "topic", "strategy")


def with_order(df: DataFrame) -> DataFrame:
    """Rows as they were just read, with _ord, _file and _line (from 1 in each file).

    Spark packs the splits of files by size, not by name, so their rows are counted by split first. One row for each split is
    put in order in one task; the rows themselves are not moved where these few are broadcast.
    """
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", before).withColumn("_start", F.min("_before").over(Window.partitionBy("_file"))).drop("_n")
    place = F.col("_before") + F.col("_at") - F.col("_first")
    placed = rows.join(splits, ["_file", "_block"]).withColumn("_ord", place).withColumn("_line", place - F.col("_start") + 1)
    return placed.select("_ord", "_line", "_file", *df.columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """_ord, value and raw (variant, null where the line is no JSON) of every line that is not blank."""
    lines = with_order(spark.read.text(path)).drop("_line", "_file").where(F.length(T.strip("value")) > 0)
    return lines.withColumn("raw", F.try_parse_json("value"))


def parse_errors(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("lines"), F.count_if(F.col("raw").isNull()).alias("parse_errors"))


def string_field(name: str, raw: str = "raw"):
    return F.try_variant_get(raw, f"$['{name}']", "string")


def read_samples(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """Samples of a JSONL file: flat fields, messages (of either chat format), scores and metadata; malformed lines left out."""
    rows = read_lines(spark, path).where("raw is not null")
    back = {new: old for old, new in (field_map or {}).items()}
    fields = {c: string_field(back.get(c, c)) if not field_map or c in back else F.lit(None).cast("string") for c in FLAT}
    messages = F.try_variant_get("raw", "$.messages", f"array<{MESSAGE}>")
    shared = from_sharegpt(F.try_variant_get("raw", "$.conversations", "array<struct<from:string,value:string>>"))
    shared = F.transform(shared, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), F.lit(None).cast("array<struct<function:struct<name:string,arguments:string>>>").alias("tool_calls")))
    scores = F.transform_values(F.try_variant_get("raw", "$.scores", "map<string,string>"), lambda _, v: v.try_cast("double"))
    out = rows.select("_ord", *[v.alias(k) for k, v in fields.items()], F.coalesce(messages, shared).alias("messages"), scores.alias("scores"), F.try_variant_get("raw", "$.total_score", "double").alias("total_score"), F.try_variant_get("raw", "$.metadata", "map<string,string>").alias("metadata"))
    output = F.coalesce(F.nullif("output", F.lit("")), "response", F.lit(""))
    return out.withColumns({"instruction": F.coalesce("instruction", F.lit("")), "output": output, "system": F.coalesce("system", F.lit(""))}).drop("response")


def scorable(samples: DataFrame) -> DataFrame:
    """Rows with both texts, or with two messages or more."""
    return samples.where(((F.length("instruction") > 0) & (F.length("output") > 0)) | (F.size(F.coalesce("messages", F.array())) >= 2))


def read_seeds(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> DataFrame:
    """Seeds: messages before instruction and output before instruction and response; others are left out."""
    rows = read_samples(spark, path, field_map)
    many = F.size(F.coalesce("messages", F.array())) > 0
    systems = F.filter("messages", lambda m: m["role"] == "system")
    return rows.where(many | ((F.length("instruction") > 0) & (F.length("output") > 0))).withColumn("system", F.when(many, F.coalesce(F.get(systems, F.lit(0))["content"], F.lit(""))).otherwise(F.col("system")))


def read_documents(spark: SparkSession, path: str, field_map: dict[str, str] | None = None, kind: str | None = None) -> DataFrame:
    """id, text (normalised), source, title, line_number, metadata and _ord of documents.

    ``kind``, else the name's end says how they are read; a folder is read by each file's own end. Documents without an id are named by
    their file's stem and line (or place in a JSON array), those without a title by the stem.
    """
    suffix = kind or ("." + path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else "")
    if not suffix:
        parts = [read_documents(spark, path, field_map, s) for s in SUFFIXES if _any(spark, f"{path}/*{s}")]
        if not parts:
            raise ValueError(f"no documents in {path}; they come as one of {SUFFIXES}")
        files = parts[0]
        for part in parts[1:]:
            files = files.unionByName(part)
        return _in_order(files)
    if suffix not in SUFFIXES:
        raise ValueError(f"documents come as one of {SUFFIXES}")
    stem = F.regexp_extract("_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    if "." not in path.rpartition("/")[2]:
        path = f"{path}/*{suffix}"
    back = {new: old for old, new in (field_map or {}).items()}
    if suffix in (".md", ".markdown", ".txt"):
        whole = with_order(spark.read.text(path, wholetext=True))
        return whole.select("_ord", stem.alias("id"), T.normalize_text("value").alias("text"), F.col("_file").alias("source"), stem.alias("title"), F.lit(1).cast("long").alias("line_number"), F.lit(None).cast("map<string,string>").alias("metadata"), F.col("_file").alias("source_path")).where(F.length("text") > 0)
    if suffix == ".jsonl":
        rows = with_order(spark.read.text(path)).where(F.length(T.strip("value")) > 0).select("_ord", "_line", "_file", F.try_parse_json("value").alias("item")).where("item is not null")
    else:
        files = with_order(spark.read.text(path, wholetext=True)).withColumn("raw", F.try_parse_json("value")).where("raw is not null")
        items = F.coalesce(F.try_variant_get("raw", "$", "array<variant>"), F.array("raw"))
        rows = files.select("_ord", "_file", F.posexplode(items).alias("_at", "item"))
        rows = rows.select(F.shiftleft("_ord", 32).bitwiseOR(F.col("_at").cast("long")).alias("_ord"), (F.col("_at") + 1).cast("long").alias("_line"), "_file", "item")

    def field(c: str):
        given = string_field(back.get(c, c), "item")
        return F.coalesce(given, string_field(c, "item")) if c in back else given

    label = F.concat(stem, F.lit("-"), F.col("_line").cast("string"))
    out = rows.select("_ord", F.coalesce(F.nullif(field("id"), F.lit("")), label).alias("id"), T.normalize_text(F.coalesce(field("text"), F.lit(""))).alias("text"), F.coalesce(field("source"), F.col("_file")).alias("source"), F.coalesce(field("title"), stem).alias("title"), F.col("_line").alias("line_number"), F.try_variant_get("item", "$.metadata", "map<string,string>").alias("metadata"), F.col("_file").alias("source_path"))
    return out.where(F.length("text") > 0)


def _any(spark: SparkSession, pattern: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def _in_order(docs: DataFrame) -> DataFrame:
    """Documents of several kinds of files by file and line: the rank of the file's path above the line's number."""
    ranks = docs.select("source_path").distinct().withColumn("_rank", F.row_number().over(Window.orderBy("source_path")))
    order = F.shiftleft(F.col("_rank").cast("long"), 40).bitwiseOR(F.col("line_number"))
    return docs.join(ranks, "source_path").withColumn("_ord", order).select(*docs.columns)


def load_document_chunks(spark: SparkSession, path: str, field_map: dict[str, str] | None = None, chunks: dict | None = None) -> DataFrame:
    """Documents of a file or folder, cut into chunks where ``chunks`` has ``enabled`` (its other keys are Chunking's fields, and ``embed``)."""
    docs = read_documents(spark, path, field_map)
    options = dict(chunks or {})
    if options.pop("enabled", False):
        embed = options.pop("embed", None)
        return chunking.chunk_documents(docs, chunking.Chunking(**options), embed)
    return docs.select("*", F.col("id").alias("source_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"))


def backtranslation_documents(docs: DataFrame, least: int = 50, most: int = 8000) -> DataFrame:
    """Documents of fitting length."""
    return docs.withColumn("text", T.strip("text")).where(F.length("text").between(least, most))


def read_table(spark: SparkSession, path: str, text: str = "text", key: str | None = None) -> DataFrame:
    """A Parquet table as samples' source: _ord from a key column, else by rows."""
    df = spark.read.parquet(path)
    return df.withColumn("_ord", F.col(key).cast("long")) if key else with_order(df).drop("_line", "_file")
