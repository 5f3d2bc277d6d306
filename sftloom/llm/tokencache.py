"""Token counts through a digest cache.

The cache is a Parquet folder with one row (digest, n_tokens) for each content, below one folder for
each tokenizer version. A run

1. digests each normalised text in the JVM and keeps one text for each digest. Copies within a task are
   folded before the shuffle, so that a text that a third of all rows hold moves once per task;
2. leaves out the digests that the cache has. Where they are all but a bounded number, the missing
   digests are broadcast to the scan (``SMALL`` digests at most, counted first), and only their texts
   move; otherwise the texts move and are held against the cache in the same partitions;
3. encodes the distinct misses in Arrow batches and appends their counts to the cache;
4. joins the counts to the rows' digests, without the texts. A hot digest is a skewed key of that join
   on the rows' side alone, which adaptive execution splits.

Normalisation must not change a count. White space at the ends is cut where the tokenizer's version
says that it drops white space, and null counts as empty.

Cases: null and empty texts share a digest and have 0 tokens; repeated rows are kept; an empty table
gives no rows and leaves the cache as it was; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import Batches, data_path, run, shared_dir
from .fasttok import word_tokenizer

SMALL = 200_000
SPACE = " \t\n\r\x0b\x0c"
COUNTS = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        content = hashlib.sha256(f.read())
    content.update((sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__).encode())
    return content.hexdigest()[:32]


def drops_white_space(path: str) -> bool:
    return path.endswith(".json") and word_tokenizer(path).fast


def normalised(path: str) -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.trim(text, F.lit(SPACE)) if drops_white_space(path) else text


def count_batches(path: str):
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("content")
            if path.endswith(".model"):
                from .pieces import piece_model

                n = piece_model(path).encode(text)[1]
            else:
                n = word_tokenizer(path).count(text)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return step


def read_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(COUNTS).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str, path: str | None = None, limit: int = 2048, small: int = SMALL) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; misses are appended to the cache."""
    spark = docs.sparkSession
    path = path or data_path("word_bpe_49k.json")
    folder = f"{cache}/tokenizer={tokenizer_version(path)}"
    content = normalised(path)
    keyed = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))
    texts = docs.select(content.alias("content")).select(F.unhex(F.sha2("content", 256)).alias("digest"), "content")
    known = read_cache(spark, folder)
    if known is not None:
        missing = keyed.select("digest").distinct().join(known, "digest", "left_anti")
        if len(missing.limit(small + 1).take(small + 1)) <= small:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    misses = texts.groupBy("digest").agg(F.first("content").alias("content"))
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    run(misses, COUNTS, count_batches(path)).write.mode("append").parquet(folder)
    counts = read_cache(spark, folder)
    return keyed.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
