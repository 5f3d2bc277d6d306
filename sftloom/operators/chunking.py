"""Cutting documents into chunks by structure, optionally also where neighbours differ in meaning."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftloom.functions import windows

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
BLANK = re.compile(r"\n\s*\n+")
ENDS = ".!?;" + "。！？；"
SENTENCE = re.compile(rf"(?<=[{ENDS}])\s+")


@dataclass(frozen=True)
class Chunking:
    """Lengths in characters; ``threshold`` is the least cosine that joins neighbours in semantic mode."""

    mode: str = "structure"
    min_length: int = 200
    max_length: int = 1500
    threshold: float = 0.55
    batch: int = 32

    def __post_init__(self) -> None:
        if self.mode not in ("structure", "semantic"):
            raise ValueError("mode is structure or semantic")
        object.__setattr__(self, "min_length", max(1, int(self.min_length)))
        object.__setattr__(self, "max_length", max(self.min_length, int(self.max_length)))


def _slices(s: str, size: int) -> list[str]:
    return [s[i : i + size].strip() for i in range(0, len(s), size)]


def _joined(parts: list[str], glue: str, most: int) -> list[str]:
    """Neighbours put together while they fit."""
    out: list[str] = []
    open_ = False
    for p in parts:
        if len(p) > most:
            out += _slices(p, most)
            open_ = False
        elif open_ and len(out[-1]) + len(glue) + len(p) <= most:
            out[-1] += glue + p
        else:
            out.append(p)
            open_ = True
    return out


def segments(text: str, most: int) -> list[str]:
    """Blocks between blank lines; longer ones as packed sentences, or slices where there is one sentence."""
    out: list[str] = []
    for block in filter(None, (b.strip() for b in BLANK.split(text.strip()))):
        if len(block) <= most:
            out.append(block)
        else:
            out += _joined([s for s in (x.strip() for x in SENTENCE.split(block)) if s], " ", most)
    return [s for s in out if s]


def neighbour_cosines(vectors: Sequence[Sequence[float]]) -> list[float]:
    v = np.asarray(vectors, np.float32)
    size = np.linalg.norm(v, axis=1)
    return [float(v[i] @ v[i + 1] / (size[i] * size[i + 1])) if size[i] * size[i + 1] else 0.0 for i in range(len(v) - 1)]


def chunk(text: str | None, config: Chunking, embed: Embed | None = None) -> list[str]:
    parts = segments(text or "", config.max_length)
    if len(parts) < 2:
        return parts
    near = None
    if config.mode == "semantic":
        if embed is None:
            raise ValueError("semantic chunking needs an embedding function")
        vectors = [v for i in range(0, len(parts), config.batch) for v in embed(parts[i : i + config.batch])]
        if len(vectors) != len(parts):
            raise ValueError("the embedding function gave another number of vectors")
        near = neighbour_cosines(vectors)
    out = [parts[0]]
    for i, part in enumerate(parts[1:]):
        far = near is not None and len(out[-1]) >= config.min_length and near[i] < config.threshold
        if far or len(out[-1]) + 2 + len(part) > config.max_length:
            out.append(part)
        else:
            out[-1] += "\n\n" + part
    if len(out) > 1 and len(out[-1]) < config.min_length and len(out[-2]) + 2 + len(out[-1]) <= config.max_length:
        out[-2:] = ["\n\n".join(out[-2:])]
    return out


def chunk_arrays(texts: pa.Array, config: Chunking, embed: Embed | None = None) -> pa.Array:
    """Chunks of each text. They leave each slice as Arrow, so that Python's strings are those of one slice."""
    kind = pa.list_(pa.string())
    return pa.concat_arrays([pa.array([chunk(t, config, embed) for t in part.to_pylist()], kind) for part in windows.slices(texts)] or [pa.array([], kind)])


def chunks_column(text: Column | str, config: Chunking = Chunking(), embed: Embed | None = None) -> Column:
    @F.arrow_udf("array<string>")
    def udf(texts: pa.Array) -> pa.Array:
        return chunk_arrays(texts, config, embed)

    return udf(text)


def chunk_documents(docs: DataFrame, config: Chunking = Chunking(), embed: Embed | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row for each chunk: id (with the chunk's number where there are several), source_id, chunk_index, chunk_count, text and all other columns."""
    cut = docs.withColumn("_chunks", chunks_column(F.col(text_col), config, embed)).withColumn("chunk_count", F.size("_chunks"))
    rows = cut.select("*", F.posexplode("_chunks").alias("chunk_index", "_text"))
    name = F.when(F.col("chunk_count") > 1, F.concat(F.col(id_col).cast("string"), F.lit(":chunk-"), F.col("chunk_index"))).otherwise(F.col(id_col).cast("string"))
    return rows.withColumn("source_id", F.col(id_col)).withColumn(id_col, name).withColumn(text_col, F.col("_text")).drop("_chunks", "_text")


def sentences(text: Column) -> Column:
    """Sentences as built-in expressions: cut after an end mark that white space follows."""
    return F.filter(F.transform(F.split(text, rf"(?<=[{ENDS}])\s+"), lambda s: F.trim(s)), lambda s: s != "")
