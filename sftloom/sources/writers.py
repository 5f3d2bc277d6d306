"""Writing JSON lines, reports and Parquet."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sftloom.operators.reshape import format_records


def write_jsonl(df: DataFrame, path: str, kind: str = "alpaca", mode: str = "error", ordered: bool = False) -> None:
    """One JSON object a line, fields without a value left out. ``ordered`` sorts all rows by _ord over the files."""
    rows = format_records(df, kind)
    rows = rows.orderBy("_ord") if ordered and "_ord" in df.columns else rows
    rows.select(F.to_json("record").alias("value")).write.mode(mode).text(path)


def append_jsonl(df: DataFrame, path: str, kind: str = "alpaca", count_path: str | None = None) -> None:
    """Append rows; with ``count_path``, a JSON file there counts all rows appended so far (counted while they are written)."""
    if count_path is None:
        write_jsonl(df, path, kind, "append")
        return
    seen = Observation()
    write_jsonl(df.observe(seen, F.count(F.lit(1)).alias("n")), path, kind, "append")
    before = json.loads(Path(count_path).read_text("utf-8"))["count"] if os.path.exists(count_path) else 0
    save_report({"count": before + seen.get["n"]}, count_path)


def write_cleaned(df: DataFrame, path: str, mode: str = "error") -> None:
    """Cleaned rows with the fields that they have; helper columns stay out."""
    fields = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" and c not in ("instruction", "output") else F.col(c) for c, t in df.dtypes if not c.startswith("_")]
    df.select(F.to_json(F.struct(*fields)).alias("value")).write.mode(mode).text(path)


def derived_path(path: str, suffix: str) -> str:
    """The path with a suffix before its end; a path that has it stays as it is."""
    stem, _, _ = path.rpartition(".jsonl")
    return path if path.endswith(f"_{suffix}.jsonl") else f"{stem or path}_{suffix}.jsonl"


def scored_path(path: str) -> str:
    return derived_path(path, "scored")


def report_path(path: str) -> str:
    stem, dot, _ = path.rpartition(".jsonl")
    return f"{stem or path}_report.json"


def save_report(report: dict, path: str) -> None:
    """A report is a few numbers; the driver writes it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False), "utf-8")


class MemoryWriter:
    """A DataFrame held for later stages."""

    def __init__(self) -> None:
        self.frames: list[DataFrame] = []

    def write(self, df: DataFrame) -> None:
        self.frames.append(df)

    def result(self) -> DataFrame | None:
        out = None
        for df in self.frames:
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return out
