"""The library's functions under SQL names."""

from __future__ import annotations

import string

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import minhash, text


def _python(fn, kind: str):
    @F.pandas_udf(kind)
    def udf(column: pd.Series) -> pd.Series:
        return column.map(fn)

    return udf


_PLAIN = set(string.ascii_letters + string.digits + string.punctuation)


def _special(s: str | None) -> float:
    odd = sum(not (c in _PLAIN or c.isspace() or "\u4e00" <= c <= "\u9fff" or "\u3400" <= c <= "\u4dbf") for c in s or "")
    return odd / len(s) if s else 0.0


def _runs(s: str) -> int:
    best = now = 0
    before = None
    for c in s:
        now = now + 1 if c == before else 1
        best, before = max(best, now), c
    return best


def _diversity(s: str | None, n: int = 3) -> float:
    t = (s or "").strip().lower()
    grams = [t[i : i + n] for i in range(len(t) - n + 1)]
    return len(set(grams)) / len(grams) if grams else 1.0


def _word_repetition(s: str | None, window: int = 5) -> float:
    w = (s or "").lower().split()
    grams = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
    return 1 - len(set(grams)) / len(grams) if grams else 0.0


def register(spark: SparkSession) -> list[str]:
    """Register SQL functions; returns their names. The Column functions in this package are faster."""
    udfs = {
        "nfkc": text.nfkc,
        "copied_ratio": text.copied_ratio,
        "special_char_ratio": _python(_special, "double"),
        "word_repetition_ratio": _python(_word_repetition, "double"),
        "char_repetition_ratio": _python(lambda s: _runs(s or "") / len(s) if s and _runs(s) >= 5 else 0.0, "double"),
        "ngram_diversity": _python(_diversity, "double"),
        "minhash_signature": _python(lambda t: minhash.signatures([minhash.tokens(t)], 128, 42)[0], "array<long>"),
    }
    for name, udf in udfs.items():
        spark.udf.register(name, udf)
    return sorted(udfs)
