"""Text measures and normalisation as Spark columns.

Everything but Unicode normalisation, the repetition measures (``windows``, Arrow batches) and the copied-ratio measure is
built from JVM expressions. Lengths count code points. White space is what Python's ``str.split`` splits on.
"""

from __future__ import annotations

import difflib
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from . import windows

SPACE = r"[\s\x1c-\x1f]"
JOINER = "\x01"
QUOTES = ('"', "'", "“", "”", "‘", "’")
REFUSALS = tuple("as an ai|i am not able|i can't|i cannot|i'm not able|not possible|sorry|unable to".split("|"))
TASK_TYPES = tuple("analysis comparison explanation how_to other qa writing".split())
_HAN = "一-鿿㐀-䶿"
_PLAIN = "".join(f"\\{c}" for c in string.punctuation)
_INVISIBLE = [0xAD, 0x200B, 0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), 0xFEFF, 0xFFFD]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; an expression that a lambda uses would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Both ends without white space."""
    return F.regexp_replace(col(text), rf"(?U)^{SPACE}+|{SPACE}+$", "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no such function."""
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def normalize_text(text: Column | str) -> Column:
    """Line ends, NFKC, invisible and control characters, spaces, line ends' blanks, runs of blank lines, both ends."""
    t = F.regexp_replace(col(text), "\r\n?", "\n")
    t = nfkc(t)
    t = F.translate(t, "".join(map(chr, _INVISIBLE)), "")
    t = F.regexp_replace(t, "\t", "    ")
    t = F.regexp_replace(t, r"[\p{Cc}\p{Cs}&&[^\n]]", "")
    t = F.regexp_replace(t, r"\p{Zs}", " ")
    t = F.regexp_replace(t, rf"(?U)[{SPACE[1:-1]}&&[^\n]]+(?=\n|\z)", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(t)


def strip_markup(text: Column | str) -> Column:
    """Optional, off by default everywhere: tags, addresses and URLs taken out."""
    t = F.regexp_replace(col(text), r"<[^<>]{1,200}>", " ")
    t = F.regexp_replace(t, r"https?://\S+", " ")
    return F.regexp_replace(t, r"\S+@\S+\.\S+", " ")


def special_char_ratio(text: Column | str) -> Column:
    """Share of characters that are not Latin letters, digits, Han characters, white space or ASCII punctuation."""
    t = col(text)
    odd = F.regexp_count(t, F.lit(rf"(?U)[^a-zA-Z0-9{_HAN}\s\x1c-\x1f{_PLAIN}]"))
    return F.when(F.length(t) > 0, odd / F.length(t)).otherwise(0.0)


def words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(col(text)), rf"(?U){SPACE}+"), lambda w: w != "")


def _windows(items: Column, n: int, glue: str) -> Column:
    """Runs of n neighbours as strings; guarded, because sequence counts down."""
    none = F.array().cast("array<string>")

    def runs(x: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat_ws(glue, *[F.get(x, i + k) for k in range(n)]))
        return F.when(F.size(x) >= n, run).otherwise(none)

    return let(items, runs)


def word_repetition_ratio(text: Column | str, window: int = 5) -> Column:
    """Share of word windows that occurred before in the text."""

    @F.arrow_udf(DoubleType())
    def repeated(t: pa.Array) -> pa.Array:
        return windows.repetition(t, window)

    return repeated(F.coalesce(F.lower(col(text)), F.lit("")))


@F.arrow_udf(IntegerType())
def _longest_run(t: pa.Array) -> pa.Array:
    return windows.longest_runs(t)


def longest_run(text: Column | str) -> Column:
    return _longest_run(F.coalesce(col(text), F.lit("")))


def char_repetition_ratio(text: Column | str, min_len: int = 5) -> Column:
    """Longest run of one character by length; 0 for runs below ``min_len``."""
    t = col(text)
    run = longest_run(t)
    return F.when(run >= min_len, run / F.length(t)).otherwise(0.0)


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def ngrams(text: Column | str, n: int, unit: str) -> Column:
    t = F.lower(strip(text))
    return _windows(characters(t), n, "") if unit == "char" else _windows(words(t), n, JOINER)


def ngram_diversity(text: Column | str, n: int = 3, *, unit: str = "char") -> Column:
    """Distinct n-grams by all n-grams; 1 for shorter texts."""

    @F.arrow_udf(DoubleType())
    def diverse(t: pa.Array) -> pa.Array:
        return windows.diversity(t, n, unit)

    return diverse(F.coalesce(F.lower(strip(text)), F.lit("")))


def shingles(text: Column | str, n: int = 3) -> Column:
    """Character n-grams in order; a shorter text is its own, an empty one has none."""
    t = F.lower(strip(text))
    runs = let(t, lambda x: _windows(characters(x), n, ""))
    return F.when(F.length(t) >= n, runs).when(F.length(t) > 0, F.array(t)).otherwise(F.array().cast("array<string>"))


def strip_fences(text: Column | str) -> Column:
    """Without code-fence lines, where the text starts with a fence."""
    def without(t: Column) -> Column:
        kept = F.array_join(F.filter(F.split(t, "\n"), lambda line: ~strip(line).startswith("```")), "\n")
        return F.when(t.startswith("```"), strip(kept)).otherwise(t)

    return let(strip(text), without)


def normalize_angle(text: Column | str) -> Column:
    return F.lower(strip(text))


def clean_evolved(text: Column | str) -> Column:
    """Stripped; one pair of equal quotes around the text comes off, tried for each kind in turn."""

    def peel(t: Column, q: str) -> Column:
        quoted = lambda x: (F.length(x) >= 2) & x.startswith(q) & x.endswith(q)
        return let(t, lambda x: F.when(quoted(x), strip(F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(x))

    t = strip(text)
    for q in QUOTES:
        t = peel(t, q)
    return t


def refers_to_context(text: Column | str) -> Column:
    """Whether an instruction points at a text that its reader does not see."""
    this, noun = "(?:根据|阅读)", "(?:text|passage|document|article)"
    here = "(?:上文|原文|这篇文章)"
    parts = [this + here, "根据(?:上述内容|给定材料)", "阅读以下材料", "上述(?:文章|文本|内容|材料)"]
    parts += [rf"\b{noun}\s+(?:above|given|provided)\b", rf"\b(?:provided|given)\s+{noun}\b"]
    return col(text).rlike("(?iu)" + "|".join(parts))


def is_refusal(text: Column | str) -> Column:
    return F.lower(col(text)).rlike("|".join(p.replace(".", r"\.") for p in REFUSALS))


def length_ratio(evolved: Column | str, original: Column | str) -> Column:
    return F.length(col(evolved)) / F.greatest(F.lit(1), F.length(col(original)))


def task_type(value: Column | str) -> Column:
    """One of the known task types, else other."""
    v = F.lower(strip(value))
    return F.when(v.isin(*TASK_TYPES), v).otherwise("other")


@F.pandas_udf(DoubleType())
def copied_ratio(instruction: pd.Series, source: pd.Series) -> pd.Series:
    """Longest block of the instruction that the source has, by the instruction's length."""

    def one(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        return difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b)).size / len(a)

    return pd.Series([one(a, b) for a, b in zip(instruction, source)], dtype="float64")


def fingerprint(*texts: Column | str) -> Column:
    """SHA-256 of the lower-cased, stripped concatenation."""
    return F.sha2(F.lower(strip(F.concat(*[F.coalesce(col(t), F.lit("")) for t in texts]))), 256)


def safe_length(text: Column | str) -> Column:
    return F.coalesce(F.length(col(text)), F.lit(0))
