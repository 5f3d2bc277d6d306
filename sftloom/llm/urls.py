"""URL filters: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

Hosts, paths and rules are matched with built-in expressions. URLs that a rule fits are the labelled
ones: the trees learn the rules' verdicts from a bounded sample of them (``rows``) and judge the rest from
lengths, depth, digit ratio, entropy, parameter counts, the suffix's number of URLs in the whole table and its share of
blocked ones in the sample (smoothed to the sample's share, which suffixes without labels get).

Cases: a null URL, or one without ``://``, has empty host and path, fits no rule, and is judged by the
trees; equal URLs are judged equally; an empty table gives no rows; other columns are ignored; where
all labels agree the trees give that verdict, and without any label ``allow``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import Batches, bounded_sample, run, sliced, utf8
from .training import sigmoid

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
BINS = 32


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def rest() -> Column:
    """What follows the first :// of the url; empty where there is none."""
    at = F.instr("url", "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def host(after: Column) -> Column:
    return F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)


def path(after: Column) -> Column:
    return F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def best_rule(rules: tuple[Rule, ...], field: str) -> Column:
    """The longest rule that fits host and path; of equally long ones the first in order of text."""
    out = F
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = out.when(fits, F.lit(getattr(rule, field)))
    return out if rules else F.lit(None).cast("string")


def ruled(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, and the fitting rule with its verdict, or nulls."""
    cut = pages.select("page_id", "url", F.coalesce(rest(), F.lit("")).alias("after"))
    cut = cut.select("page_id", "url", host(F.col("after")).alias("host"), path(F.col("after")).alias("path"))
    return cut.select("*", best_rule(rules, "text").alias("rule"), best_rule(rules, "verdict").alias("ruling"))


def by_url(of: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(of)])
    return (total[ends[1:]] - total[ends[:-1]]).astype(np.float64)


def entropy(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(ends) - 1
    owner = np.repeat(np.arange(n), np.diff(ends))
    count = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    share = count / np.maximum(count.sum(1), 1)[:, None]
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(1)


def suffixes(hosts: pa.Array) -> list[str]:
    return [h.rpartition(".")[2] for h in hosts.fill_null("").to_pylist()]


NAMES = ("length", "host_length", "path_length", "depth", "digit_ratio", "path_digits", "entropy", "host_entropy", "parameters", "query_length", "host_dots", "host_hyphens", "fragment", "secure", "suffix_rate", "suffix_count")


def lexical(batch: pa.RecordBatch, stats: dict[str, tuple[int, int]]) -> np.ndarray:
    """A row of NAMES for each url."""
    raw, ends = utf8(batch.column("url"))
    hraw, hends = utf8(batch.column("host"))
    praw, pends = utf8(batch.column("path"))
    digit = (raw >= 48) & (raw <= 57)
    length = np.diff(ends)
    question = by_url(raw == 63, ends) > 0
    sure = by_url((raw[:-1] == ord("s")) & (raw[1:] == ord(":")) if len(raw) else raw, np.minimum(ends, max(0, len(raw) - 1)))
    seen = [stats.get(s, (0, 0)) for s in suffixes(batch.column("host"))]
    blocked, count = np.array([b for _, b in seen], np.float64), np.array([n for n, _ in seen], np.float64)
    every = np.asarray(batch.column("suffix_count")) if "suffix_count" in batch.schema.names else count
    total, bad = sum(n for n, _ in stats.values()), sum(b for _, b in stats.values())
    prior = (bad + 1) / (total + 2)
    columns = [
        length,
        np.diff(hends),
        np.diff(pends),
        by_url(praw == 47, pends),
        by_url(digit, ends) / np.maximum(length, 1),
        by_url((praw >= 48) & (praw <= 57), pends),
        entropy(raw, ends),
        entropy(hraw, hends),
        by_url(raw == 38, ends) + question,
        np.where(question, length - np.diff(hends) - np.diff(pends), 0),
        by_url(hraw == 46, hends),
        by_url(hraw == 45, hends),
        by_url(raw == 35, ends) > 0,
        sure > 0,
        (blocked + 20 * prior) / (count + 20),
        np.log1p(every),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], 1)


class Forest:
    """Boosted trees of fixed depth, as arrays: feature and threshold by inner node, value by leaf."""

    def __init__(self, bias: float, stats: dict[str, tuple[int, int]], depth: int = 3):
        self.bias, self.stats, self.depth = bias, stats, depth
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def raw(self, x: np.ndarray) -> np.ndarray:
        z, rows = np.full(len(x), self.bias), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            z += leaf[node - (2**self.depth - 1)]
        return z


def grow(x: np.ndarray, y: np.ndarray, stats: dict[str, tuple[int, int]], trees: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0) -> Forest:
    """Newton boosting of the logistic loss over binned features."""
    forest = Forest(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), stats, depth)
    if len(set(y)) < 2:
        return forest
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    z = np.full(len(y), forest.bias)
    for _ in range(trees):
        p = sigmoid(z)
        g, h = y - p, p * (1 - p)
        inner = 2**depth - 1
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                key = (node - first) * BINS + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(key, weights=h, minlength=width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge))[:, : len(edge)]
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best + 1e-12):
                    best[k], feature[first + k], cut[first + k] = top[k], f, edge[at[k]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        place = node - inner
        leaf = rate * np.bincount(place, weights=g, minlength=inner + 1) / (np.bincount(place, weights=h, minlength=inner + 1) + ridge)
        forest.feature.append(feature)
        forest.cut.append(cut)
        forest.leaf.append(leaf)
        z += leaf[place]
    return forest


def suffix_counts(all_: DataFrame) -> DataFrame:
    """suffix and suffix_count: how many URLs of the whole table have the host suffix; folded in each task before the shuffle."""
    return all_.groupBy(F.substring_index("host", ".", -1).alias("suffix")).agg(F.count("*").alias("suffix_count"))


def counted(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Pages with their suffix's count; Spark broadcasts the counts where they are few, else adaptive execution splits hot suffixes."""
    return pages.withColumn("suffix", F.substring_index("host", ".", -1)).join(counts, "suffix").drop("suffix")


def fit_filter(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = 20000) -> Forest:
    """Trees from a bounded sample of the URLs that a rule fits; label 1 is block."""
    all_ = ruled(pages, rules)
    sample = bounded_sample(all_.where("ruling is not null"), rows, "page_id")
    sample = counted(sample, suffix_counts(all_)).orderBy(F.xxhash64("page_id"), "page_id", "url").toArrow().combine_chunks()
    if not sample.num_rows:
        return Forest(-1.0, {})
    batch = sample.to_batches()[0]
    y = np.array([r == "block" for r in batch.column("ruling").to_pylist()], np.float64)
    stats: dict[str, list[int]] = {}
    for s, bad in zip(suffixes(batch.column("host")), y):
        seen = stats.setdefault(s, [0, 0])
        seen[0] += 1
        seen[1] += int(bad)
    kept = {s: (n, b) for s, (n, b) in stats.items() if n >= 5}
    return grow(lexical(batch, kept), y, kept)


def judge_batches(shared):
    def step(batches: Batches) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            block = forest.raw(lexical(batch, forest.stats)) > 0
            verdict = [r or ("block" if b else "allow") for r, b in zip(batch.column("ruling").to_pylist(), block)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return step


def judge_urls(pages: DataFrame, forest: Forest, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    shared = pages.sparkSession.sparkContext.broadcast(forest)
    all_ = ruled(pages, rules)
    return run(counted(all_, suffix_counts(all_)), SCHEMA, sliced(4 << 20, "url"), judge_batches(shared))
