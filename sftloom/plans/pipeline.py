"""Stages from DataFrame to DataFrame, their registry, counters and reports."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftloom.functions import json as J
from sftloom.functions import text as T
from sftloom.operators import dedup, profile, quality, reshape, scoring
from sftloom.sources import writers

from .clients import Call, Client, StubClient, complete, materialise
from .config import App, Cleaner, Quality
from .prompts import labelled, prompt
from .strategies import STRATEGIES, Composite, Generator


class Observer(Protocol):
    def on_start(self, stage: str) -> None: ...

    def on_samples(self, strategy: str, succeeded: int) -> None: ...

    def on_complete(self, stage: str, counts: dict[str, Any]) -> None: ...


class LogObserver:
    def on_start(self, stage: str) -> None:
        print(f"{stage}: begins")

    def on_samples(self, strategy: str, succeeded: int) -> None:
        print(f"{strategy}: {succeeded} samples")

    def on_complete(self, stage: str, counts: dict[str, Any]) -> None:
        print(f"{stage}: {counts}")


@dataclass
class CompositeObserver:
    observers: list[Observer]

    def on_start(self, stage: str) -> None:
        for o in self.observers:
            o.on_start(stage)

    def on_samples(self, strategy: str, succeeded: int) -> None:
        for o in self.observers:
            o.on_samples(strategy, succeeded)

    def on_complete(self, stage: str, counts: dict[str, Any]) -> None:
        for o in self.observers:
            o.on_complete(stage, counts)


@dataclass
class Context:
    """What stages know besides their rows. ``judges`` are (name, client) pairs; ``inputs`` are tables for strategies; ``embedder`` adds the vectors that semantic deduplication needs."""

    spark: SparkSession
    config: App
    client: Client = field(default_factory=StubClient)
    judges: list[tuple[str, Client]] = field(default_factory=list)
    inputs: dict[str, DataFrame] = field(default_factory=dict)
    embedder: Callable[[DataFrame], DataFrame] | None = None
    counts: dict[str, dict[str, Any]] = field(default_factory=dict)


Stage = Callable[[DataFrame | None, Context], DataFrame]
REGISTRY: dict[str, Stage] = {}


def stage(name: str) -> Callable[[Stage], Stage]:
    def add(f: Stage) -> Stage:
        REGISTRY[name] = f
        return f

    return add


def create_strategy(kind: str, client: Client, params: dict[str, Any], **options: Any) -> Generator:
    if kind not in STRATEGIES:
        raise ValueError(f"unknown strategy {kind}; known: {sorted(STRATEGIES)}")
    return STRATEGIES[kind](client, params, **options)


def validate(df: DataFrame, q: Quality) -> DataFrame:
    """Length, then exact duplicates by fingerprint, in order."""
    rules = quality.quality_rules(min_instruction=q.min_instruction_length, max_instruction=q.max_instruction_length, min_output=q.min_output_length, max_output=q.max_output_length)
    out = quality.apply_rules(df, rules)
    return dedup.exact_dedup(out, T.fingerprint("instruction", "output")) if q.dedup else out


@stage("generate")
def generate(df: DataFrame | None, ctx: Context) -> DataFrame:
    c = ctx.config
    parts = []
    for s in c.strategies:
        params = {"total_count": c.count or None, **ctx.inputs, **s.params}
        parts.append(create_strategy(s.type, ctx.client, params, lang=c.api.lang, seed=c.random_seed or 0, call=Call(options=dict(max_tokens=2048, temperature=0.8) | c.api.params, concurrency=c.api.concurrency)))
    made = (parts[0] if len(parts) == 1 else Composite(parts)).generate(ctx.spark)
    made = made.withColumn("_ord", F.monotonically_increasing_id())
    made = materialise(quality.emit_gate(made))
    valid = validate(flat(made), c.quality)
    ctx.counts["generate"] = {"planned": sum(p.estimate() for p in parts), "attempted": made.count(), "generated": valid.count()}
    return valid


def flat(df: DataFrame) -> DataFrame:
    """Instruction and output of chat rows from their messages."""
    if "messages" not in df.columns:
        return df
    many = F.size(F.coalesce("messages", F.array())) > 0
    user, answer = reshape.validator_texts(F.col("messages"))
    return df.withColumns({"instruction": F.when(many, user).otherwise(F.col("instruction")), "output": F.when(many, answer).otherwise(F.col("output"))})


def clean_rows(df: DataFrame, c: Cleaner, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Normalise, apply the rules, remove duplicates; chat rows are judged by their messages and keep them, normalised.

    Metadata whose names begin with _ are left out.
    """
    rows = flat(df).withColumns({k: T.normalize_text(k) for k in ("instruction", "output")}).where((F.length("instruction") > 0) & (F.length("output") > 0))
    rules = quality.cleaner_rules(
        quality.LengthRule(c.min_instruction_length, c.max_instruction_length, c.min_output_length, c.max_output_length),
        quality.RatioRule(c.max_special_char_ratio, c.max_word_repetition, c.max_char_repetition),
        quality.NgramDiversityRule(c.min_ngram_diversity, c.ngram_n, c.ngram_unit),
    )
    rows = quality.apply_rules(rows, rules)
    if "messages" in rows.columns:
        rows = reshape.rebuild_messages(materialise(rows))
    if dict(rows.dtypes).get("metadata", "").startswith("map<string"):
        rows = rows.withColumn("metadata", reshape.public_metadata(F.col("metadata")))
    rows = materialise(rows)
    if c.embedding_dedup:
        if embedder is None:
            raise ValueError("semantic deduplication needs an embedding function")
        return dedup.SemanticDedup(c.embedding_threshold)(embedder(rows))
    how = dedup.strategy(c.minhash_dedup, threshold=c.minhash_threshold, perm=c.minhash_num_perm, n=c.minhash_ngram)
    return how(rows, reshape.dedup_text(rows))


@stage("clean")
def clean(df: DataFrame | None, ctx: Context) -> DataFrame:
    out = materialise(clean_rows(df, ctx.config.cleaner, ctx.embedder))
    ctx.counts["clean"] = {"kept": out.count(), "dropped": df.count() - out.count()}
    return out


def judge_prompt(df: DataFrame, dimensions: list[scoring.Dimension], lang: str) -> DataFrame:
    rubric = "\n".join(f"{d.label or d.name} (0 to {d.max_score}): " + "; ".join(d.rubric or scoring.default_rubric(d.max_score, lang)) for d in dimensions)
    grounding = F.col("metadata")["source_text"] if dict(df.dtypes).get("metadata", "").startswith("map") else (F.col("source_text") if "source_text" in df.columns else F.lit(None).cast("string"))
    both = [labelled("Instruction", F.col("instruction")), labelled("Output", F.col("output"))]
    if "messages" in df.columns:
        many = F.size(F.coalesce("messages", F.array())) > 0
        both = [F.when(many, reshape.transcript(F.col("messages"))).otherwise(F.concat_ws("\n", *both))]
    return df.withColumn("prompt", prompt("judge", rubric, labelled("Source", grounding), *both, "Reply with the keys: " + ", ".join(d.name for d in dimensions), lang=lang))


def score_rows(df: DataFrame, dimensions: list[scoring.Dimension], judges: list[tuple[str, Client]], lang: str = "en", how: str = "mean", min_judges: int = 1, concurrency: int = 3) -> DataFrame:
    """One judge: scores and total, null where the judge failed. Several: aggregated, with disagreement and quorum."""
    names = [d.name for d in dimensions]
    asked = judge_prompt(df, dimensions, lang)
    call = Call(options={"temperature": 0.3}, concurrency=concurrency)
    if len(judges) == 1:
        got = materialise(complete(asked, judges[0][1], call))
        return scoring.with_scores(got, J.parse_scores("reply", names)).drop("prompt", "reply")
    every = None
    for name, client in judges:
        rows = complete(asked.select("_ord", "prompt"), client, call).select("_ord", F.lit(name).alias("judge"), J.parse_scores("reply", names).alias("scores"))
        every = rows if every is None else every.union(rows)
    every = materialise(every)
    merged = scoring.aggregate_judges(every, "_ord", how, min_judges)
    base = df.drop(*[c for c in merged.columns if c != "_ord"], "judge_scores")
    return base.join(merged, "_ord", "left").join(scoring.judge_scores(every), "_ord", "left")


@stage("score")
def score(df: DataFrame | None, ctx: Context) -> DataFrame:
    s = ctx.config.scoring
    if not s.enabled:
        return df
    dims = [d if isinstance(d, scoring.Dimension) else scoring.Dimension(**({"name": d} if isinstance(d, str) else d)) for d in (s.dimensions or ["accuracy", "clarity", "usefulness"])]
    out = materialise(score_rows(df, dims, ctx.judges or [("judge", ctx.client)], ctx.config.api.lang, s.aggregation, s.min_judges, s.concurrency))
    ctx.counts["score"] = {"scored": out.where("scores is not null").count(), "failed": out.where("scores is null").count()}
    return out


@stage("score_filter")
def score_filter(df: DataFrame | None, ctx: Context) -> DataFrame:
    s = ctx.config.scoring
    if not s.enabled or "total_score" not in df.columns:
        return df
    out = quality.score_filter(df, s.min_total_score, s.max_judge_disagreement)
    kept = out.count()
    ctx.counts["score_filter"] = {"kept": kept, "dropped": df.count() - kept}
    return out


def run(ctx: Context, rows: DataFrame | None = None, observer: Observer | None = None, skip_failures: bool = False) -> DataFrame | None:
    """The configured stages in order, one write at the end (not in a dry run), and a report beside it.

    A stage's failure ends the run, unless ``skip_failures`` leaves the stage out.
    """
    began = time.time()
    for name in ctx.config.stages:
        if name != "generate" and (rows is None or ctx.config.dry_run):
            continue
        if observer:
            observer.on_start(name)
        try:
            rows = REGISTRY[name](rows, ctx)
        except Exception:
            if not skip_failures:
                raise
            continue
        if observer:
            if name == "generate" and rows is not None and hasattr(observer, "on_samples"):
                for r in profile.frequency(rows, "strategy").collect():  # a row for each strategy
                    observer.on_samples(r[0], r[1])
            observer.on_complete(name, ctx.counts.get(name, {}))
    if rows is not None and not ctx.config.dry_run and not rows.isEmpty():
        writers.write_jsonl(rows, ctx.config.output.path, ctx.config.output.format, "overwrite")
        writers.save_report(report(rows, ctx.counts, time.time() - began), writers.report_path(ctx.config.output.path))
    return rows


def _row(df: DataFrame) -> dict[str, Any]:
    first = df.first()
    return first.asDict() if first else {}


def report(rows: DataFrame, counts: dict[str, dict[str, Any]], seconds: float = 0.0) -> dict[str, Any]:
    """Counts, rates and distributions of a run; rounded here only."""
    made, cleaned = counts.get("generate", {}), counts.get("clean", {})
    out: dict[str, Any] = {"stages": counts, "elapsed_seconds": round(seconds, 1)}
    if made.get("attempted"):
        out["pass_rate"] = round(made["generated"] / made["attempted"], 3)
        out["rate"] = round(made["generated"] / seconds, 3) if seconds else 0.0
    if cleaned:
        out["clean_retention"] = profile.retention(cleaned["kept"], cleaned["dropped"])
    if "score_filter" in counts:
        out["score_retention"] = profile.retention(counts["score_filter"]["kept"], counts["score_filter"]["dropped"])
    for key in ("strategy", "topic"):
        if key in rows.columns:
            out[f"by_{key}"] = {r[0]: r[1] for r in profile.frequency(rows, key).collect()}
    sized = rows.select(T.safe_length("instruction").alias("instruction"), T.safe_length("output").alias("output"))
    out["lengths"] = {c: _row(profile.distribution(sized, c)) for c in sized.columns}
    if "scores" in rows.columns:
        out["scores"] = {r.dimension: {k: v for k, v in r.asDict().items() if k != "dimension"} for r in profile.score_distributions(rows).collect()}
    return out


def inspect(rows: DataFrame, parse_errors: int = 0, similarity: bool = False) -> dict[str, Any]:
    """Profile of a dataset: shapes, empty fields, lengths, histograms, repetition, topics, scores, similarity."""
    data = flat(rows)
    out: dict[str, Any] = {**_row(profile.format_counts(data)), "parse_errors": parse_errors, "repetition": _row(profile.repetition_summary(data))}
    sized = data.select(T.safe_length("instruction").alias("instruction"), T.safe_length("output").alias("output"))
    out["lengths"] = {c: _row(profile.distribution(sized, c)) for c in sized.columns}
    out["histograms"] = {c: [r.asDict() for r in profile.histogram(sized, c).orderBy("bin").collect()] for c in sized.columns}
    out["topics"] = {r[0]: r[1] for r in profile.frequency(data, "topic", top=15).collect()} if "topic" in data.columns else {}
    if "scores" in data.columns:
        out["scores"] = {r.dimension: r.asDict() for r in profile.score_distributions(data).collect()}
    if similarity:
        pairs, rows_ = dedup.similarity_profile(materialise(dedup.signatures(data, reshape.dedup_text(data))))
        rows_ = materialise(rows_)
        out["similarity"] = {**_row(profile.near_duplicate_summary(rows_)), "top_pairs": [tuple(r) for r in pairs.orderBy(F.desc("similarity"), "i", "j").limit(8).collect()], **{"max_similarity": _row(profile.distribution(rows_, "max_similarity"))}}
    return out


def render(data: dict[str, Any], title: str = "report") -> str:
    """A report as text."""
    lines = [title, "=" * len(title)]

    def add(prefix: str, value: Any) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                add(f"{prefix}{k}." if isinstance(v, dict) else f"{prefix}{k}", v)
        else:
            lines.append(f"{prefix}: {round(value, 3) if isinstance(value, float) else value}")

    add("", data)
    for name, bars in data.get("histograms", {}).items():
        top = max((b["count"] for b in bars), default=1)
        lines += [f"{name} lengths", *(f"{b['low']:>10.0f}-{b['high']:<10.0f} {'#' * max(1, round(40 * b['count'] / top))} {b['count']}" for b in bars)]
    return "\n".join(lines)
