"""Configuration: dataclasses from dictionaries or YAML, and environment files."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass
class Api:
    api_key: str = ""
    base_url: str = ""
    concurrency: int = 1
    lang: str = "en"
    model: str = "gpt-4o"
    params: dict[str, Any] = field(default_factory=dict)
    retry: dict[str, Any] = field(default_factory=dict)


@dataclass
class Strategy:
    type: str = "topic_driven"
    weight: float = 1.0
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class Quality:
    dedup: bool = True
    max_instruction_length: int = 4000
    max_output_length: int = 8000
    min_instruction_length: int = 5
    min_output_length: int = 10
    remove_truncated: bool = True  # accepted, without effect


@dataclass
class Output:
    checkpoint: bool = False
    checkpoint_path: str | None = None
    format: str = "alpaca"
    multi_turn: bool = False
    path: str = "output.jsonl"


@dataclass
class Cleaner:
    embedding_batch_size: int = 20
    embedding_dedup: bool = False
    embedding_threshold: float = 0.85
    field_map: dict[str, str] | None = None
    input_format: str = "alpaca"
    max_char_repetition: float = 0.5
    max_instruction_length: int = 4000
    max_output_length: int = 8000
    max_special_char_ratio: float = 0.3
    max_word_repetition: float = 0.5
    min_instruction_length: int = 5
    min_ngram_diversity: float = 0.2
    min_output_length: int = 10
    minhash_dedup: bool = True
    minhash_ngram: int = 3
    minhash_num_perm: int = 128
    minhash_threshold: float = 0.7
    ngram_n: int = 3
    ngram_unit: str = "char"


@dataclass
class Scoring:
    aggregation: str = "mean"
    concurrency: int = 3
    dimensions: list[Any] = field(default_factory=list)
    enabled: bool = False
    judges: list[Any] = field(default_factory=list)
    max_judge_disagreement: float = 0.0
    min_judges: int = 1
    min_total_score: float = 0.0

    def __post_init__(self) -> None:
        self.min_judges = max(1, int(self.min_judges))


@dataclass
class App:
    api: Api = field(default_factory=Api)
    strategies: list[Strategy] = field(default_factory=list)
    quality: Quality = field(default_factory=Quality)
    output: Output = field(default_factory=Output)
    cleaner: Cleaner = field(default_factory=Cleaner)
    scoring: Scoring = field(default_factory=Scoring)
    stages: list[str] = field(default_factory=lambda: "generate clean score score_filter".split())
    dry_run: bool = False
    count: int = 0
    random_seed: int | None = None


def _section(kind: type, given: dict[str, Any] | None) -> Any:
    given = dict(given or {})
    known = {f.name for f in fields(kind)}
    if kind is Strategy:
        kind_, weight = given.pop("type", "topic_driven"), float(given.pop("weight", 1.0))
        return Strategy(kind_, weight, given.pop("params", {}) | given)
    if kind is Cleaner and "dedup" in given:
        warnings.warn("cleaner.dedup is read as cleaner.minhash_dedup", stacklevel=2)
        given.setdefault("minhash_dedup", given.pop("dedup"))
    return kind(**{k: v for k, v in given.items() if k in known})


def from_dict(given: dict[str, Any]) -> App:
    one = given.get("strategies", given.get("strategy", []))
    parts = {n: _section(k, given.get(n)) for n, k in (("api", Api), ("quality", Quality), ("output", Output), ("cleaner", Cleaner), ("scoring", Scoring))}
    rest = {k: given[k] for k in ("stages", "dry_run", "count", "random_seed") if k in given}
    return App(strategies=[_section(Strategy, s) for s in (one if isinstance(one, list) else [one])], **parts, **rest)


def from_yaml(path: str) -> App:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need the yaml module; from_dict does not") from e
    with open(path, encoding="utf-8") as f:
        return from_dict(yaml.safe_load(f) or {})


def load_environment(path: str = ".env") -> dict[str, str]:
    """NAME=value lines of a file; they override the process's environment."""
    out: dict[str, str] = {}
    text = Path(path).read_text("utf-8") if os.path.exists(path) else ""
    for line in text.splitlines():
        name, sign, value = line.strip().removeprefix("export ").partition("=")
        if sign and name and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    os.environ.update(out)
    return out
