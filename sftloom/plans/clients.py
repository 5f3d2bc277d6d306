"""Language-model and embedding clients, retries, and the Spark stage that calls them."""

from __future__ import annotations

import hashlib
import json
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

Messages = Sequence[dict[str, str]]


class Client(Protocol):
    """Answers one prompt; must be picklable."""

    def complete(self, messages: Messages, **options: Any) -> str: ...


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class Retry:
    """Waits of ``first`` seconds, each ``factor`` times the last, at most ``longest``."""

    tries: int = 3
    first: float = 1.0
    factor: float = 2.0
    longest: float = 30.0
    sleep: Callable[[float], None] = time.sleep

    def call(self, f: Callable[[], Any]) -> Any:
        wait = self.first
        for left in range(self.tries, -1, -1):
            try:
                return f()
            except Exception:
                if not left:
                    raise
                self.sleep(min(wait, self.longest))
                wait *= self.factor


@dataclass(frozen=True)
class HttpClient:
    """Chat completions over HTTP with the standard library."""

    base_url: str
    api_key: str
    model: str
    timeout: float = 60.0
    json_mode: bool = True

    def _post(self, path: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", json.dumps(body).encode(), {"Authorization": f"Bearer {self.api_key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
            return json.load(reply)

    def complete(self, messages: Messages, **options: Any) -> str:
        as_json = options.pop("json_mode", self.json_mode)
        extra = {"response_format": {"type": "json_object"}} if as_json else {}
        return self._post("chat/completions", {"model": self.model, "messages": list(messages), **options, **extra})["choices"][0]["message"]["content"]

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        got = self._post("embeddings", {"model": self.model, "input": list(texts)})["data"]
        return [row["embedding"] for row in sorted(got, key=lambda row: row["index"])]


@dataclass(frozen=True)
class StubClient:
    """Deterministic offline answers: ``reply`` if given, else a sample made from the prompt's digest."""

    reply: Callable[[Messages], str] | None = None

    def complete(self, messages: Messages, **options: Any) -> str:
        if self.reply:
            return self.reply(messages)
        text = messages[-1]["content"]
        mark = hashlib.sha256(json.dumps(list(messages), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]
        wanted = re.search(r"Number of items: (\d+)", text)
        dims = re.search(r"Reply with the keys: ([\w, ]+)", text)
        if dims:
            return json.dumps({d.strip(): int(hashlib.sha256((mark + d).encode()).hexdigest(), 16) % 11 for d in dims[1].split(",")})
        if "Plan the items" in text:
            return json.dumps({"items": [{"sub_topic": f"part {i}", "angle": f"angle {mark} {i}", "difficulty": "medium", "question_type": "how"} for i in range(int(wanted[1]) if wanted else 1)]})
        made = [{"instruction": f"Explain item {mark} {i}", "output": f"This is the answer to item {mark} {i}.", "task_type": "explanation"} for i in range(int(wanted[1]) if wanted else 1)]
        return json.dumps(made if wanted else made[0])


@dataclass(frozen=True)
class HashEmbedder:
    """Deterministic embeddings: signed counts of hashed words."""

    size: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % self.size] += 1 if h >> 63 else -1
        return out.tolist()


@dataclass(frozen=True)
class Call:
    """How prompts are sent: options for the client, retries, and calls at once in one task."""

    options: dict[str, Any] = field(default_factory=lambda: dict(max_tokens=2048, temperature=0.8))
    retry: Retry = Retry()
    concurrency: int = 4


def complete(prompts: DataFrame, client: Client, call: Call = Call(), messages: str = "prompt") -> DataFrame:
    """Column ``reply`` for each row's messages; null where every try failed.

    Replies differ from call to call, so callers write the result before they use it twice (``materialise``).
    """
    schema = StructType([*prompts.schema.fields, StructField("reply", StringType())])
    at = prompts.columns.index(messages)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(given: list[dict[str, str]]) -> str | None:
            try:
                return call.retry.call(lambda: client.complete(given, **call.options))
            except Exception:
                return None

        with ThreadPoolExecutor(max(1, call.concurrency)) as pool:
            for batch in batches:
                replies = list(pool.map(one, batch.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string())], names=[*batch.schema.names, "reply"])

    return prompts.mapInArrow(step, schema)


def materialise(df: DataFrame) -> DataFrame:
    """Write a stage's rows to the checkpoint folder, so that a lost executor does not call the model again."""
    from sftloom.operators.dedup import checkpoints

    checkpoints(df.sparkSession)
    return df.checkpoint()


def embeddings(df: DataFrame, embedder: Embedder, text: str, batch: int = 20, column: str = "embedding") -> DataFrame:
    """Embedding of each row's text, ``batch`` texts a call."""
    schema = df.withColumn(column, F.array().cast("array<float>")).schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = [t or "" for t in rows.column(text).to_pylist()]
            vectors = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            if len(vectors) != len(texts):
                raise ValueError("the embedding service gave another number of vectors")
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float32()))], names=[*rows.schema.names, column])

    return df.mapInArrow(step, schema)
