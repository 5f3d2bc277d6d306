"""Generation strategies: prompts, calls, parsing and validity, as DataFrames.

Every random choice is a hash of (seed, stable id, purpose), so runs repeat whatever the partitions. What a
model said is written to the checkpoint folder before it is used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sftloom.functions import text as T
from sftloom.operators import dedup, quality, reshape

from . import parsing
from .clients import Call, Client, complete, materialise
from .prompts import KEYS, knowledge_lines, labelled, prompt

DIMENSIONS = {"difficulty": ["easy", "medium", "hard"], "question_type": ["what", "how", "why", "compare"]}
DEPTH = ("add_constraints", "deepen", "concretise", "more_reasoning_steps", "complicate_input")
PLAIN = Call(options=dict(json_mode=False, max_tokens=2048, temperature=0.8))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and parts alone."""
    h = F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / float(1 << 48)


def pick(values: list[str], u: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def decode_id(value: Column, *names: str) -> Column:
    """The parts of a prompt's id between colons, as a struct; parts that are missing are null, and the first keeps colons of its own."""
    parts = F.reverse(F.split(value, ":"))
    last = [F.get(parts, F.lit(len(names) - 1 - i)).alias(n) for i, n in enumerate(names) if i]
    first = F.array_join(F.reverse(F.slice(parts, len(names), F.greatest(F.size(parts) - len(names) + 1, F.lit(0)))), ":")
    return F.struct(F.nullif(first, F.lit("")).alias(names[0]), *last)


def with_index(df: DataFrame, *order: Column | str, name: str = "_index") -> DataFrame:
    """Row numbers from 0 in the given order, without one task that sees all rows; the ranges are written, for they are read twice."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.count("*").alias("_t"))
    before = totals.withColumn("_before", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    here = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_here", here).join(F.broadcast(before.drop("_t")), "_part").withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_before", "_here")


def apportion(target: int, weights: list[float]) -> list[int]:
    """max(1, round(target * share)) for each topic; the last one takes the remainder."""
    total = sum(weights) or 1
    out = [max(1, round(target * w / total)) for w in weights[:-1]]
    return [*out, target - sum(out)]


def plan_slots(spark: SparkSession, topics: list[str], counts: list[int], dimensions: dict[str, list[str]] = DIMENSIONS, seed: int = 0) -> DataFrame:
    """topic, slot and a value of each dimension: all combinations of a topic in hashed order, again from the start where they run out."""
    combinations = [tuple(c) for c in product(*dimensions.values())]
    names = list(dimensions)
    base = spark.createDataFrame([(t, max(0, n)) for t, n in zip(topics, counts)], "topic string, wanted int")
    combos = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c)]) for c in combinations])
    key = [F.col("c")[n] for n in names]
    rank = Window.partitionBy("topic").orderBy(F.sha2(F.concat_ws("|", F.lit(str(seed)), "topic", *key), 256))
    ranked = base.select("topic", "wanted", F.explode(combos).alias("c")).withColumn("at", F.row_number().over(rank) - 1)
    again = F.sequence(F.lit(0), F.floor((F.col("wanted") - 1 - F.col("at")) / len(combinations)).cast("int"))
    slots = ranked.where("at < wanted").select("topic", "c", "at", F.explode(again).alias("lap"))
    return slots.select("topic", (F.col("at") + F.col("lap") * len(combinations)).cast("int").alias("slot"), *[F.col("c")[n].alias(n) for n in names])


def batches(df: DataFrame, size: int, by: str, order: str) -> DataFrame:
    """Number of the batch of at most ``size`` rows that a row of its group lies in; rows are numbered over all groups, so none is hot."""
    placed = with_index(df, by, order)
    first = placed.groupBy(F.col(by).alias("_by")).agg(F.min("_index").alias("_first"))
    numbered = placed.join(first, F.col(by).eqNullSafe(F.col("_by")))
    return numbered.withColumn("batch", F.floor((F.col("_index") - F.col("_first")) / size).cast("int")).drop("_by", "_first", "_index")


@dataclass
class Generator:
    """What all strategies share. ``target`` bounds prompts, never what is kept of the replies."""

    client: Client
    params: dict[str, Any] = field(default_factory=dict)
    lang: str = "en"
    seed: int = 0
    call: Call = Call()

    def ask(self, prompts: DataFrame, call: Call | None = None) -> DataFrame:
        return materialise(complete(prompts, self.client, call or self.call))

    def generate(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def estimate(self) -> int:
        return int(self.params.get("count", self.params.get("target_count", 0)))

    def table(self, spark: SparkSession, name: str, given: DataFrame | None = None) -> DataFrame:
        """The rows given here or in the parameters, where a string is a path to read."""
        from sftloom.sources import readers

        rows = given if given is not None else self.params[name]
        if not isinstance(rows, str):
            return rows
        fields = self.params.get("field_map")
        return readers.read_seeds(spark, rows, fields) if name == "seeds" else readers.load_document_chunks(spark, rows, fields, self.params.get("chunking"))

    def limited(self, df: DataFrame, id_: str = "id") -> DataFrame:
        """At most ``target_count`` prompts, shuffled by hash where ``shuffle`` is set."""
        caps = [int(self.params[k]) for k in ("target_count", "total_count") if self.params.get(k)]
        if not caps:
            return df
        order = F.xxhash64(F.lit(self.seed), F.col(id_)) if self.params.get("shuffle") else F.col("_ord")
        return df.orderBy(order, id_).limit(min(caps))


class TopicDriven(Generator):
    """Plan items for each topic, drop repeated angles, then write the items in small batches."""

    def generate(self, spark: SparkSession) -> DataFrame:
        p = self.params
        topics = [t if isinstance(t, dict) else {"name": t} for t in p["topics"]]
        dims = p.get("dimensions", DIMENSIONS)
        counts = apportion(int(p.get("target_count", len(topics))), [float(t.get("weight", 1)) for t in topics])
        names = [t["name"] for t in topics]
        slots = plan_slots(spark, names, counts, dims, self.seed)
        lines = F.array_join(F.array_sort(F.collect_list(F.struct("slot", F.concat_ws(", ", *dims).alias("line"))))["line"], "\n")
        know = spark.createDataFrame([(t["name"], t.get("knowledge", "")) for t in topics], "topic string, knowledge string")
        wanted = slots.groupBy("topic").agg(F.count("*").alias("n"), lines.alias("lines")).join(know, "topic")
        asked = wanted.withColumn("prompt", prompt("planner", "Plan the items.", labelled("Topic", F.col("topic")), knowledge_lines(F.col("knowledge"), F.col("n")), labelled("Number of items", F.col("n")), "One line for each item:", F.col("lines"), lang=self.lang))
        plan = parsing.parse_plan(self.ask(asked), dims).withColumn("_ord", F.xxhash64("topic", "item_no"))
        plan = dedup.dedup_angles(dedup.dedup_angles(plan), ())
        plan = batches(plan, int(p.get("execution_max_per_request", 2)), "topic", "item_no")
        line = F.struct("item_no", F.concat_ws(" | ", "sub_topic", "angle", *dims).alias("line"))
        work = plan.groupBy("topic", "knowledge", "batch").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(line)).alias("items"))
        keys = KEYS["topic_multi_turn" if p.get("multi_turn") else "topic_reasoning" if p.get("require_reasoning") else "topic"]
        work = work.withColumn("prompt", prompt("topic", labelled("Topic", F.col("topic")), labelled("Number of items", F.col("n")), F.array_join(F.col("items")["line"], "\n"), keys, lang=self.lang))
        made = parsing.parse_samples(self.ask(work))
        angle = F.get(F.col("items"), F.col("item_no"))["line"]  # the sample's place names its plan item
        return made.withColumn("plan_item", angle).withColumn("strategy", F.lit("topic_driven")).withColumn("id", F.concat_ws(":", "topic", "batch", "item_no"))

    def estimate(self) -> int:
        return int(self.params.get("target_count", 0))


class SeedDriven(Generator):
    """New samples from seeds: by example, by crossing two, or by mutating one."""

    def rates(self) -> tuple[float, float]:
        cross, mutate = (min(1.0, max(0.0, float(self.params.get(k, 0)))) for k in ("crossover_rate", "mutation_rate"))
        total = cross + mutate
        return (cross / total, mutate / total) if total > 1 else (cross, mutate)

    def prompts(self, spark: SparkSession, seeds: DataFrame) -> DataFrame:
        count, k = int(self.params.get("count", 1)), int(self.params.get("example_num", 2))
        cross, mutate = self.rates()
        n = seeds.count()
        if not n:
            raise ValueError("seed_driven needs seeds")
        user, answer = F.col("instruction"), F.col("output")
        if "messages" in seeds.columns:
            first, second = reshape.seed_pair(F.col("messages"))
            user, answer = F.coalesce(first, user), F.coalesce(second, answer)
        pool = with_index(seeds.select("_ord", user.alias("u"), answer.alias("a"), *(["topic"] if "topic" in seeds.columns else [F.lit(None).cast("string").alias("topic")])), F.xxhash64(F.lit(self.seed), "_ord"), "_ord")
        ids = spark.range(count).withColumn("r", uniform(self.seed, "roulette", F.col("id")))
        mode = F.when((F.col("r") < cross) & F.lit(n >= 2), "crossover").when((F.col("r") >= cross) & (F.col("r") < cross + mutate), "mutate").otherwise("few_shot")
        size = F.when(F.col("mode") == "crossover", 2).when(F.col("mode") == "mutate", 1).otherwise(min(k, n))
        start = F.floor(uniform(self.seed, "start", F.col("id")) * n)
        wanted = ids.withColumn("mode", mode).select("id", "mode", F.explode(F.sequence(F.lit(0), size - 1)).alias("j"), start.alias("start"))
        second = F.floor(uniform(self.seed, "second", F.col("id")) * (n - 1)) + 1  # any other seed, for a crossover
        step = F.when(F.col("mode") == "crossover", F.col("j") * second).otherwise(F.col("j"))
        wanted = wanted.withColumn("_index", (F.col("start") + step) % n)
        shown = F.concat(F.lit("Instruction: "), "u", F.lit("\nOutput: "), "a")
        grouped = wanted.join(pool, "_index").groupBy("id", "mode").agg(F.array_sort(F.collect_list(F.struct("j", shown.alias("x"), "topic"))).alias("e"))
        fixed = self.params.get("topic")
        topic = F.coalesce(F.lit(fixed), F.get(F.col("e"), F.lit(0))["topic"], pick(self.params.get("topics", ["general"]), uniform(self.seed, "topic", F.col("id"))))
        return grouped.withColumn("topic", topic)

    def mutation(self) -> tuple[Column, Column, dict[str, Column]]:
        """Name and instruction of the mutation, by weight, and the dimensions that its value stands for; definitions without an instruction are left out."""
        given = [{"name": "custom", **m} for m in self.params.get("mutations") or [] if isinstance(m, dict) and m.get("instruction") and float(m.get("weight", 1)) >= 0]
        known = given or [{"name": "rephrase", "instruction": "Ask for the same in another way.", "weight": 1.0}]
        total = sum(float(m.get("weight", 1)) for m in known) or 1.0
        u, at = uniform(self.seed, "mutation", F.col("id")), 0.0
        name = text = F
        stands: dict[str, Column] = {"difficulty": F.when(F.lit(False), ""), "question_type": F.when(F.lit(False), "")}
        for m in known:
            at += float(m.get("weight", 1)) / total
            values, which = m.get("values") or [""], uniform(self.seed, "value", F.col("id"))
            chosen = pick([m["instruction"].replace("{value}", str(v)) for v in values], which)
            name, text = name.when(u < at + 1e-12, m["name"]), text.when(u < at + 1e-12, chosen)
            for d, c in stands.items():
                stands[d] = c.when(u < at + 1e-12, pick([str(v) for v in values], which) if m.get("override_field") == d and m.get("values") else None)
        return name, text, stands

    def generate(self, spark: SparkSession, seeds: DataFrame | None = None) -> DataFrame:
        given = self.table(spark, "seeds", seeds)
        rows = self.prompts(spark, given)
        name, text, stands = self.mutation()
        rows = rows.withColumns({"mutation": F.when(F.col("mode") == "mutate", name), "directive": F.when(F.col("mode") == "mutate", text).when(F.col("mode") == "crossover", F.lit("Combine what both examples ask for."))})
        kinds = {"question_type": DIMENSIONS["question_type"], "difficulty": DIMENSIONS["difficulty"]}
        rows = rows.withColumns({d: F.coalesce(F.when(F.col("mode") == "mutate", stands[d]), F.lit(self.params.get(d)), pick(v, uniform(self.seed, d, F.col("id")))) for d, v in kinds.items()})
        keys = KEYS["seed_multi_turn" if self.params.get("multi_turn") else "seed"]
        asked = rows.withColumn("prompt", prompt("seed", labelled("Topic", F.col("topic")), labelled("Kind of question", F.col("question_type")), labelled("Difficulty", F.col("difficulty")), F.col("directive"), F.array_join(F.col("e")["x"], "\n\n"), keys, lang=self.lang))
        return parsing.parse_samples(self.ask(asked.drop("e"))).withColumn("strategy", F.lit("seed_driven")).withColumn("id", F.col("id").cast("string"))


class EvolInstruct(Generator):
    """Rounds of rewriting; only the latest pool feeds the next round, and all rounds are kept."""

    def estimate(self) -> int:
        p = self.params
        pool = out = int(p.get("seed_count", 0))
        for _ in range(int(p.get("rounds", 1))):
            pool = math.ceil(pool * (float(p.get("depth_rate", 1.0)) + int(p.get("branch_factor", 1))))
            out += pool
        return out

    def evolve(self, pool: DataFrame, round_: int) -> DataFrame:
        """Valid rewritings of a pool of (id, seed_index, instruction, chain, topic)."""
        depth, breadth = min(1.0, max(0.0, float(self.params.get("depth_rate", 1.0)))), int(self.params.get("branch_factor", 1))
        kinds = list(self.params.get("depth_operators", DEPTH))
        u = uniform(self.seed, "depth", F.lit(round_), F.col("id"))
        kind = pick(kinds, uniform(self.seed, "kind", F.lit(round_), F.col("id")))
        jobs = F.concat(F.when(u < depth, F.array(kind)).otherwise(F.array().cast("array<string>")), F.array(*[F.lit(f"breadth_{i}") for i in range(breadth)]).cast("array<string>"))
        rows = pool.select("*", F.posexplode(jobs).alias("job", "evolution_type"))
        rows = rows.withColumn("prompt", prompt("evolve", labelled("Way", F.col("evolution_type")), labelled("Topic", F.col("topic")), labelled("Instruction", F.col("instruction")), lang=self.lang))
        got = self.ask(rows, PLAIN).withColumn("evolved", T.clean_evolved(F.coalesce("reply", F.lit(""))))
        low, high = float(self.params.get("min_length_ratio", 0.5)), float(self.params.get("max_length_ratio", 5.0))
        got = got.where(quality.evolution_is_valid(F.col("evolved"), F.col("instruction"), low, high))
        return got.select(F.concat_ws(".", "id", "job").alias("id"), "seed_index", "topic", F.col("evolved").alias("instruction"), F.concat("chain", F.array("evolution_type")).alias("chain"), F.lit(round_).alias("evolution_round"))

    def generate(self, spark: SparkSession, seeds: DataFrame | None = None) -> DataFrame:
        given = self.table(spark, "seeds", seeds).where(F.length(T.strip("instruction")) > 0)
        first = given.select(F.col("_ord").cast("string").alias("id"), F.col("_ord").cast("long").alias("seed_index"), (F.col("topic") if "topic" in given.columns else F.lit("")).alias("topic"), "instruction", F.array().cast("array<string>").alias("chain"), F.lit(0).alias("evolution_round"))
        pool, rounds = first, []
        for r in range(1, int(self.params.get("rounds", 1)) + 1):
            pool = self.evolve(pool, r)
            rounds.append(pool)
        every = rounds[0] if rounds else first
        for other in rounds[1:]:
            every = every.union(other)
        if self.params.get("include_seeds") or not rounds or every.isEmpty():
            every = first.union(every) if rounds else first
        if not self.params.get("generate_answers", True):
            return every.withColumns({"output": F.lit(""), "strategy": F.lit("evol_instruct")})
        keys = KEYS["answer_reasoning" if self.params.get("require_reasoning") else "answer"]
        asked = every.withColumn("prompt", prompt("answer", labelled("Topic", F.col("topic")), labelled("Instruction", F.col("instruction")), keys, lang=self.lang)).withColumnRenamed("instruction", "asked")
        made = parsing.parse_samples(self.ask(asked)).withColumn("instruction", F.col("asked")).drop("asked")
        return made.withColumn("strategy", F.lit("evol_instruct"))


class Backtranslation(Generator):
    """Instructions for given texts, which stay the outputs."""

    def generate(self, spark: SparkSession, docs: DataFrame | None = None) -> DataFrame:
        given = self.limited(self.table(spark, "documents", docs))
        asked = given.withColumn("prompt", prompt("backtranslate", labelled("Title", F.col("title")), labelled("Document", F.col("text")), KEYS["backtranslate"], lang=self.lang))
        made = parsing.parse_backtranslation(self.ask(asked))
        valid = quality.backtranslation_is_valid(F.col("instruction"), F.col("text"), int(self.params.get("max_instruction_length", 500)))
        return made.where(valid).withColumn("strategy", F.lit("instruction_backtranslation"))


class DocumentQa(Generator):
    """Questions and answers grounded in chunks, whose text stays with the sample."""

    def generate(self, spark: SparkSession, chunks: DataFrame | None = None) -> DataFrame:
        given = self.limited(self.table(spark, "chunks", chunks))
        asked = given.withColumn("prompt", prompt("document_qa", labelled("Title", F.col("title")), labelled("Document", F.col("text")), KEYS["document_qa"], lang=self.lang))
        made = parsing.parse_document_qa(self.ask(asked)).withColumnRenamed("text", "source_text")
        valid = quality.document_qa_is_valid(F.col("instruction"), F.col("output"), int(self.params.get("max_instruction_length", 500)), int(self.params.get("max_output_length", 4000)))
        return made.where(valid).withColumn("strategy", F.lit("document_qa"))


class Composite(Generator):
    """Strategies one after another; with ``weighted`` their prompt counts follow their weights."""

    def __init__(self, parts: list[Generator], weights: list[float] | None = None, total: int | None = None):
        self.parts = parts
        if weights and total:
            for part, n in zip(parts, apportion(total, weights)):
                part.params = {**part.params, "target_count": n, "count": n}

    def generate(self, spark: SparkSession) -> DataFrame:
        out = None
        for i, part in enumerate(self.parts):
            rows = part.generate(spark).withColumn("strategy_no", F.lit(i))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def estimate(self) -> int:
        return sum(p.estimate() for p in self.parts)


STRATEGIES: dict[str, type[Generator]] = {"topic_driven": TopicDriven, "seed_driven": SeedDriven, "evol_instruct": EvolInstruct, "document_qa": DocumentQa, "instruction_backtranslation": Backtranslation}
