"""The registered queries over the synthetic tables, and the DuckDB SQL that gives the same rows.

All run over whole tables and whole texts. Numbers that sums of doubles decide are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sftloom.functions import json as J
from sftloom.functions import minhash, text as T, vector
from sftloom.operators import chunking, dedup, profile, quality, reshape, scoring

from . import prompts, strategies


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations") else df


def spread(df: DataFrame) -> DataFrame:
    """Costly expressions over few input splits would leave cores idle; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.collect_messages(table(spark, sf_dir, "conversations"))


def text_quality_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, sf_dir, "documents").select("lang", F.length(t).alias("n"), T.special_char_ratio(t).alias("special"), T.word_repetition_ratio(t).alias("words"), T.char_repetition_ratio(t).alias("chars"), T.ngram_diversity(t).alias("diversity"))
    keep = F.col("n").between(10, 8000) & (F.col("special") <= 0.3) & (F.col("words") <= 0.5) & (F.col("chars") <= 0.5) & (F.col("diversity") >= 0.2)
    return docs.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(keep).alias("kept"), F.max("special").alias("max_special"), F.round(F.avg("special"), 8).alias("avg_special"),
        F.round(F.avg("words"), 8).alias("avg_words"), F.max("chars").alias("max_chars"), F.round(F.avg("diversity"), 8).alias("avg_diversity"), F.min("diversity").alias("min_diversity"),
    )


SPECIAL = "len(regexp_extract_all(text, '[^a-zA-Z0-9一-鿿㐀-䶿\\s\\p{Z}!-/:-@\\[-`{-~]'))"
WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda w: w <> '')"
MEASURES = f"""
m AS (
  SELECT doc_id, lang, length(text) AS n, CASE WHEN length(text) > 0 THEN {SPECIAL} / length(text) ELSE 0 END AS special, {WORDS} AS w, lower(trim(text, chr(32) || chr(10) || chr(9) || chr(13))) AS t
  FROM documents
), g AS (
  SELECT doc_id, count(*) AS c, count(DISTINCT x) AS d FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] || chr(1) || w[i+3] || chr(1) || w[i+4])) AS x FROM m WHERE len(w) >= 5) GROUP BY doc_id
), v AS (
  SELECT doc_id, count(*) AS c, count(DISTINCT x) AS d FROM (SELECT doc_id, substr(t, i::INT, 3) AS x FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM m WHERE length(t) >= 3)) GROUP BY doc_id
), ch AS (
  SELECT doc_id, i, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS island FROM (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0)
), r AS (
  SELECT doc_id, max(run) AS run FROM (SELECT doc_id, c, island, count(*) AS run FROM ch GROUP BY ALL) GROUP BY doc_id
), q AS (
  SELECT m.doc_id, lang, n, special, coalesce((g.c - g.d) / g.c, 0) AS words, CASE WHEN r.run >= 5 THEN r.run / n ELSE 0 END AS chars, coalesce(v.d / v.c, 1) AS diversity
  FROM m LEFT JOIN g USING (doc_id) LEFT JOIN v USING (doc_id) LEFT JOIN r USING (doc_id)
)"""


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.length(t).alias("n"), T.special_char_ratio(t).alias("special"), T.word_repetition_ratio(t).alias("words"), T.char_repetition_ratio(t).alias("chars"), T.ngram_diversity(t).alias("diversity")
    )


def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("Write a text.").alias("instruction"), F.col("text").alias("output"))
    strict = quality.cleaner_rules(quality.LengthRule(5, 4000, 10, 8000), quality.RatioRule(0.05, 0.5, 0.5), quality.NgramDiversityRule(0.2))
    return quality.apply_rules(docs, strict).select("doc_id")


def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.length("text").alias("length"))
    turns = table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("source"), F.length("text").alias("length"))
    return profile.distribution(docs.union(turns), "length", ["source"])


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.length("text").alias("length"))
    return profile.histogram(docs, "length", 10).select("bin", "low", "high", "count")


def source_frequency_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("_ord"))
    return profile.frequency(docs, "source", top=15).select("source", "count", F.col("first").alias("first_doc"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_ord", F.col("doc_id"))
    return dedup.exact_dedup(docs, T.fingerprint("text")).select("doc_id", T.fingerprint("text").alias("fingerprint"))


def conversation_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).select(F.col("conv_id").alias("_ord"), "messages", F.lit("").alias("instruction"), F.lit("").alias("output"))
    rows = rows.withColumn("x", reshape.dedup_text(rows))
    return dedup.exact_dedup(rows, T.fingerprint("x")).select(F.col("_ord").alias("conv_id"))


def conversation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.normalize_messages(messages(spark, sf_dir)).select("conv_id", "instruction", "output", "system")


def format_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.format_records(messages(spark, sf_dir), "chatml")
    return rows.select("conv_id", F.posexplode("record.messages").alias("pos", "m")).select("conv_id", F.col("pos").cast("long"), "m.role", "m.content")


def format_sharegpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.format_records(messages(spark, sf_dir), "sharegpt")
    return rows.select("conv_id", F.posexplode("record.conversations").alias("pos", "m")).select("conv_id", F.col("pos").cast("long"), F.col("m.from").alias("speaker"), "m.value")


def judge_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(spark, sf_dir).select("conv_id", F.sha2(reshape.transcript(F.col("messages")), 256).alias("transcript_sha256"))


def minhash_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four permutations of every document's signature."""
    docs = table(spark, sf_dir, "documents").withColumn("_ord", F.col("doc_id"))
    signed = dedup.signatures(docs)
    return signed.select(F.col("_ord").alias("doc_id"), F.posexplode(F.slice("signature", 1, 4)).alias("perm", "value")).withColumn("perm", F.col("perm").cast("long"))


def minhash_signatures_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All permutations of every document's signature."""
    signed = dedup.signatures(table(spark, sf_dir, "documents").withColumn("_ord", F.col("doc_id")))
    return signed.select(F.col("_ord").alias("doc_id"), F.posexplode("signature").alias("perm", "value")).withColumn("perm", F.col("perm").cast("long"))


def near_dup_greedy_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_ord", F.col("doc_id"))
    return dedup.MinHashDedup()(docs, F.col("text")).select("doc_id")


def similarity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("_ord", F.col("doc_id"))
    dedup.checkpoints(spark)
    rows = dedup.similarity_profile(dedup.signatures(docs).checkpoint())[1]
    return rows.select(F.col("_ord").alias("doc_id"), "max_similarity", "near_duplicate")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_ord"), F.col("embedding").alias("v"))


def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.semantic_pairs(vectors(spark, sf_dir), 0.4).select("i", "j", F.round("similarity", 5).alias("similarity"))


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("_ord", F.col("vec_id"))
    return dedup.SemanticDedup(0.4)(rows).select("vec_id", "label")


def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunking.sentences(F.col("text"))).alias("pos", "s")).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"), F.sum(F.length("s")).alias("total"))


def structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return chunking.chunk_documents(docs).select(F.col("source_id").alias("doc_id"), "id", F.col("chunk_index").cast("long"), F.col("chunk_count").cast("long"), F.length("text").alias("chars"))


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    clean = pages.select("page_id", T.normalize_text("html").alias("t"))
    return clean.select("page_id", F.sha2("t", 256).alias("normalized_sha256"), F.length("t").alias("chars"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three judges derived from the labels: they agree on quality and differ by the id's residues; judge c has no answer for every seventh row."""
    labels = table(spark, sf_dir, "labels")
    base = F.col("quality") * 6 + F.pmod("doc_id", F.lit(4))

    def scores(shift: Column) -> Column:
        return F.create_map(F.lit("accuracy"), (base + shift).cast("double"), F.lit("clarity"), (F.lit(8) - F.col("toxic") * 5 - shift).cast("double"))

    judges = [("a", scores(F.lit(0))), ("b", scores(F.pmod("doc_id", F.lit(3)))), ("c", F.when(F.pmod("doc_id", F.lit(7)) != 0, scores(F.lit(1))))]
    entries = F.array(*[F.struct(F.lit(n).alias("judge"), s.alias("scores")) for n, s in judges])
    return labels.select(F.col("doc_id").alias("_ord"), F.explode(entries).alias("j")).select("_ord", "j.judge", "j.scores")


def judge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.aggregate_judges(judged(spark, sf_dir), how="mean", min_judges=3)
    return rows.select(F.col("_ord").alias("doc_id"), F.round(F.col("scores")["accuracy"], 6).alias("accuracy"), F.round(F.col("scores")["clarity"], 6).alias("clarity"), F.round("total_score", 6).alias("total_score"), "judge_count", "judge_disagreement", "cross_validation_failed")


def judge_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.aggregate_judges(judged(spark, sf_dir), how="median")
    return rows.select(F.col("_ord").alias("doc_id"), "total_score", "judge_count", "judge_disagreement")


def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.aggregate_judges(judged(spark, sf_dir), how="max", min_judges=2)
    return quality.score_filter(rows, 14.0, 1.0).select(F.col("_ord").alias("doc_id"), "total_score", "judge_disagreement")


def score_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.score_distributions(judged(spark, sf_dir))


def parse_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object keys of the events' JSON, and how many values are numbers."""
    events = table(spark, sf_dir, "events")
    parsed = events.select("event_type", F.from_json(J.extract_json("props").cast("string"), "map<string,string>").alias("m"))
    rows = parsed.select("event_type", F.explode("m").alias("key", "value"))
    return rows.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.count_if(F.col("value").try_cast("double").isNotNull()).alias("numbers"), F.count_distinct("value").alias("kinds"))


def plan_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots for 100 items by language, in proportion to the documents."""
    counted = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    counts = strategies.apportion(100, [r.n for r in counted])
    return strategies.plan_slots(spark, [r.lang for r in counted], counts)


def context_reference_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    docs = table(spark, sf_dir, "documents")
    rows = turns.select(F.lit("conversations").alias("source"), "text").union(docs.select(F.lit("documents").alias("source"), "text"))
    return rows.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(T.refers_to_context("text")).alias("refers"), F.count_if(T.is_refusal("text")).alias("refuses"))


def length_ratio_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns against the turn before them, as an evolved instruction is judged against its original."""
    turns = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.withColumn("before", before).where("before is not null")
    return rows.where(quality.evolution_is_valid(F.col("text"), F.col("before"), 0.5, 2.0)).select("conv_id", "turn", T.length_ratio("text", "before").alias("ratio"))


def angle_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each source and opening word."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_ord"), F.col("source").alias("topic"), F.get(F.split("text", r"\s"), F.lit(0)).alias("angle"))
    return dedup.dedup_angles(docs).select(F.col("_ord").alias("doc_id"), F.col("topic").alias("source"))


def execution_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 1).alias("topic"))
    rows = strategies.batches(plan, 2, "topic", "item_id")
    return rows.groupBy("topic", "batch").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item"))


def backtranslation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sftloom.sources.readers import backtranslation_documents as fitting

    docs = fitting(table(spark, sf_dir, "documents"), 50, 8000)
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


def cosine_to_label_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cosine of each label's vectors to the label's first vector."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return rows.join(first, "label").groupBy("label").agg(F.round(F.avg(vector.cosine_similarity(F.col("embedding"), F.col("first"))), 5).alias("mean_cosine"), F.count("*").alias("n"))


def cleaned_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaner on chats: normalised messages of those that the length and ratio rules keep."""
    from . import config, pipeline

    rows = messages(spark, sf_dir).select(F.col("conv_id").alias("_ord"), F.lit("").alias("instruction"), F.lit("").alias("output"), "messages")
    kept = pipeline.clean_rows(rows, config.Cleaner(minhash_dedup=False, min_instruction_length=20, min_output_length=40, max_output_length=3000, max_word_repetition=0.4, min_ngram_diversity=0.0))
    return kept.select(F.col("_ord").alias("conv_id"), F.sha2(reshape.transcript(F.col("messages")), 256).alias("transcript_sha256"), F.sha2("instruction", 256).alias("instruction_sha256"))


def seed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = reshape.seed_pair(F.col("messages"))
    return messages(spark, sf_dir).select("conv_id", first.alias("instruction"), second.alias("output"))


def validator_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, answer = reshape.validator_texts(F.col("messages"))
    return messages(spark, sf_dir).select("conv_id", user.alias("instruction"), answer.alias("output"))


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes and empty fields of chats and documents together."""
    from . import pipeline

    chats = messages(spark, sf_dir).select(F.lit("").alias("instruction"), F.lit("").alias("output"), "messages")
    docs = table(spark, sf_dir, "documents").select(F.lit("").alias("instruction"), F.col("text").alias("output"), F.lit(None).cast(chats.schema["messages"].dataType).alias("messages"))
    return profile.format_counts(pipeline.flat(chats.union(docs)))


def repetition_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = profile.repetition_summary(table(spark, sf_dir, "documents"), "text")
    return rows.select(*[F.round(c, 8).alias(c) if c.startswith("mean") else F.col(c) for c in rows.columns])


def document_qa_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of two as question and answer."""
    rows = seed_pairs(spark, sf_dir)
    return rows.where(quality.document_qa_is_valid(F.col("instruction"), F.col("output"), 400, 1500)).select("conv_id")


def fenced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in code fences and quotes, taken out again."""
    t = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("```json\n"), t, F.lit("\n```")).alias("fenced"), F.concat(F.lit(' "'), T.strip(t), F.lit('" ')).alias("quoted"))
    return docs.select("doc_id", F.sha2(T.strip_fences("fenced"), 256).alias("unfenced_sha256"), F.length(T.clean_evolved("quoted")).alias("unquoted_chars"))


def public_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' JSON without private ones."""
    events = table(spark, sf_dir, "events").select("event_id", F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("_private"), F.lit("1"))).alias("m"))
    kept = events.select("event_id", F.explode(F.map_keys(reshape.public_metadata(F.col("m")))).alias("key"))
    return kept.groupBy("key").agg(F.count("*").alias("events"))


def plan_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = table(spark, sf_dir, "documents").select(F.col("lang").alias("topic"), F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("sub_topic"))
    return profile.plan_breakdown(plan)


def topic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of topic codes; the documents' languages are no codes."""
    codes = F.array(*map(F.lit, prompts.TOPICS))
    code = F.coalesce(F.get(codes, (F.col("doc_id") % 12).cast("int")), F.col("lang"))
    return table(spark, sf_dir, "documents").groupBy(prompts.topic_name(code).alias("name"), prompts.topic_name(code, "zh").alias("name_zh")).agg(F.count("*").alias("n"))


def task_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.concat(F.lit(" "), F.when(F.col("doc_id") % 3 == 0, F.upper(F.lit("qa"))).when(F.col("doc_id") % 3 == 1, F.lit("how_to")).otherwise(F.col("lang"))).alias("kind"))
    return words.groupBy(T.task_type("kind").alias("task_type")).agg(F.count("*").alias("n"))


def minhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each benchmark item's signature, all 128 values, to the next item's."""
    items = table(spark, sf_dir, "benchmark").withColumn("_ord", F.col("item_id"))
    signed = dedup.signatures(items).select(F.col("_ord").alias("item_id"), "signature")
    after = signed.select((F.col("item_id") - 1).alias("item_id"), F.col("signature").alias("other"))
    return signed.join(after, "item_id").select("item_id", minhash.minhash_similarity(F.col("signature"), F.col("other")).alias("similarity"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item as it is, without its end, and twice over; small enough for SQL that hashes all 128 permutations."""
    items = table(spark, sf_dir, "benchmark")
    t = F.col("text")
    kinds = F.array(t, F.expr("substring(text, 1, length(text) - 10)"), F.concat(t, F.lit(" "), t), t)
    return items.select("item_id", F.posexplode(kinds).alias("k", "text")).select((F.col("item_id") * 4 + F.col("k")).alias("_ord"), "text")


def near_dup_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy survivors among candidates of bands."""
    return dedup.MinHashDedup()(variants(spark, sf_dir), F.col("text")).select(F.col("_ord").alias("item"))


def near_dup_variants_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy survivors among all pairs."""
    return dedup.MinHashDedup(use_lsh=False)(variants(spark, sf_dir), F.col("text")).select(F.col("_ord").alias("item"))


def similarity_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest similarity of each row, with the table's share of near duplicates."""
    dedup.checkpoints(spark)
    rows = dedup.similarity_profile(dedup.signatures(variants(spark, sf_dir)).checkpoint())[1]
    ratio = profile.near_duplicate_summary(rows)
    return rows.crossJoin(F.broadcast(ratio)).select(F.col("_ord").alias("item"), "max_similarity", "near_duplicate", "near_duplicates", "ratio")  # one row


def score_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each judge's total; none where it failed."""
    scored = scoring.with_scores(judged(spark, sf_dir).withColumnRenamed("scores", "given"), F.col("given"))
    return scored.groupBy("judge").agg(F.sum("total_score").alias("total"), F.count("total_score").alias("scored"), F.count("*").alias("rows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        text_quality_by_lang, text_measures, rule_filter, length_distribution, length_histogram, source_frequency_topk, exact_dedup, conversation_dedup, conversation_flatten, format_chatml, format_sharegpt,
        judge_transcript, minhash_signatures, minhash_signatures_all, near_dup_greedy_survivors, similarity_profile, semantic_pairs, semantic_dedup, sentence_segments, structure_chunks, normalized_text, judge_aggregate, judge_median,
        cleaned_conversations, seed_pairs, validator_texts, dataset_counts, repetition_summary, document_qa_filter, fenced_texts, public_props, plan_breakdown, topic_names, task_types, minhash_neighbours, near_dup_variants, near_dup_variants_all_pairs, similarity_variants, score_totals,
        score_filter, score_distributions, parse_props_json, plan_slots, context_reference_filter, length_ratio_filter, angle_dedup, execution_batches, backtranslation_documents, cosine_to_label_mean,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


STRIPPED = "trim(text, chr(32) || chr(10) || chr(9) || chr(13))"
CONV = "string_agg(coalesce(text, ''), '{sep}' ORDER BY turn, role, text)"
JUDGED = """
b AS (SELECT doc_id, quality * 6 + doc_id % 4 AS base, 8 - toxic * 5 AS clear FROM labels),
j AS (
  SELECT doc_id, 'a' AS judge, base::DOUBLE AS accuracy, clear::DOUBLE AS clarity FROM b
  UNION ALL SELECT doc_id, 'b', (base + doc_id % 3)::DOUBLE, (clear - doc_id % 3)::DOUBLE FROM b
  UNION ALL SELECT doc_id, 'c', (base + 1)::DOUBLE, (clear - 1)::DOUBLE FROM b WHERE doc_id % 7 <> 0
)"""


def _distribution(rows: str, by: str) -> str:
    return f"""
WITH d AS ({rows}), s AS (SELECT {by}, v, row_number() OVER (PARTITION BY {by} ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {by}) AS n FROM d WHERE v IS NOT NULL)
SELECT {by}, count(*) AS count, min(v) AS min, max(v) AS max, sum(v::DOUBLE) / count(*) AS mean,
       (max(v) FILTER (i = (n - 1) // 2) + max(v) FILTER (i = n // 2)) / 2 AS median,
       max(v) FILTER (i = n // 4) AS p25, max(v) FILTER (i = 3 * n // 4) AS p75, max(v) FILTER (i = 9 * n // 10) AS p90, max(v) FILTER (i = least(n - 1, 95 * n // 100)) AS p95
FROM s GROUP BY {by}"""


def _signatures_sql(perms: int = 4, of: str = "documents", key: str = "doc_id") -> str:
    a, b = minhash.coefficients(128, 42)
    rows = ", ".join(f"({i}, {a[i]}::HUGEINT, {b[i]}::HUGEINT)" for i in range(perms))
    return f"""
WITH t AS (SELECT {key} AS doc_id, lower({STRIPPED}) AS t FROM {of}),
g AS (
  SELECT DISTINCT doc_id, substr(t, i::INT, 3) AS x FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM t WHERE length(t) >= 3)
  UNION SELECT doc_id, t FROM t WHERE length(t) BETWEEN 1 AND 2
), h AS (SELECT x, ('0x' || substr(sha256('42:' || x), 1, 16))::UBIGINT::HUGEINT AS h FROM (SELECT DISTINCT x FROM g)),
c(perm, a, b) AS (VALUES {rows}),
p AS (SELECT x, perm::BIGINT AS perm, ((a * (h % 2305843009213693951) % 2305843009213693951 + b) % 2305843009213693951)::BIGINT AS v FROM h, c)
SELECT t.doc_id, q.perm, coalesce(s.value, 0) AS value FROM t CROSS JOIN (SELECT perm::BIGINT AS perm FROM c) q
LEFT JOIN (SELECT doc_id, perm, min(v) AS value FROM g JOIN p USING (x) GROUP BY ALL) s ON s.doc_id = t.doc_id AND s.perm = q.perm"""


_REFERS = r"根据(上文|原文|这篇文章|上述内容|给定材料)|阅读(上文|原文|这篇文章|以下材料)|上述(文章|文本|内容|材料)|\b(text|passage|document|article)\s+(above|given|provided)\b|\b(given|provided)\s+(text|passage|document|article)\b"
_REFUSES = " OR ".join("contains(lower(text), '" + p.replace("'", "''") + "')" for p in T.REFUSALS)
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?;。！？；])\\s+', '\\1' || chr(2), 'g'), chr(2)), lambda s: trim(s)), lambda s: s <> '')"

_TURNS = "SELECT conv_id, coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text) FILTER (role = 'user'), '') AS instruction, coalesce(string_agg(coalesce(text, ''), ' ' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS output FROM conversations GROUP BY conv_id"
_CODES = ", ".join(f"({i}, '{en}', '{zh}')" for i, (en, zh) in enumerate(prompts.TOPICS.values()))
_SEEDS = "SELECT conv_id, arg_min(coalesce(text, ''), turn) FILTER (role = 'user') AS instruction, arg_min(coalesce(text, ''), turn) FILTER (role = 'assistant') AS output FROM conversations GROUP BY conv_id"

_VARIANTS = """(SELECT item_id * 4 + k AS item, CASE k WHEN 1 THEN substr(text, 1, length(text) - 10) WHEN 2 THEN text || ' ' || text ELSE text END AS text FROM benchmark, (VALUES (0), (1), (2), (3)) x(k)) y"""
_MEET = f"s AS ({_signatures_sql(128, _VARIANTS, 'item')}), m AS (SELECT a.doc_id AS i, b.doc_id AS j, a.perm FROM s a JOIN s b ON a.perm = b.perm AND a.value = b.value AND a.doc_id < b.doc_id)"
_GREEDY = """o AS (SELECT j, list(i) AS low, row_number() OVER (ORDER BY j) AS k FROM p GROUP BY j),
g(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.k + 1, CASE WHEN len(list_filter(o.low, lambda x: NOT list_contains(g.gone, x))) > 0 THEN list_append(g.gone, o.j) ELSE g.gone END FROM g JOIN o ON o.k = g.k + 1),
z AS (SELECT unnest(gone) AS id FROM g WHERE k = (SELECT max(k) FROM g))"""


def _candidates(rows: int) -> str:
    return f"c AS (SELECT i, j FROM (SELECT i, j, perm // {rows} AS band, count(*) AS n FROM m WHERE perm < {128 // rows * rows} GROUP BY ALL) WHERE n = {rows} GROUP BY i, j)"


ORACLES: dict[str, str] = {
    "near_dup_variants": f"WITH RECURSIVE {_MEET}, {_candidates(6)}, p AS (SELECT i, j FROM m JOIN c USING (i, j) GROUP BY i, j HAVING count(*) / 128 >= 0.7), {_GREEDY} SELECT DISTINCT doc_id AS item FROM s WHERE doc_id NOT IN (SELECT id FROM z)",
    "near_dup_variants_all_pairs": f"WITH RECURSIVE {_MEET}, p AS (SELECT i, j FROM m GROUP BY i, j HAVING count(*) / 128 >= 0.7), {_GREEDY} SELECT DISTINCT doc_id AS item FROM s WHERE doc_id NOT IN (SELECT id FROM z)",
    "similarity_variants": f"WITH {_MEET}, {_candidates(4)}, e AS (SELECT i, j, count(*) / 128 AS sim FROM m JOIN c USING (i, j) GROUP BY i, j), b AS (SELECT i AS item, sim FROM e UNION ALL SELECT j, sim FROM e), r AS (SELECT d.item, coalesce(max(sim), 0) AS max_similarity FROM (SELECT DISTINCT doc_id AS item FROM s) d LEFT JOIN b USING (item) GROUP BY d.item) SELECT *, max_similarity >= 0.7 AS near_duplicate, count(*) FILTER (max_similarity >= 0.7) OVER () AS near_duplicates, count(*) FILTER (max_similarity >= 0.7) OVER () / count(*) OVER () AS ratio FROM r",
    "semantic_dedup": f"WITH RECURSIVE p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4), {_GREEDY} SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM z)",
    "cleaned_conversations": f"""WITH v AS ({_TURNS}), w AS (SELECT *, {WORDS.replace('text', 'output')} AS w FROM v),
g AS (SELECT conv_id, count(*) AS c, count(DISTINCT x) AS d FROM (SELECT conv_id, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i] || chr(1) || w[i+1] || chr(1) || w[i+2] || chr(1) || w[i+3] || chr(1) || w[i+4])) AS x FROM w WHERE len(w) >= 5) GROUP BY conv_id),
k AS (SELECT v.* FROM v LEFT JOIN g USING (conv_id) WHERE length(instruction) BETWEEN 20 AND 4000 AND length(output) BETWEEN 40 AND 3000 AND coalesce((c - d) / c, 0) <= 0.4)
SELECT conv_id, sha256(string_agg('[' || role || ']: ' || coalesce({STRIPPED}, ''), chr(10) ORDER BY turn, role, text)) AS transcript_sha256, sha256(trim(any_value(instruction))) AS instruction_sha256 FROM conversations JOIN k USING (conv_id) GROUP BY conv_id""",
    "seed_pairs": _SEEDS,
    "validator_texts": _TURNS,
    "dataset_counts": f"WITH r AS (SELECT 1 AS chat, instruction, output FROM ({_TURNS}) UNION ALL SELECT 0, '', text FROM documents) SELECT count(*) AS total, count(*) FILTER (chat = 1) AS multi_turn, count(*) FILTER (chat = 0) AS single_turn, count(*) FILTER (coalesce(instruction, '') = '') AS empty_instruction, count(*) FILTER (coalesce(output, '') = '') AS empty_output FROM r",
    "repetition_summary": f"WITH {MEASURES} SELECT max(words) AS max_word, round(avg(words), 8) AS mean_word, count(*) FILTER (words > 0.1) AS high_word, max(chars) AS max_char, round(avg(chars), 8) AS mean_char, count(*) FILTER (chars > 0.02) AS high_char FROM q",
    "document_qa_filter": f"SELECT conv_id FROM ({_SEEDS}) WHERE length(instruction) BETWEEN 1 AND 400 AND length(output) BETWEEN 1 AND 1500 AND NOT regexp_matches(instruction, '{_REFERS}', 'i')",
    "fenced_texts": f"SELECT doc_id, sha256({STRIPPED}) AS unfenced_sha256, length({STRIPPED})::INT AS unquoted_chars FROM documents",
    "public_props": "SELECT key, count(*) AS events FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "plan_breakdown": "SELECT coalesce(lang, '(unknown)') AS topic, CASE WHEN doc_id % 5 <> 0 AND source <> '' THEN source ELSE '(unnamed)' END AS sub_topic, count(*) AS items FROM documents GROUP BY ALL",
    "topic_names": f"WITH c(k, en, zh) AS (VALUES {_CODES}) SELECT coalesce(en, lang) AS name, coalesce(zh, lang) AS name_zh, count(*) AS n FROM documents LEFT JOIN c ON doc_id % 12 = k GROUP BY ALL",
    "task_types": "SELECT CASE doc_id % 3 WHEN 0 THEN 'qa' WHEN 1 THEN 'how_to' ELSE 'other' END AS task_type, count(*) AS n FROM documents GROUP BY ALL",
    "minhash_neighbours": f"WITH s AS ({_signatures_sql(128, 'benchmark', 'item_id')}) SELECT a.doc_id AS item_id, count(*) FILTER (a.value = b.value) / 128 AS similarity FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 AND a.perm = b.perm GROUP BY a.doc_id",
    "score_totals": f"WITH {JUDGED} SELECT judge, sum(accuracy + clarity) AS total, count(*) AS scored, (SELECT count(*) FROM labels) AS rows FROM j GROUP BY judge",
    "text_quality_by_lang": f"WITH {MEASURES} SELECT lang, count(*) AS docs, count(*) FILTER (n BETWEEN 10 AND 8000 AND special <= 0.3 AND words <= 0.5 AND chars <= 0.5 AND diversity >= 0.2) AS kept, max(special) AS max_special, round(avg(special), 8) AS avg_special, round(avg(words), 8) AS avg_words, max(chars) AS max_chars, round(avg(diversity), 8) AS avg_diversity, min(diversity) AS min_diversity FROM q GROUP BY lang",
    "text_measures": f"WITH {MEASURES} SELECT doc_id, n::INT AS n, special, words, chars, diversity FROM q",
    "rule_filter": f"WITH {MEASURES} SELECT doc_id FROM q WHERE n BETWEEN 10 AND 8000 AND special <= 0.05 AND words <= 0.5 AND chars <= 0.5 AND diversity >= 0.2",
    "length_distribution": _distribution("SELECT 'documents' AS source, length(text)::INT AS v FROM documents UNION ALL SELECT 'conversations', length(text)::INT FROM conversations", "source"),
    "length_histogram": """
WITH d AS (SELECT length(text)::DOUBLE AS v FROM documents WHERE text IS NOT NULL), e AS (SELECT min(v) AS lo, max(v) AS hi, count(DISTINCT v) AS kinds FROM d),
k AS (SELECT lo, hi, CASE WHEN hi = lo THEN 1 ELSE greatest(1, CASE WHEN hi - lo < least(10, kinds) THEN least(least(10, kinds), greatest(2, floor(hi - lo) + 1)) ELSE least(10, kinds) END) END AS bins FROM e),
w AS (SELECT lo, bins, CASE WHEN hi = lo THEN 1 ELSE (hi - lo) / bins END AS width FROM k),
p AS (SELECT least(floor((v - lo) / width)::INT, bins - 1)::INT AS bin, lo, width FROM d, w)
SELECT bin, lo + bin * width AS low, lo + (bin + 1) * width AS high, count(*) AS count FROM p GROUP BY bin, lo, width""",
    "source_frequency_topk": "SELECT source, count(*) AS count, min(doc_id) AS first_doc FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY count DESC, first_doc LIMIT 15",
    "exact_dedup": f"WITH f AS (SELECT doc_id, sha256(lower(trim(coalesce(text, ''), chr(32) || chr(10) || chr(9) || chr(13)))) AS fingerprint FROM documents) SELECT min(doc_id) AS doc_id, fingerprint FROM f GROUP BY fingerprint",
    "conversation_dedup": f"WITH c AS (SELECT conv_id, {CONV.format(sep=' ')} AS x FROM conversations GROUP BY conv_id) SELECT min(conv_id) AS conv_id FROM c GROUP BY lower(trim(x, chr(32) || chr(10)))",
    "conversation_flatten": """
SELECT * FROM (SELECT conv_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role = 'user'), '') AS instruction, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS output,
  coalesce(last(text ORDER BY turn) FILTER (role = 'system'), '') AS system FROM conversations GROUP BY conv_id) WHERE instruction <> '' OR output <> ''""",
    "format_chatml": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, role, text AS content FROM conversations",
    "format_sharegpt": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS speaker, text AS value FROM conversations WHERE role IN ('system', 'user', 'assistant')",
    "judge_transcript": "SELECT conv_id, sha256(string_agg('[' || role || ']: ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text)) AS transcript_sha256 FROM conversations GROUP BY conv_id",
    "minhash_signatures": _signatures_sql(),
    "semantic_pairs": "SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4",
    "sentence_segments": f"WITH s AS (SELECT doc_id, unnest({_SENTENCES}) AS s FROM documents) SELECT doc_id, count(*) AS sentences, max(length(s))::INT AS longest, sum(length(s))::BIGINT AS total FROM s GROUP BY doc_id",
    "judge_aggregate": f"""WITH {JUDGED}
SELECT b.doc_id, CASE WHEN count(*) >= 3 THEN round(avg(accuracy), 6) END AS accuracy, CASE WHEN count(*) >= 3 THEN round(avg(clarity), 6) END AS clarity, CASE WHEN count(*) >= 3 THEN round(avg(accuracy) + avg(clarity), 6) ELSE 0 END AS total_score, count(*) AS judge_count,
  CASE WHEN count(*) >= 3 THEN greatest(max(accuracy) - min(accuracy), max(clarity) - min(clarity)) ELSE 0 END AS judge_disagreement, count(*) < 3 AS cross_validation_failed FROM b JOIN j USING (doc_id) GROUP BY b.doc_id""",
    "judge_median": f"WITH {JUDGED} SELECT doc_id, median(accuracy) + median(clarity) AS total_score, count(*) AS judge_count, greatest(max(accuracy) - min(accuracy), max(clarity) - min(clarity)) AS judge_disagreement FROM j GROUP BY doc_id",
    "score_filter": f"WITH {JUDGED} SELECT doc_id, max(accuracy) + max(clarity) AS total_score, greatest(max(accuracy) - min(accuracy), max(clarity) - min(clarity)) AS judge_disagreement FROM j GROUP BY doc_id HAVING count(*) >= 2 AND max(accuracy) + max(clarity) >= 14 AND greatest(max(accuracy) - min(accuracy), max(clarity) - min(clarity)) <= 1",
    "score_distributions": _distribution(f"WITH {JUDGED} SELECT 'accuracy' AS dimension, accuracy AS v FROM j UNION ALL SELECT 'clarity', clarity FROM j", "dimension"),
    "parse_props_json": "WITH k AS (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events), v AS (SELECT event_type, key, json_extract_string(props, '$.\"' || key || '\"') AS value FROM k) SELECT event_type, key, count(*) AS n, count(try_cast(value AS DOUBLE)) AS numbers, count(DISTINCT value) AS kinds FROM v GROUP BY event_type, key",
    "context_reference_filter": f"WITH r AS (SELECT 'conversations' AS source, text FROM conversations UNION ALL SELECT 'documents', text FROM documents) SELECT source, count(*) AS rows, count(*) FILTER (regexp_matches(text, '{_REFERS}', 'i')) AS refers, count(*) FILTER ({_REFUSES}) AS refuses FROM r GROUP BY source",
    "length_ratio_filter": f"WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, length(text) / greatest(1, length(before)) AS ratio FROM t WHERE before IS NOT NULL AND length(text) > 0 AND text <> before AND length(text) / greatest(1, length(before)) BETWEEN 0.5 AND 2.0 AND NOT ({_REFUSES})",
    "angle_dedup": "WITH d AS (SELECT doc_id, source, lower(trim(string_split_regex(text, '\\s')[1])) AS angle FROM documents) SELECT min(doc_id) AS doc_id, source FROM d WHERE angle <> '' GROUP BY source, angle",
    "execution_batches": "WITH p AS (SELECT item_id, substr(text, 1, 1) AS topic, ((row_number() OVER (PARTITION BY substr(text, 1, 1) ORDER BY item_id) - 1) // 2)::INT AS batch FROM benchmark) SELECT topic, batch, count(*) AS n, min(item_id) AS first_item FROM p GROUP BY topic, batch",
    "backtranslation_documents": f"SELECT lang, count(*) AS docs, sum(length({STRIPPED}))::BIGINT AS chars FROM documents WHERE length({STRIPPED}) BETWEEN 50 AND 8000 GROUP BY lang",
    "cosine_to_label_mean": "WITH f AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label) SELECT label, round(avg(list_cosine_similarity(embedding::DOUBLE[], first::DOUBLE[])), 5) AS mean_cosine, count(*) AS n FROM embeddings JOIN f USING (label) GROUP BY label",
    "plan_slots": """
WITH c AS (SELECT lang AS topic, count(*) AS w, row_number() OVER (ORDER BY lang) AS k, count(*) OVER () AS topics FROM documents GROUP BY lang),
r AS (SELECT *, greatest(1, round_even(100 * w / sum(w) OVER (), 0))::BIGINT AS share FROM c),
n AS (SELECT topic, CASE WHEN k = topics THEN 100 - coalesce(sum(share) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END AS wanted FROM r),
d AS (SELECT d.x AS difficulty, q.x AS question_type FROM (VALUES ('easy'), ('medium'), ('hard')) d(x), (VALUES ('what'), ('how'), ('why'), ('compare')) q(x)),
o AS (SELECT topic, wanted, difficulty, question_type, row_number() OVER (PARTITION BY topic ORDER BY sha256('0|' || topic || '|' || difficulty || '|' || question_type)) - 1 AS pos FROM n, d)
SELECT topic, slot::INT AS slot, difficulty, question_type FROM (SELECT *, unnest(range(pos::BIGINT, wanted::BIGINT, 12)) AS slot FROM o)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
