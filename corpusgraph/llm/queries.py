"""One query for each operator, over its whole table, with the SQL that checks it where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import (
    collocations, decontaminate, html_text, jaccard, language_model, licenses, mixing, oracle, quality, ranked_search, secret_scan,
    substrings, token_counts, toxicity,
)
from corpusgraph.runtime import materialise

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_STATEMENTS[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


@query("op1_html_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    text = F.col("main_text")
    return found.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


@query("op4_source_mix")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sizes = materialise(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "mix-sizes")
    mixed = mixing.mix_sources(sizes)
    return mixed.select("doc_id", "size", "mix.source_size", "mix.target", "mix.taken")


@query("op7_secret_scan")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scanned = secret_scan.scan_texts(docs).withColumn("row", F.col("row").dropFields("text"))
    scanned = materialise(scanned, "secret-candidates")
    found = secret_scan.judge(scanned)
    base = F.col("secrets.base")
    counts = [
        secret_scan.n_of(base, k).cast("long").alias(f"n_{kind}") for k, kind in enumerate(secret_scan.KINDS[:-1])
    ]
    return found.select(
        "doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
        secret_scan.written(F.col("secrets.spans")).alias("spans"),
    )


@query("op8_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select("doc_id", *[f"quality.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query("op9_substring_dedup", oracle.SUBSTRINGS)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept"), 256).alias("kept_sha256"))


@query("op10_decontamination", oracle.DECONTAMINATION)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "contamination.n_words", "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"), "contamination.contaminated",
    )


@query("op3_jaccard_join")
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_lm_score")
def lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    # A row without an id has no remainder and is in neither part's name, so it is held out.
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(True)))
    model = language_model.train(docs.filter("not held_out"), order=3)
    scored = language_model.score(docs, model)
    return scored.select(
        "doc_id", "held_out", "lm.n_tokens", "lm.n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "lm.base_score", "lm.score",
    )


@query("op5_toxicity")
def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs, table(spark, sf_dir, "labels").filter(remainder != 1))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.7).cast("int").alias("predicted"),
    )


@query("op6_token_counts")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"))
    return counted.select("doc_id", "tokens.n_words", "tokens.n_tokens")


@query("op11_phrase_mining", oracle.COLLOCATIONS)
def phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


@query("op12_license_scan", oracle.licenses())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scanned = materialise(licenses.scan_texts(docs).drop("text"), "license-detections")
    found = licenses.resolve(scanned)
    base = F.col("licenses.base")
    return found.select(
        "doc_id", "licenses.n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"),
        F.array_join("licenses.labels", ",").alias("labels"), "licenses.score",
    )


@query("op13_ranked_search", oracle.RANKED_SEARCH)
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
