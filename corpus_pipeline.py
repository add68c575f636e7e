"""A training corpus from ``documents``: five stages, each over all that its predecessor kept.

Quality rules drop failing lines and rejected documents; of each group of near duplicates the document with the least
id stays; contaminated documents go; secrets are masked in the text; the rest is mixed by weighted fair queueing.

Every stage takes and returns the documents' columns (the last adds the mix). ``n_chars`` follows the text where a
stage changes it. Columns travel in one struct beside the text, so no name can clash with an operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.llm import decontaminate, jaccard, mixing, quality, secret_scan
from corpusgraph.runtime import materialise


def _boxed(docs: DataFrame, *names: str) -> DataFrame:
    """``row`` (all columns but the text), ``text`` and copies of the named columns."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(rest.alias("row"), "text", *names)


def _columns(docs: DataFrame, text: Column, changed: bool = False) -> list[Column]:
    """The columns of ``docs`` out of the box, with the given text."""
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(text.alias("text"))
        elif c == "n_chars" and changed:
            out.append(F.length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_boxed(docs)).filter("quality.kept")
    return judged.select(*_columns(docs, F.col("quality.clean_text"), changed=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(_boxed(docs, "doc_id")).select(*_columns(docs, F.col("text")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_contamination(_boxed(docs), benchmark)
    return found.filter("not contamination.contaminated").select(*_columns(docs, F.col("text")))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_boxed(docs))
    masked = secret_scan.redact(F.col("text"), F.col("secrets.spans"))
    return found.select(*_columns(docs, masked, changed=True))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix with ``mix_size``, ``mix_target`` (of the source) and ``mix_taken`` (words, repeats counted)."""
    sized = _boxed(docs, "doc_id", "source").withColumn("size", mixing.word_count("text"))
    mixed = mixing.mix_sources(sized).filter("mix.taken > 0")
    return mixed.select(
        *_columns(docs, F.col("text")), F.col("size").alias("mix_size"), F.col("mix.target").alias("mix_target"),
        F.col("mix.taken").alias("mix_taken"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_masking),
    ("mixing sources", source_mixing),
]

#: SQL can express neither the MinHash pruning nor the false-discovery control; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
