"""The queries on the driver's smallest tables, and the pipeline, against the plain versions."""

import os
import zlib

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import quality, secret_scan
from corpusgraph.llm.queries import ORACLE_STATEMENTS, QUERIES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data not present")


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


def agree(got, rows, want):
    found = {r["doc_id"]: r.asDict() for r in got.collect()}
    assert len(found) == len(rows)
    for r, expected in zip(rows, want, strict=True):
        assert {c: found[r["doc_id"]][c] for c in expected} == pytest.approx(expected)


@pytest.mark.parametrize("name, plain", [
    ("op7_secret_scan", brute.secrets), ("op8_quality_rules", brute.quality), ("op9_substring_dedup", brute.substrings),
])
def test_queries(spark, rows, name, plain):
    agree(QUERIES[name](spark, SF_DIR), rows, plain([r["text"] for r in rows]))


def test_near_duplicate_query(spark, rows):
    groups, links = brute.near([r["text"] for r in rows])
    least = {g: min(r["doc_id"] for r, h in zip(rows, groups, strict=True) if h == g) for g in groups}
    agree(QUERIES["op3_jaccard_join"](spark, SF_DIR), rows, [
        {"class_id": least[g], "n_links": n} for g, n in zip(groups, links, strict=True)])


def test_language_model_query(spark, rows):
    train = [r["text"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 10]
    agree(QUERIES["op2_lm_score"](spark, SF_DIR), rows, brute.kneser_ney(train, [r["text"] for r in rows], 3))


def test_decontamination_query(spark, rows):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    agree(QUERIES["op10_decontamination"](spark, SF_DIR), rows, brute.decontaminate([r["text"] for r in rows], items))


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = QUERIES["op5_toxicity"](spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    right = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double"))).first()[0]
    assert right > 0.9


def test_registered():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14)) and ORACLE_STATEMENTS.keys() <= QUERIES.keys()


def test_pipeline(spark, rows):
    """Each stage against a plain version of its decision, on the texts that reach it."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("quality", F.lit("kept")).withColumn("mix", F.lit(1))
    columns = docs.columns
    texts = {}
    for r, q in zip(rows, brute.quality([r["text"] for r in rows]), strict=True):
        lines, lost, _ = quality.clean_lines(r["text"] or "")
        if not q["base_failed"] and 100 * lost <= 40 * q["n_words"]:
            texts[r["doc_id"]] = "\n".join(lines)
    steps = [corpus_pipeline.STAGES[0][1](spark, docs, SF_DIR).cache()]
    assert {r["doc_id"]: r["text"] for r in steps[0].collect()} == texts

    ids = sorted(texts)
    groups, _ = brute.near([texts[i] for i in ids])
    texts = {i: texts[i] for k, i in enumerate(ids) if groups[k] == k}
    steps.append(corpus_pipeline.STAGES[1][1](spark, steps[-1], SF_DIR).cache())
    assert {r["doc_id"]: r["text"] for r in steps[-1].collect()} == texts

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    judged = brute.decontaminate(list(texts.values()), items)
    texts = {i: t for (i, t), j in zip(texts.items(), judged, strict=True) if not j["contaminated"]}
    steps.append(corpus_pipeline.STAGES[2][1](spark, steps[-1], SF_DIR).cache())
    assert {r["doc_id"]: r["text"] for r in steps[-1].collect()} == texts

    steps.append(corpus_pipeline.STAGES[3][1](spark, steps[-1], SF_DIR).cache())
    masked = {r["doc_id"]: r["text"] for r in steps[-1].collect()}
    assert masked.keys() == texts.keys()
    for i, text in texts.items():
        assert not any(text[a:b] in masked[i] for a, _, b in brute.secret_spans(text)) and (brute.secret_spans(text) or masked[i] == text)

    steps.append(corpus_pipeline.STAGES[4][1](spark, steps[-1], SF_DIR).cache())
    assert all(s.columns == columns for s in steps[:4]) and steps[4].columns[: len(columns)] == columns
    last = steps[4].collect()
    sizes = {}
    for r in steps[3].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    goal = brute.targets(sizes)
    assert sum(r["mix_taken"] for r in last) <= sum(goal.values()) and all(r["mix_target"] == pytest.approx(goal[r["source"]]) for r in last)
    assert secret_scan.KINDS[-1] == "random" and corpus_pipeline.ORACLE_SQL is None
