"""Phrase mining, license scans and ranked search against the plain versions."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import collocations, decontaminate, license_rules, licenses, queries, ranked_search
from corpusgraph.llm.words import split_words

SF_DIR = "/root/testdata/sf0.001"


def sorted_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def phrase_rows(tricky):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["new", "york", "times", "new york times", "the", "old.", "A,b"]) for _ in range(30)) for _ in range(40)]
    rows = [(("en", "de", "und", None)[k % 4], t) for k, t in enumerate(texts)]
    rows += [("en", r[1]) for r in tricky] + [("xx", "one two three four five six " * 3), ("xx", None), (None, ""), ("xx", "rare words here")]
    return rows


@pytest.mark.parametrize("least, shards, range_words", [(4, 2, 200), (30, 1, 4 << 20)])
def test_collocations(spark, phrase_rows, least, shards, range_words):
    docs = spark.createDataFrame([(lang, t, k, 1.0, "x", 2) for k, (lang, t) in enumerate(phrase_rows)],
                                 "lang string, text string, shard long, f double, phrase string, size int").repartition(3)
    got = collocations.collocations(docs, least=least, shards=shards, range_words=range_words, limit=None)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted_rows(got) == brute.collocations(phrase_rows, least)


def test_collocations_limit_and_empty(spark, phrase_rows):
    docs = spark.createDataFrame(phrase_rows, "lang string, text string")
    got = sorted_rows(collocations.collocations(docs, least=30, limit=5))
    assert got == [r for r in brute.collocations(phrase_rows, 30) if r[1] <= 5]
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    # 1000 a n passes 2^63 for these counts; the quotient must be exact.
    a, n, left, right = 3 * 10**9, 9 * 10**12, 4 * 10**9, 7 * 10**9
    df = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(
        (collocations._wide(F.col("a") * 1000, 19) * collocations._wide(F.col("n"), 18)).alias("x"),
        (collocations._wide(F.col("l"), 19) * collocations._wide(F.col("r"), 18)).alias("y"))
    assert df.select(F.expr("x div y")).first()[0] == 1000 * a * n // (left * right)


def test_sequences_keep_pieces_apart():
    text = "a b rare c. a b\nc"
    data = np.frombuffer(text.encode(), np.uint8)
    words = collocations.words_in_pieces(data, np.array([0, len(data)]), np.zeros(1, np.uint64))
    frequent = words.hash != words.hash[2]
    again = collocations.unpacked([collocations.packed(words, frequent)] * 2)
    pairs = collocations.phrases(again, 2)[0]
    assert len(again.hash) == 12 and len(pairs) == 4 and len(set(pairs.tolist())) == 1
    assert len(split_words(data, np.array([0, len(data)])).hash) == 7


def test_unknown_bytes_and_languages():
    keys = collocations.language_keys(pa.array([b"en", b"\xff", b"en"], pa.binary()))
    assert keys[0] == keys[2] != keys[1]


@pytest.mark.parametrize("block_bytes", [1 << 20, 12])
def test_ranked_search(spark, tricky, documents, no_documents, block_bytes):
    items = [(1, "w1 w2 w3, the W5!"), (2, None), (3, "!!"), (4, "the the end"), (5, ""), (1, "w1 w2 w3, the W5!"), (None, "été 名前 one"), (7, "nowhere"), (8, "a_b hunter2hunter2")]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in items], "item_id long, text string, doc_id long, terms string")
    got = ranked_search.search(documents, df, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute.ranked([(r[0], r[1]) for r in tricky], items)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert ranked_search.search(no_documents, df).count() == 0 and ranked_search.search(documents, df.limit(0)).count() == 0


def test_best_keeps_ties_by_id():
    best = ranked_search._Best(2, 1)
    for scores, ids in (([5, 7, 5], [9, 4, 3]), ([5, 7, 1], [1, 8, 0]), ([7], [2])):
        best.add(np.array(scores).reshape(-1, 1), np.array(ids), np.zeros(len(ids), bool))
    assert best.score.tolist() == [7, 7] and best.doc.tolist() == [2, 4]


LICENSE_TEXTS = [
    None, "", "no terms here", "Licensed under the Apache License, Version 2.0 (the 'License')", "SPDX-License-Identifier: GPL-2.0-or-later",
    "cc-by CC BY-NC 4.0, and the MIT License or mit licence", "GNU General Public License; gnu general  public\nlicense version 3 or later",
    "SPDX-License-Identifier: MIT MIT License", "https://creativecommons.org/licenses/by-sa/4.0/ creative commons attribution share-alike 4.0 international",
    "Redistributions of source code must retain the above copyright notice. BSD-3-Clause license, 3-clause BSD License", "Tous droits réservés. Alle Rechte vorbehalten.",
    "cc by " * 500 + "mit license " * 3, "mitlicense xcc by", "gplv3 GPL v2 gpl 3.0 agpl", "apache license apache license 2.0 apache software license",
    "x" * 100_000 + " mit license", "#mit#license#1; apache#2; license",
]


def test_licenses(spark, no_documents):
    rows = [(k, t, "q", 7) for k, t in enumerate(LICENSE_TEXTS)] + [(None, LICENSE_TEXTS[5], None, 0), (3, LICENSE_TEXTS[5], "q", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string, row int").withColumn("at", F.monotonically_increasing_id()).coalesce(1)
    found = licenses.find_licenses(docs)
    assert found.columns == ["doc_id", "text", "row", "at", "licenses"]
    base = F.col("licenses.base")
    got = found.orderBy("at").select(
        "text", "licenses.n_words", F.size(base).alias("n_base"), F.array_min(base["start"]).alias("first_word"), F.array_max(base["start"]).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base["label"])), ",").alias("base_labels"), F.array_join("licenses.labels", ",").alias("labels"),
        "licenses.score", F.transform("licenses.spans", lambda s: F.struct(s["start"], s["end"])).alias("spans"),
    ).collect()
    want = brute.licenses([r[1] for r in rows], license_rules.RULES, licenses.PHRASES, license_rules.KINDS, licenses.STRENGTH)
    assert len(got) == len(rows)
    for r, text, expected in zip(got, [r[1] for r in rows], want, strict=True):
        assert r["text"] == text and {**{c: r[c] for c in expected}, "spans": [tuple(s) for s in r["spans"]]} == expected
    labels = [w["labels"] for w in want]
    assert labels[3] == "apache,apache-2.0" and labels[4] == "gpl-2.0-or-later" and "cc-by-nc-4.0" in labels[5] and labels[7] == "mit"
    assert licenses.find_licenses(no_documents).count() == 0


def test_license_rules_are_sound():
    assert len(license_rules.RULES) > 250
    for r in license_rules.RULES:
        parts = brute.BENCHMARK_WORD.findall(r.pattern)
        assert r.keyword in parts and not set(r.pattern) & set("*{\\")


@pytest.mark.parametrize("name, columns", [("op12_license_scan", 8), ("op13_ranked_search", 4)])
def test_queries(spark, name, columns):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = queries.QUERIES[name](spark, SF_DIR)
    assert len(got.columns) == columns
    if name.startswith("op13"):
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
        assert sorted_rows(got) == sorted(brute.ranked([(r["doc_id"], r["text"]) for r in docs], items))
    else:
        want = brute.licenses([r["text"] for r in docs], license_rules.RULES, licenses.PHRASES, license_rules.KINDS, licenses.STRENGTH)
        found = {r["doc_id"]: r.asDict() for r in got.collect()}
        for r, expected in zip(docs, want, strict=True):
            assert {c: found[r["doc_id"]][c] for c in expected if c != "spans"} == {c: v for c, v in expected.items() if c != "spans"}


def test_decontamination_with_odd_bytes_and_inner_names(spark):
    docs = spark.range(3).selectExpr("id", "CASE id WHEN 0 THEN cast(unhex('6120FF6220632064') AS string) WHEN 1 THEN 'x c d e' END AS text", "id AS __hits", "id AS contamination")
    items = spark.createDataFrame([(1, "c d")], "item_id long, text string")
    found = decontaminate.find_contamination(docs, items)
    assert found.columns == ["id", "text", "__hits", "contamination"]
    rows = {r["id"]: (r["__hits"], r["c"]["n_words"], r["c"]["n_hit"]) for r in found.selectExpr("id", "__hits", "contamination AS c").collect()}
    assert rows == {0: (0, 4, 2), 1: (1, 4, 2), 2: (2, 0, 0)}
