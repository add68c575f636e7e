"""Boilerplate phrases count as whole words, and only where they make up a good share of a line."""

import pytest

from corpusgraph.llm import quality


@pytest.mark.parametrize("line, fails", [
    ("Read more", True), ("Share on Facebook", True), ("© 2024 Example Inc. All rights reserved.", True),
    ("Privacy Policy · Terms of Service", True), ("They share only one bread", False), ("We spread more butter", False),
    ("You can sign up for the evening course at the front desk of the town library until Friday", False),
    ("Read more " + "word " * 7 + "end", True), ("Read more " + "word " * 8 + "end", False),
])
def test_boilerplate_line(line, fails):
    assert quality.line_fails(line, line.split()) is fails


def test_long_line_with_phrases_is_kept(spark):
    words = [f"w{k}" for k in range(2000)]
    words[400:400] = ["spread", "more"]
    words[900:900] = ["read", "more"]
    text = " ".join(words)
    rows = spark.createDataFrame([(1, text), (2, text.replace(" w50 ", "\n") + "\nClick here to subscribe to us")], "doc_id long, text string")
    got = {r["doc_id"]: r["quality"] for r in quality.quality_rules(rows).select("doc_id", "quality").collect()}
    assert got[1]["kept"] and got[1]["lost_words"] == 0 and got[1]["clean_text"] == text
    assert got[2]["kept"] and got[2]["lost_words"] == 6 and got[2]["clean_text"] == text.replace(" w50 ", "\n")
