"""License scans: ordered signature rules behind a keyword prefilter. SQL functions only.

A text is cut into words (runs of letters, digits and other non-ASCII characters, A-Z lower-cased). Its distinct words
are met with the rules' keywords; only rules whose keyword occurs are tried, so a text without any costs one pass. For
the others the words are written out with their numbers, `` gnu#17; general#18; ...``, and the patterns of
``license_rules`` match on that, which gives every detection as an interval of words without counting back.

Detections of one document are ordered by start, longest first, then by the rules' order. One is suppressed if its
interval lies within that of a detection of a kind of the same or higher priority before it (tag, notice, title, name,
mention). Running maxima of the ends, one for each kind, decide this in one sorted pass, not by comparing pairs. Of the
intervals that remain a lower kind may hold a higher one, or two may overlap in part: both stay.

Besides, the places of ``PHRASES`` are always reported, whatever the rules say. The labels are those of both.
The score is the highest strength of what was found (``STRENGTH``, a phrase counts as a name), 0 if nothing was.

Defined results: a null or empty text has no words and score 0; repeated rows are scanned each by itself; an empty table
gives no rows; bytes that are no UTF-8 are letters; other columns pass through (one named ``licenses`` gives way to the
result). Detections travel by a row number that the written table of the first step holds, never by an id of the user's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corpusgraph.llm.license_rules import KINDS, RULES
from corpusgraph.runtime import materialise

#: Phrases that are always reported, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
STRENGTH = {"tag": 0.99, "notice": 0.95, "title": 0.9, "name": 0.7, "mention": 0.4}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "array<struct<start:bigint,end:bigint,kind:int,rule:int>>"


def numbered(pattern: str) -> str:
    """The pattern over words written as `` word#number;``."""
    return " " + pattern.replace(" ", r"#\d+; ") + r"#\d+;"


def _interval(match: Column, *more: Column) -> Column:
    first = F.regexp_extract(match, r"#(\d+);", 1).cast("bigint")
    last = F.regexp_extract(match, r"#(\d+);$", 1).cast("bigint")
    return F.struct(first.alias("start"), (last + 1).alias("end"), *more)


def _literal(values: list[Column]) -> Column:
    return F.array(*values)


def _detections(hit: Column, line: Column) -> Column:
    rules = _literal([
        F.struct(F.lit(r.keyword).alias("keyword"), F.lit(numbered(r.pattern)).alias("pattern"), F.lit(r.kind).alias("kind"), F.lit(n).alias("rule"))
        for n, r in enumerate(RULES)
    ])
    tried = F.filter(rules, lambda r: F.array_contains(hit, r["keyword"]))
    return F.flatten(F.transform(tried, lambda r: F.transform(
        F.regexp_extract_all(line, r["pattern"], F.lit(0)),
        lambda m: _interval(m, r["kind"].alias("kind"), r["rule"].alias("rule")),
    )))


def _phrases(line: Column) -> Column:
    """Places of ``PHRASES``: no word of one begins another, so that they cannot overlap."""
    either = "(?:" + "|".join(p.replace(" ", r"#\d+; ") for p in PHRASES) + ")"
    labels = _literal([F.lit(x) for x in PHRASES.values()])
    names = _literal([F.lit(x) for x in PHRASES])
    said = lambda m: F.trim(F.regexp_replace(m, r"#\d+;", ""))
    return F.transform(
        F.regexp_extract_all(line, F.lit(" " + either + r"#\d+;"), F.lit(0)),
        lambda m: _interval(m, F.get(labels, (F.array_position(names, said(m)) - 1).cast("int")).alias("label")),
    )


def scan_texts(documents: DataFrame, text: str = "text", column: str = "licenses") -> DataFrame:
    """First step: ``column`` holds a row number, ``n_words``, ``base`` (places of the phrases) and ``found`` (all
    detections). Write it before the second step, so that the numbers stay."""
    keywords = sorted({r.keyword for r in RULES} | {p.split()[0] for p in PHRASES})
    words, hit, line = (f"w{uuid.uuid4().hex}" for _ in range(3))
    scanned = documents.drop(column)
    kept = [F.col(f"`{c}`") for c in scanned.columns]
    scanned = scanned.withColumn(words, F.coalesce(
        F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>")))
    scanned = scanned.withColumn(hit, F.array_intersect(words, _literal([F.lit(k) for k in keywords])))
    written = F.array_join(F.transform(words, lambda w, k: F.concat(F.lit(" "), w, F.lit("#"), k.cast("string"), F.lit(";"))), "")
    scanned = scanned.withColumn(line, F.when(F.size(hit) > 0, written).otherwise(""))
    return scanned.select(*kept, F.struct(
        F.monotonically_increasing_id().alias("row"), F.size(words).cast("bigint").alias("n_words"), _phrases(F.col(line)).alias("base"),
        _detections(F.col(hit), F.col(line)).cast(FOUND).alias("found"),
    ).alias(column))


def suppress(detections: DataFrame, *key: str) -> DataFrame:
    """Detections (``start``, ``end``, ``kind``, ``rule``) without those inside one of the same or higher priority."""
    before = W.partitionBy(*key).orderBy("start", F.desc("end"), "kind", "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = F.lit(None).cast("bigint")
    for kind in reversed(range(len(KINDS))):
        reach = F.when(F.col("kind") == kind, F.max(F.when(F.col("kind") <= kind, F.col("end"))).over(before)).otherwise(reach)
    return detections.withColumn("reach", reach).filter(F.col("reach").isNull() | (F.col("reach") < F.col("end"))).drop("reach")


def resolve(scanned: DataFrame, column: str = "licenses") -> DataFrame:
    """Second step, over the written first one: ``column`` holds ``n_words``, ``base`` (start, end, label), ``spans``
    (start, end, kind, label, rule) of the detections that stay, ``labels`` (both, distinct and sorted) and ``score``."""
    labels = _literal([F.lit(r.label) for r in RULES])
    kinds = _literal([F.lit(k) for k in KINDS])
    strengths = _literal([F.lit(STRENGTH[k]) for k in KINDS])
    name = F.lit(STRENGTH["name"])
    at = F.col(f"{column}.row")
    box, row = f"b{uuid.uuid4().hex}", f"r{uuid.uuid4().hex}"

    found = scanned.filter(F.size(f"{column}.found") > 0).select(at.alias(row), F.explode(f"{column}.found").alias("d")).select(row, "d.*")
    left = suppress(found, row).groupBy(row).agg(F.array_sort(F.collect_list(F.struct(
        "start", "end", F.get(kinds, F.col("kind")).alias("kind"), F.get(labels, F.col("rule")).alias("label"), "rule",
        F.get(strengths, F.col("kind")).alias("strength"),
    ))).alias(box))  # one row's detections
    joined = scanned.withColumn(row, at).join(left, row, "left")
    base, spans = F.col(f"{column}.base"), F.coalesce(F.col(box), F.array())
    every = F.array_sort(F.array_distinct(F.concat(base["label"], spans["label"])))
    score = F.greatest(
        F.coalesce(F.array_max(spans["strength"]), F.lit(0.0)), F.when(F.size(base) > 0, name).otherwise(F.lit(0.0)))
    result = F.struct(
        F.col(f"{column}.n_words").alias("n_words"), base.alias("base"),
        F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "label", "rule")])).alias("spans"),
        every.alias("labels"), score.alias("score"),
    )
    others = [F.col(f"`{c}`") for c in scanned.columns if c != column]
    return joined.select(*others, result.alias(column))


def find_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a struct column ``licenses`` (see ``resolve``)."""
    return resolve(materialise(scan_texts(documents, text), "license-detections"))
