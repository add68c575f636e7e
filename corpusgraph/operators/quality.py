"""Ground-truth checks: expected facts against what the lookups return."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.constants import LIMIT_REFS, LIMIT_RESOLVE_EXACT
from corpusgraph.corpus import Corpus
from corpusgraph.operators.bundle import symbol_source
from corpusgraph.operators.lookup import auto_resolve, find_references, symbols_exact
from corpusgraph.runtime import materialise


def ground_truth_check(c: Corpus, expected: DataFrame) -> DataFrame:
    """(repo, name, check, passed) for the search, show and refs checks.

    ``expected``: repo, name, file_contains, kind, show_contains, refs_min. Search passes when
    the hits hold the file part and the kind, show when the source of the best match holds the
    text, refs (only with ``refs_min`` > 0) when at least that many sites come back.
    """
    targets = expected.select("repo", F.col("name").alias("target")).distinct()
    key = ["repo", "name"]

    hits = symbols_exact(c, targets, limit=LIMIT_RESOLVE_EXACT).select(*key, "rel_path", F.col("kind").alias("hit_kind"))
    search = expected.join(hits, key, "left").groupBy(*key).agg(
        (
            F.coalesce(F.bool_or(F.contains("rel_path", F.col("file_contains"))), F.lit(False))
            & F.coalesce(F.bool_or(F.col("hit_kind") == F.col("kind")), F.lit(False))
        ).alias("passed")
    )
    best = materialise(auto_resolve(c, targets), "resolved")
    sources = best.select("repo", F.col("target").alias("name"), "symbol_id").join(symbol_source(c, best), "symbol_id")
    show = expected.join(sources, key, "left").select(
        *key, F.coalesce(F.contains("source", F.col("show_contains")), F.lit(False)).alias("passed")
    )
    counts = find_references(c, targets, LIMIT_REFS).groupBy("repo", F.col("target").alias("name")).agg(F.count("*").alias("n"))
    refs = expected.where("refs_min > 0").join(counts, key, "left").select(
        *key, (F.coalesce("n", F.lit(0)) >= F.col("refs_min")).alias("passed")
    )
    named = [d.withColumn("check", F.lit(n)) for n, d in (("search", search), ("show", show), ("refs", refs))]
    return reduce(DataFrame.unionByName, named)


def check_totals(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check").agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"))
