"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corpusgraph.plans import fixtures, queries_graph, queries_source
from corpusgraph.plans.catalog import QUERIES

HEADLINE = [
    "find_references", "symbols_exact", "search_symbols", "flex_resolve", "text_search", "enclosing_symbol",
    "call_edges", "containment_edges", "impact", "trace", "refs_impact", "top_by_import_fan", "structure_report",
    "context_window", "nesting", "ignore_rules", "symbol_diff", "changed_symbols", "classify_changes", "upsert_files",
    "latest_changes", "investigate", "extract_symbols", "extract_imports", "extract_refs",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.time()
        run()
        seconds[name] = round(time.time() - start, 3)

    # Building the fact and edge tables is the counterpart of a cold index run.
    timed("build_facts", lambda: fixtures.corpus(spark, sf_dir))
    timed("build_impact_edges", lambda: queries_graph.impact_edges(spark, sf_dir))
    timed("build_trace_edges", lambda: queries_graph.trace_edges(spark, sf_dir))
    timed("build_import_edges", lambda: queries_graph.import_edges(spark, sf_dir))
    timed("build_source_lines", lambda: queries_source.masked_lines(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "corpus_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir),
    }))


if __name__ == "__main__":
    main()
