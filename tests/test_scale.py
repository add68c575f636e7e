"""What a query builds and shuffles: rows of the test's own, plans read with broadcasts off."""

import re

import pytest
from pyspark.sql import functions as F

from corpusgraph import runtime
from corpusgraph.corpus import FILES_SCHEMA, IMPORTS_SCHEMA, LazyCorpus
from corpusgraph.operators import callsites, edges, graph, imports, search
from corpusgraph.plans import fixtures as fx
from corpusgraph.plans.catalog import QUERIES

DOCS = [
    (1, "Alpha calls Bravox Charlie\nBeta Alphax\n\nGamma\r\n", "en", "src1"),
    (2, "Delta Alphax Alphax\nbeta Gammas and Charlie", "en", "src2"),
    (2, "Other lines Bravox\nhere\nAlpha", "de", "src3"),
    (3, None, "en", "src1"),
    (4, "", "fr", None),
    (5, "Alpha Charlie\nDelta\n", None, "src1"),
]


@pytest.fixture
def tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string"
    spark.createDataFrame(DOCS, schema).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def written(monkeypatch):
    names = []
    real = runtime.materialise

    def note(df, name, *rest):
        names.append(name)
        return real(df, name, *rest)

    for module in (runtime, fx):
        monkeypatch.setattr(module, "materialise", note)
    return names


@pytest.mark.parametrize("name, unused", [
    ("detect_language", {"lines", "symbols", "refs", "imports"}), ("text_search", {"symbols", "refs", "imports"}),
    ("defining_files", {"refs", "imports"}), ("refs_batch_topk", {"imports"}),
])
def test_only_facts_in_use_are_built(spark, tables, monkeypatch, name, unused):
    names = written(monkeypatch)
    QUERIES[name](spark, tables).collect()
    assert "files" in names and not unused & set(names)


def test_lines_and_calls_are_not_shuffled_for_their_file(spark, tables, monkeypatch):
    monkeypatch.setattr(fx, "spread", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (fx._files(spark, tables), fx._refs(spark, tables), fx._heads(spark, tables)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_ids_that_repeat_meet_every_file_of_theirs(spark, tables):
    """As a join of the lines with all files by id gives them."""
    c = fx.corpus(spark, tables)
    n = {(r.file_id, r.language): r.n_lines for r in c.files.collect()}
    assert n == {(1, "src1"): 4, (2, "src2"): 5, (2, "src3"): 5, (3, "src1"): 0, (4, None): 0, (5, "src1"): 2}
    files = c.files.select("file_id", "language")
    words = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("ord", "w")
    want = (
        c.lines.select("repo", "file_id", "line", words).where("ord > 0 AND length(w) >= 6").join(files, "file_id")
        .select("repo", "file_id", "line", "ord", fx.capital(F.col("w")).alias("name"), "language")
    )
    assert sorted(map(str, c.refs.collect())) == sorted(map(str, want.collect()))
    assert c.refs.where("file_id = 2").count() == 2 * 5


def test_calls_are_exploded_behind_all_shuffles(spark, tables):
    plan = edges.containment_edges(fx.corpus(spark, tables))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(callees") < plan.index("Exchange")


def test_edges_of_limited_searches(spark):
    """Only the first 2 * limit edges of a name are kept, and they are those of the whole table, ties and repeated ids included."""
    files = [("r", i, f"/r/p{i % 7}.x", f"p{i % 7}.x", "x", "", 0, 0, 1) for i in range(20)]
    files += [("r", 3, "/r/a.x", "a.x", "x", "", 0, 0, 1), ("r", 4, None, None, "x", "", 0, 0, 1)]
    raw = [("r", i, f"p{j}/p{i % 3}", "x") for i in range(20) for j in range(7)]
    c = LazyCorpus(
        files=lambda: spark.createDataFrame(files, FILES_SCHEMA), imports=lambda: spark.createDataFrame(raw, IMPORTS_SCHEMA))
    every = graph.ranked(imports.import_edges(c), "stem")
    got = graph.ranked(imports.import_edges(c, limit=2), "stem", 2)
    want = every.where("edge_rank <= 4").select(got.columns)
    assert got.count() < every.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_words_do_not_carry_the_text_of_their_line(spark, tables, monkeypatch):
    """Lines are priced once, with a hash for their text, before their words are exploded."""
    written_columns = {}
    monkeypatch.setattr(callsites, "materialise", lambda df, name: written_columns.setdefault(name, df))
    c = fx.corpus(spark, tables)
    names = c.symbols.select("repo", F.col("name").alias("target")).distinct()
    got = {(r.repo, r.target): r.grep_bytes for r in callsites.output_cost(c, names, 20).collect()}
    assert {"cost", "text_hash"} <= set(written_columns["priced_lines"].columns)
    # "Beta Alphax" and "Alpha calls Bravox Charlie" of document 1, "Delta Alphax Alphax" of document 2
    assert got["repo_en", "Alpha"] == sum(len(x) + 1 for x in (
        "src1/d1.en:1:Alpha calls Bravox Charlie", "src1/d1.en:2:Beta Alphax")) + sum(
        len(f"{p}:1:Delta Alphax Alphax") + 1 for p in ("src2/en/d2.en", "src3/de/d2.de"))


def test_hits_are_cut_to_their_snippet_before_they_meet_their_file(spark, tables):
    """Lines may be long; only what is shown of them is shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = search.text_search(fx.corpus(spark, tables), "Charlie", limit=None)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Exchange") < plan.index("substring(text")
        assert sorted(r.snippet for r in hits.collect()) == [
            "Alpha Charlie", "Alpha calls Bravox Charlie", "beta Gammas and Charlie", "beta Gammas and Charlie"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_files_of_one_id_do_not_carry_each_other(spark, tmp_path):
    """Copies of an id have its languages once each, with their number, and meet the ids without their texts."""
    rows = [(1, "Alpha calls Bravox\nBeta", "en", x) for x in ["src1"] * 6 + ["src2", None]] + [(2, "Alpha Charlie", "en", "src1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sf = str(tmp_path)
    assert {(r.file_id, len(r.languages), r.n_lines) for r in fx.contents(spark, sf).collect()} == {(1, 3, 16), (2, 1, 1)}
    refs = fx.corpus(spark, sf).refs
    count = {(r.file_id, r["language"]): r["count"] for r in refs.where("name = 'Bravox'").groupBy("file_id", "language").count().collect()}
    assert count == {(1, "src1"): 48, (1, "src2"): 8, (1, None): 8}
    assert refs.where("file_id = 2").count() == 1
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx._repeated(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "split(text" in plan[plan.index("SortMergeJoin"):]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_all_callers_are_found_without_shuffling_their_product(spark, monkeypatch):
    """Twelve names are called by a hub, which thirty files call: rows by target are made behind the last shuffle."""
    monkeypatch.setattr(graph, "BLOCK_TARGETS", 5, raising=False)
    rows = [("r", f"t{i}", "hub", 1, i, "/r/a", "a") for i in range(12)] + [("r", "t1", "hub", 1, 1, "/r/Z", "Z")]
    rows += [("r", "hub", f"c{f % 7}", f, f, f"/r/p{f}", f"p{f}") for f in range(2, 32)]
    rows += [("r", "c1", "t3", 40, 2, "/r/x", "x"), ("r", "c2", "t3", 40, 1, "/r/x", "x"), ("r", "t2", "c3", 3, 9, "/r/p3", "p3")]
    edges_ = spark.createDataFrame(rows, "repo string, callee string, caller string, file_id bigint, line int, path string, rel_path string")
    targets = spark.createDataFrame([("r", f"t{i}") for i in range(12)] + [("r", "none"), (None, "t1")], "repo string, target string")
    for depth in (1, 2, 4):
        got = graph.find_impact(edges_, targets, depth, limit=None)
        want = graph.find_impact(edges_, targets, depth, limit=10**6)
        assert {r["rank"] for r in got.collect()} == {None}
        assert sorted(map(str, got.drop("rank").collect())) == sorted(map(str, want.select(got.columns).drop("rank").collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Exchange hashpartitioning\([^)]*target#[^)]*file_id#", plan)


def test_contents_and_lines_are_not_copied_unless_ids_repeat(spark, tmp_path, monkeypatch):
    rows = [(1, "Alpha calls Bravox\nBeta", "en", "src1"), (2, "Delta Alphax", "en", "src1")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    names = written(monkeypatch)
    got = QUERIES["impact"](spark, str(tmp_path)).collect()
    assert not {"contents", "lines"} & set(names) and "refs" in names
    assert [(r.target, r.caller) for r in got] == []
    assert fx.lines(spark, str(tmp_path)).count() == 3


def _search_rows(spark, fan):
    """t is called by ``fan`` callers, each of them by many files; the callers a0, a1, ... come in order of their names."""
    rows = [("r", "t", f"a{k}", k, 1, f"/r/{k}", f"{k}") for k in range(fan)]
    rows += [("r", f"a{k}", f"z{f}", 100 + f, 1, f"/r/{100 + f}", f"{100 + f}") for k in range(fan) for f in range(30)]
    return spark.createDataFrame(rows, "repo string, callee string, caller string, file_id bigint, line int, path string, rel_path string")


def test_names_behind_those_that_fill_a_target_are_not_expanded(spark):
    table = _search_rows(spark, 8)
    frontier = spark.createDataFrame([("r", "t", f"a{k}", 8) for k in range(8)], "repo string, target string, name string, seen int")
    kept = graph._needed_names(frontier, table, "callee", 20, unique=False)
    assert [r.name for r in kept.collect()] == ["a0"]
    few = graph._needed_names(frontier, table, "callee", 70, unique=True)
    assert sorted(r.name for r in few.collect()) == ["a0", "a1", "a2"]  # 8 + 30 + 30 < 70
    targets = spark.createDataFrame([("r", "t")], "repo string, target string")
    got = graph.find_impact(table, targets, 3, 20).collect()
    assert sorted((r["rank"], r.depth, r.symbol) for r in got) == [(k + 1, 1, "t") if k < 8 else (k + 1, 2, "a0") for k in range(20)]


def test_limited_edges_are_the_first_of_all(spark):
    """Names called in several bins of a file, and callers whose first lines name too few callees."""
    from corpusgraph.corpus import REFS_SCHEMA, SYMBOLS_SCHEMA

    n = 200
    files = [("r", i, f"/r/p{i}.x", f"p{i}.x", "x", "", 0, 0, n) for i in range(6)]
    symbols = [("r", i * 10 + k, i, f"s{k % 2}", "function", 1 + 50 * k, 50 + 50 * k, 0, 0, "", 0, "", "x") for i in range(6) for k in range(4)]
    refs = [("r", i, line, 0, "Samename" if line < 190 else f"Other{line % 7}{i}", "x") for i in range(6) for line in range(1, n + 1)]
    c = LazyCorpus(
        files=lambda: spark.createDataFrame(files, FILES_SCHEMA), symbols=lambda: spark.createDataFrame(symbols, SYMBOLS_SCHEMA),
        refs=lambda: spark.createDataFrame(refs, REFS_SCHEMA))
    for make, key in ((edges.impact_edges, "callee"), (edges.trace_edges, "caller")):
        for limit in (2, 9):
            want = graph.ranked(make(c), key).where(F.col("edge_rank") <= 2 * limit)
            got = graph.ranked(make(c, limit), key, limit).select(want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
