"""Joins and searches against straightforward Python on random small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.corpus import Corpus
from corpusgraph.operators import bundle, edges, graph, imports, lookup
from corpusgraph.operators.ranking import top_k, with_rank
from corpusgraph.runtime import materialise

SYMBOLS = "repo string, symbol_id bigint, file_id bigint, name string, kind string, start_line int, end_line int, start_col int, end_col int, parent string, depth int, signature string, language string"


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(7)
    symbols, refs, sid = [], [], 0
    for f in range(4):
        def nest(lo, hi, depth):
            nonlocal sid
            while lo < hi:
                end = min(hi, lo + rng.choice([0, 1, 5, 40, 300]))
                sid += 1
                symbols.append(("r", sid, f, f"n{rng.randrange(12)}", "function", lo, end, 0, 0, "", 0, "", "go"))
                if depth < 4 and end - lo > 2:
                    nest(lo + 1, end - 1, depth + 1)
                lo = end + rng.choice([1, 2, 7])
        nest(1, 700, 0)
        refs += [("r", f, rng.randrange(1, 720), i, f"n{rng.randrange(15)}", "go") for i in range(400)]
    files = [("r", f, f"/p/f{f}", f"d/f{f}.go", "go", "", 0, 0, 720) for f in range(4)]
    c = Corpus(
        files=spark.createDataFrame(files, "repo string, file_id bigint, path string, rel_path string, language string, hash string, mtime_us bigint, size bigint, n_lines int"),
        lines=None,
        symbols=spark.createDataFrame(symbols, SYMBOLS),
        imports=None,
        refs=spark.createDataFrame(refs, "repo string, file_id bigint, line int, ord int, name string, language string"),
    )
    return c, symbols, refs


def around(symbols, f, line):
    return [s for s in symbols if s[2] == f and s[5] <= line <= s[6]]


def test_enclosing_symbol(facts):
    c, symbols, refs = facts
    want = {}
    for _, f, line, *_ in refs:
        hit = sorted(around(symbols, f, line), key=lambda s: (s[6] - s[5], -s[5], s[1]))
        if hit:
            want[f, line] = hit[0][1]
    got = {(r["file_id"], r["line"]): r["symbol_id"] for r in edges.enclosing_symbol(c.refs, c.symbols).collect()}
    assert got == want and len(want) > 100


def test_containment_edges(facts):
    c, symbols, refs = facts
    want = {(f, s[3], name, line) for _, f, line, _, name, _ in refs for s in around(symbols, f, line)}
    got = [(r["file_id"], r["caller"], r["callee"], r["line"]) for r in edges.containment_edges(c).collect()]
    assert set(got) == want and len(got) == len(want)


def test_nesting(facts):
    c, symbols, _ = facts
    want = {}
    for s in symbols:
        outer = [o for o in symbols if o[2] == s[2] and o[5] <= s[5] and o[6] >= s[6] and o[1] != s[1]
                 and (o[6] - o[5] > s[6] - s[5] or o[1] < s[1])]
        near = min(outer, key=lambda o: (o[6] - o[5], -o[5], -o[1]), default=None)
        want[s[1]] = (len(outer), near[3] if near else "")
    got = {r["symbol_id"]: (r["depth"], r["parent"]) for r in edges.nesting(c.symbols).collect()}
    assert got == want


def levels(roots, step, depth, limit, order):
    """Whole levels first, then cut: the meaning of the limit."""
    out = {}
    for root in roots:
        seen, expanded, frontier, rows = set(), {root}, {root}, []
        for d in range(1, depth + 1):
            best = {}
            for name in frontier:
                for key, row, nxt in step(name):
                    if key not in seen and (key not in best or row < best[key][0]):
                        best[key] = (row, nxt)
            rows += [(d, *order(k, v[0])) for k, v in best.items()]
            seen |= set(best)
            frontier = {v[1] for v in best.values() if v[1] is not None} - expanded
            expanded |= frontier
        out[root] = sorted(rows)[:limit]
    return out


@pytest.mark.parametrize("limit", [3, 10, 10_000])
@pytest.mark.parametrize("depth", [1, 2, 4])
def test_find_impact(spark, facts, depth, limit):
    c, symbols, refs = facts
    table = {}
    for _, f, line, _, callee, _ in refs:
        hit = sorted(around(symbols, f, line), key=lambda s: (s[6] - s[5], -s[5], s[1]))
        if hit and hit[0][3] != callee:
            k = (callee, hit[0][3], f)
            table[k] = min(line, table.get(k, line))
    by_callee = {}
    for (callee, caller, f), line in table.items():
        by_callee.setdefault(callee, []).append(((caller, f), (callee, line), caller))
    roots = [f"n{i}" for i in range(15)]
    want = levels(roots, lambda n: by_callee.get(n, []), depth, limit, lambda k, v: (v[0], f"d/f{k[1]}.go", v[1], k[0]))
    targets = spark.createDataFrame([("r", r) for r in roots], "repo string, target string")
    got = {r: [] for r in roots}
    for r in graph.find_impact(edges.impact_edges(c), targets, depth, limit).collect():
        got[r["target"]].append((r["depth"], r["symbol"], r["rel_path"], r["line"], r["caller"]))
    assert {k: sorted(v) for k, v in got.items()} == want


@pytest.mark.parametrize("limit", [4, 10_000])
def test_find_trace(spark, facts, limit):
    c, symbols, refs = facts
    defined = {s[3] for s in symbols}
    table = {}
    for _, f, line, _, callee, _ in refs:
        for s in around(symbols, f, line):
            if s[3] != callee and len(callee) > 2:
                k = (s[3], callee)
                at = (f"d/f{f}.go", line)
                table[k] = min(at, table.get(k, at))
    by_caller = {}
    for (caller, callee), at in table.items():
        by_caller.setdefault(caller, []).append(((caller, callee), at, callee if callee in defined else None))
    roots = [f"n{i}" for i in range(15)]
    want = levels(roots, lambda n: by_caller.get(n, []), 3, limit, lambda k, v: (k[0], v[0], v[1], k[1]))
    targets = spark.createDataFrame([("r", r) for r in roots], "repo string, target string")
    got = {r: [] for r in roots}
    for r in graph.find_trace(edges.trace_edges(c), targets, 3, limit).collect():
        got[r["target"]].append((r["depth"], r["caller"], r["rel_path"], r["line"], r["callee"]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_substring_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aB./") for _ in range(n))
    texts = [("r", word(rng.randrange(0, 60))) for _ in range(60)] + [("other", "aB./aB./aB./aB./aB./")]
    patterns = [("r", t[1][i:i + n]) for t in texts[:40] for i, n in [(rng.randrange(20), rng.choice([1, 2, 5, 15, 16, 17, 30]))]]
    patterns += [("r", word(4)), ("r", "")]
    want = {(r, p, t) for r, p in patterns for q, t in texts if r == q and p.lower() in t.lower()}
    got = imports.substring_pairs(
        spark.createDataFrame(patterns, "repo string, pattern string"), spark.createDataFrame(texts, "repo string, text string")
    ).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_keeps_a_hot_key_out_of_one_task(spark):
    """The row limit runs in front of the shuffle as well as behind it."""
    hot = spark.range(1000).select((F.col("id") % 3 == 0).alias("k"), "id").repartition(3)
    plan = top_k(hot, ["k"], ["id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_ranked_edges_give_the_same_rows_without_ordering_edges(spark, facts):
    c = facts[0]
    table = edges.impact_edges(c)
    ranked = graph.ranked(table, "callee")
    targets = spark.createDataFrame([("r", f"n{i}") for i in range(15)], "repo string, target string")
    columns = ["target", "depth", "symbol", "caller", "rel_path", "line", "rank"]
    rows = lambda df: sorted(tuple(r) for r in df.select(columns).collect())
    for limit in (3, 50):
        assert rows(graph.find_impact(ranked, targets, 2, limit)) == rows(graph.find_impact(table, targets, 2, limit))
    stored = materialise(ranked, "ranked_edges")
    plan = graph._first_edges(stored, "callee", 3)._jdf.queryExecution().executedPlan().toString()
    assert "edge_rank" in plan and "Window" not in plan and "Sort" not in plan
    every = graph.find_impact(ranked, targets, 2, None).drop("rank")
    assert rows(every.withColumn("rank", F.lit(0))) == rows(graph.find_impact(table, targets, 2, 1 << 20).withColumn("rank", F.lit(0)))


def test_with_rank_keeps_every_row(spark):
    rows = [("a", k % 500, k) for k in range(2000)] + [("b", 1, 1)]
    df = spark.createDataFrame(rows, "k string, o int, id int")
    got = [tuple(r) for r in with_rank(df, ["k"], ["o", "id"], 150, "r").collect()]
    place = {r: n + 1 for n, r in enumerate(sorted((x for x in rows if x[0] == "a"), key=lambda x: (x[1], x[2])))} | {("b", 1, 1): 1}
    assert sorted(got, key=str) == sorted([(*r, place[r] if place[r] <= 150 else None) for r in rows], key=str)


def test_show_lines_and_strict_bundles(spark):
    """Ranges against a plain reading; names with one, several and no symbols, with hints that fit and that do not."""
    files = [("r", 1, "/p/d/a.go", "d/a.go", "go", "", 0, 0, 70), ("r", 2, "/p/d/b.go", "d/b.go", "go", "", 0, 0, 4)]
    symbols = [
        ("r", 1, 1, "Big", "class", 2, 68, 0, 0, "", 0, "", "go"), ("r", 2, 1, "Run", "method", 3, 4, 0, 0, "Big", 1, "", "go"),
        ("r", 3, 2, "Run", "function", 1, 2, 0, 0, "", 0, "", "go"), ("r", 4, 2, "one", "function", 3, 4, 0, 0, "", 0, "", "go"),
    ]
    lines = [("r", f[1], n, f"{f[3]} {n}") for f in files for n in range(1, f[8] + 1)]
    c = Corpus(
        files=spark.createDataFrame(files, "repo string, file_id bigint, path string, rel_path string, language string, hash string, mtime_us bigint, size bigint, n_lines int"),
        lines=spark.createDataFrame(lines, "repo string, file_id bigint, line int, text string"),
        symbols=spark.createDataFrame(symbols, SYMBOLS), imports=None,
        refs=spark.createDataFrame([("r", 2, 4, 0, "Run", "go")], "repo string, file_id bigint, line int, ord int, name string, language string"),
    )
    want = {
        "/p/d/a.go:L10-L12": range(9, 14), "d/b.go:2": range(1, 4), "d/b.go": range(1, 5), "d/b.go:1-900000000": range(1, 5),
        "d/b.go:9": range(0), "d/b.go:4-1": range(0), "d/none.go:1": range(0), "one": range(0), "d/b.go:one": range(0),
    }
    targets = spark.createDataFrame([("r", t) for t in want] * 2, "repo string, target string")
    got = [(r["target"], r["line"]) for r in lookup.show_lines(c, targets, context=1).collect()]
    assert sorted(got) == sorted((t, n) for t, ns in want.items() for n in ns)

    asked = [("r", "Big", None), ("r", "Run", ""), ("r", "Run", "b.go"), ("r", "Run", "zzz"), ("r", "one", "zzz"), ("r", "none", "")]
    found = bundle.investigate_strict(c, edges.impact_edges(c), spark.createDataFrame(asked, "repo string, target string, file_hint string"))
    rows = {(r["target"], r["file_hint"]): r for r in found.collect()}
    assert {k: (r["status"], r["matches"], r["also"]) for k, r in rows.items()} == {
        ("Big", ""): ("found", 1, None), ("Run", ""): ("ambiguous", 2, ["d/a.go:3", "d/b.go:1"]), ("Run", "b.go"): ("found", 1, None),
        ("Run", "zzz"): ("ambiguous", 2, ["d/a.go:3", "d/b.go:1"]), ("one", "zzz"): ("found", 1, None), ("none", ""): ("not found", 0, None),
    }
    assert len(rows["Big", ""]["source"].split("\n")) == 67 and [m["name"] for m in rows["Big", ""]["members"]] == ["Run"]
    assert rows["Run", "b.go"]["symbol_id"] == 3 and len(rows["Run", "b.go"]["refs"]) == 1
    assert rows["Run", "b.go"]["impact"][0]["caller"] == "one" and rows["Run", ""]["source"] is None
