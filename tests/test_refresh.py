"""Scanning, ignore rules, refresh invariants and the change stream on real files."""

import os

import pytest
from pyspark.sql import functions as F

from corpusgraph.sources import ignore, tree
from corpusgraph.sources.store import FactStore
from corpusgraph.streaming import refresh as rf

GO = "package a\n\nfunc %s() {\n\thelper()\n}\n"
PY = "import os\n\ndef %s():\n    return os.getcwd()\n"


def write(root, rel, text):
    path = root / rel
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "tree"
    for rel, text in {
        "main.go": GO % "Main", "pkg/util.go": GO % "Util", "pkg/deep/x.py": PY % "x", "web/app.ts": "export class App {}\n",
        "node_modules/m/i.js": "function no() {}\n", "pkg/.git/h.py": PY % "no", "docs/a.md": "# text\n", "Makefile": "all:\n",
        "gen/out.go": GO % "no", "gen/keep.go": GO % "Keep", "pkg/__init__.py": PY % "boot", ".hidden.py": PY % "dot", ".gitignore": "# generated\n/gen/*.go\n!keep.go\n*.tmp.py\n",
        "pkg/.gitignore": "deep/skip.py\n", "pkg/deep/skip.py": PY % "no", "pkg/a.tmp.py": PY % "no",
    }.items():
        write(root, rel, text)
    return root


def test_scan(spark, repo):
    rows = {r["rel_path"]: r["language"] for r in tree.scan_source_tree(spark, str(repo), "r").collect()}
    assert rows == {
        "main.go": "go", "pkg/util.go": "go", "pkg/deep/x.py": "python", "web/app.ts": "typescript", "gen/out.go": "go",
        "gen/keep.go": "go", "pkg/deep/skip.py": "python", "pkg/a.tmp.py": "python", "pkg/__init__.py": "python", ".hidden.py": "python",
    }


def test_scan_names_repositories_by_folder(spark, repo):
    rows = {(r["repo"], r["rel_path"]) for r in tree.scan_source_tree(spark, str(repo.parent)).collect()}
    assert ("tree", "pkg/util.go") in rows


RULES = [  # (rule file lines per folder, path, ignored)
    ({"": "build-out/\n*.log"}, "a/build-out/x.go", True),
    ({"": "build-out/"}, "build-out", False),
    ({"": "*.go\n!main.go"}, "src/main.go", False),
    ({"": "*.go\n!main.go"}, "src/other.go", True),
    ({"": "/top.go"}, "sub/top.go", True),  # a name without a slash is looked for at any depth
    ({"": "/a/top.go"}, "sub/a/top.go", False),
    ({"": "/top.go"}, "top.go", True),
    ({"": "a/*.ts"}, "x/a/f.ts", True),
    ({"": "a/*.ts"}, "x/a/b/f.ts", False),
    ({"": "**/n/*.go"}, "p/q/n/f.go", True),
    ({"": "a/**/z.c"}, "a/z.c", True),
    ({"": "lib/**"}, "lib/x/y.c", True),
    ({"": "f?.[ch]"}, "src/f1.h", True),
    ({"": "f?.[!c]"}, "src/f1.c", False),
    ({"": "*.{js,ts}"}, "w/a.ts", True),
    ({"sub": "*.rb"}, "sub/x/a.rb", True),
    ({"sub": "*.rb"}, "other/a.rb", False),
    ({"": "*.rb", "sub": "!a.rb"}, "sub/a.rb", False),
    ({"": "sub/", "sub": "!a.rb"}, "sub/a.rb", True),
    ({"": "# *.rb\n\n"}, "a.rb", False),
    ({"": "[z-a].py\n*.go"}, "b.py", False),  # a class that cannot be is no match and harms no other rule
    ({"": "[z-a].py\n*.go"}, "b.go", True),
    ({"": "[[:alpha:]].py"}, "b.py", False),
    ({"": "[a-c].py"}, "b.py", True),
]


def test_ignore_rules(spark):
    rule_files = [(f"r{i}", base, text) for i, (files, _, _) in enumerate(RULES) for base, text in files.items()]
    paths = [(f"r{i}", path) for i, (_, path, _) in enumerate(RULES)]
    rules = ignore.parse_rules(spark.createDataFrame(rule_files, "repo string, base_dir string, content string"))
    got = {r["repo"]: r["ignored"] for r in ignore.ignored_files(spark.createDataFrame(paths, "repo string, rel_path string"), rules).collect()}
    assert got == {f"r{i}": want for i, (_, _, want) in enumerate(RULES)}


def visible(store):
    c = store.corpus()
    return {
        (r["rel_path"], r["name"], r["start_line"])
        for r in c.symbols.join(c.files.select("file_id", "rel_path"), "file_id").collect()
    }


def test_refresh_cycle(spark, repo, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    first = rf.refresh(spark, str(repo), store, "r").first()
    assert (first["indexed"], first["unchanged"], first["errors"], first["unsupported"]) == (7, 0, 0, 2)
    names = {(p, n) for p, n, _ in visible(store)}
    assert names == {("main.go", "Main"), ("pkg/util.go", "Util"), ("pkg/deep/x.py", "x"), ("web/app.ts", "App"), ("gen/keep.go", "Keep"),
                     ("pkg/__init__.py", "boot"), (".hidden.py", "dot")}

    again = rf.refresh(spark, str(repo), store, "r").first()
    assert (again["indexed"], again["unchanged"], again["stale_removed"]) == (0, 7, 0)
    assert store.last_snapshot() == 1

    changed = write(repo, "main.go", "\n\n" + GO % "Renamed")
    os.utime(changed, (4e9, 4e9))
    write(repo, "new.py", PY % "fresh")
    (repo / "web" / "app.ts").unlink()
    third = rf.refresh(spark, str(repo), store, "r").first()
    assert (third["indexed"], third["unchanged"], third["stale_removed"], third["symbols_found"]) == (2, 5, 1, 2)
    rebuilt = FactStore(spark, str(tmp_path / "rebuilt"))
    rf.refresh(spark, str(repo), rebuilt, "r")
    assert visible(store) == visible(rebuilt)

    packed = FactStore(spark, str(tmp_path / "packed"))
    store.compact(packed)
    assert visible(packed) == visible(store)


def test_unreadable_file_is_counted(spark, tmp_path):
    files = spark.createDataFrame([("r", str(tmp_path / "missing.go")), ("r", str(write(tmp_path, "ok.go", "x")))], "repo string, path string")
    got = {os.path.basename(r["path"]): (r["content"], r["error"] is None) for r in tree.read_files(files).collect()}
    assert got == {"missing.go": (None, False), "ok.go": (bytearray(b"x"), True)}


FEED = "repo string, path string, rel_path string, language string, op string, mtime_us bigint, seq bigint, content string"


def test_stream_latest_event_wins(spark, tmp_path):
    source = tmp_path / "feed"
    batches = [
        [("r", "/a", "a.go", "go", "upsert", 10, 1, GO % "A1"), ("r", "/a", "a.go", "go", "upsert", 12, 2, GO % "A2"),
         ("r", "/b", "b.go", "go", "upsert", 10, 3, GO % "B1")],
        [("r", "/a", "a.go", "go", "upsert", 11, 4, GO % "late"), ("r", "/b", "b.go", "go", "delete", 13, 5, None),
         ("r", "/c", "c.py", "python", "upsert", 9, 6, PY % "c1")],
        [("r", "/b", "b.go", "go", "upsert", 12, 7, GO % "late"), ("r", "/c", "c.py", "python", "delete", 20, 8, None),
         ("r", "/c", "c.py", "python", "upsert", 21, 9, PY % "c2")],
    ]
    store = FactStore(spark, str(tmp_path / "store"))
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(str(source))
        feed = spark.readStream.schema(FEED).parquet(str(source))
        rf.refresh_stream(feed, store, str(tmp_path / "checkpoint")).awaitTermination()
        if i == 0:
            assert {n for _, n, _ in visible(store)} == {"A2", "B1"}
    assert {n for _, n, _ in visible(store)} == {"A2", "c2"}
    # A replayed batch writes the same snapshot again.
    rf.refresh_batch(store, spark.createDataFrame(batches[2], FEED), 2)
    assert {n for _, n, _ in visible(store)} == {"A2", "c2"}


def test_stream_keeps_what_a_batch_stored(spark, repo, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))
    rf.refresh(spark, str(repo), store, "r")
    before = visible(store)
    source = tmp_path / "feed"
    spark.createDataFrame([("s", "/n", "n.go", "go", "upsert", 5, 1, GO % "N")], FEED).coalesce(1).write.parquet(str(source))
    for checkpoint in ("one", "two"):  # another checkpoint on the same store is another writer
        feed = spark.readStream.schema(FEED).parquet(str(source))
        rf.refresh_stream(feed, store, str(tmp_path / checkpoint)).awaitTermination()
        assert visible(store) == before | {("n.go", "N", 3)}


def test_equal_time_is_settled_by_sequence(spark, tmp_path):
    events = [("r", "/a", "a.go", "go", "upsert", 10, n, GO % f"V{n}") for n in (1, 2, 3)]
    for batches in ([events], [[e] for e in events], [[events[2]], events[:2]]):
        store = FactStore(spark, str(tmp_path / f"store{len(batches)}{len(batches[0])}"))
        for k, rows in enumerate(batches):
            rf.refresh_batch(store, spark.createDataFrame(rows, FEED), k)
        assert {n for _, n, _ in visible(store)} == {"V3"}


def test_unlisted_folder_deletes_nothing(spark, repo, tmp_path, monkeypatch):
    store = FactStore(spark, str(tmp_path / "store"))
    rf.refresh(spark, str(repo), store, "r")
    before = visible(store)
    hidden = repo / "pkg"
    listed = tree.list_tree

    def broken(*args):
        rows = listed(*args)
        below = F.startswith("path", F.lit(f"{hidden}/"))
        lost = spark.createDataFrame([("r", str(hidden), "pkg", "", 0, 0, True)], rows.schema)
        return rows.where(~below).unionByName(lost)

    monkeypatch.setattr(tree, "list_tree", broken)
    row = rf.refresh(spark, str(repo), store, "r").first()
    assert row["stale_removed"] == 0 and visible(store) == before


def test_folder_errors_are_rows(spark, tmp_path):
    rows = tree.list_tree(spark, str(tmp_path / "nowhere"), "r").collect()
    assert [(r["path"], r["failed"], r["language"]) for r in rows] == [(str(tmp_path / "nowhere"), True, "")]
    with pytest.raises(ValueError, match="dbfs"):
        tree.list_tree(spark, "dbfs://x", "r")


def test_latest_state_stream(spark, tmp_path):
    rows = [("r", "/a", "upsert", "2024-01-01 10:00:00", 1), ("r", "/a", "delete", "2024-01-01 10:05:00", 2), ("r", "/b", "upsert", "2024-01-01 10:01:00", 3)]
    schema = "repo string, path string, op string, ts timestamp, event_id bigint"
    df = spark.createDataFrame(rows, "repo string, path string, op string, ts string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "ev"))
    state = rf.latest_state_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "ev")))
    q = state.writeStream.outputMode("update").format("memory").queryName("latest_state").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["path"], r["op"]) for r in spark.table("latest_state").collect()} == {("/a", "delete"), ("/b", "upsert")}
