"""Scores of any order against dictionaries, and the narrow arrays that hold the counts."""

import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.llm import blobs, language_model, queries, shared_arrays
from corpusgraph.llm.words import split_words


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_of_any_order(tricky, documents, order):
    keep = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(False))
    train = [r[1] for r in tricky if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10]
    want = brute.scores(train, [r[1] for r in tricky], order)
    for shard_keys in (5000, 4 << 20):
        model = language_model.train(documents.filter(keep), order=order, shard_keys=shard_keys)
        got = {r["row"]: r["score"] for r in language_model.score(documents, model).select("row", "lm.score").collect()}
        assert [got[k] for k in range(len(tricky))] == pytest.approx(want)


def test_registered_query_looks_two_words_back(spark, tmp_path):
    texts = ["x a b", "y a c"] * 20 + ["z a b", "z a c"] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op2_lm_score"](spark, str(tmp_path)).collect()
    train = [texts[r["doc_id"]] for r in rows if not r["held_out"]]
    assert [r["score"] for r in rows] == pytest.approx(brute.scores(train, [texts[r["doc_id"]] for r in rows], 3))
    assert [r["score"] for r in rows] != pytest.approx(brute.scores(train, [texts[r["doc_id"]] for r in rows], 2))


def test_narrow_columns_lose_nothing(tmp_path):
    rng = np.random.default_rng(3)
    for large in (0, 3, 400):
        keys = np.sort(rng.choice(1 << 40, 500, replace=False).astype(np.uint64))
        values = rng.integers(0, 255, 500)
        values[rng.permutation(500)[:large]] = rng.integers(254, 1 << 33, large)
        shared_arrays.write(str(tmp_path), f"t{large}", 0, keys=keys, n=values)
        places = rng.permutation(500)
        (got,) = shared_arrays.look_up(str(tmp_path), f"t{large}", np.zeros(500, np.int64), keys[places], ("n",))
        assert (got == values[places]).all()


@pytest.mark.parametrize("n", [0, 1, 7, 8, 40, 5000])
def test_short_keys(tmp_path, n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))
    keys[: n // 2] >>= np.uint64(9)  # some buckets hold many
    keys = np.unique(keys)
    shard = np.zeros(len(keys), np.int64)
    shared_arrays.write_short(str(tmp_path), "t", 0, keys[::2], n=np.arange(len(keys[::2])))
    asked = rng.permutation(len(keys))
    got = shared_arrays.holds(str(tmp_path), "t", shard, keys[asked])
    assert (got == (asked % 2 == 0)).all()
    (places,) = shared_arrays.look_up(str(tmp_path), "t", shard, keys[asked], ("n",))
    assert (places == np.where(asked % 2 == 0, asked // 2, 0)).all()
    assert not shared_arrays.holds(str(tmp_path), "t", shard + 1, keys).any()


@pytest.mark.parametrize("n_columns", [1, 2, 3])
def test_rows_come_back(n_columns):
    rng = np.random.default_rng(n_columns)
    rows = rng.integers(0, 1 << 40, 20, dtype=np.uint64)[rng.integers(0, 20, (n_columns, 5000))]
    columns, (n,) = blobs.reduced([*rows], [np.ones(5000, np.int64)])
    want, counts = np.unique(rows, axis=1, return_counts=True)
    back = blobs.unpack_rows(blobs.pack_rows(columns, [n]), n_columns, 1)
    assert (np.stack(back[:-1]) == want).all() and (back[-1] == counts).all()
    nothing = blobs.unpack_rows(blobs.pack_rows([np.zeros(0, np.uint64)] * n_columns, [n[:0]]), n_columns, 1)
    assert [len(c) for c in nothing] == [0] * (n_columns + 1)


def test_numbers_of_words(spark, tmp_path):
    texts = [" ".join(f"w{k}" for k in range(j + 1)) for j in range(60)]
    model = language_model.train(spark.createDataFrame([(t,) for t in texts], "text string"), shard_keys=50)
    words = split_words(np.frombuffer("\n".join(texts + ["unseen"]).encode(), np.uint8), np.array([0, len("\n".join(texts + ["unseen"]))]))
    number, plain = model.numbered(words.hash)
    assert number[-1] == language_model.UNKNOWN and plain[-1] == 0 and len(np.unique(number)) == 61
    ranked = np.argsort(number[:-1], kind="stable")
    assert (np.diff(np.floor(np.log2(plain[:-1][ranked]))) <= 0).all()
    assert model.frequent == len(np.unique(number[plain >= 16])) + 1  # the end of a text counts as well


def test_looked_up_pages_are_given_back(tmp_path, monkeypatch):
    """A worker that reads all of its arrays holds a bounded part of them."""
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[2]) * 4096

    keys = np.arange(1 << 20, dtype=np.uint64) << np.uint64(40)
    shards = np.arange(len(keys)) >> 17
    for shard in range(8):
        shared_arrays.write(str(tmp_path), "t", shard, keys=keys[shards == shard], n=np.arange(len(keys))[shards == shard])
    monkeypatch.setattr(shared_arrays, "HELD_BYTES", 1 << 20, raising=False)
    before = held()
    (got,) = shared_arrays.look_up(str(tmp_path), "t", shards, keys, ("n",))
    assert (got == np.arange(len(keys))).all()
    assert held() - before < 4 << 20  # of 12 MB
