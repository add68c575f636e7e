"""Ranked lexical search without an index: one Aho-Corasick scan of the texts counts the items' terms in each document.

Terms are runs of letters, digits and non-ASCII bytes, A-Z lower-cased. The automaton holds every distinct term of the
items between two guards (spaces), and runs over the text's terms between single guards, so it reports whole terms alone.
Its outputs are numbers of terms, which lists map to the items that hold them. A scan writes, for each document, how many
terms it has and which of the items' terms how often (documents' other terms are only counted). From that come the number
of documents N, of all terms L and, for each term, of the documents with it, df; then every task adds up

    w(term) * ((10^9 tf) div (1000 tf + 8 m)),   w = floor(1000 ln((2 N + 2) / (2 df + 1))),   m = 10 + (90 n N) div L

for the documents it holds, in 64-bit integers, and keeps the best ``k`` documents of each item, so that only
``k`` rows for each item leave a task.

Items are searched in blocks whose distinct terms hold at most ``block_bytes`` of text (measured before anything is
collected); an item lies whole in one block. One block at a time is held by the driver and sent to the tasks, so what is
broadcast is bounded however many items there are; each further block is another scan.

Defined results: a null or empty text has no terms and is not found; an item without terms has no rows; repeated items
are searched each by itself, repeated documents are found each; equal scores are ordered by ``doc_id``, null last;
documents without score above 0 are not returned; empty tables give no rows; bytes that are no UTF-8 belong to terms;
other columns are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.words import by_document
from corpusgraph.operators.ranking import top_k
from corpusgraph.runtime import materialise

BEST = 10
BLOCK_BYTES = 1 << 20
#: Scores (documents x items) that a task holds at once.
CELLS = 2 << 20

#: Lower-cases A-Z and turns every byte that is in no term into a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def _each_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for rows, data, offsets in by_document(batches):
        yield rows, [data[lo:hi].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)]


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(``row``, ``item_id``, ``terms``): the distinct terms of each item; ``row`` tells repeated items apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _each_text(batches):
            terms = [sorted(set(terms_of(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array(terms, pa.list_(pa.binary()))], names=["row", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col(item).alias("item_id"), F.col(text).alias("text"))
    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, item_id {kind}, terms array<binary>")


def automaton(terms: list[bytes]) -> ahocorasick.Automaton:
    """Reports the number of a term where it stands between guards. Latin-1 keeps a character for each byte."""
    machine = ahocorasick.Automaton()
    for k, term in enumerate(terms):
        machine.add_word(f" {term.decode('latin-1')} ", k)
    machine.make_automaton()
    return machine


def count_terms(documents: DataFrame, terms: list[bytes], doc_id: str, text: str) -> DataFrame:
    """(``doc_id``, ``n``, ``terms``, ``tf``) of every document with at least one term at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, number = automaton(terms), itemgetter(1)
        for rows, texts in _each_text(batches):
            n, found = [], []
            for raw in texts:
                words = terms_of(raw)
                n.append(len(words))
                line = f" {b' '.join(words).decode('latin-1')} "
                found.append(Counter(map(number, machine.iter(line))) if words and terms else {})
            some = pa.array([k > 0 for k in n])
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array(n, pa.int64()), pa.array([list(f) for f in found], pa.list_(pa.int32())),
                pa.array([list(f.values()) for f in found], pa.list_(pa.int64())),
            ], names=["doc_id", "n", "terms", "tf"]).filter(some)

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<bigint>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


class _Best:
    """The best ``k`` (score, document) of each item so far, null ids last."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.item, self.score, self.doc, self.lost = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, doc: np.ndarray, lost: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item. ``lost``: documents without an id."""
        at, item = np.nonzero((scores > 0) & (scores >= self.least))
        item, score, doc, lost = (np.concatenate(c) for c in (
            (self.item, item), (self.score, scores[at, item]), (self.doc, doc[at]), (self.lost, lost[at])))
        order = np.lexsort((doc, lost, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.k]
        self.item, self.score, self.doc, self.lost = item[place < self.k], score[order], doc[order], lost[order]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.least[self.item[last]] = self.score[last]


def best_of_tasks(counted: DataFrame, weights: np.ndarray, postings: list[np.ndarray], n_items: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(``item``, ``score``, ``doc_id``): the best ``k`` documents for each item among those of each task."""
    sizes = np.array([len(p) for p in postings], np.int64)
    begin = np.cumsum(sizes) - sizes
    items = np.concatenate([*postings, np.zeros(0, np.int64)]).astype(np.int64)

    def scores(n, lengths, terms, tf) -> np.ndarray:
        m = 10 + 90 * n * n_docs // n_terms
        doc = np.repeat(np.arange(len(n)), lengths)
        part = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        # Every found term goes to all items that hold it.
        fan = sizes[terms]
        place = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(begin[terms], fan)
        out = np.zeros(len(n) * n_items, np.int64)
        np.add.at(out, np.repeat(doc, fan) * n_items + items[place], np.repeat(part, fan))
        return out.reshape(len(n), n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, block = _Best(k, n_items), 16  # small at first: a threshold soon keeps most scores out
        for batch in batches:
            lo = 0
            while lo < batch.num_rows:
                rows = batch.slice(lo, block)
                lengths, terms = _lists(rows.column(2))
                _, tf = _lists(rows.column(3))
                ids = rows.column(0)
                best.add(scores(rows.column(1).to_numpy(), lengths, terms, tf), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
                lo, block = lo + block, max(1, min(2 * block, CELLS // max(n_items, 1), 1024))
        yield pa.RecordBatch.from_arrays([
            pa.array(best.item), pa.array(best.score), pa.array(best.doc, mask=best.lost),
        ], names=["item", "score", "doc_id"])

    return counted.mapInArrow(run, "item long, score long, doc_id long")


def _search_block(documents: DataFrame, block: list, kind: str, doc_id: str, text: str, k: int) -> DataFrame:
    spark = documents.sparkSession
    terms = sorted({t for r in block for t in r["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    lists: list[list[int]] = [[] for _ in terms]
    for i, r in enumerate(block):
        for t in r["terms"]:
            lists[number[t]].append(i)
    counted = materialise(count_terms(documents, terms, doc_id, text), "term-counts")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        df[r["term"]] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    postings = [np.array(p, np.int64) for p in lists]
    found = best_of_tasks(counted.select("doc_id", "n", "terms", "tf"), weights, postings, len(block), n_docs, max(n_terms, 1), k)
    ranked = top_k(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {kind}")
    return names.join(ranked, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", k: int = BEST, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``item_id``, ``rank``, ``doc_id``, ``score``): the best ``k`` documents for each item."""
    known = materialise(item_terms(items, item, item_text), "item-terms").filter(F.size("terms") > 0)
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + F.octet_length(t))
    total = known.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n_blocks, kind = max(1, -(-int(total) // block_bytes)), known.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(n_blocks):
        block = known.filter(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == b).orderBy("row").collect()  # about block_bytes
        found = _search_block(documents, block, kind, doc_id, text, k)
        if n_blocks > 1:
            found = materialise(found, "ranked")
        out = found if out is None else out.unionByName(found)
    return out
