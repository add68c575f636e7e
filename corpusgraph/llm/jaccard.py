"""N-gram Jaccard join: all links between documents whose sets of five-word shingles are alike, pruned by Bayes.

1. Documents with equal shingle sets form a class; from here on a class counts once, whatever its number of copies.
2. Each class has 128 MinHash values. Values are cut into 32 bands of four; classes that agree on a band meet in a
   bucket. A pair at the threshold 0.8 meets nowhere with odds of (1 - 0.8^4)^32, below 5e-8.
3. In a bucket, pairs are compared 16 values at a time. After n values with m agreements the posterior of the
   similarity is Beta(m + 1, n - m + 1); a pair is dropped as soon as the probability that it reaches the threshold
   is below ``TOLERANCE``. A bucket returns edges that span what is left, never its pairs: two classes that are tied
   already are not compared again, so a bucket of near copies takes one pass.
4. Tied classes are the components of these edges. Within a component all pairs are verified on the shingle sets
   themselves, by products of small incidence matrices; the result is each class' number of links and edges that
   span the verified links. These edges' components are the groups of near duplicates.

Hot buckets and components are cut into blocks, and pairs of blocks are dealt to tasks, so no task gets more than two
blocks whatever the size. Pairs live in a task's matrices only; rows grow with the classes (and, in a component of
many blocks, with its number of blocks). Counting the links of a component takes time with the square of its different
texts; copies cost nothing.

Classes are named by 64 bits of a cryptographic hash of the set: n classes share a name with odds of n^2 / 2^65.

Defined results: words are runs of ``[^\\x20\\x09-\\x0D]``, taken as they are. A text of one to four words has one
shingle, all its words; a null text or one without words has no shingles, no links and no group, and is kept. Repeated
rows are copies of each other. A null id counts as a document; the name of a group is the least id in it that is not
null. An empty table gives no rows. Other columns, whatever their names, pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm.components import components
from corpusgraph.llm.words import Words, by_document, mix, split_words, windows
from corpusgraph.runtime import materialise

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
HASHES, BAND, STEP = 128, 4, 16
#: Most classes of a bucket, and most classes and shingles of a component, that are compared in one block.
BUCKET_BLOCK = 2048
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 400_000

_rng = np.random.default_rng(5)
_SALTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every document of a piece in order, and the n + 1 bounds of the documents."""
    hashes, first = windows(words, size)
    doc = words.doc[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(words.counts)])
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = words.counts[short] > k
            whole[has] = mix(whole[has] + words.hash[begin[short[has]] + k] + np.uint64(k + 1))
        hashes, doc = np.concatenate([hashes, whole]), np.concatenate([doc, short])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def names(hashes: np.ndarray, bounds: np.ndarray) -> list[int | None]:
    """A 64-bit name for each set; None for an empty one."""
    return [
        int.from_bytes(hashlib.blake2b(hashes[lo:hi].tobytes(), digest_size=8).digest(), "little", signed=True)
        if hi > lo else None
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)
    ]


def minhash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bits of each MinHash value, a row for each set that is not empty."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), HASHES), np.uint16)
    step = np.empty_like(hashes)
    for k in range(HASHES if len(starts) else 0):
        np.bitwise_xor(hashes, _SALTS[k], out=step)
        np.multiply(step, _FACTORS[k], out=step)
        out[:, k] = (mix(np.minimum.reduceat(step, starts)) >> np.uint64(48)).astype(np.uint16)
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For 16, 32, ... compared values, the least number of agreements that keeps a pair: the posterior chance of
    reaching the threshold after m of n is that of at most m successes in n + 1 draws at the threshold."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Which of ``others`` (signatures) stay after comparing with ``one`` step by step."""
    left, agree = np.arange(len(others)), np.zeros(len(others), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        agree = agree + (others[left, part] == one[part]).sum(axis=1)
        stay = agree >= need
        left, agree = left[stay], agree[stay]
        if not len(left):
            break
    return left


def spanning(signatures: np.ndarray, side: np.ndarray, least: list[int]) -> list[tuple[int, int]]:
    """Edges that span the surviving pairs of a bucket; with two sides, only pairs across them are compared."""
    n = len(signatures)
    label = np.arange(n)
    two = bool(side.any()) and not bool(side.all())
    edges = []
    for p in range(n):
        rest = np.arange(p + 1, n)
        rest = rest[(label[rest] != label[p]) & ((side[rest] != side[p]) | (not two))]
        if not len(rest):
            continue
        for q in rest[survivors(signatures[p], signatures[rest], least)]:
            if label[q] != label[p]:
                edges.append((p, int(q)))
                label[label == label[q]] = label[p]
    return edges


def sketch(documents: DataFrame, text: str = "text", shingle: int = SHINGLE, signatures: bool = True) -> DataFrame:
    """The documents' columns but the text, with ``__class`` and, if wanted, ``__n`` (shingles) and ``__sig``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in by_document(batches, text):
            hashes, bounds = shingle_sets(split_words(data, offsets), shingle)
            n = np.diff(bounds)
            named = names(hashes, bounds)
            columns = [*rows.columns, pa.array(named, pa.int64())]
            if signatures:
                sig = iter(minhash(hashes, bounds))
                columns += [pa.array(n), pa.array([next(sig).tobytes() if k else None for k in n], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    added = [T.StructField("__class", T.LongType())]
    if signatures:
        added += [T.StructField("__n", T.LongType()), T.StructField("__sig", T.BinaryType())]
    fields = [*documents.schema.fields, *added]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return documents.mapInArrow(run, plain).toDF(*[f.name for f in fields])


def runs(batches: Iterator[pa.RecordBatch], keys: int, most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Batches in the same order, cut so that rows with equal first ``keys`` columns stay together: what may go on
    in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if len(held) > 1 and _key(held[0], 0, keys) == _key(batch, batch.num_rows - 1, keys):
            continue  # one long run so far
        table = pa.Table.from_batches(held).combine_chunks()
        whole = table.to_batches()[0]
        last, at = _key(whole, whole.num_rows - 1, keys), whole.num_rows - 1
        while at and _key(whole, at - 1, keys) == last:
            at -= 1
        if at:
            yield whole.slice(0, at)
        held = [whole.slice(at)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _key(batch: pa.RecordBatch, row: int, keys: int) -> tuple:
    return tuple(batch.column(k)[row].as_py() for k in range(keys))


def grouped(batch: pa.RecordBatch, keys: int) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of equal keys in a batch of longs."""
    change = np.zeros(batch.num_rows, bool)
    change[0] = True
    for k in range(keys):
        values = batch.column(k).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    at = np.append(np.flatnonzero(change), batch.num_rows)
    yield from zip(at[:-1].tolist(), at[1:].tolist(), strict=True)


def _pairs_of_blocks(block: Column, n_blocks: Column) -> Column:
    """Every (lo, hi) pair of blocks with the given one in it."""
    return F.transform(F.sequence(F.lit(0).cast("long"), n_blocks - 1), lambda other: F.struct(
        F.least(block, other).alias("lo"), F.greatest(block, other).alias("hi")))


def tied(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Edges (a, b) that span all pairs of classes that share a band and survive the pruning."""
    least = least_matches(threshold, tolerance)
    n_bands = HASHES // BAND

    def cut_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            if batch.num_rows:
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, n_bands)
                keys = mix(mix(sig.reshape(-1)).reshape(sig.shape) ^ number).astype(np.int64).reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), n_bands))], names=["key", "cls"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 3):
            cls = batch.column(3).to_numpy()
            side = batch.column(4).to_numpy() != batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint16).reshape(-1, HASHES)
            found = []
            for lo, hi in grouped(batch, 3):
                if hi - lo > 1:
                    found += [(cls[lo + p], cls[lo + q]) for p, q in spanning(sig[lo:hi], side[lo:hi], least)]
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    bands = classes.select("cls", "sig").select(F.col("cls"), F.col("sig")).mapInArrow(cut_bands, "key long, cls long")
    shared = bands.groupBy("key").count().filter("count > 1")
    members = materialise(bands.join(shared, "key"), "buckets")
    n_blocks = F.ceil(F.col("count") / BUCKET_BLOCK).cast("long")
    block = F.pmod(F.xxhash64("cls"), n_blocks)
    dealt = (
        members.join(classes.select("cls", "sig"), "cls")
        .withColumn("block", block)
        .select("key", F.explode(_pairs_of_blocks(F.col("block"), n_blocks)).alias("p"), "cls", "block", "sig")
        .select("key", "p.lo", "p.hi", "cls", "block", "sig")
        .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    )
    return dealt.mapInArrow(compare, "a long, b long")


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of incidence matrices of a few thousand columns."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, count = np.unique(values, return_inverse=True, return_counts=True)
    both = count[place] > 1  # a shingle of one set is in no intersection
    column = np.cumsum(count > 1) - 1
    place, owner = column[place[both]], owner[both]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((n, n), np.float32)
    wide = 2048
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, wide):
        lo, hi = np.searchsorted(place, [at, at + wide])
        matrix = np.zeros((n, wide), np.float32)
        matrix[owner[lo:hi], place[lo:hi] - at] = 1
        out += matrix @ matrix.T
    for k, s in enumerate(sets):
        out[k, k] = len(s)
    return out


def verified(
    documents: DataFrame, id: str, text: str, classes: DataFrame, members: DataFrame, shingle: int, threshold: float
) -> DataFrame:
    """(cls, other, links, texts): for every class of a component, its links (documents, different texts) as found in
    one pair of blocks, and a class that it is tied to by verified links there."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in by_document(batches, "text"):
            hashes, bounds = shingle_sets(split_words(data, offsets), shingle)
            named = names(hashes, bounds)
            right = [k for k, (a, b) in enumerate(zip(named, rows.column(0).to_pylist(), strict=True)) if a == b]
            kept = rows.take(pa.array(right, pa.int64()))
            sets = pa.array([hashes[bounds[k] : bounds[k + 1]].tobytes() for k in right], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], sets], names=[*kept.schema.names[:-1], "set"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 3):
            for lo, hi in grouped(batch, 3):
                part = batch.slice(lo, hi - lo)
                cls, keep = np.unique(part.column(3).to_numpy(), return_index=True)  # rows that repeat an id
                size = part.column(4).to_numpy()[keep].astype(np.int64)
                side = (part.column(5).to_numpy() != part.column(1).to_numpy())[keep]
                sets = [np.frombuffer(part.column(6)[int(k)].as_py(), np.uint64) for k in keep]
                n = np.array([len(s) for s in sets])
                inter = intersections(sets).astype(np.float64)
                linked = inter >= threshold * (n[:, None] + n[None, :] - inter) - 1e-9
                np.fill_diagonal(linked, False)
                label, before = np.arange(len(cls)), None
                while before is None or (label != before).any():
                    before = label
                    label = np.minimum(label, np.where(linked, label[None, :], len(cls)).min(axis=1, initial=len(cls)))
                    label = label[label]
                counted = linked & (side[:, None] != side[None, :]) if side.any() and not side.all() else linked
                if part.column(1)[0].as_py() != part.column(2)[0].as_py() and (side.all() or not side.any()):
                    counted = np.zeros_like(linked)  # one of the two blocks is empty: its own task has counted
                yield pa.RecordBatch.from_arrays([
                    pa.array(cls), pa.array(cls[label]), pa.array((counted * size[None, :]).sum(axis=1)),
                    pa.array(counted.sum(axis=1)),
                ], names=["cls", "other", "links", "texts"])

    sizes = members.groupBy("root").agg(
        F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES)).cast("long").alias("blocks")
    )
    wanted = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("blocks")))
    body = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sets = (
        body.join(wanted.withColumnRenamed("rep", "id_").hint("merge"), F.col("id").eqNullSafe(F.col("id_")))
        .select("cls", "size", "root", "block", "blocks", "text")
        .mapInArrow(shingles, "cls long, size long, root long, block long, blocks long, set binary")
    )
    dealt = (
        sets.select("root", F.explode(_pairs_of_blocks(F.col("block"), F.col("blocks"))).alias("p"), "cls", "size", "block", "set")
        .select("root", "p.lo", "p.hi", "cls", "size", "block", "set")
        .repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    )
    return dealt.mapInArrow(count, "cls long, other long, links long, texts long")


def near_classes(
    documents: DataFrame, id: str, text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> tuple[DataFrame, DataFrame]:
    """(id, cls) of every document, and the classes: cls, size, rep (least id), links, texts, group (the class that
    names its group of near duplicates) and group_id (the least id in the group)."""
    sketched = sketch(documents.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", shingle)
    sketched = materialise(sketched.drop("text"), "sketch")
    classes = materialise(
        sketched.filter("__class is not null").groupBy(F.col("__class").alias("cls")).agg(
            F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"), F.first("__n").alias("n"), F.first("__sig").alias("sig"),
        ), "classes",
    )
    ties = components(tied(classes, threshold, tolerance))
    members = materialise(
        classes.drop("sig").join(ties.withColumnRenamed("node", "cls"), "cls"), "tied-classes")
    found = materialise(verified(documents, id, text, classes, members, shingle, threshold), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    groups = components(found.filter("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    named = (
        classes.drop("sig", "n").join(links, "cls", "left").join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("group", F.coalesce("root", "cls"))
    )
    least = named.groupBy("group").agg(F.min("rep").alias("group_id"))
    whole = materialise(named.drop("root").join(least, "group").fillna(0, ["links", "texts"]), "near-classes")
    return sketched.select("id", F.col("__class").alias("cls")), whole


def link_documents(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row for each document: its id, ``class_id`` (the least id of its group of near duplicates; its own id
    without one), ``n_links`` (other documents at the threshold or above, copies included), ``n_copies`` (other
    documents with the same set) and ``n_near_texts`` (different texts it links to)."""
    rows, classes = near_classes(documents, id, text, **options)
    return rows.join(classes.select("cls", "group_id", "size", "links", "texts"), "cls", "left").select(
        F.col("id").alias(id), F.coalesce("group_id", "id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("size") - 1, F.lit(0)).alias("n_links"),
        F.coalesce(F.col("size") - 1, F.lit(0)).alias("n_copies"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_near_texts"),
    )


def keep_one(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents less all but one of each group: the one with the least id stays (of repeated rows, one)."""
    shingle = options.get("shingle", SHINGLE)
    _, classes = near_classes(documents, id, text, **options)
    best = F.min(F.struct(F.col("rep").isNull(), "rep", "cls")).alias("best")
    stay = classes.groupBy("group").agg(best).select(F.col("best.cls").alias("cls"), F.col("best.rep").alias("rep"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns if c != text])  # no name of the user's meets an inner one
    boxed = documents.select(row.alias("row"), F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = sketch(boxed, "text", shingle, signatures=False)
    worded = rows.filter("__class is not null").join(
        stay, (F.col("__class") == F.col("cls")) & F.col("id").eqNullSafe(F.col("rep"))
    ).dropDuplicates(["__class"])
    wordless = rows.filter("__class is null")
    names = [F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in documents.columns]
    return worded.select(*names).unionAll(wordless.select(*names))
