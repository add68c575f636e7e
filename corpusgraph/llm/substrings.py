"""Substring deduplication: word windows that occur more than once in the corpus lose all their words.

A window is ``window`` consecutive words of one document, known by its 64-bit Rabin-Karp hash. Windows are counted
over the whole corpus, and every word in a window that starts at two places or more (in one document or in two)
goes; overlapping repeated windows merge into maximal intervals. Both counting and removal look at the input.

Plan: documents are packed into chunks of a few MB, written once. Each chunk sends its sorted hashes, cut by range,
to the shards; a shard sees a range of hashes of all chunks and answers every blob with one bit for each hash of it,
in the blob's order. A chunk takes its hashes again, sorts them as before and reads the bits off. So hashes travel once
at 5 to 6 bytes, answers at a bit, and neither a frequent passage nor a source decides the size of a task.

Two different windows share a 64-bit hash with odds of n^2 / 2^65 over n windows, about 1e-5 for 20 million.

Defined results: a null text has no words; texts shorter than a window keep all; repeated rows repeat each other's
windows and lose them all; an empty table gives no rows; other columns come back with their row (one named
``dedup`` gives way to the result).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm import blobs
from corpusgraph.llm.words import by_document, covered, pieces, split_words, texts, windows
from corpusgraph.runtime import materialise

WINDOW = 35
CHUNK_BYTES = 2 << 20
SHARD_KEYS = 4 << 20


def chunked(documents: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of whole documents: ``chunk`` (its name), ``bytes`` and ``docs`` (the documents' columns). A name is
    only read from the written table, so a task that runs again does no harm."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for rows, _, offsets in by_document(batches, "__text", chunk_bytes):
            docs = pa.StructArray.from_arrays(rows.columns, names=rows.schema.names)
            whole = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + n]), pa.array([int(offsets[-1] - offsets[0])]), whole],
                names=["chunk", "bytes", "docs"],
            )
            n += 1

    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("bytes", T.LongType()),
        T.StructField("docs", T.ArrayType(documents.schema)),
    ])
    return documents.mapInArrow(run, schema)


def _documents_of(docs: pa.ListScalar) -> pa.StructArray:
    return docs.values


def sorted_windows(column: pa.Array, window: int) -> tuple[list, np.ndarray]:
    """Words of a chunk by piece, with the first words of their windows, and all window hashes in order."""
    data, offsets = texts(column)
    parts, hashes = [], []
    for lo, hi in pieces(offsets):
        words = split_words(data, offsets[lo : hi + 1])
        found, first = windows(words, window)
        parts.append((lo, words, first, found))
        hashes.append(found)
    return parts, np.sort(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def repeated_bits(chunks: DataFrame, window: int, bits: int) -> DataFrame:
    """(chunk, shard, bits): for each distinct hash of the chunk in that shard, in order, whether it is repeated."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, hashes = sorted_windows(_documents_of(docs).field("__text"), window)
                keys, counts = np.unique(hashes, return_counts=True)
                places = blobs.cuts(keys, bits)
                sent = [(s, lo, hi) for s, (lo, hi) in enumerate(zip(places[:-1], places[1:], strict=True)) if hi > lo]
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(sent), pa.int64()), pa.array([s for s, _, _ in sent], pa.int64()),
                    pa.array([blobs.pack(keys[lo:hi], counts[lo:hi]) for _, lo, hi in sent], pa.binary()),
                ], names=["chunk", "shard", "blob"])

    def answer(table: pa.Table) -> pa.Table:
        parts = [blobs.unpack(b.as_py(), 1) for b in table.column("blob")]
        keys, counts = blobs.summed(*[np.concatenate(x) for x in zip(*parts, strict=True)])
        again = keys[counts > 1]
        found = []
        for own, _ in parts:
            at = np.searchsorted(again, own)
            hit = np.zeros(len(own), bool)
            inside = at < len(again)
            hit[inside] = again[at[inside]] == own[inside]
            found.append(np.packbits(hit).tobytes())
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "bits": pa.array(found, pa.binary())})

    sent = chunks.select("chunk", "docs").mapInArrow(send, "chunk long, shard long, blob binary")
    return sent.groupBy("shard").applyInArrow(answer, "chunk long, shard long, bits binary")


def remove_repeats(
    documents: DataFrame, text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """The documents' columns with ``dedup``: n_words, n_removed, kept (the kept words joined by one space) and
    removed (intervals of word numbers, end exclusive). The columns come back under their own names."""
    documents = documents.drop("dedup")
    names = documents.columns
    packed = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)], F.col(text).alias("__text"))
    packed = packed.drop(f"c{names.index(text)}")  # the text travels once
    chunks = materialise(chunked(packed, chunk_bytes), "chunks")
    total = chunks.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    bits = blobs.shard_bits(int(total) // 6, shard_keys)
    answers = materialise(repeated_bits(chunks, window, bits), "repeated")
    by_chunk = answers.groupBy("chunk").agg(F.collect_list(F.struct("shard", "bits")).alias("answers"))

    kind = pa.struct([
        ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, answers in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = _documents_of(docs)
                parts, hashes = sorted_windows(rows.field("__text"), window)
                keys = np.unique(hashes)
                places = blobs.cuts(keys, bits)
                again = np.zeros(len(keys), bool)
                for a in answers or ():
                    lo, hi = places[a["shard"]], places[a["shard"] + 1]
                    again[lo:hi] = np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=hi - lo).astype(bool)
                result = []
                for _, words, first, found in parts:
                    gone = covered(first[again[np.searchsorted(keys, found)]], window, len(words.hash))
                    result += _kept(words, gone)
                columns = [rows.field(k) for k in range(rows.type.num_fields)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(result, kind)], names=[*[f.name for f in rows.type], "dedup"]
                )

    result = T.StructType([
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
        T.StructField("removed", T.ArrayType(T.StructType([
            T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    joined = chunks.join(by_chunk, "chunk", "left").select("docs", "answers")
    out = joined.mapInArrow(remove, T.StructType([*packed.schema.fields, T.StructField("dedup", result)]))
    back = [F.col("__text" if c == text else f"c{k}").alias(c) for k, c in enumerate(names)]
    return out.select(*back, "dedup")


def _kept(words, gone: np.ndarray) -> list[dict]:
    """One result for each document of a piece."""
    out, at = [], 0
    for n in words.counts.tolist():
        lost = gone[at : at + n]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], lost, [False]]).astype(np.int8))).reshape(-1, 2)
        stay = np.flatnonzero(~lost) + at
        out.append({
            "n_words": n, "n_removed": int(lost.sum()),
            "kept": b" ".join([words.data[s:e].tobytes() for s, e in zip(words.start[stay], words.end[stay], strict=True)]).decode("utf-8", "replace"),
            "removed": [{"start": int(a), "end": int(b)} for a, b in edges],
        })
        at += n
    return out
