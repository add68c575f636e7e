"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of every text.

Words are runs of letters, digits and non-ASCII bytes after lower-casing A-Z. A window is ``window``
consecutive words of an item; an item with fewer words is one window, one without words has none. A
document word inside any occurrence of a window is hit, and a document is contaminated if its hit words
are at least ``share`` percent of its words.

Defined results: a null text has no words and is clean; repeated rows are judged each by itself; without
items nothing is hit; bytes that are no UTF-8 are letters, and ``spans`` count each as one replaced character or a part
of one, as Spark shows the text; other columns pass through (one named ``contamination`` gives way to the result).

Benchmarks are test sets, small beside a corpus, but they do grow: the automaton is sent to the workers only
while the items hold at most ``automaton_bytes`` of text (checked before anything is collected). Beyond that
the items are cut into as many groups, and one scan follows another, each with its own automaton, all in one
stage without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm.words import by_document

WINDOW = 13
SHARE_PERCENT = 5
AUTOMATON_BYTES = 16 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

_LOWER = {c: c + 32 for c in range(65, 91)}

HIT_COLUMNS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def item_windows(words: list[bytes], window: int) -> list[str]:
    """Windows of one item as they stand in a normalised text, between single spaces. Latin-1 keeps a
    character for each byte."""
    if not words:
        return []
    last = max(len(words) - window, 0)
    return [f" {b' '.join(words[k : k + window]).decode('latin-1')} " for k in range(last + 1)]


def build(items: list[tuple[str, str | None]], window: int) -> ahocorasick.Automaton:
    """Automaton whose values are (numbers of the items with this window, words of the window)."""
    patterns: dict[str, list[str]] = {}
    for item, text in items:
        for pattern in item_windows(normal_words((text or "").encode()), window):
            patterns.setdefault(pattern, []).append(item)
    machine = ahocorasick.Automaton()
    for pattern, owners in patterns.items():
        machine.add_word(pattern, (tuple(dict.fromkeys(owners)), pattern.count(" ") - 1))
    machine.make_automaton()
    return machine


def scan(text: bytes, machine: ahocorasick.Automaton, known: list[dict]) -> tuple[int, np.ndarray | None, set[str]]:
    """Number of words, which of them are hit (None: none), and the items found. ``known``: ranges of words
    hit before."""
    words = normal_words(text)
    if not words:
        return 0, None, set()
    line = f" {b' '.join(words).decode('latin-1')} "
    hit, found, ends = None, set(), None
    for r in known:
        hit = np.zeros(len(words), bool) if hit is None else hit
        hit[r["start"] : r["end"]] = True
    for at, (owners, length) in machine.iter(line) if len(machine) else ():
        if ends is None:
            hit = np.zeros(len(words), bool) if hit is None else hit
            ends = np.cumsum([len(w) + 1 for w in words])  # position of the space behind each word
        last = int(np.searchsorted(ends, at))
        hit[last - length + 1 : last + 1] = True
        found.update(owners)
    return len(words), hit, found


def ranges(hit: np.ndarray | None) -> list[dict]:
    """Maximal runs of hit words."""
    if hit is None:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return [{"start": int(lo), "end": int(hi)} for lo, hi in edges.reshape(-1, 2)]


def in_code_points(text: str, runs: list[dict]) -> list[dict]:
    """Ranges of words as ranges of code points of the original text."""
    if not runs:
        return []
    # Lower-casing A-Z alone changes no length; other letters stay as they are.
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [{"start": places[r["start"]][0], "end": places[r["end"] - 1][1]} for r in runs]


def item_groups(benchmark: DataFrame, item: str, text: str, limit: int) -> list[DataFrame]:
    """The benchmark, cut so that each part holds about ``limit`` bytes of text."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // limit))
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text"))
    if n == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = SHARE_PERCENT, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """The documents with a struct column ``contamination``: ``n_words``, ``n_hit``, ``items`` (found, sorted as
    strings), ``spans`` (hit ranges in code points of the original text) and ``contaminated``."""
    documents = documents.drop("contamination")
    out, hits_column = documents, f"hits_{uuid.uuid4().hex}"  # no name of the user's
    groups = item_groups(benchmark, item, item_text, automaton_bytes)
    for k, group in enumerate(groups):
        items = [(r["item"], r["text"]) for r in group.collect()]  # about automaton_bytes at most
        out = _scan_group(out, text, items, window, hits_column, first=k == 0, last=k == len(groups) - 1)
    hits = F.col(hits_column)
    decided = hits.withField(
        "contaminated", (hits["n_hit"] > 0) & (hits["n_hit"] * 100 >= hits["n_words"] * share)
    )
    return out.select(*[F.col(f"`{c}`") for c in documents.columns], decided.alias("contamination"))


def _scan_group(
    documents: DataFrame, text: str, items: list[tuple[str, str | None]], window: int, hits: str, first: bool, last: bool
) -> DataFrame:
    """One scan. Between scans ``spans`` are ranges of words; the last turns them into code points."""
    place = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(place)),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = build(items, window)
        for rows, data, offsets in by_document(batches, text):
            columns, names = rows.columns, rows.schema.names
            before = [None] * rows.num_rows if first else columns[-1].to_pylist()
            found = []
            for lo, hi, known in zip(offsets[:-1], offsets[1:], before, strict=True):
                raw = data[lo:hi].tobytes()
                n, hit, owners = scan(raw, machine, known["spans"] if known else [])
                runs = ranges(hit)
                found.append({
                    "n_words": n, "n_hit": 0 if hit is None else int(hit.sum()),
                    "items": sorted(owners.union(known["items"] if known else ())),
                    "spans": in_code_points(raw.decode("utf-8", "replace"), runs) if last else runs,
                })
            if not first:
                columns, names = columns[:-1], names[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], names=[*names, hits])

    fields = documents.schema.fields if first else documents.schema.fields[:-1]
    return documents.mapInArrow(run, T.StructType([*fields, T.StructField(hits, HIT_COLUMNS)]))
