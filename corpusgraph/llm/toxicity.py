"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

Windows are lower-case words with the spaces around them. On two thirds of the labelled sample, windows typical of each class
are found: a window counts once for each different window before it, so copies of a text do not add up, and it is
typical of toxic text if its count is significantly above what the other class' rate gives (Poisson tail, times
the number of windows: about one would pass by chance). A dictionary is trained on the typical windows of each class. A window's distance is the
number of bytes that its compressed form loses when the toxic dictionary is added to the ordinary one.

On the other third, each (window length, distance) cell gets its log-odds between the documents of both classes: the
calibrated thresholds. A document is scored by logistic regression, fitted there too, on the two highest log-odds of
its different windows. Nothing but the text is an input.

The labelled sample is bounded: ``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE`` documents of at most ``SAMPLE_BYTES`` bytes,
in the order of a hash of their ids. Scoring covers all documents and whole texts in one stage without a shuffle.

Defined results: a null or empty text has no windows and gets the score of log-odds 0; repeated rows score alike;
without toxic or without ordinary labels all documents get the share of toxic labels; an empty table gives no rows;
other columns pass through (one named ``toxicity`` gives way to the result).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm.words import LOWER, by_document, split_words

TOXIC_SAMPLE, ORDINARY_SAMPLE, SAMPLE_BYTES = 3_000, 8_000, 20_000
TOXIC_DICTIONARY, ORDINARY_DICTIONARY = 8 << 10, 110 << 10
LIFT, SIGNIFICANCE = 5.0, 1.0
LONGEST, FARTHEST = 16, 10
#: Window values that a task remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Known bytes around a window: the first are a match that opens the compressed block, the last keep the search, which
#: leaves out the end of its input, from leaving out the window.
_HEAD, _TAIL = bytes(range(1, 33)), bytes(range(200, 209))
_PARAMETERS = {
    "strategy": zstandard.STRATEGY_BTOPT, "min_match": 3, "window_log": 18, "chain_log": 16, "hash_log": 16,
    "search_log": 6, "target_length": 32, "write_content_size": 0, "write_checksum": 0, "write_dict_id": 0,
}


def windows_of(text: str | None) -> list[bytes]:
    return [b" %b " % w for w in (text or "").encode().translate(LOWER.tobytes()).split()]


def contexts(texts: list[str]) -> Counter:
    """For each window, the number of different windows before it."""
    pairs: set[tuple[bytes, bytes]] = set()
    for text in texts:
        found = windows_of(text)
        pairs.update(zip([b"", *found], found, strict=False))
    return Counter(w for _, w in pairs)


def _tail(count: int, expected: float) -> float:
    """Poisson odds of ``count`` or more, by the first terms of its tail."""
    term = math.exp(-expected + count * math.log(expected) - math.lgamma(count + 1))
    total, k = 0.0, count
    while term > total * 1e-9:
        total += term
        k += 1
        term *= expected / k
    return total


def typical(own: Counter, other: Counter) -> set[bytes]:
    """Windows whose count is well above, and not by chance, what the other class would give."""
    rate = sum(own.values()) / max(sum(other.values()), 1)
    found = set()
    for w, c in own.items():
        expected = rate * (other[w] + 0.5)
        if c > LIFT * expected and _tail(c, expected) * len(own) < SIGNIFICANCE:
            found.add(w)
    return found


def train_dictionary(texts: list[str], wanted: set[bytes] | None, size: int) -> bytes:
    """Dictionary of the windows of a class. Too small a sample for training is a dictionary as it is."""
    samples = []
    for text in texts:
        joined = b"".join(w for w in dict.fromkeys(windows_of(text)) if wanted is None or w in wanted)
        samples += [joined[k : k + 2000] for k in range(0, len(joined), 2000)]
    padded = [s.ljust(16) for s in samples if s]
    try:
        return zstandard.train_dictionary(size, padded, k=12, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(padded))[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
    dictionary = zstandard.ZstdCompressionDict(content + _HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    odds: dict[tuple[int, int], float] = field(default_factory=dict)
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def meter(self):
        """Function from a window to its calibrated log-odds."""
        plain, both = compressor(self.ordinary), compressor(self.ordinary + self.toxic)

        def value(window: bytes) -> float:
            cell = _cell(window, plain, both)
            return self.odds.get(cell, 0.0)

        return value


def _cell(window: bytes, plain: zstandard.ZstdCompressor, both: zstandard.ZstdCompressor) -> tuple[int, int]:
    framed = _HEAD + window + _TAIL
    gain = len(plain.compress(framed)) - len(both.compress(framed))
    return min(len(window), LONGEST), max(-1, min(gain, FARTHEST))


def top_two(values: list[float]) -> tuple[float, float]:
    best = sorted(values, reverse=True)[:2]
    return best[0] if best else 0.0, best[1] if len(best) > 1 else 0.0


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept by Newton's method with a small ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + 0.05 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return w


def fit(rows: list[tuple[str, int, bool]]) -> Model:
    """From (text, toxic, whether it calibrates) rows."""
    part = {(y, c): [t for t, yy, cc in rows if yy == y and cc == c] for y in (0, 1) for c in (False, True)}
    if not all(part.values()):
        share = (sum(y for _, y, _ in rows) + 0.5) / (len(rows) + 1) if rows else 0.0
        return Model(weights=(0.0, 0.0, math.log(share / (1 - share)) if rows else -30.0))
    toxic, ordinary = contexts(part[1, False]), contexts(part[0, False])
    model = Model(
        train_dictionary(part[0, False], None, ORDINARY_DICTIONARY),
        train_dictionary(part[1, False], typical(toxic, ordinary), TOXIC_DICTIONARY),
    )
    plain, both = compressor(model.ordinary), compressor(model.ordinary + model.toxic)
    known: dict[bytes, tuple[int, int]] = {}

    def cells(text: str) -> list[tuple[int, int]]:
        found = set(windows_of(text))
        for w in found:
            if w not in known:
                known[w] = _cell(w, plain, both)
        return [known[w] for w in found]

    labelled = [(cells(t), y) for y in (0, 1) for t in part[y, True]]
    seen = [Counter(), Counter()]
    for own, y in labelled:
        seen[y].update(set(own))
    n = [len(part[0, True]), len(part[1, True])]
    model.odds = {
        c: math.log((seen[1][c] + 0.5) / (n[1] + 1)) - math.log((seen[0][c] + 0.5) / (n[0] + 1))
        for c in seen[0].keys() | seen[1].keys()
    }
    # Cells below even odds say nothing: a long text has windows of every kind.
    model.odds = {c: v for c, v in model.odds.items() if v > 0}
    x = np.array([top_two([model.odds.get(c, 0.0) for c in own]) for own, _ in labelled])
    w = _logistic(x, np.array([y for _, y in labelled]))
    model.weights = (max(float(w[0]), 0.0), max(float(w[1]), 0.0), float(w[2]))
    return model


def train(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on a bounded sample of ``labels`` (id, label). Its ids are at most TOXIC_SAMPLE + ORDINARY_SAMPLE rows, so
    they are sent to the documents, and no text is shuffled."""
    named = labels.select(F.col(id).alias("id"), F.col(label).alias("label")).filter("id is not null and label is not null")
    place = F.xxhash64(F.lit(11), F.col("id"))
    wanted = None
    for value, n in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        part = named.filter(F.col("label") == value).orderBy(place, "id").limit(n)
        wanted = part if wanted is None else wanted.unionAll(part)
    calibrates = F.pmod(F.xxhash64(F.lit(12), F.col("id")), F.lit(3)) == 0
    sample = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(
        F.octet_length("text") <= SAMPLE_BYTES
    ).join(F.broadcast(wanted), "id").select("text", "label", calibrates.alias("calibrates"))
    rows = sample.toArrow()  # bounded by the sample's rows and SAMPLE_BYTES
    return fit(sorted(zip(*[rows.column(k).to_pylist() for k in range(3)], strict=True)))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with ``toxicity``, between 0 and 1."""

    documents = documents.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, known = model.meter(), {}
        for rows, data, offsets in by_document(batches, text):
            words = split_words(data, offsets, LOWER)
            order = np.lexsort((words.hash, words.doc))
            h, d = words.hash[order], words.doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            h, d, at = h[new], d[new], order[new]
            if len(known) > REMEMBERED:
                known.clear()
            values = np.zeros(len(h))
            lower = LOWER[words.data]
            for k, (key, place) in enumerate(zip(h.tolist(), at.tolist(), strict=True)):
                v = known.get(key)
                if v is None:
                    word = lower[words.start[place] : words.end[place]].tobytes()
                    v = known[key] = value(b" %b " % word)
                values[k] = v
            best = np.zeros((rows.num_rows, 2))
            bounds = np.searchsorted(d, np.arange(rows.num_rows + 1))
            for k in np.unique(d[values > 0]).tolist():
                best[k] = top_two(values[bounds[k] : bounds[k + 1]].tolist())
            a, b, c = model.weights
            result = 1 / (1 + np.exp(-np.clip(best @ np.array([a, b]) + c, -30, 30)))
            columns = [*rows.columns, pa.array(result)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    fields = [*documents.schema.fields, T.StructField("toxicity", T.DoubleType())]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return documents.mapInArrow(run, plain).toDF(*[f.name for f in fields])
