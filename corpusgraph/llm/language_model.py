"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

Counting. Words are counted first and numbered, the frequent ones first, so an n-gram is a row of small numbers. Tasks
reduce n-grams of the highest order to sorted rows with their counts and send one blob to each shard (``blobs``). A
shard is a range of hashes of the last word of the context; after a frequent word the follower decides as well, so no
word decides the size of a shard. An n-gram without its first word lies in the same shard: one shuffle serves all
orders. A shard adds up its n-grams, writes them as sorted arrays, makes those of the next lower order with the number
of ways in which each was extended (continuation counts), and writes for each context how many followers it has once,
twice and more often. Contexts that end in a frequent word lie in several shards; their parts, and the continuation
counts of single words, are sent on and added up. What is gathered grows with the corpus' n-grams; nothing is pruned
or capped.

Scoring. Workers memory-map the sorted arrays, look up some hundred thousand sorted keys at a time and hold a bounded
part of the arrays in memory:

    p_k(w | u) = max(c(u w) - D(c), 0) / c(u) + (D1 N1(u) + D2 N2(u) + D3 N3(u)) / c(u) * p_(k-1)(w | u')

with raw counts in the highest order, continuation counts below, and 1 / (V + 1) under single words. Discounts are
the modified Kneser-Ney estimates from the counts of counts of each order.

Tokens: words after lower-casing A-Z, then one end. Defined results: a null or empty text is one end; an unseen
context leaves all to the lower order; repeated rows count each; an empty training set leaves the uniform level alone;
other columns pass through (one named ``lm`` gives way to the result). The order is a parameter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgraph.llm import blobs, shared_arrays
from corpusgraph.llm.words import LOWER, Words, by_document, mix, split_words
from corpusgraph.runtime import materialise, work_dir

ORDER = 3
#: Bigrams of a shard, and those that a task counts before it sends them. Longer n-grams count by their words, so a
#: shard takes as much memory at any order.
SHARD_KEYS = 4 << 20
TASK_TOKENS = 4 << 20
#: Bytes of texts that a worker scores at a time. Each time it reads the arrays anew, as far as they pass what it may hold.
SCORED_BYTES = 4 << 20
END = np.uint64(0x14057B7EF767814F)
#: Numbers of the place before a text and of words that training has not seen. Words count from 1.
BEGIN, UNKNOWN = np.uint64(0), np.uint64(1 << 63)
#: Words are numbered by the power of two below their count, the most frequent first.
BANDS = 64
_STEP = np.uint64(0x9FB21C651E98DF25)


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (an end behind each text), their documents, and their places in them."""
    sizes = words.counts + 1
    ends = np.cumsum(sizes) - 1
    is_word = np.ones(int(sizes.sum()), bool)
    is_word[ends] = False
    token = np.full(len(is_word), END)
    token[is_word] = words.hash
    doc = np.repeat(np.arange(len(sizes)), sizes)
    return token, doc, np.arange(len(token)) - np.repeat(ends + 1 - sizes, sizes)


def history(token: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """The token ``back`` places before each; the begin mark before a text."""
    before = np.full(len(token), BEGIN)
    inside = np.flatnonzero(place >= back)
    before[inside] = token[inside - back]
    return before


def context_key(words: list[np.ndarray]) -> np.ndarray:
    key = np.full(len(words[0]), np.uint64(len(words)))
    for w in words:
        key = mix(key * _STEP + w)
    return key


def gram_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix((context ^ (context >> np.uint64(29))) * _STEP + word)


@dataclass
class Model:
    """Where the arrays lie and what is known of each order: n1 to n4 (n-grams with that count), the number of
    n-grams and the sum of their counts. ``first`` has for each band and shard of words the numbers given before it;
    words of numbers up to ``frequent`` are spread."""

    folder: str
    order: int
    word_bits: int
    words_each: int
    first: np.ndarray
    bits: int = 0
    frequent: int = 0
    n_words: int = 0
    train_tokens: int = 0
    stats: dict[int, list[int]] = field(default_factory=dict)

    def numbered(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, and their training counts."""
        word, back = np.unique(token, return_inverse=True)
        shard = blobs.shard_of(word, self.word_bits)
        plain, place = shared_arrays.look_up(self.folder, "words", shard, word, ("plain", "place"))
        number = np.where(plain > 0, (self.first[_band(plain), shard] + place).astype(np.uint64), UNKNOWN)
        return number[back], plain[back]

    def is_spread(self, last: np.ndarray) -> np.ndarray:
        """Whether the n-grams of contexts with these last words lie in several shards."""
        return last <= np.uint64(self.frequent)

    def gram_shard(self, last: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Shard of n-grams by the last words of their contexts; after a frequent one, and at the beginning of texts,
        the follower decides as well. An n-gram without its first word lies in the same shard."""
        return blobs.shard_of(mix(np.where(self.is_spread(last), mix(last * _STEP + word), last)), self.bits)

    def discounts(self, level: int) -> np.ndarray:
        """For counts 0, 1, 2 and 3 or more."""
        n1, n2, n3, n4 = self.stats[level][:4]
        if min(n1, n2, n3) == 0:  # too few n-grams to estimate from
            return np.array([0.0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.0, [1.0, 2.0, 3.0])])


def _band(counts: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(counts)[1] - 1, 0)


def _number_words(documents: DataFrame, text: str, model: Model, shard_keys: int) -> None:
    """Counts the words, writes them as sorted arrays with their places among the words of a band, and makes the
    numbers known to the model. The driver gets as many numbers as there are bands and shards."""
    folder, bits = model.folder, model.word_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, ...]:
            token = np.concatenate([np.zeros(0, np.uint64), *held])
            held.clear()
            return blobs.summed(np.concatenate([keys, token]), np.concatenate([counts, np.ones(len(token), np.int64)]))

        for _, data, offsets in by_document(batches, text):
            held.append(tokens(split_words(data, offsets, LOWER))[0])
            if sum(map(len, held)) > TASK_TOKENS // 4:
                keys, counts = merged()
                if len(keys) > TASK_TOKENS:
                    yield _rows("words", _by_range(keys, bits, counts)).combine_chunks().to_batches()[0]
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        if len(keys):
            yield _rows("words", _by_range(keys, bits, counts)).combine_chunks().to_batches()[0]

    def write(table: pa.Table) -> pa.Table:
        parts = [blobs.unpack(b.as_py(), 1) for b in table.column("blob")]
        keys, plain = blobs.summed(*[np.concatenate(c) for c in zip(*parts, strict=True)])
        band = _band(plain)
        sizes = np.bincount(band, minlength=BANDS)
        order = np.argsort(band, kind="stable")
        place = np.zeros(len(keys), np.int64)
        place[order] = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
        shard = int(table.column("shard")[0].as_py())
        shared_arrays.write(folder, "words", shard, keys=keys, plain=plain, place=place)
        return pa.table({"shard": pa.array([shard]), "sizes": pa.array([sizes.tolist()]), "n": pa.array([int(plain.sum())])})

    words = documents.select(text).mapInArrow(count, SENT).groupBy("shard")
    sizes = np.zeros_like(model.first)
    for row in words.applyInArrow(write, "shard long, sizes array<bigint>, n long").collect():
        sizes[:, row["shard"]] = row["sizes"]
        model.train_tokens += row["n"]
    ends = np.cumsum(sizes[::-1].ravel()).reshape(sizes.shape)[::-1]
    model.first, model.n_words = ends - sizes, int(sizes.sum())
    # A band is spread as a whole if its least count passes a quarter of a shard.
    model.frequent = int(sizes[int(np.ceil(np.log2(max(shard_keys // 4, 1)))) :].sum())


def _arranged(words: list[np.ndarray]) -> list[np.ndarray]:
    """Columns of n-grams in the order in which rows are sorted: rows of a context lie together, and contexts with
    the same last word."""
    return [words[-2], *words[:-2], words[-1]]


def _in_order(columns: list[np.ndarray]) -> list[np.ndarray]:
    return [*columns[1:-1], columns[0], columns[-1]]


def _sent(shard: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]):
    """(shard, blob) of sorted rows."""
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    at = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        rows = order[lo:hi]
        yield int(shard[lo]), blobs.pack_rows([c[rows] for c in columns], [c[rows] for c in counts])


def _rows(kind: str, sent, stats: list[int] | None = None) -> pa.Table:
    sent = [*sent, *([(0, b"")] if stats else [])]
    return pa.table({
        "kind": pa.array([kind] * len(sent), pa.string()), "shard": pa.array([s for s, _ in sent], pa.int64()),
        "blob": pa.array([b for _, b in sent], pa.binary()),
        "stats": pa.array([None] * (len(sent) - bool(stats)) + ([stats] if stats else []), pa.list_(pa.int64())),
    })


#: Of a context: followers it has once, twice and more often, and all their counts.
FOLLOWERS = ("n1", "n2", "n3", "count")
SENT = "kind string, shard long, blob binary, stats array<bigint>"


def _by_range(keys: np.ndarray, bits: int, *columns: np.ndarray):
    """(shard, blob) of sorted keys cut by range."""
    places = blobs.cuts(keys, bits)
    for shard, (lo, hi) in enumerate(zip(places[:-1], places[1:], strict=True)):
        if hi > lo:
            yield shard, blobs.pack(keys[lo:hi], *[c[lo:hi] for c in columns])


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [*np.bincount(np.minimum(counts, 5), minlength=6)[1:5].tolist(), len(counts), int(counts.sum())]


def train(documents: DataFrame, text: str = "text", order: int = ORDER, shard_keys: int = SHARD_KEYS) -> Model:
    """Counts all of ``documents`` and writes the model's arrays to shared storage."""
    spark = documents.sparkSession
    n_bytes = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    word_bits = blobs.shard_bits(int(n_bytes) // 16, shard_keys)
    folder = f"{work_dir(spark)}/ngrams-{uuid.uuid4().hex[:12]}"
    model = Model(folder, order, word_bits, shard_keys, np.zeros((BANDS, 1 << word_bits), np.int64))
    _number_words(documents, text, model, shard_keys)
    model.bits = blobs.shard_bits(model.train_tokens * order // 2, shard_keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """n-grams of the highest order, reduced over a few million tokens at a time."""
        held: list[list[np.ndarray]] = []

        def flush():
            words = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            columns, counts = blobs.reduced(_arranged(words), [np.ones(len(words[0]), np.int64)])
            sent = _sent(model.gram_shard(columns[0], columns[-1]), columns, counts)
            return _rows("grams", sent).combine_chunks().to_batches()[0]

        for _, data, offsets in by_document(batches, text):
            token, _, place = tokens(split_words(data, offsets, LOWER))
            word, _ = model.numbered(token)
            held.append([*[history(word, place, k) for k in range(order - 1, 0, -1)], word])
            if sum(len(h[0]) for h in held) * order > 2 * TASK_TOKENS:
                yield flush()
        if held:
            yield flush()

    def reduce_shard(table: pa.Table) -> pa.Table:
        """Adds up a shard, writes its n-grams of every order and the contexts it holds whole, and sends on what it
        has of the others and of single words."""
        shard = int(table.column("shard")[0].as_py())
        parts = [blobs.unpack_rows(b.as_py(), order, 1) for b in table.column("blob")]
        *columns, c = [np.concatenate(p) for p in zip(*parts, strict=True)]
        del parts
        out = []
        for level in range(order, 1, -1):
            columns, (c,) = blobs.reduced(columns, [c])
            words = _in_order(columns)
            context = context_key(words[:-1])
            key = gram_key(context, words[-1])
            by_key = np.argsort(key)
            shared_arrays.write_short(folder, f"grams{level}", shard, key[by_key], count=c[by_key])
            out.append(_rows(f"stats{level}", (), _counts_of_counts(c)))
            first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            sums = [np.add.reduceat(x.astype(np.int64), first) for x in (c == 1, c == 2, c > 2, c)]
            spread = model.is_spread(columns[0][first])
            whole = first[~spread]
            write_contexts(f"contexts{level}", shard, context[whole], *[s[~spread] for s in sums])
            pieces = first[spread]
            sent = _sent(blobs.shard_of(mix(context[pieces]), model.bits), [w[pieces] for w in columns[:-1]], [s[spread] for s in sums])
            out.append(_rows(f"contexts{level}", sent))
            # Without their first words these are the n-grams below; each counts the ways it was extended.
            columns, c = _arranged(words[1:]) if level > 2 else words[1:], np.ones(len(c), np.int64)
        (word,), ways = blobs.reduced(columns, [c])
        out.append(_rows("words", _sent(((word - np.uint64(1)) // np.uint64(shard_keys)).astype(np.int64), [word], ways)))
        return pa.concat_tables(out)

    def write_contexts(name: str, shard: int, keys: np.ndarray, *sums: np.ndarray) -> None:
        order = np.argsort(keys)
        once = order[sums[-1][order] == 1]  # seen once, so their columns are known
        shared_arrays.write_short(folder, f"{name}once", shard, keys[once])
        more = order[sums[-1][order] > 1]
        shared_arrays.write_short(folder, name, shard, keys[more], **{c: s[more] for c, s in zip(FOLLOWERS, sums, strict=True)})

    def write_spread(table: pa.Table) -> pa.Table:
        level, shard = int(table.column("kind")[0].as_py().removeprefix("contexts")), int(table.column("shard")[0].as_py())
        parts = [blobs.unpack_rows(b.as_py(), level - 1, len(FOLLOWERS)) for b in table.column("blob")]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        (last, *rest), sums = blobs.reduced(columns[: level - 1], columns[level - 1 :])
        write_contexts(f"spread{level}", shard, context_key([*rest, last]), *sums)
        return pa.table({"n": pa.array([len(last)])})

    def write_words(table: pa.Table) -> pa.Table:
        shard, parts = int(table.column("shard")[0].as_py()), [blobs.unpack_rows(b.as_py(), 1, 1) for b in table.column("blob")]
        (word,), (ways,) = blobs.reduced([np.concatenate([p[0] for p in parts])], [np.concatenate([p[1] for p in parts])])
        # Every word ends some n-gram, so the words of a shard are all there.
        shared_arrays.write(folder, "ways", shard, ways=ways)
        return pa.table({"stats": pa.array([_counts_of_counts(ways)], pa.list_(pa.int64()))})

    grams = documents.select(text).mapInArrow(count, SENT).groupBy("shard")
    rows = materialise(grams.applyInArrow(reduce_shard, SENT), "ngrams")
    for level in range(2, order + 1):
        model.stats[level] = _total(rows.filter(F.col("kind") == f"stats{level}"), 6)
    spread = rows.filter("kind like 'contexts%'").groupBy("kind", "shard").applyInArrow(write_spread, "n long")
    spread.agg(F.sum("n")).collect()
    model.stats[1] = _total(rows.filter("kind = 'words'").groupBy("shard").applyInArrow(write_words, "stats array<bigint>"), 6)
    return model


def _total(rows: DataFrame, n: int) -> list[int]:
    sums = rows.agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)) for k in range(n)]).first()
    return [int(x) for x in sums]


def _kept_back(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return np.maximum(counts - discount[np.minimum(counts, 3)], 0.0)


def probabilities(model: Model, token: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The model's probability of every token in its context, and the tokens' plain training counts."""
    folder = model.folder
    word, plain = model.numbered(token)
    n1, n2, _, _, distinct, total = model.stats[1]
    uniform, d = 1.0 / (model.n_words + 1), model.discounts(1)
    if total:
        ways, known = np.zeros(len(word), np.int64), np.flatnonzero(plain)
        at = (word[known] - np.uint64(1)).astype(np.int64)
        ways[known] = shared_arrays.at_places(folder, "ways", at // model.words_each, at % model.words_each, "ways")
        free = d[1] * n1 + d[2] * n2 + d[3] * (distinct - n1 - n2)
        p = _kept_back(ways, d) / total + free / total * uniform
    else:
        p = np.full(len(token), uniform)
    for level in range(2, model.order + 1):
        before = [history(word, place, k) for k in range(level - 1, 0, -1)]
        context, d = context_key(before), model.discounts(level)
        shard = model.gram_shard(before[-1], word)
        followers = np.zeros((len(FOLLOWERS), len(token)), np.int64)
        spread = model.is_spread(before[-1])
        for name, of in ((f"contexts{level}", ~spread), (f"spread{level}", spread)):
            at = np.flatnonzero(of)
            spot = shard[at] if name.startswith("contexts") else blobs.shard_of(mix(context[at]), model.bits)
            followers[:, at] = shared_arrays.look_up(folder, name, spot, context[at], FOLLOWERS)
            left = followers[-1, at] == 0
            at, spot = at[left], spot[left]
            once = at[shared_arrays.holds(folder, f"{name}once", spot, context[at])]
            followers[0, once] = followers[-1, once] = 1
        m1, m2, m3, seen = followers
        count, at = np.zeros(len(token), np.int64), np.flatnonzero(seen)
        (count[at],) = shared_arrays.look_up(folder, f"grams{level}", shard[at], gram_key(context, word)[at], ("count",))
        some = np.maximum(seen, 1)
        free = d[1] * m1 + d[2] * m2 + d[3] * m3
        p = np.where(seen > 0, _kept_back(count, d) / some + free / some * p, p)
    return p, plain


SCORES = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
    T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
])


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with a struct column ``lm``: ``n_tokens``, ``n_known`` (tokens seen in training), ``base_score``
    (log10 probability under single words with 0.1 added to each count) and ``score`` (under the model)."""
    documents = documents.drop("lm")
    total, distinct = model.train_tokens, model.n_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in by_document(batches, text, SCORED_BYTES):
            token, doc, place = tokens(split_words(data, offsets, LOWER))
            p, plain = probabilities(model, token, place)
            n = rows.num_rows
            base = np.log10((plain + 0.1) / (total + 0.1 * (distinct + 1)))
            sums = pa.StructArray.from_arrays([
                pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[plain > 0], minlength=n)),
                pa.array(np.bincount(doc, weights=base, minlength=n)),
                pa.array(np.bincount(doc, weights=np.log10(p), minlength=n)),
            ], names=SCORES.names)
            columns = [*rows.columns, sums]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    fields = [*documents.schema.fields, T.StructField("lm", SCORES)]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return documents.mapInArrow(run, plain).toDF(*[f.name for f in fields])
