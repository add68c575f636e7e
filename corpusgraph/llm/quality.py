"""Quality rules, line by line first: failing lines go, then documents that lost too much or fail as a whole.

A line with words fails if
* it is navigation: at least ``bars`` bars or bullets stand as words of their own and make up a fifth of its words;
* it is shouting: at least ``shouts`` words, and nine in ten of those with letters hold no lower-case letter;
* it is symbols: at least three of ``[#*$%&|<>]`` and one for every two words;
* it is boilerplate: phrases of ``BOILERPLATE`` stand in it, as whole words, and make up a fifth of its words;
* it repeats: an earlier line of the document is equal, and it has at least ``repeat_words`` words;
* its punctuation runs wild: more ``!``, ``?`` and ``…`` than half its words, with four or more of them.

The document's own counts (symbols, repeated lines, words in repeated windows of five) are taken on the whole
text. It fails with fewer than ``least_words`` words, with more than ``repeat_share`` percent of its words in
repeated windows, or if failing lines hold more than ``lost_share`` percent of its words.

Defined results: a null or empty text has no words and fails; repeated rows are judged each by itself; a text
of one huge line is one line; bytes that are no UTF-8 read as U+FFFD in ``clean_text``; an empty table gives no rows; other columns pass through (one named
``quality`` gives way to the result).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusgraph.llm.words import WHITE, by_document, covered, split_words, windows

LEAST_WORDS = 10
REPEAT_WINDOW = 5
REPEAT_SHARE = 20
LOST_SHARE = 40
BARS = 2
SHOUTS = 4
REPEAT_WORDS = 3
#: Phrases of notices and menus, lower case.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy",
    "read more", "share on", "sign up for", "skip to content", "subscribe to", "terms of service", "we use cookies",
)
_BOILERPLATE = re.compile(r"\b(?:" + "|".join(map(re.escape, BOILERPLATE)) + r")\b")
_NAVIGATION = {"|", "»", "«", "›", "‹", "•", "·", ">", "/", "::"}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LINE_END = 10

VERDICT = T.StructType([
    *[T.StructField(n, T.LongType()) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
])
_ARROW = pa.struct([
    *[(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words")],
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("clean_text", pa.string()),
])


def line_fails(line: str, words: list[str]) -> bool:
    """Rules on one line's own text; repeats are judged by the document."""
    n = len(words)
    bars = sum(w in _NAVIGATION for w in words)
    if bars >= BARS and bars * 5 >= n:
        return True
    symbols = sum(map(line.count, "#*$%&|<>"))
    if symbols >= 3 and symbols * 2 >= n:
        return True
    loud = sum(map(line.count, "!?…"))
    if loud >= 4 and loud * 2 > n:
        return True
    if n >= SHOUTS and not line.islower():
        lettered = [w for w in words if w.upper() != w.lower()]
        upper = sum(w == w.upper() for w in lettered)
        if len(lettered) >= SHOUTS and upper * 10 >= len(lettered) * 9:
            return True
    notice = sum(len(p.split()) for p in _BOILERPLATE.findall(line.lower()))
    return notice > 0 and notice * 5 >= n


def clean_lines(text: str) -> tuple[list[str], int, int]:
    """Lines that stay, words that go with the others, and lines with a word that are equal to an earlier one."""
    kept, lost, repeats, seen = [], 0, 0, set()
    for line in text.split("\n"):
        words = re.findall(r"[^\x20\x09-\x0D]+", line)
        if not words:
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        if (again and len(words) >= REPEAT_WORDS) or line_fails(line, words):
            lost += len(words)
        else:
            kept.append(line)
    return kept, lost, repeats


def repeat_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of a piece: words, code points in words, and words in a window that the text holds twice."""
    n_docs = len(offsets) - 1
    words = split_words(data, offsets)
    lead = (words.data & 0xC0) != 0x80  # bytes that begin a code point
    inside = (lead & ~WHITE[words.data]).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(inside)])
    chars = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
    hashes, first = windows(words, REPEAT_WINDOW)
    doc = words.doc[first]
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = covered(first[order][again], REPEAT_WINDOW, len(words.hash))
    return words.counts, chars, np.bincount(words.doc[hit], minlength=n_docs)


def quality_rules(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a struct column ``quality``: the counts, ``base_failed``, ``kept`` and ``clean_text``
    (the lines that stay)."""

    documents = documents.drop("quality")
    result = f"quality_{uuid.uuid4().hex}"  # no name of the user's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in by_document(batches, text):
            counts, chars, repeated = repeat_words(data, offsets)
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data[offsets[0] : offsets[-1]]])])
            symbols = np.diff(symbols[offsets - offsets[0]])
            found = []
            for k, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                lines, lost, repeats = clean_lines(data[lo:hi].tobytes().decode("utf-8", "replace"))
                n = int(counts[k])
                failed = n < LEAST_WORDS or 100 * int(repeated[k]) > REPEAT_SHARE * n
                found.append({
                    "n_words": n, "word_chars": int(chars[k]), "n_symbols": int(symbols[k]), "n_dup_lines": repeats,
                    "n_repeat_words": int(repeated[k]), "lost_words": lost, "base_failed": failed,
                    "kept": not failed and 100 * lost <= LOST_SHARE * n, "clean_text": "\n".join(lines),
                })
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, _ARROW)], names=[*rows.schema.names, result])

    schema = T.StructType([*documents.schema.fields, T.StructField(result, VERDICT)])
    return documents.mapInArrow(run, schema).withColumnRenamed(result, "quality")
