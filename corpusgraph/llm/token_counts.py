"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie of pre-tokens.

Pre-tokens are the words of a text with the vocabulary's mark for a space in front. A word's tokens are its cut into
pieces with the highest sum of scores (Viterbi); a character that no piece covers counts as one token for each of its
UTF-8 bytes. A task inserts the distinct pre-tokens of a batch into a trie. What holds at a node (the best score and
number of tokens of its prefix) is the same for all words that share the prefix, so it is computed once for each node,
from the nodes above it, and terminals store the counts; texts then add up the counts of their words. Each task has
the vocabulary (fixed in size) and a trie of its own batch, so nothing is shuffled and memory follows the batch.

The vocabulary is a public sentencepiece file; its path is a parameter. Its pieces are ranked, and a piece's score is
the logarithm of a Zipf law over its rank, -log(rank + OFFSET): the file's tokenizer is not trained here.

Ties go to the cut with fewer tokens, then to the longer last piece. Defined results: a null text or one without words
has no tokens; repeated rows count alike; a very long word is one path of the trie; an empty table gives no rows;
other columns pass through (one named ``tokens`` gives way to the result).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusgraph.llm.words import by_document, split_words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
OFFSET = 10.0
#: Score of a byte of an uncovered character: below any piece's.
BYTE_SCORE = -25.0
MARK = "▁"
#: Bytes of text whose distinct pre-tokens share a trie.
BATCH_BYTES = 4 << 20


def load_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Pieces of the file with their scores; control and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces: dict[str, float] = {}
    for k in range(model.get_piece_size()):
        if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k)):
            pieces[model.id_to_piece(k)] = -math.log(len(pieces) + OFFSET)
    return pieces


class PieceTrie:
    """The vocabulary by reversed pieces: from a node of the word trie, pieces that end there are found by walking up.
    Each node is (score or None, children by character)."""

    def __init__(self, pieces: dict[str, float]):
        self.root: list = [None, {}]
        for piece, score in pieces.items():
            node = self.root
            for c in reversed(piece):
                node = node[1].setdefault(c, [None, {}])
            node[0] = score


def count_words(words: list[str], vocabulary: PieceTrie) -> list[int]:
    """Tokens of each of the sorted, distinct ``words``.

    Sorted words visit their trie in depth-first order, so the trie need not be kept as a whole: the path to the
    current node is enough, and a node is left once no further word has its prefix."""
    path: list[str] = []  # characters from the root
    best: list[float] = [0.0]  # by depth: best score and its number of tokens
    tokens: list[int] = [0]
    out = []
    for word in words:
        shared = 0
        most = min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del path[shared:], best[shared + 1 :], tokens[shared + 1 :]
        for c in word[shared:]:
            path.append(c)
            depth = len(path)
            n_bytes = len(c.encode())
            high, n = best[-1] + n_bytes * BYTE_SCORE, tokens[-1] + n_bytes
            node = vocabulary.root
            at = depth - 1
            while at >= 0:
                node = node[1].get(path[at])
                if node is None:
                    break
                if node[0] is not None:
                    score = best[at] + node[0]
                    if score > high or (score == high and tokens[at] + 1 <= n):
                        high, n = score, tokens[at] + 1
                at -= 1
            best.append(high)
            tokens.append(n)
        out.append(tokens[-1])
    return out


def count_tokens(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with ``tokens``: ``n_words`` and ``n_tokens``."""
    documents = documents.drop("tokens")
    pieces = load_vocabulary(vocabulary)  # a fixed 32,000 entries, sent with the tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PieceTrie(pieces)
        for rows, data, offsets in by_document(batches, text, BATCH_BYTES):
            words = split_words(data, offsets)
            _, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
            distinct = [MARK + words.text(k).decode("utf-8", "replace") for k in first.tolist()]
            order = sorted(range(len(distinct)), key=distinct.__getitem__)
            counts = np.zeros(len(distinct), np.int64)
            counts[order] = count_words([distinct[k] for k in order], trie)
            sums = np.bincount(words.doc, weights=counts[back], minlength=rows.num_rows).astype(np.int64)
            found = pa.StructArray.from_arrays([pa.array(words.counts), pa.array(sums)], names=["n_words", "n_tokens"])
            columns = [*rows.columns, found]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    fields = [*documents.schema.fields, T.StructField("tokens", kind)]
    plain = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    return documents.mapInArrow(run, plain).toDF(*[f.name for f in fields])
