"""Words, windows and blobs against regular expressions and plain loops."""

import numpy as np
import pyarrow as pa
from brute import WORD, lower
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import blobs
from corpusgraph.llm.words import LOWER, covered, pieces, split_words, texts, windows

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\t\x0b\x1fé🙂-", max_size=30)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(rows):
    data, offsets = texts(pa.array(rows, pa.string()))
    for lo, hi in pieces(offsets, 16):
        words = split_words(data, offsets[lo : hi + 1], LOWER)
        found = [(int(d), LOWER[np.frombuffer(words.text(k), np.uint8)].tobytes().decode()) for k, d in enumerate(words.doc)]
        want = [(d, w) for d, t in enumerate(rows[lo:hi]) for w in WORD.findall(lower(t))]
        assert found == want
        assert len({h for h in words.hash.tolist()}) == len({w for _, w in want})
        hashes, first = windows(words, 2)
        pairs = [k for k in range(len(want) - 1) if want[k][0] == want[k + 1][0]]
        assert first.tolist() == pairs
        same = {(want[k][1], want[k + 1][1]) for k in pairs}
        assert len(set(hashes.tolist())) == len(same)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 5))
def test_blobs(values, bits):
    keys, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    at = blobs.cuts(keys, bits)
    back = [blobs.unpack(blobs.pack(keys[a:b], counts[a:b]), 1) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert np.concatenate([k for k, _ in back]).tolist() == keys.tolist()
    assert np.concatenate([c for _, c in back]).tolist() == counts.tolist()
    doubled = blobs.summed(np.concatenate([keys, keys]), np.concatenate([counts, counts]))
    assert doubled[0].tolist() == keys.tolist() and doubled[1].tolist() == (2 * counts).tolist()


def test_covered():
    assert covered(np.array([1, 2, 8]), 3, 10).tolist() == [False, True, True, True, True, False, False, False, True, True]
