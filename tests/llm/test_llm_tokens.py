"""Word spans and keys of Arrow texts against Python."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pairlab.llm import tokens


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aB9 \t\n\x0b\x1c.é\U0001F642 "), max_size=40)),
                max_size=8))
def test_words_and_keys(texts):
    words = tokens.words_of(pa.array(texts, pa.string()))
    want = [w for t in texts for w in _lower(t).split()]
    assert [words.raw[a:b].tobytes() for a, b in zip(words.start, words.end)] == want
    assert np.diff(words.first).tolist() == [len(_lower(t).split()) for t in texts]
    by_word = {}
    for w, k in zip(want, words.key.tolist()):
        assert by_word.setdefault(w, k) == k
    assert len(set(by_word.values())) == len(by_word)


def test_words_longer_than_a_piece_and_slices():
    rng = random.Random(1)
    long = "".join(rng.choice("xyz") for _ in range(3 * tokens.PIECE + 17))
    texts = pa.array(["a " + long, long + " b", None, "", long[:-1] + "y" if long[-1] != "y" else long[:-1] + "z"])
    words = tokens.words_of(texts)
    assert words.key[1] == words.key[2] != words.key[4]
    for a, b in tokens.slices(texts, 10):
        part = tokens.words_of(texts.slice(a, b - a))
        assert part.key.tolist() == words.key[words.first[a]:words.first[b]].tolist()
    assert sum(b - a for a, b in tokens.slices(texts, 10)) == len(texts)
    assert list(tokens.slices(texts.slice(0, 0), 10)) == []
