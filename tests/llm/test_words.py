import numpy as np
import pyarrow as pa

from sitefeed.llm import words as W
from sitefeed.llm.blocks import pack, unpack

TEXTS = ["", None, "a", " Two  words\n", "é ß\tx\x0by\x0cz", "x" * 5000, "the cat the cat", "  "]


def every(column, separators=W.SPACE, lower=False, limit=None):
    found = []
    for texts in W.slices(column, lower=lower, limit=limit):
        words = W.split(texts, separators)
        hashes = W.word_hashes(texts, words)
        for i in range(len(texts)):
            part = slice(words.first[i], words.first[i + 1])
            spans = zip(words.start[part], words.end[part], strict=True)
            found.append([(texts.data[a:b].tobytes(), int(h)) for (a, b), h in zip(spans, hashes[part], strict=True)])
    return found


def test_words_are_those_of_a_plain_split():
    for column in (pa.array(TEXTS), pa.array(TEXTS, pa.large_string()), pa.array(["zz", *TEXTS]).slice(1)):
        for limit in (1, 10, None):
            found = every(column, limit=limit)
            assert [[w for w, _ in f] for f in found] == [(t or "").encode().split() for t in TEXTS]


def test_hash_depends_on_the_word_only():
    seen = {}
    for limit in (1, 7, None):
        for text in every(pa.array(TEXTS), limit=limit):
            for word, h in text:
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_window_hashes_tell_sequences_apart():
    values = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    found = W.window_hashes(values, 3)
    assert found[0] == found[3] and len(set(found.tolist())) == 6
    assert len(W.window_hashes(values, 10)) == 0
    inside = W.windows_within(np.array([0, 0, 4, 9]), 3, 9)
    assert inside.tolist() == [True, True, False, False, True, True, True]


def test_pack_round_trip():
    r = np.random.default_rng(1)
    keys = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    values = r.integers(0, 1 << 40, 1000).astype(np.uint64)
    for n in (0, 1, 1000):
        got = unpack(pack(keys[:n], values[:n]), 2)
        assert (got[0] == keys[:n]).all() and (got[1] == values[:n]).all()
