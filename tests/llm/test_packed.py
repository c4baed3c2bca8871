import pickle
import tracemalloc

import numpy as np
import zstandard

from askbase.llm.pieces import Lexicon


def _segments(n, parts):
    pack, out = zstandard.ZstdCompressor().compress, []
    for k in range(parts):
        words = [b"%07d" % i for i in range(k, n, parts)]
        sizes = np.full(len(words), 2, np.int32)
        ids = np.array([x for w in words for x in (int(w) % 50, 7)], np.uint16)
        out.append(pack(pickle.dumps((np.full(len(words), 7, np.int32), b"".join(words), (sizes, ids)))))
    return out


def test_a_lexicon_opens_in_little_more_memory_than_it_keeps():
    lexicon = Lexicon(_segments(200_000, 40))
    tracemalloc.start()
    lexicon.open()
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 34 * 200_000
    assert peak < 46 * 200_000
    rows = lexicon.find([b"0000000", b"0199999", b"nothing"])
    assert rows[2] == -1
    for row, number in zip(rows[:2], (0, 199_999)):
        assert lexicon.ids[lexicon.first[row]:lexicon.first[row + 1]].tolist() == [number % 50, 7]


def test_an_empty_lexicon_finds_nothing():
    assert Lexicon([]).find([b"a"]).tolist() == [-1]
