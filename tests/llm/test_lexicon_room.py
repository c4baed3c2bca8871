"""A worker's lexicon keeps few bytes a word and tells words apart whose hashes agree; units keep their pieces."""

import pickle
import tracemalloc

import numpy as np
import sentencepiece
import xxhash
import zstandard

from askbase.llm import pieces
from askbase.llm.packed import Words
from askbase.llm.pieces import Lexicon

N = 200_000


def _lexicon():
    pack, out = zstandard.ZstdCompressor().compress, []
    for k in range(40):
        words = [b"%07d" % i for i in range(k * N // 40, (k + 1) * N // 40)]
        out.append(pack(pickle.dumps((np.full(len(words), 7, np.int32), b"".join(words),
                                      (np.full(len(words), 2, np.int32), np.zeros(2 * len(words), np.uint16))))))
    return Lexicon(out)


def test_a_word_takes_few_bytes():
    lexicon = _lexicon()
    tracemalloc.start()
    lexicon.open()
    kept, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 29 * N and peak < 40 * N
    assert np.array_equal(lexicon.find([b"%07d" % i for i in range(N)]), np.arange(N))
    assert lexicon.find([b"%07d" % (N + i) for i in range(N)]).max() == -1


def test_words_whose_hashes_agree_are_told_apart():
    by_hash = {}
    for i in range(400_000):
        word = b"%016x" % (i * 0x9E3779B97F4A7C15 % (1 << 64))
        by_hash.setdefault(xxhash.xxh32_intdigest(word), []).append(word)
    both = [own for own in by_hash.values() if len(own) > 1]
    assert both
    words = [w for own in both for w in own[1:]] + [both[0][0]]
    part = pickle.dumps((np.full(len(words), 16, np.int32), b"".join(words), (np.arange(len(words)),)))
    lexicon = Words([zstandard.ZstdCompressor().compress(part)])
    assert lexicon.find(words).tolist() == list(range(len(words)))
    assert lexicon.find([own[0] for own in both[1:]]).max(initial=-1) == -1


def test_kept_columns_and_units_up_to_the_longest(spark):
    import public_tokenizers
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", *[("understanding" * 5)[:n] + " " + "xé" * (n // 2) for n in range(40, 52)]]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id int, text string, tail string, `a.b` int")
    model = pieces.default_model()
    for room in (pieces.LEXICON_BYTES, 10):
        got = pieces.encode(docs, model, lexicon_bytes=room, keep=["a.b", "tail"])
        assert got.columns == ["a.b", "tail", "piece_ids", "n_pieces", "round_trip"]
        for r in got.collect():
            assert list(r.piece_ids) == sp.encode(texts[r["a.b"]] or "") and r.round_trip and r.tail == "x"
    assert pieces.encode(docs, model).columns == [*docs.columns, "piece_ids", "n_pieces", "round_trip"]
