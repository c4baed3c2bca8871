"""Slices of texts are tokenised as each text is, a distinct word once."""

import random

import numpy as np
import pyarrow as pa

from askbase.llm import shards


def _texts(letters, seed):
    rng = random.Random(seed)
    for _ in range(300):
        yield pa.array([None if rng.random() < 0.05 else "".join(rng.choices(letters, k=rng.randint(0, 9)))
                        for _ in range(rng.randint(1, 30))], pa.string())


def test_tokens_of_a_slice_are_those_of_its_texts():
    tokenizer = shards.Tokenizer(shards.read_ranks())
    one, many = tokenizer.packer(), tokenizer.slice_packer()
    for texts in _texts(" \n\t \x0b\x1c\x85 aA1é'.sß漢-_l ​　́\U0001f600\U0001e900", 1):
        ids, ends = many(texts)
        alone = [np.frombuffer(one(t), "<u2") for t in texts.to_pylist()]
        assert ids.tolist() == np.concatenate(alone).tolist()
        assert np.diff(ends, prepend=0).tolist() == [len(a) for a in alone]
        assert many(texts, counted=True)[1].tolist() == ends.tolist()


def test_a_word_of_a_slice_is_tokenised_once(monkeypatch):
    import tiktoken
    seen = []

    class Counted(tiktoken.Encoding):
        def encode_ordinary(self, text):
            seen.append(len(text))
            return super().encode_ordinary(text)

    monkeypatch.setattr(tiktoken, "Encoding", Counted)
    texts = pa.array(["a few words again and again " * 100 + "."] * 50)
    shards.Tokenizer(shards.read_ranks()).slice_packer()(texts)
    assert sum(seen) < 100


def test_other_patterns_are_matched_text_by_text():
    ranks = {bytes([i]): i for i in range(256)}
    many = shards.Tokenizer(ranks, r"[\s\S]").slice_packer()
    assert many(pa.array(["a b", None, ""]))[0].tolist() == [97, 32, 98]
