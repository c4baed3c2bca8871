"""Many texts are read at once as each text is."""

import numpy as np

from askbase.llm import lm


def test_contexts_of_many_texts_are_those_of_each():
    model = lm.Model(np.array([4.0, 3, 2, 2]), np.array([5.0] * 40))
    rng = np.random.default_rng(3)
    seqs = [rng.integers(0, 44, n).astype(np.int32).tobytes() for n in (1, 2, 3, 1, 7, 2)]
    apart = [model.read([s]) for s in seqs]
    for got, want in zip(model.read(seqs), zip(*apart)):
        assert np.array_equal(got, np.concatenate(want))
    padded = model.read(seqs[2:3])[0]
    assert padded[0].tolist() == [model.words.classes] * 2 and padded[1, 0] == model.words.classes
