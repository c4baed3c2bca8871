"""Slices of texts cut into words give the units of each text."""

import random
import re

import pyarrow as pa

from askbase.llm import pieces


def _texts(letters, seed):
    rng = random.Random(seed)
    for _ in range(300):
        yield pa.array([None if rng.random() < 0.05 else "".join(rng.choices(letters, k=rng.randint(0, 9)))
                        for _ in range(rng.randint(1, 30))], pa.string())


def test_units_of_a_slice_are_those_of_its_texts():
    find = re.compile(pieces.default_model().pattern).findall
    for texts in _texts("  \n\t▁ab.é▁\x01", 2):
        codes, units, sizes = pieces._flat(texts, find)
        alone = [pieces.units_of(t, find) for t in texts.to_pylist()]
        assert [units[c] for c in codes] == [u for own in alone for u in own]
        assert sizes.tolist() == [len(own) for own in alone]
        assert len(set(units)) == len(units)
