"""SimHash buckets with many fingerprints on few open bits, against all pairs."""

import numpy as np
import pytest

from askbase.llm import simhash


def dense(count: int, bits: list[int], seed: int) -> np.ndarray:
    """``count`` distinct fingerprints that differ on ``bits`` only."""
    codes = np.random.default_rng(seed).choice(1 << len(bits), count, replace=False)
    base = np.uint64(0x9E3779B97F4A7C15) & ~np.uint64(sum(1 << p for p in bits))
    return np.sort(base | sum((codes >> k & 1).astype(np.uint64) << np.uint64(p) for k, p in enumerate(bits)))


def brute(prints: np.ndarray, radius: int) -> np.ndarray:
    labels = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    while True:
        low = np.array([labels[n].min() for n in near])
        if (low == labels).all():
            return labels
        labels = low


@pytest.mark.parametrize("count, width, radius", [(300, 9, 1), (600, 14, 2), (300, 15, 2), (1200, 15, 4),
                                                  (700, 16, 3), (500, 18, 3), (600, 24, 5), (300, 30, 4)])
def test_dense_bucket_ends(count, width, radius):
    bits = list(range(3, 3 + 2 * width, 2)) if width < 31 else list(range(width))
    prints = dense(count, bits, width)
    known = (1 << 64) - 1 - sum(1 << p for p in bits)
    assert (simhash.local_components(prints, known, radius) == brute(prints, radius)).all()


@pytest.mark.parametrize("fold", [0, 50, 500])
def test_links_before_a_fold_stay(fold):
    rng = np.random.default_rng(fold)

    def four():  # a link on four bits is mostly found in one table only
        return np.uint64(sum(1 << int(p) for p in rng.choice(64, 4, replace=False)))

    crowd = dense(400, list(range(12)), 1)  # crowded in the tables, so that pairs are folded between them
    prints = [crowd]
    for middle in rng.integers(0, 1 << 64, 150, np.uint64):
        prints.append(np.array([middle, middle ^ four(), middle ^ four()]))
    prints = np.unique(np.concatenate(prints))
    got = simhash.local_components(prints, 0, 4, direct=16, fold=fold)
    assert (got == brute(prints, 4)).all()


def test_second_level_bucket_gives_its_links(spark):
    prints = dense(400, list(range(0, 30, 2)), 5)  # 400 fingerprints agree on 49 bits
    rows = [(k, simhash._signed(int(p))) for k, p in enumerate(prints)]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), crowd=256).collect()
    want = brute(prints, 4)
    at = {f: k for k, f in rows}
    low = {}
    for r in got:
        low.setdefault(r.root, []).append(at[r.fp])
    assert sorted(map(sorted, low.values())) == sorted(np.flatnonzero(want == k).tolist() for k in np.unique(want))
