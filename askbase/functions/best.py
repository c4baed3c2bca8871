"""The first rows of each query, in numpy."""

import numpy as np


def objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def first_of_each(query: np.ndarray, key: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` rows of smallest key of each query, by query, key and id; null ids come first.

    Ids are compared among rows of equal keys only.
    """
    order = np.lexsort((key, query))
    q, k = query[order], key[order]
    last = np.minimum(np.searchsorted(q, q) + n, np.searchsorted(q, q, side="right")) - 1
    near = k <= k[last]
    order, q, k = order[near], q[near], k[near]
    same = (q[1:] == q[:-1]) & (k[1:] == k[:-1])
    tied = np.zeros(len(q), dtype=bool)
    tied[1:] |= same
    tied[:-1] |= same
    by_id = np.zeros(len(q), dtype=np.int64)
    if tied.any():
        among = ids[order[tied]].tolist()
        place = {v: i for i, v in enumerate(sorted(set(among), key=lambda v: (v is not None, v)))}
        by_id[tied] = [place[v] for v in among]
    again = np.lexsort((by_id, k, q))
    order, q = order[again], q[again]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < n]
