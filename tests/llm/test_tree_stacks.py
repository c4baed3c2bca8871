"""Families of siblings worked on in stacks give what they give one by one."""

import math

import numpy as np

from askbase.llm import lm


def _case(leaves, rows, seed):
    rng = np.random.default_rng(seed)
    tree = lm.Tree(np.sort(rng.integers(5, 900, leaves))[::-1].astype(float))
    for level in tree.levels:
        level += rng.normal(0, 0.3, level.shape)
    leaf = (leaves * rng.random(rows) ** 3).astype(np.int32)
    pair = rng.integers(0, 30, rows)
    return tree, rng.normal(0, 1, (30, lm.DIM)).astype(np.float32)[pair], leaf, pair


def _one_by_one(tree, leaf, depth):
    parent = leaf // tree.arity ** (depth + 1)
    cuts = np.nonzero(np.diff(parent, prepend=-1, append=-1))[0].tolist()
    for i, j in zip(cuts, cuts[1:]):
        yield i, j, int(parent[i]) * tree.arity


def test_stacks_hold_each_row_once_and_are_few():
    tree, _, leaf, _ = _case(30_000, 20_000, 1)
    parent = np.sort(leaf) // np.int32(tree.arity)
    for piece in (None, 16):
        stacks = list(tree.stacks(parent, 2, piece))
        rows = np.concatenate([r.ravel() for r, _, _ in stacks])
        assert np.array_equal(np.sort(rows[rows < len(parent)]), np.arange(len(parent)))
        for r, _, first in stacks:
            own = np.where(r < len(parent), parent[np.minimum(r, len(parent) - 1)] * tree.arity, first[:, None])
            assert (own == first[:, None]).all()
        assert len(stacks) < len(np.unique(parent)) / 10


def test_scores_are_normalised_products_with_and_without_equal_contexts():
    for leaves in (1, 3, 200, 7001):
        tree, hidden, leaf, pair = _case(leaves, 700, leaves)
        want = np.zeros(len(leaf))
        for depth, level in enumerate(tree.levels):
            for k, x in enumerate(leaf):
                node = x // tree.arity ** depth
                first = node // tree.arity * tree.arity
                scores = level[first:first + tree.arity].astype(float) @ np.r_[hidden[k], 1].astype(float)
                want[k] += scores[node - first] - math.log(np.exp(scores).sum())
        assert np.allclose(tree.log_probabilities(hidden, leaf), want, atol=1e-4)
        assert np.allclose(tree.log_probabilities(hidden, leaf, pair), want, atol=1e-4)


def test_training_in_stacks_takes_the_same_steps():
    for leaves in (3, 200, 7001):
        tree, hidden, leaf, _ = _case(leaves, 900, leaves)
        levels = [x.copy() for x in tree.levels]
        squares, met = [np.ones_like(x) for x in levels], [np.zeros(len(x), np.float32) for x in levels]
        tree.train(hidden, leaf, np.random.default_rng(5), [x.copy() for x in squares], met)
        rng, order = np.random.default_rng(5), np.argsort(leaf, kind="stable")
        context, leaf = np.c_[hidden, np.ones(len(hidden), np.float32)][order], leaf[order]
        for depth, level in enumerate(levels):
            node, parent = leaf // tree.arity ** depth, leaf // tree.arity ** (depth + 1)
            size = np.minimum(tree.arity, len(level) - parent * tree.arity)
            shift = np.log(np.minimum(lm.SIBLINGS, size) / size)
            right = 1 / (1 + np.exp(np.einsum("ij,ij->i", level[node], context) - shift))
            for x in np.unique(node):
                g = (right[:, None] * context)[node == x].sum(axis=0)
                squares[depth][x] += g * g
                level[x] += lm.TREE_RATE * g / np.sqrt(squares[depth][x])
            for i, j, first in _one_by_one(tree, leaf, depth):
                drawn = first + rng.permutation(int(size[i]))[:lm.SIBLINGS]
                g = -1 / (1 + np.exp(shift[i] - level[drawn] @ context[i:j].T)) @ context[i:j]
                squares[depth][drawn] += g * g
                level[drawn] += lm.TREE_RATE * g / np.sqrt(squares[depth][drawn])
            assert np.allclose(tree.levels[depth], level, atol=1e-3)
            assert met[depth].sum() > len(leaf)
