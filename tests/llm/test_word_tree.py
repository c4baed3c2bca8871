"""The language model's tree of words: a proper distribution, equal to plain sums, and learning."""

import math

import numpy as np

from askbase.llm import lm


def plain(model, context, code):
    """ln P(code | context) by sums over all classes and over all siblings, one by one."""
    def softmax(rows, bias, at):
        scores = [sum(float(a) * float(b) for a, b in zip(hidden, r)) + float(x) for r, x in zip(rows, bias)]
        return scores[at] - math.log(sum(math.exp(s) for s in scores))

    words, tree = model.words, model.tree
    hidden = sum(words.context[c] * words.scale[i] for i, c in enumerate(context))
    leaf = code - model.base
    if leaf < 0:
        return softmax(words.target, words.bias[:, 0], code)
    total = softmax(words.target, words.bias[:, 0], model.base + leaf // tree.arity ** 2)
    for depth, level in enumerate(tree.levels):
        node = leaf // tree.arity ** depth
        first = node // tree.arity * tree.arity
        family = level[first:first + tree.arity]
        total += softmax(family[:, :-1], family[:, -1], node - first)
    return total


def model_of(leaves, seed=5):
    rng = np.random.default_rng(seed)
    model = lm.Model(np.array([9.0, 30.0, 50.0, 40.0]), np.sort(rng.integers(5, 40, leaves))[::-1].astype(float))
    for level in model.tree.levels:
        level += rng.normal(0, 0.5, level.shape).astype(np.float32)
    return model, rng


def test_probabilities_equal_plain_sums():
    for leaves in (0, 1, 2, 65, 400):
        model, rng = model_of(leaves)
        seqs = [rng.integers(0, 4 + leaves, n).astype(np.int32) for n in (1, 7, 30)]
        got = model.log_probabilities([s.tobytes() for s in seqs])
        contexts, _, _ = model.read([s.tobytes() for s in seqs])
        want = [plain(model, c, int(x)) for c, x in zip(contexts, np.concatenate(seqs))]
        assert np.allclose(got, want, atol=1e-4), leaves


def test_all_words_add_up_to_one():
    for leaves in (0, 3, 65, 400):
        model, _ = model_of(leaves)
        every = [np.array([2, 3, w], np.int32).tobytes() for w in range(4 + leaves)]
        assert math.isclose(np.exp(model.log_probabilities(every)[2::3]).sum(), 1, rel_tol=1e-4)


def test_leaves_learn_from_their_context():
    model = lm.Model(np.array([1.0, 1.0, 400.0, 400.0]), np.full(200, 20.0))
    rng = np.random.default_rng(1)
    pairs = np.array([[2, 4 + 7], [3, 4 + 8]], np.int32)[rng.integers(0, 2, 3000)].ravel()  # 7 follows 2, 8 follows 3
    contexts, classes, leaf = model.read([pairs.tobytes()])
    squares = {n: np.full_like(getattr(model.words, n), 1e-6) for n in lm.LogBilinear.NAMES}
    tree_squares, met = [np.ones_like(x) for x in model.tree.levels], [np.zeros(len(x)) for x in model.tree.levels]
    at = np.nonzero(leaf >= 0)[0]
    before = model.tree.log_probabilities(model.words.predicted(contexts[at]), leaf[at]).mean()
    for s in range(0, len(classes), 200):
        model.words.train(contexts[s:s + 200], classes[s:s + 200], rng, squares)
        part = at[(at >= s) & (at < s + 200)]
        model.tree.train(model.words.predicted(contexts[part]), leaf[part], rng, tree_squares, met)
    after = model.tree.log_probabilities(model.words.predicted(contexts[at]), leaf[at])
    assert after.mean() > before + 1
    assert met[0][[7, 8]].min() > 0 and met[0][60:].max() == 0  # only the family met is touched


def test_the_vocabulary_grows_with_the_corpus(spark):
    """More text gives more leaves; where no leaf fits in, scores come from *other* and counts stay right."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % n}" for k in range(60))) for i, n in zip(range(80), [30, 90] * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    with_leaves = lm.score_texts(docs, head=5, least=3).orderBy("doc_id").collect()
    without = lm.score_texts(docs, head=5, least=3, vector_bytes=0).orderBy("doc_id").collect()
    assert [r[:5] for r in with_leaves] == [r[:5] for r in without]
    assert all(math.isclose(a.base_score, b.base_score, rel_tol=1e-9) for a, b in zip(with_leaves, without))
    known = sum(r.score for r in with_leaves if not r.held_out)
    assert known > sum(r.score for r in without if not r.held_out)
