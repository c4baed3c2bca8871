"""The similarity join, the periodic runs and the spelling variants against slow plain versions."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
from askbase.llm import jaccard_join, runs, variants

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


ROWS = [(r[0], r[1]) for r in cases.documents()]


# 11 similarity join

def near_copies(seed: int, groups: int, members: int, length: int):
    """Texts in groups, each with a share of changed words about the threshold."""
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.randint(3, length))]
        for _ in range(rng.randint(1, members)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            out.append((len(out), " ".join(own + [f"tail{rng.randint(0, 3)}"] * rng.randint(0, 1))))
    return out


def compare_join(frame, rows, **how):
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in
                 jaccard_join.jaccard_join(frame, **how).collect())
    want = cases.jaccard_groups(rows, how.get("width", 3), how.get("percent", 90))
    assert got == sorted((repr(i), n, repr(c)) for i, n, c in want)


def test_join_of_awkward_documents(docs, empty):
    compare_join(docs, ROWS)
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_join_of_given_documents(real):
    compare_join(real, [tuple(r) for r in real.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed, how", [(1, {}), (2, {"percent": 70, "width": 2}), (3, {"percent": 80, "width": 1}),
                                       (4, {"group": 500, "members": 8}), (5, {"group": 1, "members": 8, "percent": 85})])
def test_join_of_near_copies(spark, seed, how):
    """Groups about the threshold, also dealt out to blocks of a few sets."""
    rows = near_copies(seed, 25, 30, 200)
    compare_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), rows, **how)


@pytest.mark.parametrize("percent", [50, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    """Sets at the allowed difference, with the differing elements anywhere, in one band or two."""
    scheme, rng = jaccard_join.PartEnum(percent), np.random.default_rng(percent)
    for _ in range(300):
        size = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 64, size, np.uint64))
        gone = int(rng.integers(0, len(a) + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[gone:]],
                                      rng.integers(0, 1 << 64, int(rng.integers(0, gone + 1)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and not np.array_equal(a, b) and 100 * both >= percent * (len(a) + len(b) - both):
            assert len(np.intersect1d(scheme.signatures(a), scheme.signatures(b)))


# 12 runs

def word_texts(seed: int):
    rng = random.Random(seed)
    for _ in range(120):
        kinds = rng.choice([1, 2, 3, 8])
        text = [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            part = [rng.randrange(kinds + 2) for _ in range(rng.randint(1, 7))]
            at = rng.randint(0, len(text))
            text[at:at] = (part * rng.randint(2, 8))[:rng.randint(1, 60)]
        yield [b"w%d" % x for x in text]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    for words in word_texts(seed):
        assert runs.find_runs(words) == cases.runs(words)


@pytest.mark.parametrize("least, exponent", [(2, 2), (6, 3), (9, 4), (10, 5)])
def test_runs_of_other_sizes(least, exponent):
    for words in word_texts(77):
        assert runs.find_runs(words, least, exponent) == cases.runs(words, least, exponent)


def test_grammar_gives_the_text_back():
    for words in word_texts(5):
        ids = [int(w[1:]) for w in words]
        grammar = runs.Grammar([ids, ids[::-1]], 99)
        texts = {}
        for i, (left, right) in enumerate(grammar.rules):
            texts[99 + i] = texts.get(left, [left]) + texts.get(right, [right])
        assert [[x for s in start for x in texts.get(s, [s])] for start in grammar.starts] == [ids, ids[::-1]]
        counts = collections.Counter(p for s in grammar.starts for p in zip(s, s[1:]) if p[0] != p[1])
        assert max(counts.values(), default=0) < 2


def test_runs_of_long_texts():
    assert runs.find_runs([b"a"] * 300_000) == [(0, 300_000, 1)]
    period = [b"%d" % i for i in range(5000)]
    assert runs.find_runs([b"x"] + period * 5 + [b"y"]) == [(1, 25_000, 5000)]
    assert runs.find_runs([b"%d" % i for i in range(100_000)]) == []


def test_runs_query_fields(docs, empty, spark, real):
    got = runs.with_runs(docs).collect()
    assert sorted(repr((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in got) == sorted(
        repr((i, len(cases.words(t)), cases.runs(cases.words(t)) if len(t or "") < 5000 else [],
              cases.collapsed(cases.words(t)) if len(t or "") < 5000 else " ".join(cases.words(t)))) for i, t in ROWS)
    assert "n_words" in got[0].asDict() and got[0]["kept"] == 4 and runs.with_runs(empty).count() == 0
    texts = {r.doc_id: cases.planted_words(r.doc_id, r.text) for r in real.select("doc_id", "text").collect()}
    seen = 0
    for r in runs.op12_periodic_runs(spark, DATA).collect():
        words = texts[r.doc_id]
        if len(words) > 400:
            continue
        found, seen = cases.runs(words), seen + 1
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), cases.sha(lines), cases.sha(cases.collapsed(words)))
        assert (r.start, r.length, r.period, r.exponent_milli) == (
            (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert seen > 100


# 13 variants

def random_words(seed: int, count: int, letters: str, shortest: int = 5):
    rng, out = random.Random(seed), {}
    while len(out) < count:
        word = "".join(rng.choice(letters) for _ in range(rng.randint(shortest, shortest + 4)))
        out[word] = rng.randint(3, 60)
        if rng.random() < .5:
            at = rng.randrange(len(word))
            out[word[:at] + rng.choice(letters) * rng.randint(0, 2) + word[at + 1:]] = rng.randint(3, 60)
    return {w: n for w, n in out.items() if len(w) >= shortest}


@pytest.mark.parametrize("seed, letters, crowd", [(1, "abcdefghij", 4096), (2, "ab", 4096), (3, "abé", 40), (4, "ab", 3),
                                                  (5, "aàb", 1)])
def test_near_words_equal_brute_force(spark, seed, letters, crowd):
    words = random_words(seed, 400, letters)
    frame = spark.createDataFrame(list(words.items()), "word string, n bigint").repartition(3)
    got = {r.word: (r.n_near, r.best_n, r.best) for r in variants.near_words(frame, 5, crowd).collect()}
    assert got == cases.near_words(words)


def test_position_index():
    words = ["house", "horse", "mouse", "houses", "hous", "ouse", "hhouse"]
    index = variants.PositionIndex(words)
    of = lambda bits: {w for k, w in enumerate(words) if bits >> k & 1}
    assert of(index.near("house", 5)) == {"horse", "mouse", "houses", "hhouse"}
    assert of(index.near("house", 4)) == {"hous", "ouse"}
    assert of(index.near("house", 5, apart=2)) == {"mouse", "hhouse"}


def test_forms_lead_to_roots(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w0"), ("b", "w36"), ("c", "d")]
    got = {r.word: r.root for r in variants.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {**{w: "w37" for w, _ in forms}, "c": "d"}


def test_variants_of_awkward_documents(docs, empty):
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root)
           for r in variants.spelling_variants(docs, min_count=1).collect()}
    assert got == cases.variants(ROWS, min_count=1) and len(got) >= 30
    assert variants.spelling_variants(empty).count() == 0


def test_variants_of_given_documents(spark, real):
    rows = [tuple(r) for r in real.select("doc_id", "text").collect()]
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in variants.op13_spelling_variants(spark, DATA).collect()}
    assert got == cases.variants(rows, planted=True) and any(v[2] for v in got.values())


def test_skew_join(spark):
    from askbase.llm.common import skew_join
    left = spark.range(10_000).select("id", F.when(F.col("id") < 4000, F.lit(7)).otherwise(F.col("id") % 1500).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.min("id").alias("low")).where("k <> 8")
    got = skew_join(left, right, "k", "rows", heavy=10)
    want = left.join(right.drop("rows"), "k")
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
