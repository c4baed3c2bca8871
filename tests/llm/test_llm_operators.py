"""Each operator against a plain version, over awkward rows, repeated rows and empty tables."""

import math
import os
import random
import sys
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import cases  # noqa: E402
from askbase.llm import (decontaminate, extract, license_scan, line_dedup, lm, pieces, quality, shards,  # noqa: E402
                         simhash, warc)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], cases.SCHEMA)


ROWS = [(r[0], r[1]) for r in cases.documents()]


def ordered(rows):
    return sorted(rows, key=repr)


def kept_columns(frame, docs, replaced=()):
    return [c for c in docs.columns if c not in replaced] == [c for c in frame.columns if c in docs.columns
                                                              and c not in replaced]


# 1 lines

def test_lines(docs, empty):
    got = line_dedup.dedup_lines(docs)
    assert kept_columns(got, docs, ["n_lines"])
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == ordered(
        cases.line_dedup(ROWS))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_with_a_full_filter(docs):
    """A filter far too small lets every line through and changes nothing."""
    got = line_dedup.dedup_lines(docs, filter_bits=1 << 10)
    assert ordered((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == ordered(
        cases.line_dedup(ROWS))


def test_once_filter_grows_and_never_denies():
    once = line_dedup.OnceFilter(bits=256)
    h = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    once.seen(h)
    assert once.seen(h).all() and len(once.parts) > 10


# 2 shards

def test_shards_round_trip(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    total = shards.write_shards(docs, path, "key", length=16, per_shard=100)
    got = shards.read_shards(spark, path, length=16, per_shard=100).collect()
    assert sorted(r.slot for r in got) == list(range(total))
    pack = shards.Tokenizer(shards.read_ranks()).packer()
    stop = np.array([50256], "<u2").tobytes()
    texts = {}
    for r in sorted(got, key=lambda r: (repr(r.doc_id), r.seq)):
        texts.setdefault(r.doc_id, []).append(bytes(r.tokens))
    assert b"".join(texts[7]) == pack(ROWS[8][1]) + stop and b"".join(texts[5]) == stop
    assert sum(r.n_tokens for r in got) == sum(len(pack(t)) // 2 + 1 for _, t in ROWS)
    part = shards.read_shards(spark, path, 150, 333, length=16, per_shard=100).collect()
    assert ordered(part) == ordered(r for r in got if 150 <= r.slot < 333)
    assert all(r.offset == (r.slot % 100) * (14 + 32 + 1) for r in got)


def test_shards_of_nothing(spark, empty, tmp_path):
    assert shards.write_shards(empty, f"file://{tmp_path}/none", "key") == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    a, b = (shards.feistel(np.arange(n), n, k) for k in ("a", "b"))
    assert sorted(a) == list(range(n)) and (n < 16 or list(a) != list(b))


# 3 pieces

def test_pieces_equal_the_library(docs, empty):
    import public_tokenizers
    import sentencepiece
    model = pieces.default_model()
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for size in (pieces.LEXICON_BYTES, 400):  # all units sent; a few sent and the others joined
        got = pieces.decode(pieces.encode(docs, model, lexicon_bytes=size), model)
        assert kept_columns(got, docs, ["piece_ids"])
        for r in got.collect():
            assert list(r.piece_ids) == sp.encode(r.text or "") and r.n_pieces == len(r.piece_ids)
            assert r.decoded == (r.text or "").replace("▁", " ")
            assert r.round_trip == ("▁" not in (r.text or ""))
    assert pieces.encode(empty, model).count() == 0


def best_path(unit, table, low):
    """The score of the best segmentation, by trying all."""
    if not unit:
        return 0.0
    options = [table[unit[:n]][1] + best_path(unit[n:], table, low) for n in range(1, len(unit) + 1) if unit[:n] in table]
    if unit[0] not in table:
        options.append(low + best_path(unit[1:], table, low))
    return max(options, default=float("-inf"))


def test_unigram_viterbi(spark):
    rng = random.Random(3)
    table = {"▁": (3, -4.0)} | {a: (4 + i, -3.0 - i) for i, a in enumerate("abc")}
    for p in ["ab", "▁a", "bca", "▁ab", "cc", "aab", "ba"]:
        table[p] = (len(table) + 3, -rng.uniform(2, 6))
    names = ["<unk>", "<s>", "</s>", *table]
    model = pieces.Model(table, names, [], 0, "unigram")
    texts = ["".join(rng.choice("abcz ") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    got = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).collect()
    score = {i: s for i, s in table.values()} | {0: model.low}
    for r in got:
        want = sum(best_path(u, table, model.low) for u in pieces.units_of(r.text, pieces.re.compile(model.pattern).findall))
        assert math.isclose(sum(score[i] for i in r.piece_ids), want, abs_tol=1e-9), r
    assert model.encode_long("▁aabbca") == [i for i in model.encode_long("▁aabbca")]


# 4 language model

def test_language_model(docs, empty):
    want = ordered(cases.base_scores(ROWS))
    for size in (lm.LEXICON_BYTES, 100):
        got = ordered(tuple(r) for r in lm.score_texts(docs, head=20, lexicon_bytes=size).collect())
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert all(math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got, want))
        assert all(r[6] < 0 for r in got)
    assert lm.score_texts(empty).count() == 0
    only = lm.score_texts(docs.where(lm.held_out("doc_id"))).collect()  # nothing to learn from
    assert only and all(r.train_tokens == 0 and r.base_score == 0 and r.n_known == 0 for r in only)


def test_model_probabilities_add_up_and_learn():
    rng = np.random.default_rng(0)
    model = lm.LogBilinear(np.array([5.0, 10.0, 20.0, 20.0]))
    sequence = np.array([2, 3] * 4000)  # 3 always follows 2
    contexts = model.contexts(sequence)
    squares = {n: np.full_like(getattr(model, n), 1e-6) for n in model.NAMES}
    before = model.log_probabilities(contexts, sequence).mean()
    for s in range(0, len(sequence), 256):
        model.train(contexts[s:s + 256], sequence[s:s + 256], rng, squares)
    assert model.log_probabilities(contexts, sequence).mean() > before + 0.3
    for c in contexts[:5]:
        p = np.exp(model.log_probabilities(np.repeat(c[None], 4, 0), np.arange(4)))
        assert math.isclose(p.sum(), 1, rel_tol=1e-5)


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [r for r in lm.score_texts(docs).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows)


# 5 decontamination

ITEMS = [(1, cases.PASSAGE), (2, "Short, item!"), (2, "Short, item!"), (3, None), (4, " ... "), (None, "other words here"),
         (5, "w1x1")]


def test_contamination(spark, docs, empty):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    for block in (decontaminate.BLOCK_WORDS, 1):  # one block, and one for each item
        got = decontaminate.judged(decontaminate.find_contamination(docs, bench, block_words=block))
        assert kept_columns(got, docs, ["n_words", "items", "spans"])
        rows = []
        for r in got.collect():
            hit = {k for s in r.spans for k in range(s.start, s.end)}
            rows.append((r.doc_id, r.text, r.n_words, hit, sorted(r.items), r.n_hit, r.contaminated))
        want = []
        for i, t in ROWS:
            n, hit, ids = cases.contamination(t, ITEMS)
            want.append((i, t, n, hit, sorted(ids), len(hit), len(hit) > 0 and 20 * len(hit) >= n))
        assert ordered(rows) == ordered(want)
    assert decontaminate.find_contamination(empty, bench).count() == 0
    none = decontaminate.judged(decontaminate.find_contamination(docs, bench.limit(0)))
    assert none.where("contaminated OR n_words IS NULL").count() == 0


def test_wu_manber_random():
    rng = random.Random(5)
    for _ in range(300):
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(60)]
        m = rng.randint(1, 5)
        found = {tuple(rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(m)): ["x"] for _ in range(4)}
        got = sorted(s for s, _ in decontaminate.WuManber(found).search(text))
        assert got == [i for i in range(len(text) - m + 1) if tuple(text[i:i + m]) in found]


# 6 pages

PAGE = ("<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>Home"
        "</ul></nav><div class='cookie-notice'>Accept</div><article><h1>Head &amp; more</h1><p>First\n  line <b>bold</b>"
        "<br>next<p>Caf&eacute; &#x41;<aside>side</aside><form>f</form><section id=comments><p>me too</section></article>"
        "<div class=ad>Buy</div><footer>&copy; site</footer></body></html>")


def test_page_text(spark):
    plain = "<body><div>Top bar of the site</div><div>{}</div><p>Read on at our shop</p></body>"
    rows = [(1, "http://a.example/x/1", PAGE), (2, "http://a.example/x/2", PAGE), (2, "http://a.example/x/2", PAGE),
            (3, "http://b.example/1", plain.format("one text")), (4, "http://b.example/2", plain.format("another text")),
            (5, None, None), (None, "", ""), (6, "http://c.example/", "<p>alone" + "<div>" * 3000), (7, "nonsense", "a &lt b &am")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = sorted(((r.page_id, r.text) for r in extract.extract_text(pages).collect()), key=repr)
    main = "Head & more\nFirst line bold next\nCafé A"
    assert got == sorted([(1, main), (2, main), (2, main), (3, "one text"), (4, "another text"), (5, ""), (None, ""),
                          (6, "alone"), (7, "a < b &am")], key=repr)
    assert extract.extract_text(pages.limit(0)).count() == 0


def test_common_positions():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        for got in (extract.common_positions(a, b), extract._common(a, b, 8)):
            rest = iter(b)
            assert len(got) == cases.common_length(a, b) and all(a[i] in rest for i in got)


# 7 revisits

def test_revisits(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        full = rng.random() < 0.4
        url = rng.choice(["http://H.example:80/a/?utm_x=1", "http://h.example/a#f", "http://h.example/b?z=1&b=2",
                          "HTTP://h.example/b?b=2&z=1", None])
        tag = rng.choice(['"1"', '"2"', 'W/"1"', None])
        headers = {k: v for k, v in (("ETag", tag), ("Last-Modified", rng.choice(["m", "n", None])), ("X", str(i)),
                                     ("Content-Length", str(i))) if v}
        rows.append((i, rng.choice([None, 1, 2, 3, 50, 99]), url, 200 if full else 304,
                     headers if i % 50 else None, rng.choice(["body", ""]) if full else None))
    rows += rows[:20] + [(500, 60, "http://h.example/a", 404, {}, "x"), (501, 60, "http://h.example/a", 200, {}, None)]
    records = spark.createDataFrame(rows, "record_id bigint, time bigint, url string, status int, "
                                          "headers map<string,string>, body string")
    name = {"http://H.example:80/a/?utm_x=1": "http://h.example/a", "http://h.example/a#f": "http://h.example/a",
            "http://h.example/b?z=1&b=2": "http://h.example/b?b=2&z=1",
            "HTTP://h.example/b?b=2&z=1": "http://h.example/b?b=2&z=1"}
    at = lambda r: (-1 if r[1] is None else r[1], r[0], r[3] == 304)
    want = []
    for r in rows:
        if r[3] != 304:
            continue
        url, mine = name.get(r[2]), {k.lower(): v for k, v in (r[4] or {}).items()}
        earlier = [q for q in rows if q[3] == 200 and q[5] is not None and name.get(q[2]) == url and at(q) < at(r)]
        if url is None or not earlier:
            want.append((r[0], r[1], "orphan", None, None))
            continue
        last = max(earlier, key=at)
        theirs = {k.lower(): v for k, v in (last[4] or {}).items()}
        tags = [h["etag"].removeprefix("W/") for h in (mine, theirs) if "etag" in h]
        times = [h["last-modified"] for h in (mine, theirs) if "last-modified" in h]
        status = ("resolved" if tags[0] == tags[1] else "mismatch") if len(tags) == 2 else (
            "resolved" if times[0] == times[1] else "mismatch") if len(times) == 2 else "unchecked"
        good = status != "mismatch"
        merged = theirs | {k: v for k, v in mine.items() if k not in warc.FORBIDDEN}
        want.append((r[0], r[1], status, last[0] if good else None, merged if good else None))
    got = [(r.record_id, r.time, r.status, r.response_id, r.headers)
           for r in warc.resolve_revisits(records.repartition(5)).collect()]
    norm = lambda xs: ordered((*x[:4], sorted(x[4].items()) if x[4] is not None else None) for x in xs)
    assert norm(got) == norm(want)
    assert warc.resolve_revisits(records.limit(0)).count() == 0


# 8 licences

def test_licences(spark, docs, empty):
    gpl = ("# This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
           "Public License\n as published by the Free Software Foundation; either version 3 of the License, or (at your "
           "option) any later version.").replace("License\n", "License")
    texts = [(1, gpl, ["GPL-3.0-or-later"]), (2, None, []), (3, "", []), (4, "version 3 of the license.", []),
             (5, "Released under the MIT License. " * 3 + "\nLicensed under the Apache License, Version 2.0.",
              ["MIT", "Apache-2.0"]), (6, "y" * 200_000, [])]
    frame = spark.createDataFrame([x[:2] for x in texts], "doc_id bigint, text string")
    got = {r.doc_id: (r.licences, r.status) for r in license_scan.scan_licences(frame).collect()}
    assert {k: v[0] for k, v in got.items()} == {i: want for i, _, want in texts}
    assert got[4][1] == "unknown rule" and got[2][1] == "none"
    scanned = license_scan.scan_licences(docs)
    assert kept_columns(scanned, docs, ["status"])
    assert {tuple(r.licences) for r in scanned.collect()} == {(), ("MIT", "Proprietary")}
    assert license_scan.scan_licences(empty).count() == 0


def plain_rules(ids, rules, gap):
    free, found = list(ids), []
    for name, wanted in rules:
        for start in range(len(free)):
            path = [start] if free[start] == wanted[0] else None
            for want in wanted[1:] if path else ():
                ahead = free[path[-1] + 1:path[-1] + 2 + gap]
                if want not in ahead:
                    path = None
                    break
                path.append(path[-1] + 1 + ahead.index(want))
            if path:
                found.append((path[0], name))
                free = [None if i in path else x for i, x in enumerate(free)]
    return list(dict.fromkeys(n for _, n in sorted(found)))


def test_licence_rules_random(spark):
    rng = random.Random(4)
    sentences = {f"s {c}": c for c in "abcd"}
    rules = [("L1", ["a", "b", "c"]), ("L2", ["a", "b"]), ("L3", ["d", "a"]), ("L4", ["c"])]
    lists = [[rng.choice("abcd") for _ in range(rng.randint(0, 10))] for _ in range(150)]
    frame = spark.createDataFrame([(i, "\n".join(f"S, {c}" for c in x)) for i, x in enumerate(lists)], "doc_id int, text string")
    for r in license_scan.scan_licences(frame, sentences=sentences, rules=rules, gap=1).collect():
        assert r.licences == plain_rules(lists[r.doc_id], rules, 1), lists[r.doc_id]


# 9 quality

def test_quality_counts(docs, empty):
    got = quality.features(docs)
    assert kept_columns(got, docs, ["quality"])
    rows = [(r.doc_id, r.text, (r.quality.n_words, r.quality.word_chars, r.quality.n_symbols, r.quality.n_dup_lines,
                                r.quality.n_repeat_words)) for r in got.collect()]
    assert ordered(rows) == ordered((i, t, cases.quality_counts(t)) for i, t in ROWS)
    assert quality.features(empty).count() == 0


def test_binomial_tail(spark):
    pairs = [(0, 1), (0, 500), (3, 500), (12, 1000), (0, 10_000), (80, 10_000), (10, 20)]
    frame = spark.createDataFrame(pairs, "k int, n int").select(
        "k", "n", quality.binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), 0.0125).alias("p"))
    p = Fraction(1, 80)
    for r in frame.collect():
        want = 1.0
        if r.k < r.n / 80:
            want = float(sum(math.comb(r.n, i) * p ** i * (1 - p) ** (r.n - i) for i in range(r.k + 1)))
        assert math.isclose(r.p, want, rel_tol=1e-6), r


def test_cutoffs_are_certified(spark):
    """Symbols tell bad from good in one stratum; too few labels in the other."""
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        rows.append((i, " ".join([f"word{i}x{k}" + "#" * bad for k in range(25)]), "a" if i < 1400 else None))
        labels.append((i, int(not bad)))
    rows.append((5000, " ".join(["clean"] + [f"more{k}" for k in range(30)]), "a"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (9999, 0), (5000, None)], "doc_id bigint, quality int")
    cuts = {r.stratum: r for r in quality.thresholds(quality.features(docs), marks).collect()}
    assert cuts["a"].symbols_per_word == 0.75 and cuts["a"].word_length is None
    assert cuts[None].symbols_per_word is None
    kept = {r.doc_id for r in quality.keep_good(docs, marks).collect()}
    assert kept == {i for i in range(1400) if i % 3} | set(range(1400, 1500)) | {5000}
    assert quality.keep_good(docs, marks.limit(0)).count() == len(rows)
    assert quality.keep_good(docs.limit(0), marks).count() == 0


# 10 near duplicates

def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in found]
    assert ordered(got) == ordered(cases.simhash_groups(ROWS))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r.group for r in found})
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_every_near_pair_meets():
    masks = simhash.covering_masks(list(range(64)), 4)
    rng = random.Random(6)
    for _ in range(2000):
        apart = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not m & apart for m in masks)


@pytest.mark.parametrize("crowd", [1, 8, 10_000])
def test_crowded_buckets(spark, crowd):
    """Thousands of fingerprints around two centres, in buckets dealt out again or not."""
    rng = random.Random(7)
    prints = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(700):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    prints |= {rng.getrandbits(64) for _ in range(100)}
    rows = [(k, simhash._signed(p)) for k, p in enumerate(sorted(prints))]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id bigint, fp bigint"), crowd=crowd).collect()
    u = np.array(sorted(prints), np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None]) <= 4, 1))
    want = simhash._smallest(np.arange(len(u)), a, b)
    ids = {p: i for i, p in rows}
    assert {ids[r.fp]: r.component_id for r in got} == dict(enumerate(want.tolist()))
    assert (simhash.local_components(u, 0, 4, direct=128) == want).all()
