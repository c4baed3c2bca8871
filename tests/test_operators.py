"""Small goldens, traps and invariants, checked against plain Python."""

import math
import os
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from askbase.functions import payloads, text, vocab
from askbase.operators import answers, chunks, evaluation, fusion, layout, ordered, ranking, rows
from askbase.sources import cells, configs, corpus, files, terms
from askbase.sources.corpus import CorpusStore
from askbase.plans.ingest import ingest
from askbase.streaming import ingest as streaming


def one(spark, value, expr, type_="string"):
    frame = spark.createDataFrame([(value,)], f"x {type_}")
    return frame.select(expr("x").alias("y")).first().y


# ---- text rules ----------------------------------------------------------------

@pytest.mark.parametrize("value", ["", " ", "a", " a\t", " a b ", "one  two\nthree", "\x1ca\x1f"])
def test_strip_and_word_count_as_python(spark, value):
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, value, text.word_count) == len(value.split())


@pytest.mark.parametrize("value,want", [
    ("Client_Form A.xlsx", "client_form_a"), ("DRAFT - North 2.xlsx", "draft_north_2"),
    ("---.xlsx", "untitled"), ("Éa.xlsx", "a")])
def test_slug(spark, value, want):
    assert one(spark, value, lambda c: text.slug(text.stem(c))) == want


def test_slug_collision_is_reported(spark):
    names = spark.createDataFrame([("A-b.xlsx", 2), ("A b.xlsx", 2), ("c.xlsx", 2)], "f string, r long")
    ids = names.select(text.pair_id("f", "r").alias("chunk_id"))
    assert [tuple(r) for r in chunks.duplicate_ids(ids).collect()] == [("a_b_row_2", 2)]
    with pytest.raises(ValueError):
        chunks.require_unique_ids(ids)


def test_tokens_keep_ascii_only(spark):
    assert one(spark, "Éa ISO-27001, b", text.tokens) == ["a", "iso", "27001", "b"]


@pytest.mark.parametrize("n", [1, 26, 27, 52, 702, 703, 16384])
def test_column_letters_round_trip(spark, n):
    assert one(spark, n, lambda c: text.column_index(text.column_letter(c)), "long") == n


def test_column_letter_names(spark):
    want = {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    assert {n: one(spark, n, text.column_letter, "long") for n in want} == want


def test_four_shortening_rules(spark):
    value = " \n" + "x" * 500
    assert one(spark, value, text.shorten_cell) == "x" * 79 + "…"
    assert one(spark, value, text.shorten_chunk) == "| " + "x" * 237 + "…"
    assert one(spark, value, text.shorten_hit) == "  | " + "x" * 155 + "…"
    assert one(spark, value, text.shorten_candidate) == value[:400] + "…"


def test_two_refusal_rules(spark):
    loud = "Sorry: I CANNOT FIND THIS IN OUR CORPUS."
    assert one(spark, loud, text.says_refusal) and not one(spark, loud, text.is_refusal)
    assert one(spark, f" {vocab.REFUSAL_TEXT}\n", text.is_refusal)


def test_pair_row(spark):
    assert [one(spark, v, text.pair_row) for v in ("a_row_12", "a_row_12x", "", "zz")] == [
        "12", "a_row_12x", "?", "zz"]


# ---- JSON -----------------------------------------------------------------------

@pytest.mark.parametrize("raw,want", [
    ('{"ranking": [2, 0]}', [2, 0]), ('{"ranking": ["1", 1.9, true]}', [1, 1, 1]),
    ('{"ranking": ["1.5"]}', None), ('{"ranking": [null]}', None), ('{"ranking": null}', []),
    ("{}", []), ("[1]", None), ("oops", None), (None, None)])
def test_ranking_positions(spark, raw, want):
    assert one(spark, raw, payloads.ranking_positions) == want


@pytest.mark.parametrize("raw,want", [
    ('{"faithfulness": 9, "relevance": "4", "completeness": 2.9, "reasoning": " ok "}', (9, 4, 2, "ok")),
    ('{"faithfulness": 5, "relevance": 4}', None), ('{"faithfulness": "x", "relevance": 4, "completeness": 1}', None),
    ("[]", None), ("nope", None)])
def test_judge_scores(spark, raw, want):
    got = one(spark, raw, payloads.judge_scores)
    assert (tuple(got) if got else None) == want


# ---- ordered operators ----------------------------------------------------------------

@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.booleans()), min_size=1, max_size=40),
       st.integers(1, 7))
def test_block_scan_equals_one_pass(spark, items, block):
    data = [(k, i * 3, f"m{i}" if m else None) for i, (k, m) in enumerate(items)]
    frame = spark.createDataFrame(data, "k string, n long, m string")
    got = ordered.block_scan(frame, ["k"], "n", {"last": F.col("m")}, {"i": F.col("m").isNull()}, block)
    state, want = {}, set()
    for k, n, m in data:
        last, count = state.get(k, (None, 0))
        want.add((k, n, m or last, count))
        state[k] = (m or last, count + (m is None))
    assert {(r.k, r.n, r["last"], r.i) for r in got.collect()} == want


def sheet(spark, lines):
    wide = spark.createDataFrame([("F-1.xlsx", "S", n + 1, *line) for n, line in enumerate(lines)],
                                 "source_file string, sheet string, row_no long, A string, B string, C string")
    mapping = spark.createDataFrame([("F-1.xlsx", "A", "question"), ("F-1.xlsx", "B", "answer"),
                                     ("F-1.xlsx", "C", "section")], "source_file string, col_letter string, role string")
    files_ = spark.createDataFrame([("F-1.xlsx", "S", 1, "Acme", None)],
                                   "source_file string, sheet string, header_row long, client string, date string")
    return wide, configs.build_configs(mapping, files_)


def test_rows_sections_and_metadata(spark):
    wide, config = sheet(spark, [
        ("Question", "Answer", "Section"), ("Legal", None, None), ("Is it ok?", "yes", ""),
        ("", "answer only", ""), ("Own?", "", "Mine"), ("New part", "", ""), ("Short?", "", "")])
    got = rows.load_rows(cells.grid_from_wide(wide), config, block=2).orderBy("row_no").collect()
    assert [(r.row_no, r.row_index, r.pair_id, r.metadata) for r in got] == [
        (3, 0, "f_1_row_3", {"section": "Legal", "client": "Acme"}),
        (5, 1, "f_1_row_5", {"section": "Mine", "client": "Acme"}),
        (7, 2, "f_1_row_7", {"section": "New part", "client": "Acme"})]
    built = chunks.build_chunks(rows.load_rows(cells.grid_from_wide(wide), config), "separated")
    assert built.count() == 6 and chunks.non_empty(built).count() == 2 * 3 - 2
    assert sorted(r.chunk_index for r in built.collect()) == list(range(6))


def test_empty_chunk_stats(spark):
    empty = spark.createDataFrame([], "text string")
    assert tuple(chunks.chunk_stats(empty).first()) == (0, 0.0, 0, 0)


def test_config_problems_are_raised(spark):
    _, config = sheet(spark, [("Question", "Answer", "x")])
    configs.require_valid_configs(config)
    with pytest.raises(ValueError, match="missing role answer"):
        configs.require_valid_configs(config.withColumn("columns", F.map_filter("columns", lambda k, v: k != "answer")))


# ---- retrieval ------------------------------------------------------------------------------

def brute_bm25(docs, query):
    words = {i: re.findall("[a-z0-9]+", t.lower()) for i, t in docs}
    n, mean = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(t for w in words.values() for t in set(w))
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = {}
    for i, w in words.items():
        tf = Counter(w)
        s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(w) / mean))
                for t in re.findall("[a-z0-9]+", query.lower()) if t in tf)
        if s > 0:
            out[i] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


def made_docs(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 20
    return [(f"d{i:03}", " ".join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for i in range(n)]


@pytest.mark.parametrize("how, sent", [({}, 1000), ({"salts": 3, "heavy_share": 0.0, "buckets": 2}, 1000),
                                       ({"salts": 4, "heavy_share": 0.03}, 0)])
def test_bm25_equals_brute_force(spark, how, sent):
    docs = made_docs(80, 1) + [(f"copy{i}", "w1 w2 the") for i in range(40)]
    asked = [("q1", "W1 w2 the the"), ("q2", "w9 unknown"), ("q3", "zzz"), ("q4", "the"), ("q5", "w3-w4")]
    index = terms.temporary_index(spark.createDataFrame(docs, "chunk_id string, text string").repartition(5), **how)
    got = index.bm25(spark.createDataFrame(asked, "query_id string, text string"), 7, sent=sent)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    for q, words in asked:
        want = [(i, round(s, 6)) for i, s in brute_bm25(docs, words)[:7]]
        assert found.get(q, []) == want


@pytest.mark.parametrize("metric, how", [("cosine", {}), ("l2", {}), ("l2_sq", {"block": 1, "part": 7})])
def test_knn_equals_brute_force_with_ties(spark, metric, how):
    rng = random.Random(3)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    data += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(200, [0.0] * 4)]
    asked = [("a", [1.0, 0.1, 0.0, 0.0]), ("b", [0.0, 0.0, 1.0, 1.0])]

    def distance(x, y):
        if metric != "cosine":
            d = sum((p - q) ** 2 for p, q in zip(x, y))
            return d if metric == "l2_sq" else math.sqrt(d)
        size = math.hypot(*x) * math.hypot(*y)
        return 1 - (sum(p * q for p, q in zip(x, y)) / size if size else 0)

    got = ranking.knn(spark.createDataFrame(data, "chunk_id long, embedding array<double>").repartition(4),
                      spark.createDataFrame(asked, "query_id string, embedding array<double>"), 9, metric, **how)
    for q, v in asked:
        want = sorted(((round(distance(x, v), 9), i) for i, x in data))[:9]
        mine = [r.chunk_id for r in got.filter(F.col("query_id") == q).orderBy("rank").collect()]
        assert mine == [i for _, i in want]


def test_many_queries_meet_the_whole_corpus(spark):
    """More queries than a block holds; the corpus is scanned once and nothing is collected on the way."""
    rng = random.Random(9)
    data = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(200)]
    asked = [(f"q{i}", [rng.gauss(0, 1) for _ in range(3)]) for i in range(1500)]
    corpus = spark.createDataFrame(data, "chunk_id long, embedding array<double>").repartition(3)
    got = ranking.knn(corpus, spark.createDataFrame(asked, "query_id string, embedding array<double>").repartition(20),
                      2, "l2", block=64)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # the packed corpus once, and the scores
    best = {(r.query_id, r.rank): r.chunk_id for r in got.collect()}
    assert len(best) == 3000
    for q, v in asked[::50]:
        near = sorted((sum((a - b) ** 2 for a, b in zip(x, v)), i) for i, x in data)
        assert [best[q, 1], best[q, 2]] == [near[0][1], near[1][1]]
    words = [(f"d{i}", f"w{i % 300} w{i % 7} the") for i in range(900)]
    index = terms.temporary_index(spark.createDataFrame(words, "chunk_id string, text string"))
    found = index.bm25(spark.createDataFrame([(f"q{i}", f"w{i % 300}") for i in range(1500)], "query_id string, text string"), 1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "regexp" not in plan
    top = {r.query_id: int(r.chunk_id[1:]) for r in found.collect()}
    assert len(top) == 1500 and all(top[f"q{i}"] % 300 == i % 300 or i % 300 < 7 for i in range(1500))


def test_index_follows_the_store(spark, tmp_path):
    """One index for a version of the store; a change of the chunks makes the next one."""
    place = CorpusStore(spark, f"file://{tmp_path}/lib")
    chunk = "chunk_id string, text string, metadata map<string,string>, pair_id string, role string, " \
            "chunk_index long, strategy string, source_file string"
    row = lambda i, f: (f"c{i}", f"word{i} common", {}, "p", "question", i, "separated", f)
    place.write(spark.createDataFrame([row(1, "a"), row(2, "a")], chunk))
    first = place.term_index("separated", "question")
    assert place.term_index("separated", "question").path == first.path
    assert {r.term: r.df for r in first.term_stats().collect()} == {"word1": 1, "word2": 1, "common": 2}
    place.write(spark.createDataFrame([row(3, "b")], chunk))
    second = place.term_index("separated", "question")
    assert second.path != first.path and second.totals.n_docs == 3
    assert place.term_index("separated", "answer").term_stats().count() == 0
    asked = spark.createDataFrame([("q", "common")], "query_id string, text string")
    assert place.term_index("separated", "answer").bm25(asked).count() == 0
    place.reset()
    assert place.term_index("separated").totals.n_docs == 0


def test_progress_state_does_not_grow(spark, tmp_path):
    """Runs that end leave the state; one that goes on later is counted on."""
    events = [(run, run % 2, "step", i, 100 * run + i, run * 3600 * 10 + i) for run in range(12) for i in range(5)]
    events.append((0, 0, "late", 99, 5000, 11 * 36000 + 50))
    rows = spark.createDataFrame(events, "run_id long, collection long, type string, batch long, seq long, s long").select(
        "run_id", "collection", "type", "batch", "seq", F.timestamp_seconds(F.col("s") + 36_000_000).alias("ts"))
    for run in range(12):
        part = rows.where(F.floor(F.unix_seconds("ts") / 36000) == 1000 + run).coalesce(1)
        part.write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        streaming.progress_stream(arriving, f"{tmp_path}/out", f"{tmp_path}/state", "1 second", 3600_000)
    got = {(r.run_id, r.collection): (r.type, r.batch, r.seq, r.n_events)
           for r in streaming.read_progress(spark, f"{tmp_path}/out").collect()}
    want = {(run, run % 2): ("step", 4, 100 * run + 4, 5) for run in range(12)} | {(0, 0): ("late", 99, 5000, 6)}
    assert got == want
    finished = spark.read.parquet(f"{tmp_path}/out").where("finished").select("run_id").distinct().count()
    assert finished == 11  # all but the last one
    sizes = spark.read.format("statestore").load(f"{tmp_path}/state").count()
    assert sizes <= 2


def hits(spark, items):
    return spark.createDataFrame(items, "query_id string, chunk_id string, rank long")


def test_fusion_is_symmetric_with_total_order(spark):
    a = hits(spark, [("q", "x", 1), ("q", "y", 2)])
    b = hits(spark, [("q", "z", 1), ("q", "y", 2)])
    one_way = fusion.reciprocal_rank_fusion(a, b).orderBy("rank").collect()
    other = fusion.reciprocal_rank_fusion(b, a).orderBy("rank").collect()
    assert one_way == other and [r.chunk_id for r in one_way] == ["y", "x", "z"]
    assert one_way[0].score == pytest.approx(2 / 62)


@pytest.mark.parametrize("raw,want", [
    ('{"ranking": [2, 0]}', "cabd"), ('{"ranking": [9, -1, 3, 3]}', "dabc"), ("no", "abcd"), (None, "abcd")])
def test_ranking_is_a_permutation(spark, raw, want):
    pool = hits(spark, [("q", c, i) for i, c in enumerate("abcd", 1)]).withColumn(
        "score", F.lit(0.5)).withColumn("score_type", F.lit("bm25"))
    order = spark.createDataFrame([("q", raw)], "query_id string, ranking_json string")
    got = fusion.apply_ranking(pool, order, None).orderBy("rank").collect()
    assert "".join(r.chunk_id for r in got) == want
    assert [r.score for r in got] == ([4.0, 3.0, 2.0, 1.0] if raw and raw != "no" else [0.5] * 4)


@pytest.mark.parametrize("more", [0, 600])
def test_client_mentions_are_whole_words(spark, more):
    said = spark.createDataFrame([(1, "We do outfield work."), (2, "For FIELD and a.c. Ltd"), (3, None),
                                  (4, "aXc Ltd, Éfield"), (5, "The Cafe\u0301 Noir & a\\Eb, q&a")],
                                 "query_id long, answer string")
    clients = spark.createDataFrame(
        [("Field",), ("A.C. Ltd",), ("Other",), ("Cafe\u0301 Noir",), ("A\\Eb",), ("&",), (" & ",), ("",),
         *[(f"Company {i}",) for i in range(more)]], "client string")
    got = answers.client_mentions(said, clients).collect()
    assert {r.query_id: r.mentioned_clients for r in got} == {
        1: [], 2: ["A.C. Ltd", "Field"], 3: [], 4: [], 5: [" & ", "&", "A\\Eb", "Cafe\u0301 Noir"]}


def test_answer_id_changes_only_the_suffix(spark):
    assert one(spark, "a__question_row_1__question", answers.answer_id) == "a__question_row_1__answer"


def test_missing_answer_is_marked(spark):
    stored = spark.createDataFrame([("p__answer", "yes", "answer")], "chunk_id string, text string, role string")
    top = hits(spark, [("q", "p__question", 1), ("q", "r__question", 2)])
    got = answers.pair_link(top, stored, 10).orderBy("rank").collect()
    assert [r.answer_text for r in got] == ["yes", "(answer not found)"]


# ---- evaluation ----------------------------------------------------------------------------------

def test_rates_without_rows_are_zero(spark):
    schema = ("collection string, retrieval string, rerank string, scope string, recall long, mrr double, "
              "refused boolean, faithfulness long, relevance long, completeness long")
    data = [("c", "r", "k", "in", 1, 0.5, False, None, None, None), ("c", "r", "k", "in", 0, 0.0, True, None, None, None)]
    got = evaluation.aggregate_configs(spark.createDataFrame(data, schema)).first()
    assert (got.recall_at_3, got.mrr, got.retrieval_gap_rate) == (0.5, 0.25, 0.5)
    assert (got.hallucination_refusal_rate, got.faithfulness, got.n_judged) == (0.0, 0.0, 0)
    assert got.mrr <= got.recall_at_3


def test_config_matrix_has_36(spark):
    got = evaluation.config_matrix(spark).orderBy("config_no").collect()
    assert len({r.config_key for r in got}) == 36
    assert got[0].config_key == "combined_cosine|semantic|none"


# ---- store -------------------------------------------------------------------------------------------

def test_store_ingest_delete_reset(spark, tmp_path):
    wide, config = sheet(spark, [("Question", "Answer", "S"), ("Is it ok?", "yes", ""), ("And this?", "", "")])
    loaded = rows.load_rows(cells.grid_from_wide(wide), config)
    other = loaded.withColumn("source_file", F.lit("G: 2=x.xlsx")).withColumn(
        "pair_id", F.concat(F.lit("g"), "pair_id"))
    kept = CorpusStore(spark, str(tmp_path / "store"))
    ingest(kept, loaded.unionByName(other), buckets=2)
    before = {(r.chunk_id, r.text) for r in kept.read().collect()}
    assert len(before) == 2 * (2 + 3) and kept.checkpoint().count() == 8
    ingest(kept, loaded.unionByName(other))
    assert {(r.chunk_id, r.text) for r in kept.read().collect()} == before
    assert kept.checkpoint().count() == 8
    gone = {r.collection: r.n_removed for r in kept.delete("G: 2=x.xlsx")}
    assert gone == {"combined_cosine": 2, "combined_l2": 2, "separated_cosine": 3, "separated_l2": 3}
    assert {r.source_file for r in kept.read().collect()} == {"F-1.xlsx"}
    assert {r.source_file for r in kept.checkpoint().collect()} == {"F-1.xlsx"}
    with pytest.raises(LookupError):
        kept.delete("G: 2=x.xlsx")
    with pytest.raises(ValueError):
        kept.delete("../x")
    kept.reset()
    assert kept.read().count() == 0 and kept.checkpoint().count() == 0


def test_role_filter_reaches_the_scan(spark, tmp_path):
    wide, config = sheet(spark, [("Question", "Answer", "S"), ("Is it ok?", "yes", "")])
    kept = CorpusStore(spark, str(tmp_path / "store"))
    ingest(kept, rows.load_rows(cells.grid_from_wide(wide), config), ["separated_l2"])
    plan = kept.read("separated", "question").select("chunk_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,question)" in plan and "strategy" in plan.split("PartitionFilters")[1]
    assert "ReadSchema: struct<chunk_id:string,role:string>" in plan


def _filled_store(spark, path, files=6):
    """A store with questions and answers of some files, two rows each."""
    columns = ("chunk_id string, text string, metadata map<string,string>, pair_id string, role string, "
               "chunk_index long, strategy string, source_file string")
    made = [(f"file_{f}_row_{r}__{role}", f"{role} {f} {r}", {}, f"file_{f}_row_{r}", role, i, "separated", f"File {f}.xlsx")
            for f in range(files) for r in (2, 3) for i, role in enumerate(("question", "answer"))]
    kept = CorpusStore(spark, str(path))
    kept.write(spark.createDataFrame(made, columns))
    return kept, columns


def test_lookup_reads_only_the_buckets_of_its_ids(spark, tmp_path):
    kept, _ = _filled_store(spark, tmp_path / "store")
    hits = spark.createDataFrame([("q", 1, "file_1_row_2__question"), ("q", 2, "file_4_row_3__question"),
                                  ("r", 1, "file_1_row_3__question")], "query_id string, rank int, chunk_id string")
    linked = answers.pair_link(hits, kept.read("separated"), hits_bound=3)
    assert {(r.query_id, r.rank): r.answer_text for r in linked.collect()} == {
        ("q", 1): "answer 1 2", ("q", 2): "answer 4 3", ("r", 1): "answer 1 3"}
    texts = answers.with_text(hits, kept.read("separated", "question"), 3, ("text",))
    assert sorted(texts.columns) == ["chunk_id", "query_id", "rank", "text"]
    for frame in (linked, texts):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("dynamicpruning") and "bucket" in plan.split("PartitionFilters")[1]
    used = {r.chunk_id: r.bucket for r in kept.read().collect()}
    wanted = {used[r.chunk_id] for r in hits.collect()}
    others = [p for p in (tmp_path / "store" / "chunks").rglob("*.parquet")
              if int(p.parent.name.split("=")[1]) not in wanted]
    assert others
    for p in others:  # a bucket that is read now fails the job
        p.with_name(f".{p.name}.crc").unlink(missing_ok=True)
        p.write_bytes(b"no parquet")
    assert answers.with_text(hits, kept.read("separated", "question"), 3, ("text",)).count() == 3
    with pytest.raises(Exception):
        kept.read().collect()


def test_files_share_buckets_and_are_replaced_alone(spark, tmp_path, monkeypatch):
    """With two buckets for six files a write or delete of one file leaves its neighbours."""
    monkeypatch.setattr(corpus, "BUCKETS", 2)
    kept, columns = _filled_store(spark, tmp_path / "store")
    content = lambda: sorted((r.chunk_id, r.text) for r in kept.read().collect())
    before = content()
    assert len(before) == 24 and kept.read().select("bucket").distinct().count() <= 2
    again = kept.read().where("source_file = 'File 2.xlsx' AND role = 'question'").drop("embedding", "bucket").collect()
    kept.write(spark.createDataFrame(again, kept.read().drop("embedding", "bucket").schema))
    want = [r for r in before if not r[0].startswith("file_2") or r[0].endswith("question")]
    assert content() == want
    kept.delete("File 5.xlsx")
    assert content() == [r for r in want if not r[0].startswith("file_5")]
    for f in (0, 1, 2, 3, 4):
        kept.delete(f"File {f}.xlsx")
    assert content() == []


def test_interrupted_rewrite_is_finished(spark, tmp_path, monkeypatch):
    """A delete that dies between the new folders and the old loses and repeats nothing."""
    monkeypatch.setattr(corpus, "BUCKETS", 2)
    kept, _ = _filled_store(spark, tmp_path / "store")
    done = spark.createDataFrame([("separated_l2", f"File {f}.xlsx", 2, 4) for f in range(6)], corpus.CHECKPOINT)
    kept.mark_done(done)
    with monkeypatch.context() as broken:
        calls = []

        def dies():
            calls.append(1)
            if len(calls) > 1:
                raise RuntimeError("lost")
        broken.setattr(kept, "recover", dies)
        with pytest.raises(RuntimeError):
            kept.delete("File 3.xlsx")
    assert kept._exists(kept.aside_path) and kept.checkpoint().count() == 5
    again = CorpusStore(spark, str(tmp_path / "store"))
    again.recover()
    left = [r.chunk_id for r in again.read().collect()]
    assert len(left) == len(set(left)) == 20 and not any(c.startswith("file_3") for c in left)
    assert not again._exists(again.aside_path)


def test_ingest_appends_and_counts_without_reading_the_store(spark, tmp_path):
    wide, config = sheet(spark, [("Question", "Answer", "S"), ("Is it ok?", "yes", "")])
    loaded = rows.load_rows(cells.grid_from_wide(wide), config)
    kept = CorpusStore(spark, str(tmp_path / "store"))
    ingest(kept, loaded, ["separated_l2"])
    ingest(kept, loaded)
    counts = {r.collection: (r.rows, r.chunks_embedded) for r in kept.checkpoint().collect()}
    assert counts == {"combined_cosine": (1, 1), "combined_l2": (1, 1), "separated_cosine": (1, 2), "separated_l2": (1, 2)}
    assert kept.read().count() == 3


def test_route_rejects_unknown(spark):
    paths = spark.createDataFrame([("a/B.XLSX",), ("x.txt",), ("noext",)], "path string")
    assert [r.route for r in files.route_files(paths).collect()] == ["sheet", "rejected", "rejected"]


# ---- layout --------------------------------------------------------------------------------------------

@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 60), min_size=1, max_size=30))
def test_lines_equal_greedy_grouping(spark, tops):
    data = [(1, 1, i, t / 2) for i, t in enumerate(tops)]
    frame = spark.createDataFrame(data, "doc_id long, page long, word_no long, top double")
    got = {r.word_no: r.line_top for r in layout.assign_lines(frame).collect()}
    anchor, want = None, {}
    for _, _, i, top in sorted(data, key=lambda w: w[3]):
        if anchor is None or top - anchor > 2.5:
            anchor = top
        want[i] = anchor
    assert got == want


def test_pending_work_uses_both_keys(spark):
    units = spark.createDataFrame([("a", "f"), ("b", "f")], "collection string, source_file string")
    done = spark.createDataFrame([("a", "f"), ("b", "g")], "collection string, source_file string")
    assert [tuple(r) for r in corpus.pending(units, done).collect()] == [("b", "f")]


# ---- sinks and resumed runs ------------------------------------------------------------------------------

def test_sinks(spark, tmp_path):
    rated = spark.createDataFrame([("c", "bm25", "none", 0.5, 0.25, 0.1, 1.0, 4.0, 3.0, 2.0, 3, 1, 1)], (
        "collection string, retrieval string, rerank string, recall_at_3 double, mrr double, "
        "retrieval_gap_rate double, hallucination_refusal_rate double, faithfulness double, relevance double, "
        "completeness double, n_in_scope long, n_out_scope long, n_judged long"))
    evaluation.write_comparison(rated, str(tmp_path / "table"))
    assert any("bm25" in r.value for r in spark.read.text(str(tmp_path / "table")).collect())
    evaluation.write_results(rated, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 1


def test_resumed_matrix(spark):
    configs = evaluation.config_matrix(spark)
    done = configs.filter("config_no IN (1, 2, 30)").select("config_key")
    there = spark.createDataFrame([("combined_cosine",), ("separated_l2",)], "collection string")
    left = [r.config_no for r in evaluation.pending_configs(configs, done, there).collect()]
    assert sorted(left) == [3, 4, 5, 6, 7, 8, 9, 28, 29, *range(31, 37)]
    assert [r.config_no for r in evaluation.pending_configs(configs, done, there, 3).collect()] == [3, 4, 5]
    old = configs.filter("config_no < 4").selectExpr(*evaluation.AXES, "'old' AS run")
    new = configs.filter("config_no = 2").selectExpr(*evaluation.AXES, "'new' AS run")
    assert sorted(r.run for r in evaluation.with_earlier(new, old).collect()) == ["new", "old", "old"]


def test_config_documents(spark, tmp_path):
    body = """{
  "source_file": "A.xlsx", "sheet": "S", "header_row": 3,
  "columns": {"question": "B", "answer": "C", "ignore": ["E", "F"]},
  "metadata_fields": ["ref"], "client": null, "date": "2020"
}"""
    (tmp_path / "a.json").write_text(body)
    got = configs.read_configs(spark, str(tmp_path)).first()
    assert (got.header_row, got.columns, got.ignore, got.client) == (3, {"question": "B", "answer": "C"}, ["E", "F"], None)
    (tmp_path / "b.json").write_text(body[:60])
    with pytest.raises(Exception):
        configs.read_configs(spark, str(tmp_path)).collect()


def test_ragged_vectors_and_far_columns_are_errors(spark):
    corpus = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", [1.0, 2.0, 3.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    with pytest.raises(Exception):
        ranking.knn(corpus, asked, 2, "cosine", vector="embedding").collect()
    with pytest.raises(Exception):
        spark.range(20_000, 20_001).select(text.column_letter("id")).collect()


def test_last_answer_of_a_row_is_exported_once(spark, tmp_path):
    from askbase.operators import review
    rows = spark.createDataFrame([("f.xlsx", 1, "q1"), ("f.xlsx", 2, "q2"), ("f.xlsx", 3, "q3")],
                                 "source_file string, row_no bigint, question string")
    given = spark.createDataFrame(
        [(1, 1, "old", "accepted"), (4, 1, "new", None), (2, 2, None, "accepted"),
         (3, 3, "given", "accepted"), (5, 3, "left out", "skipped"), (6, None, "no row", "accepted")],
        "answer_no bigint, row_no bigint, answer string, status string").selectExpr(
        "*", "'f.xlsx' source_file", "0.456D confidence",
        "array(named_struct('rank', 1, 'source_file', 'past.xlsx', 'pair_id', 'past__r7')) sources")
    out = review.export_answers(rows, given)
    got = {r.row_no: (r.suggested_answer, r.answer_confidence) for r in out.collect()}
    assert out.count() == 3 and got == {1: ("new", 0.46), 2: ("", 0.46), 3: (None, None)}
    review.write_export(out, str(tmp_path / "export"))
    written = spark.read.option("header", True).csv(str(tmp_path / "export"))
    assert review.EXPORT_HEADERS[0] in written.columns and written.count() == 3


def test_matrix_goes_on_after_a_crash(spark, tmp_path, monkeypatch):
    """A run that dies between two strategies and one that does not give the same rows."""
    from askbase.operators.vectors import embed
    from askbase.plans import experiment
    wide, config = sheet(spark, [("Question", "Answer", "S"), ("Is it ok?", "yes it is", ""), ("Where are you?", "at home", "")])
    made = chunks.non_empty(chunks.build_chunks(rows.load_rows(cells.grid_from_wide(wide), config), "combined", "separated"))
    held = spark.createDataFrame(embed(made).collect(), embed(made).schema)
    asked = spark.createDataFrame([("q1", "is it ok", "in", "f_1_row_2"), ("q2", "where", "out", None)],
                                  "query_id string, text string, scope string, expected_pair_id string")
    order = spark.createDataFrame([("q1", '{"ranking": [1, 0]}')], "query_id string, ranking_json string")
    whole = experiment.ExperimentRun(spark, str(tmp_path / "whole"))
    want = sorted(map(str, whole.advance(held, asked, order).collect()))
    assert len(want) == 72 and whole.finished().count() == 36
    cut = experiment.ExperimentRun(spark, str(tmp_path / "cut"))
    run, calls = experiment.run_matrix, []

    def dies(*args, **how):
        calls.append(args[4].count())
        if len(calls) == 2:
            raise RuntimeError("lost")
        return run(*args, **how)
    monkeypatch.setattr(experiment, "run_matrix", dies)
    with pytest.raises(RuntimeError):
        cut.advance(held, asked, order)
    assert cut.finished().count() == 18 and cut.rows().count() == 36
    assert sorted(map(str, cut.advance(held, asked, order).collect())) == want and calls == [18, 18, 18]
    only = experiment.ExperimentRun(spark, str(tmp_path / "only"))
    assert only.advance(held.where("strategy = 'combined'"), asked, order, first=4).count() == 8


@pytest.mark.parametrize("postings, weights, scores, sent", [(40, (3, 50), 64, 1000), (10_000, (1, 10), 16, 0)])
def test_search_in_a_grid_of_cells(spark, monkeypatch, postings, weights, scores, sent):
    """Every cell boundary, rare and frequent terms, ties, ids that are null or come twice: as brute force has it."""
    monkeypatch.setattr(terms, "CELL_POSTINGS", postings)
    monkeypatch.setattr(terms, "CELL_WEIGHTS", weights)
    monkeypatch.setattr(terms, "_SCORES", scores)
    docs = made_docs(150, 5) + [(f"x{i}", f"rare{i} the w3") for i in range(60)] + [("x7", None)]
    asked = [(f"q{i}", t) for i, (_, t) in enumerate(made_docs(20, 6))] + [("r", "rare7 the"), (None, "w3"), ("s", None)]
    index = terms.temporary_index(spark.createDataFrame(docs, "chunk_id string, text string"))
    got = index.bm25(spark.createDataFrame(asked, "query_id string, text string"), 3, sent=sent)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroups" in plan  # no join that makes a row for each query and document
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    # a text that is null has no tokens, but its document counts
    plain = [(i if t is not None else "x7-null", t or "") for i, t in docs]
    for q, words in asked:
        assert found.get(q, []) == [(i, round(s, 6)) for i, s in brute_bm25(plain, words or "")[:3]]


def test_tables_that_are_folders_are_streamed(spark, tmp_path):
    """A large table is a folder of files; the stream found none of them."""
    from askbase.registry.queries import QUERIES
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}") for c in range(20) for t in range(4)]
    made = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made.repartition(3).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    (tmp_path / "file").mkdir()
    made.toPandas().to_parquet(tmp_path / "file/conversations.parquet")
    for kind in ("folder", "file"):
        got = QUERIES["stream_ingest"](spark, f"file://{tmp_path}/{kind}").collect()
        assert sorted((r.chunk_id, r.text) for r in got) == sorted(
            (f"conv_{c}_row_{t}__{role}", text) for c, t, role, text in turns)


def test_best_rows_are_sorted_seldom(monkeypatch):
    """A sort for every slice of the corpus took most of a search's time; ties and late winners stay right."""
    import numpy as np
    rng = np.random.default_rng(4)
    score = np.round(rng.random((500, 3)), 2)
    ids = np.array([f"d{i:03}" for i in rng.permutation(500)], dtype=object)
    best, calls = ranking._Best(3, 5), []
    settle = best.settle
    monkeypatch.setattr(best, "settle", lambda: (calls.append(1), settle()))
    for at in range(0, 500, 20):
        best.offer(score[at:at + 20], ids[at:at + 20])
    best.settle()
    assert len(calls) == 1
    for q in range(3):
        mine = list(best.id[best.query == q])
        assert mine == [i for _, i in sorted(zip(score[:, q], ids))[:5]]
    monkeypatch.setattr(ranking, "HELD_ROWS", 2)
    often = ranking._Best(3, 5)
    for at in range(0, 500, 3):
        often.offer(score[at:at + 3], ids[at:at + 3])
    often.settle()
    assert list(often.id) == list(best.id) and list(often.score) == list(best.score)


def test_postings_are_dealt_to_as_many_tasks_as_they_need(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(terms, "PART_POSTINGS", 50)
    docs = [(f"d{i}", " ".join(f"w{(i * 7 + k) % 90}" for k in range(20))) for i in range(60)]
    index = terms.build_index(spark.createDataFrame(docs, "chunk_id string, text string"), str(tmp_path / "ix"))
    tasks = {p.name.split("-")[1] for p in (tmp_path / "ix" / "postings").rglob("part-*.parquet")}
    assert index.postings.count() == 60 * 20
    assert len(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cells_of_a_search_are_dealt_to_as_many_tasks_as_they_need(spark, monkeypatch):
    docs = [(f"d{i}", " ".join(f"w{(i * 7 + k) % 90}" for k in range(20))) for i in range(60)]
    index = terms.temporary_index(spark.createDataFrame(docs, "chunk_id string, text string"))
    asked = spark.createDataFrame([("q", "w1 w2 w3"), ("r", "w50")], "query_id string, text string")
    want = sorted(map(tuple, index.bm25(asked, 5).collect()))
    monkeypatch.setattr(terms, "CELL_POSTINGS", 2)
    found = index.bm25(asked, 5)
    assert sorted(map(tuple, found.collect())) == want
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_by_id_without_a_window(spark):
    texts = [("a", "B b c"), ("a", "x Y z"), ("a", "one two"), (None, "c"), (None, "C"), ("e", None), ("f", "..")]
    frame = spark.createDataFrame(texts, "id string, text string").select("id", F.lower("text").alias("low"))
    found = terms._count_terms(frame.repartition(3, "id").sortWithinPartitions("id")).collect()
    norm = math.sqrt((1 + math.log(2)) ** 2 + 6)
    want = [("a", 3, norm, "b", 2)] + [("a", 3, norm, t, 1) for t in "cxyz"] + [
        ("a", 2, norm, t, 1) for t in ("one", "two")] + [(None, 1, 1 + math.log(2), "c", 2)]
    key = lambda r: (r[0] or "", r[1], r[3], r[4])
    assert sorted(map(key, found)) == sorted(map(key, want))
    assert {r.id: round(r.norm, 9) for r in found} == {r[0]: round(r[2], 9) for r in want}


def test_pairs_are_rescored_from_parts_made_once_a_text(spark, monkeypatch):
    from askbase.plans import answering
    made = "chunk_id string, text string, pair_id string, source_file string, metadata map<string,string>"
    corpus_rows = spark.createDataFrame([(f"c{i}", f"some words {i} and more {i % 3}", f"p{i}", "f", {}) for i in range(9)], made)
    asked = spark.createDataFrame([("q", "some words 4"), ("r", "more 1 and"), ("s", None)], "query_id string, text string")
    pool = asked.select("query_id").crossJoin(corpus_rows.select("chunk_id")).withColumn("rank", F.lit(1))
    pairs = answering.with_both_texts(pool, corpus_rows, asked, 3)
    plain = fusion.rescore(pairs.drop(*answering.PARTS))
    quick = fusion.rescore(pairs, parts=answering.PARTS)
    assert sorted(quick.columns) == sorted(plain.columns)
    rows_of = lambda frame: sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in frame.collect())
    assert rows_of(quick) == rows_of(plain)


def test_the_matrix_ranks_ids_and_fetches_texts_for_the_first_ones_only(spark, monkeypatch):
    from askbase.plans import experiment
    seen, plain = {}, experiment.stored

    def noted(df, name):
        seen[name] = df.columns
        return plain(df, name)

    monkeypatch.setattr(experiment, "stored", noted)
    made = "question string, answer string, context string, metadata map<string,string>, source_file string, pair_id string, row_index bigint"
    qa = spark.createDataFrame([(f"what is item {i}", f"item {i}", None, {}, "f", f"f_row_{i}", i) for i in range(8)], made)
    from askbase.operators.vectors import embed
    built = embed(chunks.non_empty(chunks.build_chunks(qa, "combined", "separated")))
    asked = spark.createDataFrame([("q", "what is item 3", "in", "f_row_3"), ("o", "nothing here", "out", None)],
                                  "query_id string, text string, scope string, expected_pair_id string")
    rankings = spark.createDataFrame([("q", "[1, 0]")], "query_id string, ranking_json string")
    found = experiment.run_matrix(built, asked, rankings, experiment.pools(built, asked),
                                  evaluation.config_matrix(spark)).collect()
    assert len(found) == 72
    assert "text" not in seen["tops"] and "text" not in seen["pair-scores"]
    best = {(r.collection, r.retrieval, r.rerank): r.answer for r in found if r.query_id == "q"}
    assert best["separated_cosine", "bm25", vocab.RERANK_MODES[1]] == "item 3"
    assert best["combined_cosine", "bm25", vocab.RERANK_MODES[1]] == "Q: what is item 3\nA: item 3"


@pytest.mark.parametrize("postings, weights, scores", [(1, (1, 1), 1), (200, (1, 30), 300), (10_000, (1, 10_000), 10_000)])
def test_large_grid_is_a_product_of_packed_partitions(spark, monkeypatch, postings, weights, scores):
    """A grid's rows were repeated for each of its cells, so shuffles grew with queries times documents."""
    docs = made_docs(150, 5) + [(f"x{i}", f"rare{i} the w3") for i in range(60)] + [("x7", None)]
    asked = [(f"q{i}", t) for i, (_, t) in enumerate(made_docs(20, 6))] + [("r", "rare7 the"), (None, "w3"), ("s", None)]
    index = terms.temporary_index(spark.createDataFrame(docs, "chunk_id string, text string"))
    queries = spark.createDataFrame(asked, "query_id string, text string")
    want = sorted(map(str, index.bm25(queries, 3).withColumn("score", F.round("score", 9)).collect()))
    monkeypatch.setattr(terms, "CELL_POSTINGS", postings)
    monkeypatch.setattr(terms, "CELL_WEIGHTS", weights)
    monkeypatch.setattr(terms, "_SCORES", scores)
    monkeypatch.setattr(terms, "GRID_ROWS", -1)
    monkeypatch.setattr(terms, "TASKS_A_CORE", 1)
    found = index.bm25(queries, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    assert sorted(map(str, found.withColumn("score", F.round("score", 9)).collect())) == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_meet_as_a_product_of_packed_partitions(spark, kind):
    """The corpus was repeated in a shuffle for every block of queries; each side goes through one once."""
    rng = random.Random(8)
    data = [(f"c{i}", [float(rng.randint(0, 2)) for _ in range(6)]) for i in range(400)] + [("zero", [0.0] * 6)]
    asked = [(f"q{i}", v) for i, (_, v) in enumerate(data[::9])] + [("z", [0.0] * 6)]
    corpus = spark.createDataFrame(data, f"chunk_id string, embedding array<{kind}>").repartition(3)
    queries = spark.createDataFrame(asked, f"query_id string, embedding array<{kind}>").repartition(5)
    for metric in ("cosine", "l2"):
        found = ranking.knn(corpus, queries, 4, metric, block=3, part=50)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Generate" not in plan
        best = {(r.query_id, r.rank): r.chunk_id for r in found.collect()}
        for q, v in asked:
            def distance(x):
                if metric == "l2":
                    return round(math.dist(x, v), 9)
                size = math.hypot(*x) * math.hypot(*v)
                return round(1 - (sum(a * b for a, b in zip(x, v)) / size if size else 0), 9)
            near = sorted((distance(x), i) for i, x in data)[:4]
            assert [best[q, k] for k in range(1, 5)] == [i for _, i in near]


@pytest.mark.parametrize("metric", ["cosine", "l2", "l2_sq"])
@pytest.mark.parametrize("scale", [1.0, 1e-4, 1e18, math.nan])
def test_screened_vectors_are_the_nearest_ones(metric, scale):
    import numpy as np
    rng = np.random.default_rng(2)
    x = rng.poisson(0.4, (900, 12)).astype(float)
    x[40:90] = x[3]
    x[5] = 0
    q = x[::30].copy()
    x, q = (x, q) if math.isnan(scale) else (x * scale, q * scale)
    if math.isnan(scale):
        x[7, 2] = math.nan
    ids = np.array([f"d{i:03}" for i in rng.permutation(900)], dtype=object)
    plain, screened = ranking._Best(len(q), 5), ranking._Best(len(q), 5)
    plain.offer(ranking._distances(x, q, metric), ids)
    block = ranking._Block(q, metric, 5)
    for at in range(0, 900, 300):
        block.meet(x[at:at + 300], ids[at:at + 300], screened)
    plain.settle()
    screened.settle()
    assert list(plain.id) == list(screened.id)
    assert np.allclose(plain.score, screened.score, rtol=1e-9, atol=1e-9 * min(1, scale if scale == scale else 1))


def test_a_token_line_has_the_parts_of_its_text(spark):
    texts = [("Some words, some WORDS 4 more",), ("",), ("..",), (None,), ("one",), ("Ünder  x\ny",)]
    made = spark.createDataFrame(texts, "t string").select(
        fusion.lexical_parts("t").alias("a"), fusion.line_parts(text.token_line("t")).alias("b")).collect()
    assert all(r.a == r.b for r in made) and made[0].a.words == ["some", "words", "4", "more"]


def test_best_pairs_are_ranked_without_texts(spark, monkeypatch):
    """Texts and metadata of all pairs went through the shuffle of their ranking."""
    from askbase.plans import answering
    seen, plain = {}, answering.stored
    monkeypatch.setattr(answering, "stored", lambda df, name: (seen.update({name: df.columns}), plain(df, name))[1])
    made = "chunk_id string, text string, pair_id string, source_file string, metadata map<string,string>"
    corpus_rows = spark.createDataFrame([(f"c{i}", f"some words {i} and more {i % 3}", f"p{i}", "f", {"k": str(i)})
                                         for i in range(9)], made)
    asked = spark.createDataFrame([("q", "some words 4"), ("r", "more 1 and"), ("r", "words 2"), ("s", None), (None, "more")],
                                  "query_id string, text string")
    pool = spark.createDataFrame([(q, f"c{i}", i + 1, 0.5, "bm25") for q in ("q", "r", "s", None) for i in range(9)],
                                 "query_id string, chunk_id string, rank bigint, score double, score_type string")
    want = fusion.rescore(answering.with_both_texts(pool, corpus_rows, asked, 3), parts=answering.PARTS)
    got = answering.best_pairs(pool, corpus_rows, asked, 3)
    columns = ["query_id", "chunk_id", "rank", "score", "score_type", "text", "pair_id", "source_file", "metadata"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert seen["top"] == [*pool.columns, "text_no"]


def test_shuffles_and_folders_are_given_back(spark, tmp_path):
    """Finished shuffles and the tables an ingest made on its way stayed on disk."""
    from askbase.functions import sizing
    kept = sizing.stored(spark.range(5), "kept")
    gone = sizing.stored(spark.range(5), "gone")
    folder = gone.inputFiles()[0].removeprefix("file:").replace("//", "").rsplit("/", 1)[0]
    assert os.path.isdir(folder)
    sizing.discard(gone)
    assert not os.path.exists(folder) and kept.count() == 5
