"""One named query per operator, over the given tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import payloads, text, vocab
from ..functions.sizing import shared_dir, stored
from ..operators import (answers, chunks as ch, evaluation as ev, fusion, layout, profile,
                         ranking, review, rows as rw, vectors)
from ..plans import answering, experiment
from ..plans.ingest import ingest
from ..sources import cells as cl, configs as cf, corpus as store, files as fl
from ..sources.terms import TermIndex, temporary_index
from ..streaming import ingest as stream
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _fx(spark, sf, name):
    return fx.fixture(spark, sf, name)


def _cells(spark, sf):
    return cl.cells_from_wide(_fx(spark, sf, "fx_wide"))


def _configs(spark, sf):
    return cf.build_configs(_fx(spark, sf, "fx_mapping"), _fx(spark, sf, "fx_files"))


def _rows(spark, sf):
    return rw.load_rows(cl.grid_from_wide(_fx(spark, sf, "fx_wide")), _configs(spark, sf))


def _chunks(spark, sf):
    return ch.non_empty(ch.build_chunks(_rows(spark, sf), "combined", "separated"))


_STORED: dict[tuple, str] = {}
#: The role of the chunks that are searched, by strategy.
_ASKED = {"separated": "question", "combined": None}


def _library(spark, sf) -> str:
    """Folder with the ingested corpus and the questions, written once per session.

    Retrieval reads a stored corpus, as it would in use, not the sheets.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        root = shared_dir(spark, "library")
        ingest(store.CorpusStore(spark, root), _rows(spark, sf))
        _fx(spark, sf, "fx_questions").write.parquet(f"{root}/questions")
        _STORED[key] = root
    return _STORED[key]


def _corpus(spark, sf, strategy="separated", role=None):
    return store.CorpusStore(spark, _library(spark, sf)).read(strategy, role)


def _index(spark, sf, strategy="separated", role="question"):
    """The store's inverted index of these chunks."""
    return store.CorpusStore(spark, _library(spark, sf)).term_index(strategy, role)


def _doc_index(spark, sf):
    """The inverted index of all documents, built once per session."""
    key = (spark.sparkContext.applicationId, sf, "documents")
    if key not in _STORED:
        _STORED[key] = temporary_index(fx.table(spark, sf, "documents"), "doc_id").path
    return TermIndex(spark, _STORED[key])


def _questions(spark, sf):
    return spark.read.parquet(f"{_library(spark, sf)}/questions")


def _questions_bound(questions):
    """Number of questions, counted; the pools derived from it are bounded by it."""
    return questions.count()


def _meta(*names):
    return [F.try_element_at("metadata", F.lit(n)).alias(n) for n in names]


def _hits(hits, id_col="chunk_id"):
    return hits.select("query_id", id_col, "rank", F.round("score", 6).alias("score"))


META = ("ref", "category", "section", "client", "date")


# ---- sheets, configs, files -------------------------------------------------

@query
def cells_unpivot(spark, sf):
    return _cells(spark, sf).select("source_file", "sheet", "row_no", "col_letter", "col_no", "value")


@query
def load_rows(spark, sf):
    return _rows(spark, sf).select(
        "source_file", "row_no", "pair_id", "question", "answer", "context",
        "source_format", *_meta(*META))


@query
def load_rows_from_cells(spark, sf):
    grid = cl.grid_from_cells(_cells(spark, sf))
    return rw.load_rows(grid, _configs(spark, sf)).select(
        "source_file", "row_no", "pair_id", "question", "answer", "context", *_meta(*META))


@query
def config_scan(spark, sf):
    path = shared_dir(spark, "configs")
    cf.write_configs(_configs(spark, sf).repartition(3, "source_file"), path)
    return cf.read_configs(spark, path).select(
        "source_file", "sheet", "header_row", F.col("columns")["question"].alias("question"),
        F.col("columns")["answer"].alias("answer"), F.array_join("ignore", ",").alias("ignored"),
        F.array_join("metadata_fields", ",").alias("metadata_fields"), "client", "date")


@query
def config_validate(spark, sf):
    mapping = cf.normalize_mapping(_fx(spark, sf, "fx_mapping_bad"))
    files = _fx(spark, sf, "fx_files").withColumn(
        "sheet", F.when(F.col("file_no") != 7, F.col("sheet")))
    once = mapping.dropDuplicates(["source_file", "role"]).filter(F.col("role") != "ignore")
    return cf.config_problems(cf.build_configs(once, files)).select(
        "source_file", F.array_join("problems", "; ").alias("problems"))


@query
def config_build(spark, sf):
    return _configs(spark, sf).select(
        "source_file", "sheet", "header_row",
        F.explode(F.concat(F.map_entries("columns"), F.transform(
            "ignore", lambda c: F.struct(F.lit("ignore").alias("key"), c.alias("value"))))).alias("e"),
        F.array_join("metadata_fields", ",").alias("metadata_fields"), "client", "date").select(
        "source_file", "sheet", "header_row", F.col("e.key").alias("role"),
        F.col("e.value").alias("col_letter"), "metadata_fields", "client", "date")


@query
def route_ext(spark, sf):
    return fl.route_files(_fx(spark, sf, "fx_filenames"))


@query
def proposal_normalize(spark, sf):
    return cf.normalize_mapping(_fx(spark, sf, "fx_mapping_bad"))


@query
def apply_client_edit(spark, sf):
    edit = F.when(F.col("file_no") % 3 == 0, "").when(F.col("file_no") % 3 == 1, "Edited Client")
    files = _fx(spark, sf, "fx_files").withColumn("edit", edit)
    return files.select("source_file", cf.edited("client", "edit").alias("client"),
                        cf.edited("date", F.lit(None).cast("string")).alias("date"))


@query
def known_clients(spark, sf):
    return cf.known_clients(_fx(spark, sf, "fx_files"))


@query
def header_row_valid(spark, sf):
    claimed = _fx(spark, sf, "fx_files").withColumn(
        "header_row", F.when(F.col("file_no") == 2, F.lit(0))
        .when(F.col("file_no") == 4, F.lit(100_000_000_000_000)).otherwise(F.col("header_row")))
    return cl.header_row_check(_cells(spark, sf), claimed.select(
        "source_file", "sheet", "header_row"))


# ---- profiling ----------------------------------------------------------------

@query
def sheet_scores(spark, sf):
    scores = profile.sheet_scores(_cells(spark, sf))
    return scores.join(profile.largest_sheet_rows(scores), "source_file").drop("sheet_no")


@query
def sheet_pick(spark, sf):
    return profile.pick_sheet(profile.sheet_scores(_cells(spark, sf)))


@query
def header_row(spark, sf):
    return profile.header_rows(_cells(spark, sf))


def _profiled(spark, sf):
    cells = _cells(spark, sf)
    headers = profile.header_rows(cells)
    return cells, headers, profile.heuristic_roles(profile.column_profile(
        cells, headers, vocab.HEADER_SCAN_ROWS))


@query
def column_profile(spark, sf):
    cells = _cells(spark, sf)
    found = profile.column_profile(cells, profile.header_rows(cells), vocab.HEADER_SCAN_ROWS)
    rounded = ("pct_non_empty", "avg_words", "q_rate")
    return found.withColumns({c: F.round(c, 6) for c in rounded})


@query
def column_samples(spark, sf):
    cells = _cells(spark, sf)
    return profile.column_samples(cells, profile.header_rows(cells), vocab.HEADER_SCAN_ROWS)


@query
def heuristic_roles(spark, sf):
    return _profiled(spark, sf)[2].select(
        "source_file", "sheet", "col_letter", "header", "role", "reason")


@query
def question_column(spark, sf):
    roles = _profiled(spark, sf)[2]
    return profile.question_columns(roles, _fx(spark, sf, "fx_mapping"))


@query
def question_list(spark, sf):
    cells, headers, roles = _profiled(spark, sf)
    columns = profile.question_columns(roles, _fx(spark, sf, "fx_mapping"))
    return profile.question_list(cells, headers, columns)


@query
def question_preview(spark, sf):
    return profile.question_preview(question_list(spark, sf))


def _sheet_columns(spark, sf):
    return _fx(spark, sf, "fx_mapping").select("source_file", "col_letter")


@query
def mapping_except(spark, sf):
    mapping = cf.normalize_mapping(_fx(spark, sf, "fx_mapping_bad"))
    return profile.mapping_differences(mapping, _sheet_columns(spark, sf))


@query
def proposal_issues(spark, sf):
    mapping = cf.normalize_mapping(_fx(spark, sf, "fx_mapping_bad"))
    return profile.proposal_issues(mapping, _sheet_columns(spark, sf))


@query
def mapping_rows(spark, sf):
    return profile.mapping_rows(_fx(spark, sf, "fx_mapping"), _fx(spark, sf, "fx_headers"))


# ---- rows and chunks ------------------------------------------------------------

@query
def section_markers(spark, sf):
    rows = rw.role_rows(cl.grid_from_wide(_fx(spark, sf, "fx_wide")), _configs(spark, sf))
    marker = rw.is_section_marker("question", "answer", "context", "metadata")
    return rows.select("source_file", "row_no", "question", marker.alias("is_marker"))


@query
def section_ffill(spark, sf):
    rows = rw.role_rows(cl.grid_from_wide(_fx(spark, sf, "fx_wide")), _configs(spark, sf))
    return rw.fill_sections(rows).select("source_file", "row_no", "section")


@query
def row_metadata(spark, sf):
    return _rows(spark, sf).select("pair_id", F.explode("metadata").alias("key", "value"))


@query
def file_summary_rollup(spark, sf):
    return rw.file_summary(_rows(spark, sf))


def _chunk_columns(frame):
    return frame.select("chunk_id", "text", "pair_id", "source_file", "role", "strategy",
                        "chunk_index", F.try_element_at("metadata", F.lit("section")).alias("section"))


@query
def chunks_combined(spark, sf):
    return _chunk_columns(ch.build_chunks(_rows(spark, sf), "combined"))


@query
def chunks_separated(spark, sf):
    return _chunk_columns(ch.build_chunks(_rows(spark, sf), "separated"))


@query
def chunks_nonempty(spark, sf):
    separated = ch.build_chunks(_rows(spark, sf), "separated")
    return ch.non_empty(separated).select("chunk_id", "chunk_index")


@query
def metadata_sanitize(spark, sf):
    sheet = _fx(spark, sf, "fx_sheet")
    raw = F.create_map(F.lit("context"), "context", F.lit("category"), "category",
                       F.lit("role"), F.nullif("role", F.lit("system")))
    return sheet.select("source_file", "row_no", F.explode(text.drop_empty(raw)).alias("key", "value"))


@query
def chunk_stats(spark, sf):
    stats = ch.chunk_stats(_chunks(spark, sf), "strategy")
    return stats.withColumn("avg_words", F.round("avg_words", 6))


@query
def chunk_samples(spark, sf):
    rows = _rows(spark, sf)
    return ch.edge_samples(rows, ch.build_chunks(rows, "combined", "separated"))


@query
def batch_plan(spark, sf):
    return ch.batch_plan(ch.build_chunks(_rows(spark, sf), "separated"))


@query
def dup_chunk_ids(spark, sf):
    name = F.concat("source", F.when(F.col("doc_id") % 2 == 0, "-").otherwise(" "), "lang", F.lit(".xlsx"))
    ids = fx.table(spark, sf, "documents").select(
        text.pair_id(name, F.floor(F.col("doc_id") / 40)).alias("chunk_id"))
    return ch.duplicate_ids(ids)


# ---- corpus store -----------------------------------------------------------------

def _stored(spark, sf):
    kept = store.CorpusStore(spark, shared_dir(spark, "corpus"))
    kept.write(_chunks(spark, sf), buckets=4)
    return kept


@query
def corpus_write_read(spark, sf):
    return _chunk_columns(_stored(spark, sf).read())


@query
def corpus_scan_role(spark, sf):
    return _stored(spark, sf).read("separated", "question").select("chunk_id", "text")


@query
def corpus_stats(spark, sf):
    return store.corpus_stats(_chunks(spark, sf))


@query
def collection_counts(spark, sf):
    return store.collection_counts(_chunks(spark, sf))


@query
def corpus_delete_counts(spark, sf):
    return store.delete_counts(_chunks(spark, sf), "Client File-2.xlsx")


@query
def corpus_after_delete(spark, sf):
    kept = _stored(spark, sf)
    kept.delete("Client File-2.xlsx")
    return kept.read().select("chunk_id", "strategy", "source_file")


@query
def pending_work(spark, sf):
    units = store.collection_units(_fx(spark, sf, "fx_files"))
    return store.pending(units, _fx(spark, sf, "fx_checkpoint"))


@query
def checkpoint_rows(spark, sf):
    kept = store.CorpusStore(spark, shared_dir(spark, "corpus"))
    ingest(kept, _rows(spark, sf))
    return kept.checkpoint()


@query
def embed_chunks(spark, sf):
    made = vectors.embed(ch.non_empty(ch.build_chunks(_rows(spark, sf), "separated")))
    return made.select("chunk_id", F.posexplode("embedding").alias("slot", "value")).filter(
        F.col("value") != 0).select("chunk_id", F.col("slot").cast("bigint").alias("slot"),
                                    F.round(F.col("value").cast("double"), 6).alias("value"))


# ---- retrieval and ranking -----------------------------------------------------------

def _vector_hits(spark, sf, metric):
    corpus = fx.table(spark, sf, "embeddings")
    return ranking.knn(corpus, fx.label_centroids(spark, sf), metric=metric, id_col="vec_id")


@query
def knn_cosine(spark, sf):
    return _hits(_vector_hits(spark, sf, "cosine"), "vec_id")


@query
def knn_l2(spark, sf):
    return _hits(_vector_hits(spark, sf, "l2"), "vec_id")


def _benchmark(spark, sf):
    return fx.table(spark, sf, "benchmark").select(
        F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), "text")


@query
def bm25_topk(spark, sf):
    return _hits(ranking.bm25(_doc_index(spark, sf), _benchmark(spark, sf), id_col="doc_id"), "doc_id")


@query
def bm25_term_stats(spark, sf):
    found = _doc_index(spark, sf).term_stats()
    return found.withColumn("idf", F.round("idf", 6))


@query
def tfidf_cosine(spark, sf):
    return _hits(ranking.tfidf_cosine(_doc_index(spark, sf), _benchmark(spark, sf), id_col="doc_id"), "doc_id")


def _hybrid(spark, sf):
    return answering.retrieve(_corpus(spark, sf, role="question"), _questions(spark, sf), "hybrid",
                              index=_index(spark, sf))


@query
def rrf_hybrid(spark, sf):
    return _hits(_hybrid(spark, sf))


def _bm25_pool(spark, sf):
    """BM25 pools over question chunks; what a step that joins their texts needs."""
    questions = _questions(spark, sf)
    pool = stored(ranking.bm25(_index(spark, sf), questions), "pool")
    return pool, _corpus(spark, sf, role="question"), questions, _questions_bound(questions)


def _bm25_pairs(spark, sf):
    """BM25 pools over question chunks, with the text of both sides."""
    return answering.with_both_texts(*_bm25_pool(spark, sf))


@query
def rerank_none(spark, sf):
    hits = ranking.bm25(_doc_index(spark, sf), _benchmark(spark, sf), id_col="doc_id")
    return _hits(fusion.rerank_none(hits), "doc_id")


@query
def rerank_pairs(spark, sf):
    return _hits(fusion.rescore(_bm25_pairs(spark, sf), parts=answering.PARTS))


@query
def rerank_permutation(spark, sf):
    moved = fusion.apply_ranking(_bm25_pairs(spark, sf), _fx(spark, sf, "fx_rankings"), None)
    return moved.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "score_type")


@query
def score_gap(spark, sf):
    gaps = fusion.score_gap(ranking.bm25(_doc_index(spark, sf), _benchmark(spark, sf), id_col="doc_id"))
    return gaps.withColumns({c: F.round(c, 6) for c in ("top_score", "second_score", "gap")})


# ---- answers -----------------------------------------------------------------------------

def _top(spark, sf):
    """Reranked and linked hits of every question."""
    chunks = _corpus(spark, sf)
    top = answering.best_pairs(*_bm25_pool(spark, sf))
    bound = _questions_bound(_questions(spark, sf)) * vocab.TOP_K
    return answers.pair_link(top, chunks, bound)


@query
def pair_link(spark, sf):
    return _top(spark, sf).select("query_id", "rank", "chunk_id", "answer_id", "answer_text")


@query
def context_blocks(spark, sf):
    return answers.context_blocks(_top(spark, sf))


@query
def draft_or_refuse(spark, sf):
    drafted = answers.draft_or_refuse(_questions(spark, sf), _top(spark, sf), answering.MIN_OVERLAP)
    return drafted.select("query_id", "answer")


def _flat_payload(payload):
    return payload.select(
        "query_id", "answer", "refused", F.round("confidence", 4).alias("confidence"),
        F.array_join("pair_ids", ",").alias("pair_ids"),
        F.array_join("mentioned_clients", ",").alias("mentioned_clients"),
        answers.format_sources("sources").alias("source_list"),
        F.coalesce(F.array_join(F.transform("sources", lambda s: F.coalesce(
            s.section, F.lit("-"))), ","), F.lit("")).alias("sections"))


@query
def answer_payload(spark, sf):
    top, questions = _top(spark, sf), _questions(spark, sf)
    drafted = answers.draft_or_refuse(questions, top, answering.MIN_OVERLAP)
    return _flat_payload(answers.answer_payload(
        drafted, top, cf.known_clients(_fx(spark, sf, "fx_files"))))


def _answered(spark, sf, questions):
    return answering.answer_questions(
        _corpus(spark, sf), questions, cf.known_clients(_fx(spark, sf, "fx_files")),
        questions_bound=_questions_bound(questions))


@query
def answer_questions(spark, sf):
    return _flat_payload(_answered(spark, sf, _questions(spark, sf)))


@query
def client_mentions(spark, sf):
    found = answers.client_mentions(
        _fx(spark, sf, "fx_answers"), cf.known_clients(_fx(spark, sf, "fx_files")),
        "answer", "answer_no")
    return found.select("answer_no", F.array_join("mentioned_clients", ",").alias("clients"))


@query
def refusal_flags(spark, sf):
    return _fx(spark, sf, "fx_answers").select(
        "answer_no", text.says_refusal("answer").alias("says_refusal"),
        text.is_refusal("answer").alias("is_refusal"))


# ---- evaluation ------------------------------------------------------------------------------

@query
def config_matrix(spark, sf):
    """Every configuration with the number of chunks that its collection holds."""
    searched = store.collection_counts(_corpus(spark, sf, None))
    return ev.config_matrix(spark).join(searched, "collection")


@query
def eval_questions(spark, sf):
    path = shared_dir(spark, "questions")
    number = F.regexp_extract("query_id", r"(\d+)$", 1).cast("bigint")
    asked = _fx(spark, sf, "fx_questions").withColumns({  # documents of one file and one block of rows
        "part": F.regexp_extract("query_id", r"^(.*?)\d+$", 1), "block": F.floor(number / 1024)})
    listed = F.array_sort(F.collect_list(F.struct(F.col("query_id").alias("id"), F.col("text").alias("question"),
                                                  "scope", "expected_pair_id"))).alias("questions")
    asked.groupBy("part", "block").agg(listed).drop("part", "block").write.json(path)
    return ev.read_questions(spark, path)


@query
def config_pending(spark, sf):
    """Configurations left to run: some are finished, one collection is missing."""
    done = fx.table(spark, sf, "labels").select(
        F.element_at(_config_keys(spark), (F.col("doc_id") % 36 + 1).cast("int")).alias("config_key"))
    there = fx.table(spark, sf, "documents").select(
        F.element_at(F.array(*map(F.lit, list(vocab.COLLECTIONS)[:3])), (F.col("doc_id") % 3 + 1).cast("int"))
        .alias("collection")).distinct()
    return ev.pending_configs(ev.config_matrix(spark), done.where(~F.endswith("config_key", F.lit("|none"))), there, first=5)


def _config_keys(spark):
    return F.array(*[F.lit(r.config_key) for r in ev.config_matrix(spark).orderBy("config_no").collect()])


@query
def eval_rank(spark, sf):
    questions = _questions(spark, sf)
    final = fusion.rerank_none(_hybrid(spark, sf), vocab.TOP_K)
    hits = answers.with_text(final, _corpus(spark, sf, role="question"),
                             _questions_bound(questions) * vocab.TOP_K)
    ranks = ev.expected_ranks(hits, questions)
    hit, reciprocal = ev.rank_scores("hit_rank")
    return questions.filter(F.col("scope") == "in").join(ranks, "query_id", "left").select(
        "query_id", "hit_rank", hit.alias("recall"), F.round(reciprocal, 6).alias("mrr"))


RATES = ("recall_at_3", "mrr", "retrieval_gap_rate", "hallucination_refusal_rate",
         "faithfulness", "relevance", "completeness")


@query
def eval_aggregate(spark, sf):
    found = ev.aggregate_configs(fx.eval_rows(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in RATES})


@query
def eval_axis_means(spark, sf):
    found = ev.axis_means(ev.aggregate_configs(fx.eval_rows(spark, sf)))
    return found.withColumns({c: F.round(c, 6) for c in RATES[:3]})


@query
def comparison_table(spark, sf):
    return ev.comparison_lines(ev.aggregate_configs(fx.eval_rows(spark, sf)))


@query
def leaderboard_gap(spark, sf):
    found = ev.lowest_gap(ev.aggregate_configs(fx.eval_rows(spark, sf)))
    return found.select("config_key", F.round("retrieval_gap_rate", 6).alias("retrieval_gap_rate"),
                        F.round("mrr", 6).alias("mrr"))


@query
def judge_parse(spark, sf):
    scores = payloads.judge_scores("payload_json")
    return _fx(spark, sf, "fx_judge").select("query_id", scores.alias("j")).select(
        "query_id", F.col("j").isNotNull().alias("judged"), "j.faithfulness", "j.relevance",
        "j.completeness", "j.reasoning")


@query
def eval_matrix(spark, sf):
    questions = _questions(spark, sf)
    chunks = _corpus(spark, sf, None)
    bound = _questions_bound(questions) * vocab.POOL_SIZE * 36
    rows = experiment.run_matrix(
        chunks, questions, _fx(spark, sf, "fx_rankings"),
        experiment.pools(chunks, questions, index=lambda s: _index(spark, sf, s, _ASKED[s])),
        ev.config_matrix(spark), hits_bound=bound)
    judged = ev.with_judge(rows, _fx(spark, sf, "fx_question_judge"))
    return ev.aggregate_configs(judged).withColumns({c: F.round(c, 6) for c in RATES})


@query
def eval_resumed(spark, sf):
    """The matrix stops after 20 configurations and goes on in a second run."""
    questions, chunks = _questions(spark, sf), _corpus(spark, sf, None)
    run = experiment.ExperimentRun(spark, shared_dir(spark, "experiment"))
    for first in (20, None):
        rows = run.advance(chunks, questions, _fx(spark, sf, "fx_rankings"), first,
                           lambda s: _index(spark, sf, s, _ASKED[s]),
                           hits_bound=_questions_bound(questions) * vocab.POOL_SIZE * 36)
    judged = ev.with_judge(rows, _fx(spark, sf, "fx_question_judge"))
    return ev.aggregate_configs(judged).withColumns({c: F.round(c, 6) for c in RATES})


# ---- review and export ---------------------------------------------------------------------------

@query
def apply_edits(spark, sf):
    edited = review.apply_edits(_fx(spark, sf, "fx_answers"), _fx(spark, sf, "fx_edits"))
    n = review.edit_count(edited).scalar()
    return edited.select("answer_no", "answer", "refused", "status", "modified",
                         n.alias("n_modified"))


def _cited(spark, sf):
    """Answers with one or two sources each."""
    def source(shift):
        other = (F.col("file_no") + shift) % 25
        return F.struct(
            F.concat(F.lit("Client File-"), other.cast("string"), F.lit(".xlsx")).alias("source_file"),
            F.when(F.col("answer_no") % 3 == 0, "untracked").when(F.col("answer_no") % 3 == 1, "")
            .otherwise(F.col("pair_id")).alias("pair_id"))
    listed = F.when(F.col("answer_no") % 2 == 0, F.array(source(0), source(1))).otherwise(
        F.array(source(2)))
    return _fx(spark, sf, "fx_answers").withColumn(
        "sources", F.when(F.col("answer_no") % 11 != 0, listed))


@query
def export_filled(spark, sf):
    edited = review.apply_edits(_cited(spark, sf), _fx(spark, sf, "fx_edits"))
    wide = _fx(spark, sf, "fx_wide").filter(F.col("sheet") == "Main").select(
        "source_file", "row_no", F.col("B").alias("question"))
    return review.export_answers(wide, edited).withColumn(
        "download_name", review.download_name("source_file"))


@query
def answer_sheet(spark, sf):
    """Questions found in all sheets, answered from the corpus and written into their rows; some edited or skipped."""
    listed = question_list(spark, sf)
    edits = listed.where(F.col("row_no") % 5 == 0).select(
        "source_file", "sheet", "row_no", F.when(
            F.col("row_no") % 2 == 0, F.concat(F.lit("Edited: "), "text")).alias("new_text"),
        (F.col("row_no") % 3 == 0).alias("skipped"))
    rows = _fx(spark, sf, "fx_wide").select("source_file", "sheet", "row_no", F.col("B").alias("question"))
    return answering.answer_sheet(_corpus(spark, sf), listed, rows, cf.known_clients(_fx(spark, sf, "fx_files")),
                                  edits, questions_bound=listed.count())


@query
def format_sources(spark, sf):
    return _cited(spark, sf).select("answer_no", answers.format_sources("sources").alias("source_list"))


@query
def run_totals(spark, sf):
    return review.run_totals(_fx(spark, sf, "fx_answers"), "source_file")


@query
def review_summary(spark, sf):
    return review.review_summary(_fx(spark, sf, "fx_answers"), "source_file")


@query
def run_state(spark, sf):
    return review.run_state(_fx(spark, sf, "fx_run_events"))


# ---- scalar functions -------------------------------------------------------------------------------

def _docs(spark, sf):
    return fx.table(spark, sf, "documents")


@query
def tokens(spark, sf):
    found = text.tokens("text")
    return _docs(spark, sf).select(
        "doc_id", F.size(found).cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(found, " ")).alias("token_hash"), text.token_line("text").alias("line"))


@query
def slugs(spark, sf):
    files = _fx(spark, sf, "fx_filenames")
    return files.select("path", text.slug(text.stem(text.basename("path"))).alias("slug"),
                        text.slug("path").alias("path_slug")).unionByName(
        _fx(spark, sf, "fx_files").select(F.col("source_file").alias("path"),
                                          text.slug(text.stem("source_file")).alias("slug"),
                                          text.slug(F.lit("--")).alias("path_slug")))


@query
def text_features(spark, sf):
    return _fx(spark, sf, "fx_sheet").select(
        "source_file", "row_no", text.word_count("question").alias("question_words"),
        text.word_count("answer").alias("answer_words"),
        text.ends_with_question_mark("question").alias("asks"))


@query
def truncate_forms(spark, sf):
    padded = F.concat(F.lit(" \n"), F.col("text"))
    return _docs(spark, sf).select(
        "doc_id", text.shorten_cell(padded).alias("cell"), text.shorten_chunk(padded).alias("chunk"),
        text.shorten_hit(padded).alias("hit"), text.shorten_candidate(padded).alias("candidate"))


@query
def column_letters(spark, sf):
    letter = text.column_letter(F.col("doc_id") % 16384 + 1)
    return _docs(spark, sf).select("doc_id", letter.alias("letter"),
                                   text.column_index(letter).alias("col_no"))


@query
def pair_row(spark, sf):
    ids = _fx(spark, sf, "fx_user_rows").select(F.explode(F.array(
        "pair_id", F.concat("pair_id", F.lit("x")), F.lit(""))).alias("pair_id"))
    return ids.select("pair_id", text.pair_row("pair_id").alias("row_label"))


@query
def list_markers(spark, sf):
    first = F.regexp_extract("text", r"^\S+", 0)
    word = (F.when(F.col("doc_id") % 5 == 0, "•").when(F.col("doc_id") % 5 == 1, F.concat(
        F.col("doc_id").cast("string"), F.lit(".")))
        .when(F.col("doc_id") % 5 == 2, "·").when(F.col("doc_id") % 5 == 3, "-").otherwise(first))
    font = F.concat("source", F.when(F.col("doc_id") % 3 == 0, "-SemiBold").otherwise("-Light"))
    return _docs(spark, sf).select("doc_id", word.alias("word"),
                                   text.is_list_marker(word).alias("is_marker"),
                                   text.is_bold_font(font).alias("is_bold"))


# ---- page layout -----------------------------------------------------------------------------------------

def _lined(spark, sf):
    return layout.assign_lines(fx.page_words(spark, sf))


@query
def modal_size(spark, sf):
    return layout.modal_size(fx.page_words(spark, sf), "doc_id", "page")


@query
def layout_lines(spark, sf):
    return _lined(spark, sf).groupBy("doc_id", "page", "line_top").agg(
        F.count("*").alias("n_words"), F.min("word_no").alias("first_word_no"),
        F.max("word_no").alias("last_word_no"))


@query
def line_signature(spark, sf):
    return layout.line_signature(_lined(spark, sf))


@query
def layout_paragraphs(spark, sf):
    found = layout.paragraph_breaks(layout.line_signature(_lined(spark, sf)))
    return found.select("doc_id", "page", "line_top", "para_no")


@query
def paragraph_text(spark, sf):
    return layout.paragraphs(_lined(spark, sf)).select(
        "doc_id", "page", "para_no", "text", "is_bold", "has_num_pr", "rendered_size")


@query
def bbox_in_table(spark, sf):
    paras = layout.paragraphs(_lined(spark, sf))
    return layout.boxed(paras, _fx(spark, sf, "fx_boxes")).select(
        "doc_id", "page", "para_no", "in_table")


@query
def zip_pair_dates(spark, sf):
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    n = F.col("n").cast("bigint")
    paras = layout.drop_spacers(lines.select(
        "doc_id", F.floor(n / 5).alias("table_row"), n.alias("para_no"), "text",
        (n % 4 == 0).alias("has_num_pr")))
    dates = lines.filter(n % 5 < 2).select(
        "doc_id", F.floor(n / 5).alias("table_row"), n.alias("date_no"),
        (F.lit(2000) + n % 25).cast("string").alias("date"))
    return layout.pair_dates(paras, dates).select("doc_id", "table_row", "para_no", "date")


# ---- streams -----------------------------------------------------------------------------------------------

def _stream(spark, sf, name):
    """A table as a stream of files: it is one file, or a folder of them."""
    stream_of = spark.readStream.schema(fx.table(spark, sf, name).schema)
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return stream_of.parquet(f"{sf}/{name}.parquet")
    return stream_of.option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query
def stream_ingest(spark, sf):
    """Turns arrive as files; replies are stored once as chunks, also on a second run."""
    root = shared_dir(spark, "stream-ingest")

    def to_chunks(batch):
        rows = batch.filter(F.col("role") != "system").select(
            F.concat(F.lit("conv_"), F.col("conv_id").cast("string"), F.lit("_row_"),
                     F.col("turn").cast("string"), F.lit("__"), "role").alias("chunk_id"),
            F.col("text"), F.col("role"))
        return ch.non_empty(rows)

    for _ in range(2):
        stream.append_new(_stream(spark, sf, "conversations"), to_chunks, "chunk_id",
                          f"{root}/chunks", f"{root}/state")
    return spark.read.parquet(f"{root}/chunks").select("chunk_id", "text", "role")


def _sheet_stream(spark, sf) -> store.CorpusStore:
    """Half of the source files arrive, the stream stops; the others arrive, and some again; it goes on."""
    key = (spark.sparkContext.applicationId, sf, "sheets")
    if key not in _STORED:
        root = shared_dir(spark, "sheet-stream")
        wide = _fx(spark, sf, "fx_wide")
        half = F.pmod(F.xxhash64("source_file"), F.lit(2))
        for k in range(3):  # the third delivery repeats the first
            part = wide.where(half == k % 2).repartition("source_file")
            part.write.mode("append").parquet(f"{root}/inbox")
            arriving = spark.readStream.schema(wide.schema).parquet(f"{root}/inbox")
            stream.ingest_stream(store.CorpusStore(spark, f"{root}/store"), arriving, _configs(spark, sf),
                                 f"{root}/state")
        _STORED[key] = f"{root}/store"
    return store.CorpusStore(spark, _STORED[key])


@query
def stream_ingest_chunks(spark, sf):
    return _chunk_columns(_sheet_stream(spark, sf).read())


@query
def stream_ingest_checkpoint(spark, sf):
    return _sheet_stream(spark, sf).checkpoint()


@query
def stream_sessions(spark, sf):
    """Sessions that have ended, each written once."""
    root = shared_dir(spark, "stream-sessions")
    events = _stream(spark, sf, "events").select(F.col("user_id").alias("session_id"),
                                                 F.col("ts").cast("timestamp").alias("ts"))
    for _ in range(2):  # a second run finds nothing new
        stream.session_stream(events, f"{root}/closed", f"{root}/state", "6 hours")
    closed = spark.read.schema("session_id long, started timestamp, ended timestamp, n_events long").parquet(
        f"{root}/closed")
    return closed.select("session_id", F.unix_micros("started").alias("started"), F.unix_micros("ended").alias("ended"),
                         "n_events")


@query
def stream_answer(spark, sf):
    root = shared_dir(spark, "stream-answer")
    def answer(batch):
        asked = batch.select(F.concat(F.lit("out-"), F.col("item_id").cast("string"))
                             .alias("query_id"), "text")
        return _flat_payload(_answered(spark, sf, asked))

    stream.answer_stream(_stream(spark, sf, "benchmark"), answer, f"{root}/answers", f"{root}/state")
    return spark.read.parquet(f"{root}/answers").drop("batch_id")


@query
def stream_progress(spark, sf):
    root = shared_dir(spark, "stream-progress")
    events = _stream(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), (F.col("event_id") % 4).alias("collection"),
        F.col("event_type").alias("type"), (F.col("event_id") % 40 + 1).alias("batch"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    stream.progress_stream(events, f"{root}/latest", f"{root}/state")
    return stream.read_progress(spark, f"{root}/latest")


@query
def stream_dedup(spark, sf):
    """Every event is delivered twice; ids are stored once."""
    root = shared_dir(spark, "stream-dedup")
    both = _stream(spark, sf, "events").union(_stream(spark, sf, "events")).select(
        F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type"))
    stream.dedup_stream(both, "event_id", "ts", "60 days", f"{root}/events", f"{root}/state")
    stored = spark.read.parquet(f"{root}/events")
    return stored.groupBy("event_type").agg(
        F.count("*").alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


@query
def session_retention(spark, sf):
    sessions = fx.table(spark, sf, "events").withColumnRenamed("user_id", "session_id")
    idle = stream.idle_sessions(sessions, 6 * 3600)
    return idle.withColumn("idle_seconds", F.round("idle_seconds", 3))
