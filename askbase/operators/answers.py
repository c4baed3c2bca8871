"""From ranked hits to answers: linking, context, drafting, provenance."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, vocab
from ..sources.corpus import fetch


def with_text(hits: DataFrame, chunks: DataFrame, hits_bound: int | None = None,
              columns=("text", "pair_id", "source_file", "metadata")) -> DataFrame:
    """Fetch chunk columns for the few ids that were ranked, from their buckets of a store."""
    return fetch(chunks, hits, "chunk_id", columns, hits_bound)


def answer_id(c) -> Column:
    return F.regexp_replace(text.col(c), "__question$", "__answer")


def pair_link(hits: DataFrame, chunks: DataFrame, hits_bound: int | None = None) -> DataFrame:
    """Answer chunk of every question hit; a fixed text where there is none.

    ``hits_bound`` is a known upper bound of the number of hits (queries times
    k); it allows the corpus side to be read without a shuffle. Only ids are
    sent to every task by that bound; answers' texts are joined by their size.
    """
    linked = hits.withColumn("answer_id", answer_id("chunk_id"))
    found = fetch(chunks.filter(F.col("role") == "answer"), linked.select("answer_id").distinct(),
                  "answer_id", [F.col("text").alias("answer_text")], hits_bound)
    return linked.join(found, "answer_id", "left").withColumn(
        "answer_text", F.coalesce("answer_text", F.lit(vocab.ANSWER_MISSING)))


def _blocks(entry: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.struct("rank", entry.alias("block"))))
    return F.array_join(F.transform(ordered, lambda b: b.block), "\n\n")


def context_blocks(top: DataFrame, by=("query_id",), with_source: bool = True) -> DataFrame:
    """Numbered context per query; ``answer_text`` null means a combined chunk."""
    source = F.concat(F.lit(", source="), F.coalesce("source_file", F.lit("?"))) \
        if with_source else F.lit("")
    head = F.concat(F.lit("[past Q&A "), F.col("rank").cast("string"), source, F.lit("]\n"))
    body = F.when(F.col("answer_text").isNull(), F.col("text")).otherwise(
        F.concat(F.lit("Q: "), F.col("text"), F.lit("\nA: "), F.col("answer_text")))
    return top.groupBy(*by).agg(_blocks(F.concat(head, body)).alias("context"))


def draft_or_refuse(questions: DataFrame, top: DataFrame, min_score: float,
                    by=("query_id",), score: str = "score") -> DataFrame:
    """The best hit's answer when it is good enough, else the refusal sentence.

    A stand-in for a language model: callers with drafted answers join those
    instead and keep the refusal for questions without hits.
    """
    best = top.groupBy(*by).agg(
        F.min_by(F.struct(F.col(score).alias("score"), "answer_text"), "rank").alias("_best"))
    usable = ((F.col("_best.score") >= min_score) & (text.strip("_best.answer_text") != "")
              & (F.col("_best.answer_text") != vocab.ANSWER_MISSING))
    return questions.join(best, list(by), "left").withColumn(
        "answer", F.when(usable, F.col("_best.answer_text")).otherwise(vocab.REFUSAL_TEXT)
    ).drop("_best")


def client_mentions(answers: DataFrame, clients: DataFrame, text_col: str = "answer",
                    id_col: str = "query_id") -> DataFrame:
    """Names of clients found in each answer as whole words, in any case.

    A name is looked for where its first word occurs; one without any word
    character can only fill the gap between two words, and is looked up as that.
    Words are joined with the names' keys as (id, word) rows, so no text is
    shuffled for a word; a match is then verified in the answer's row.
    """
    low = F.lower(F.coalesce(text_col, F.lit("")))
    word = F.regexp_extract(F.lower("client"), r"(?U)\w+", 0)
    listed = clients.filter(F.col("client") != "").select("client").distinct().select(
        "client", F.when(word != "", word).otherwise(F.lower("client")).alias("word"))
    keys = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)),
                                     F.regexp_extract_all(low, F.lit(r"(?U)\W+"), F.lit(0))))
    near = (answers.select(F.col(id_col).alias("_id"), F.explode(keys).alias("word")).join(listed, "word")
            .groupBy("_id").agg(F.array_sort(F.collect_set("client")).alias("_names")))
    joined = answers.join(near, F.col(id_col) == F.col("_id"), "left").drop("_id")
    verified = F.filter("_names", lambda n: F.regexp_like(low, F.concat(
        F.lit(r"(?U)\b\Q"), F.replace(F.lower(n), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))))
    return joined.withColumn("mentioned_clients", F.coalesce(
        verified, F.array().cast("array<string>"))).drop("_names")


def sources_of(top: DataFrame, by=("query_id",)) -> DataFrame:
    """Provenance of each answer: its hits in rank order."""
    def meta(name):
        return F.try_element_at("metadata", F.lit(name)).alias(name)

    source = F.struct(
        "rank", F.coalesce("source_file", F.lit("?")).alias("source_file"),
        F.coalesce("pair_id", F.lit("?")).alias("pair_id"), meta("section"), meta("client"),
        F.round("score", 4).alias("score"), "score_type",
        F.col("text").alias("question_text"), "answer_text")
    return top.groupBy(*by).agg(
        F.array_sort(F.collect_list(source), lambda a, b: (a["rank"] - b["rank"]).cast("int")).alias("sources"),
        F.round(F.min_by("score", "rank"), 4).alias("confidence"))


def answer_payload(drafts: DataFrame, top: DataFrame, clients: DataFrame,
                   by=("query_id",)) -> DataFrame:
    """Answer with refusal flag, confidence, sources and names of other clients."""
    joined = drafts.join(sources_of(top, by), list(by), "left")
    full = joined.select(
        "*", text.is_refusal("answer").alias("refused"),
    ).withColumn("confidence", F.coalesce("confidence", F.lit(0.0))).withColumn(
        "pair_ids", F.coalesce(F.transform("sources", lambda s: s.pair_id),
                               F.array().cast("array<string>")))
    return client_mentions(full, clients, "answer", by[0])


def format_sources(sources) -> Column:
    """'file row N | file row M' in rank order; '' without sources."""
    return F.coalesce(F.array_join(F.transform(text.col(sources), lambda s: F.concat(
        F.coalesce(F.nullif(s.source_file, F.lit("")), F.lit("?")), F.lit(" row "),
        text.pair_row(s.pair_id))), " | "), F.lit(""))
