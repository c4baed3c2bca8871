"""Combining and re-ordering ranked pools."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import payloads, text, vocab


def rank_by(hits: DataFrame, *order, by=("query_id",), top: int | None = None) -> DataFrame:
    """Replace ``rank`` by the position in ``order`` and keep the first ``top``."""
    window = Window.partitionBy(*by).orderBy(*order)
    ranked = hits.withColumn("rank", F.row_number().over(window).cast("bigint"))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, n: int = vocab.POOL_SIZE,
                           id_col: str = "chunk_id", by=("query_id",),
                           k: int = vocab.RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over two rankings; one shuffle on the query serves sums and ranks."""
    keys = [*by, id_col]
    parts = first.select(*keys, "rank").unionByName(second.select(*keys, "rank")).repartition(*by)
    fused = parts.groupBy(*keys).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    top = rank_by(fused, F.round("score", 9).desc(), id_col, by=by, top=n)
    return top.select(*keys, "rank", "score", F.lit("rrf").alias("score_type"))


def first_seen(first: DataFrame, second: DataFrame, id_col: str, value: str,
               by=("query_id",)) -> DataFrame:
    """Per (query, id) the ``value`` of the first ranking, else of the second."""
    keys = [*by, id_col]
    tagged = first.select(*keys, value, F.lit(0).alias("_side")).unionByName(
        second.select(*keys, value, F.lit(1).alias("_side")))
    return tagged.groupBy(*keys).agg(F.min_by(value, "_side").alias(value))


def rerank_none(hits: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    return hits.filter(F.col("rank") <= k)


def _jaccard(a: Column, b: Column) -> Column:
    """Of arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 0.0).otherwise(both / either)


def _bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def _parts(words: Column) -> Column:
    return F.transform(F.array(words), lambda w: F.struct(
        F.array_distinct(w).alias("words"), _bigrams(w).alias("bigrams")))[0]


def lexical_parts(c) -> Column:
    """The distinct words and bigrams of a text: what the overlap of many pairs needs of each text once."""
    return _parts(text.tokens(c))


def line_parts(line) -> Column:
    """The same from a token line, which is a fraction of their size where a text goes with each of its pairs."""
    return _parts(F.filter(F.split(line, " "), lambda w: w != ""))


def parts_overlap(a: Column, b: Column) -> Column:
    """Jaccard of tokens plus half the Jaccard of bigrams, a deterministic stand-in for a neural pair scorer."""
    return _jaccard(a["words"], b["words"]) + 0.5 * _jaccard(a["bigrams"], b["bigrams"])


def lexical_overlap(query, candidate) -> Column:
    """The overlap of two texts. The one-element array binds their parts, so that each text is tokenised once."""
    both = F.struct(lexical_parts(query).alias("q"), lexical_parts(candidate).alias("c"))
    return F.transform(F.array(both), lambda p: parts_overlap(p["q"], p["c"]))[0]


def rescore(pairs: DataFrame, score_fn: Callable | None = None, k: int | None = vocab.TOP_K,
            id_col: str = "chunk_id", by=("query_id",), parts: tuple[str, str] | None = None) -> DataFrame:
    """New score for every (query_text, text) pair, best first.

    ``score_fn`` takes the two columns and returns a column (a built-in
    expression or a pandas UDF); without one the words' overlap is the score. ``parts`` names
    columns with the :func:`lexical_parts` of both texts, made once for all pairs of a text; they are dropped.
    """
    if parts and not score_fn:
        score = parts_overlap(F.col(parts[0]), F.col(parts[1]))
    else:
        score = (score_fn or lexical_overlap)(F.col("query_text"), F.col("text"))
    scored = pairs.withColumn("score", score).drop(*parts or ())
    return rank_by(scored.withColumn("score_type", F.lit("crossencoder" if score_fn else "overlap")),
                   F.round("score", 9).desc(), id_col, by=by, top=k)


def apply_ranking(hits: DataFrame, rankings: DataFrame, k: int | None = vocab.TOP_K,
                  by=("query_id",)) -> DataFrame:
    """Re-order pools by a JSON ranking supplied per query, repairing it.

    Positions out of range or seen before are dropped, positions not named
    follow in pool order, and an unusable payload leaves the pool as it was.
    """
    by = list(by)
    order = rankings.select(*[c for c in by if c in rankings.columns], payloads
                            .ranking_positions("ranking_json").alias("_order"))
    known = hits.dropna(subset=by)
    sized = known.withColumn("_size", F.count("*").over(Window.partitionBy(*by)))
    joined = sized.join(order, [c for c in by if c in rankings.columns], "left")
    usable = F.filter("_order", lambda p: (p >= 0) & (p < F.col("_size")))
    place = F.array_position(F.array_distinct(usable), F.col("rank") - 1)
    placed = joined.withColumn("_place", F.nullif(place, F.lit(0)))
    moved = rank_by(placed.withColumnRenamed("rank", "pool_rank"),
                    F.col("_place").asc_nulls_last(), "pool_rank", by=by, top=k)
    good = F.col("_order").isNotNull()
    return (moved.withColumn("score", F.when(good, (F.col("_size") - F.col("rank") + 1).cast("double"))
                             .otherwise(F.col("score")))
            .withColumn("score_type", F.when(good, "llm_rerank").otherwise(F.col("score_type")))
            .drop("_order", "_size", "_place", "pool_rank"))


def score_gap(hits: DataFrame) -> DataFrame:
    """How far the best hit is ahead of the second one, per query."""
    return hits.filter(F.col("rank") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second_score"),
    ).withColumn("gap", F.col("top_score") - F.col("second_score"))
