"""Chunks from Q&A rows: one per row, or question and answer apart."""

from pyspark.sql import DataFrame, functions as F

from ..functions import text, vocab
from .ordered import BLOCK, running_index

# Keys that describe the chunk itself; row metadata never overrides them.
SYSTEM_KEYS = ("pair_id", "source_file", "strategy", "role", "chunk_index")


def _own_metadata():
    return F.map_filter(text.drop_empty("metadata"), lambda k, v: ~k.isin(*SYSTEM_KEYS))


def build_chunks(rows: DataFrame, *strategies: str) -> DataFrame:
    """Chunks of the given strategies in one pass over the rows.

    ``chunk_index`` restarts in every file, following ``row_index``.
    """
    def piece(strategy, role, body, index):
        return F.struct(F.lit(strategy).alias("strategy"), F.lit(role).cast("string").alias("role"),
                        body.alias("text"), index.alias("chunk_index"))

    i = F.col("row_index")
    combined = F.concat_ws("\n", F.concat(F.lit("Q: "), "question"),
                           F.concat(F.lit("A: "), "answer"),
                           F.concat(F.lit("C: "), F.nullif("context", F.lit(""))))
    pieces = {"combined": [piece("combined", None, combined, i)],
              "separated": [piece("separated", "question", F.col("question"), i * 2),
                            piece("separated", "answer", F.col("answer"), i * 2 + 1)]}
    wanted = [p for s in strategies for p in pieces[s]]
    return rows.select(
        "pair_id", "source_file", _own_metadata().alias("metadata"), F.inline(F.array(*wanted))
    ).select(F.concat_ws("__", "pair_id", "role").alias("chunk_id"), "text", "metadata",
             "pair_id", "source_file", "role", "strategy", "chunk_index")


def non_empty(chunks: DataFrame) -> DataFrame:
    return chunks.filter(text.strip("text") != "")


def chunk_stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Number of chunks and their word counts; zeros for no chunks."""
    n = text.word_count("text")
    zero = F.lit(0).cast("bigint")
    return chunks.groupBy(*by).agg(
        F.count("*").alias("n_chunks"), F.coalesce(F.avg(n), F.lit(0.0)).alias("avg_words"),
        F.coalesce(F.min(n), zero).alias("min_words"),
        F.coalesce(F.max(n), zero).alias("max_words"))


def edge_samples(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks of the first and the last row of the corpus, shortened."""
    place = F.struct("source_file", "row_no")
    edges = rows.agg(F.min_by("pair_id", place).alias("first"),
                     F.max_by("pair_id", place).alias("last"))
    edges = edges.select(F.explode(F.array(
        F.struct(F.lit("first").alias("edge"), F.col("first").alias("pair_id")),
        F.struct(F.lit("last").alias("edge"), F.col("last").alias("pair_id")))).alias("e"))
    return chunks.join(F.broadcast(edges.select("e.*")), "pair_id").select(
        "edge", "strategy", "chunk_id", text.shorten_chunk("text").alias("preview"))


def batch_plan(chunks: DataFrame, size: int = vocab.EMBED_BATCH, block: int = BLOCK) -> DataFrame:
    """Batch number and total per (strategy, file) of the chunks that carry text."""
    keys = ["strategy", "source_file"]
    filled = non_empty(chunks)
    kept = running_index(filled, keys, "chunk_index", "_i", block)
    totals = filled.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("n_batches"))
    return kept.join(totals, keys).select(
        *keys, "chunk_id", (F.floor(F.col("_i") / size) + 1).alias("batch"),
        (F.col("_i") % size).alias("slot"), "n_batches")


def duplicate_ids(chunks: DataFrame, key: str = "chunk_id") -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def require_unique_ids(chunks: DataFrame) -> None:
    bad = duplicate_ids(chunks).take(5)
    if bad:
        raise ValueError("chunk ids are not unique: " + ", ".join(r.chunk_id for r in bad))
