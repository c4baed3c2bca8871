"""Ingest: rows to stored, embedded chunks, resumable per collection and file."""

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions import vocab
from ..functions.sizing import discard, give_back, stored
from ..operators.chunks import build_chunks, non_empty, require_unique_ids
from ..operators.vectors import embed, hash_embed
from ..sources.corpus import CorpusStore, bucket_of, collection_units, pending


def ingest(store: CorpusStore, rows: DataFrame, collections=None,
           embed_fn: Callable = hash_embed, buckets: int = 0) -> None:
    """Write what the checkpoint lacks, then record it.

    Both distances of a strategy share one stored table, so a file's chunks
    are built and embedded once, and not again where one of them is finished.
    The rows are stored first, since the checkpoint counts them again. Chunks are
    counted as they are built; the store is not read again. A file
    without usable chunks is recorded too. Repeated chunk ids stop the ingest.
    """
    names = list(collections or vocab.COLLECTIONS)
    rows = stored(rows, "rows")
    files = rows.select("source_file").distinct()
    todo = pending(collection_units(files, names), store.checkpoint()).persist()
    there = store.checkpoint().select("collection", "source_file", "chunks_embedded").join(
        collection_units(files), ["collection", "source_file"]).groupBy("strategy", "source_file").agg(
        F.max("chunks_embedded").alias("n"))
    wanted = todo.select("strategy", "source_file").distinct().join(
        there, ["strategy", "source_file"], "left_anti")
    strategies = sorted({vocab.COLLECTIONS[n][0] for n in names})
    fresh = stored(non_empty(build_chunks(rows, *strategies)).join(
        wanted, ["strategy", "source_file"], "left_semi"), "fresh")
    require_unique_ids(fresh)
    sizes = stored(fresh.groupBy("strategy", "source_file", bucket_of("chunk_id").alias("bucket")).agg(
        F.count("*").alias("n")), "sizes")
    store.write(embed(fresh, embed_fn), buckets, sizes)
    discard(fresh)
    give_back(rows.sparkSession)
    n_rows = rows.groupBy("source_file").agg(F.count("*").alias("rows"))
    n_chunks = sizes.select("strategy", "source_file", "n").unionByName(there).groupBy(
        "strategy", "source_file").agg(F.sum("n").alias("chunks_embedded"))
    entries = (todo.join(n_rows, "source_file")
               .join(n_chunks, ["strategy", "source_file"], "left")
               .withColumn("chunks_embedded", F.coalesce("chunks_embedded", F.lit(0))))
    store.mark_done(entries)
    todo.unpersist()
    discard(rows, sizes)
