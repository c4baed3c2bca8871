"""The corpus store: Parquet by strategy and bucket, with a checkpoint log.

A chunk's bucket is a hash of the file part of its id, so a file lies in one
folder of a strategy, an id tells its folder, and the number of folders does not grow
with the number of files. Distance is chosen when searching, so two stored strategies
serve four logical collections.
"""

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text, vocab
from ..functions.sizing import broadcast_if, stored
from .terms import TermIndex, build_index

CHUNKS = ("chunk_id string, text string, metadata map<string,string>, pair_id string, "
          "role string, chunk_index bigint, embedding array<float>, "
          "source_file string, strategy string, bucket int")
CHECKPOINT = ("collection string, source_file string, rows bigint, chunks_embedded bigint")
#: Checkpoint rows as written: the entry of highest number holds for its unit.
LOG = f"{CHECKPOINT}, entry bigint, removed boolean"
#: Where the chunks of a file were put, written before them; may name places that are empty by now.
PARTS = "strategy string, source_file string, bucket int"
#: Folders of a strategy. Fixed, since stored ids are found by it.
BUCKETS = 1024


def bucket_of(chunk_id) -> Column:
    """The folder number of a chunk, pair or answer id: all ids of a file have the same one."""
    file_part = F.regexp_replace(text.col(chunk_id), r"_row_\d+(__\w+)?$", "")
    return F.pmod(F.xxhash64(file_part), F.lit(BUCKETS)).cast("int")


def fetch(chunks: DataFrame, ids: DataFrame, id_col: str, columns, ids_bound: int | None = None) -> DataFrame:
    """``ids`` with ``columns`` of the chunk that ``id_col`` names; ids without a chunk are left out.

    In a store only the buckets of the ids are read: where ``ids_bound`` lets the ids be sent
    to every task, the scan is pruned by them at run time. The comparison of lengths leaves no row out but
    empty ids; it tells the optimizer that the ids are a selection.
    """
    keyed = {id_col: F.col("chunk_id")}
    if "bucket" in chunks.columns:
        keyed["_bucket"] = F.col("bucket")
        ids = ids.where(F.length(id_col) > 0).withColumn("_bucket", bucket_of(id_col))
    wanted = chunks.select(*[c.alias(n) for n, c in keyed.items()], *columns)
    return wanted.join(broadcast_if(ids, ids_bound), list(keyed)).drop("_bucket")


def pending(units: DataFrame, done: DataFrame, keys=("collection", "source_file")) -> DataFrame:
    """Units of work that the checkpoint does not list yet."""
    return units.join(done.select(*keys).distinct(), list(keys), "left_anti")


def collection_units(files: DataFrame, collections=None) -> DataFrame:
    """Every source file with every logical collection it belongs in."""
    names = collections or list(vocab.COLLECTIONS)
    table = F.array(*[F.struct(F.lit(n).alias("collection"),
                               F.lit(vocab.COLLECTIONS[n][0]).alias("strategy")) for n in names])
    return files.select("source_file", F.inline(table))


def collection_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per logical collection."""
    per = chunks.groupBy("strategy").agg(F.count("*").alias("n_chunks"))
    table = F.array(*[F.struct(F.lit(n).alias("collection"), F.lit(s).alias("strategy"))
                      for n, (s, _) in vocab.COLLECTIONS.items()])
    names = chunks.sparkSession.range(1).select(F.inline(table))
    return names.join(per, "strategy", "left").select(
        "collection", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Q&A pairs per source file and in total (combined chunks count pairs)."""
    pairs = chunks.filter(F.col("strategy") == "combined")
    per_file = pairs.groupBy("source_file").agg(F.count("*").alias("n_pairs"))
    return per_file.rollup("source_file").agg(
        F.sum("n_pairs").alias("n_pairs"), F.count("source_file").alias("n_files")).select(
        F.coalesce("source_file", F.lit("TOTAL")).alias("source_file"), "n_pairs", "n_files")


def delete_counts(chunks: DataFrame, source_file: str) -> DataFrame:
    """Chunks before, after and removed per logical collection for one file."""
    gone = F.col("source_file") == source_file
    per = chunks.groupBy("strategy").agg(
        F.count("*").alias("n_before"), F.count_if(~gone).alias("n_after"),
        F.count_if(gone).alias("n_removed"))
    table = F.array(*[F.struct(F.lit(n).alias("collection"), F.lit(s).alias("strategy"))
                      for n, (s, _) in vocab.COLLECTIONS.items()])
    names = chunks.sparkSession.range(1).select(F.inline(table))
    zero = F.lit(0)
    return names.join(per, "strategy", "left").select("collection", *[
        F.coalesce(c, zero).alias(c) for c in ("n_before", "n_after", "n_removed")])


class CorpusStore:
    """Chunks, their places and the record of finished work under one folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.chunks_path = f"{root}/chunks"
        self.aside_path = f"{root}/chunks-next"
        self.parts_path = f"{root}/parts"
        self.checkpoint_path = f"{root}/checkpoint"
        self.index_path = f"{root}/terms"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def _remove(self, name: str) -> None:
        self._fs(name).delete(self._path(name), True)

    def _folder(self, root: str, strategy: str, bucket: int) -> str:
        return f"{root}/strategy={strategy}/bucket={bucket}"

    def read(self, strategy: str | None = None, role: str | None = None) -> DataFrame:
        """Chunks; strategy prunes folders, role is pushed into the Parquet scan."""
        if not self._exists(self.chunks_path):
            return self.spark.createDataFrame([], CHUNKS)
        chunks = self.spark.read.schema(CHUNKS).parquet(self.chunks_path)
        if strategy:
            chunks = chunks.filter(F.col("strategy") == strategy)
        if role:
            chunks = chunks.filter(F.col("role") == role)
        return chunks

    def parts(self) -> DataFrame:
        if not self._exists(self.parts_path):
            return self.spark.createDataFrame([], PARTS)
        return self.spark.read.schema(PARTS).parquet(self.parts_path)

    def write(self, chunks: DataFrame, buckets: int = 0, parts: DataFrame | None = None) -> None:
        """Replace the (strategy, file) parts that occur in ``chunks``.

        New files are appended. Only where a file was written before, finished or
        not, its buckets are written anew without it first. Repeating a write leaves the same content.
        ``buckets`` > 0 deals the rows of a bucket to that many tasks; else the optimizer
        splits and joins them by size. ``parts`` spares the pass that finds (strategy, source_file, bucket).
        """
        self.recover()
        columns = [f.split()[0] for f in CHUNKS.split(", ")]
        if "embedding" not in chunks.columns:
            chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        chunks = chunks.withColumn("bucket", bucket_of("chunk_id")).select(*columns)
        if parts is None:
            parts = stored(chunks.select("strategy", "source_file", "bucket").distinct(), "parts")
        self._drop(parts.select("strategy", "source_file").distinct())
        parts.select("strategy", "source_file", "bucket").write.mode("append").parquet(self.parts_path)
        if buckets:
            salt = F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))
            chunks = chunks.repartition("strategy", "bucket", salt)
        else:
            chunks = chunks.hint("rebalance", "strategy", "bucket")
        (chunks.sortWithinPartitions("strategy", "bucket", "chunk_id").write.mode("append")
         .partitionBy("strategy", "bucket").parquet(self.chunks_path))

    def _drop(self, units: DataFrame) -> None:
        """Take the rows of these (strategy, source_file) units out of the folders that hold them."""
        places = [(r.strategy, r.bucket) for r in self.parts().join(
            units, ["strategy", "source_file"], "left_semi").select("strategy", "bucket").distinct().collect()]
        places = [p for p in places if self._exists(self._folder(self.chunks_path, *p))]
        if not places:  # at most BUCKETS for a strategy
            return
        touched = self.spark.read.schema(CHUNKS).option("basePath", self.chunks_path).parquet(
            *[self._folder(self.chunks_path, *p) for p in places])
        (touched.join(units, ["strategy", "source_file"], "left_anti").select(touched.columns)
         .hint("rebalance", "strategy", "bucket").sortWithinPartitions("strategy", "bucket", "chunk_id")
         .write.partitionBy("strategy", "bucket").parquet(self.aside_path))
        for place in places:
            if not self._exists(self._folder(self.aside_path, *place)):
                self._remove(self._folder(self.chunks_path, *place))
        self.recover()

    def recover(self) -> None:
        """Put folders that were written anew in place; finishes what a crash left, before any write or delete."""
        if not self._exists(self.aside_path):
            return
        if self._exists(f"{self.aside_path}/_SUCCESS"):
            fs = self._fs(self.aside_path)
            for found in fs.globStatus(self._path(self._folder(self.aside_path, "*", "*"))):
                fresh = found.getPath()
                place = self._path(f"{self.chunks_path}/{fresh.getParent().getName()}/{fresh.getName()}")
                fs.delete(place, True)
                fs.rename(fresh, place)
        self._remove(self.aside_path)

    def version(self) -> str:
        """Changes with the stored chunks: their files' names, sizes and times."""
        if not self._exists(self.chunks_path):
            return "empty"
        files = self._fs(self.chunks_path).listFiles(self._path(self.chunks_path), True)
        mark = hashlib.sha256()
        names = []
        while files.hasNext():
            f = files.next()
            names.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        for name in sorted(names):
            mark.update(name.encode())
        return mark.hexdigest()[:16]

    def term_index(self, strategy: str, role: str | None = None) -> TermIndex:
        """The inverted index of these chunks, built once for each version of the store."""
        path = f"{self.index_path}/{strategy}-{role or 'all'}-{self.version()}"
        if self._exists(f"{path}/postings/_SUCCESS"):  # written last
            return TermIndex(self.spark, path)
        if self._exists(path):  # a build that did not end
            self._remove(path)
        return build_index(self.read(strategy, role), path)

    def checkpoint(self) -> DataFrame:
        """Finished units, each as its newest entry has it."""
        if not self._exists(self.checkpoint_path):
            return self.spark.createDataFrame([], CHECKPOINT)
        log = self.spark.read.schema(LOG).parquet(self.checkpoint_path)
        newest = log.groupBy("collection", "source_file").agg(
            F.max_by(F.struct("rows", "chunks_embedded", "removed"), "entry").alias("e"))
        return newest.where(~F.col("e.removed")).select("collection", "source_file", "e.rows", "e.chunks_embedded")

    def _log(self, entries: DataFrame, removed: bool) -> None:
        entries.select(*[f.split()[0] for f in CHECKPOINT.split(", ")], F.lit(time.time_ns()).alias("entry"),
                       F.lit(removed).alias("removed")).write.mode("append").parquet(self.checkpoint_path)

    def mark_done(self, entries: DataFrame) -> None:
        """Record finished units; call only after their chunks are written."""
        self._log(entries, False)

    def delete(self, source_file: str) -> list:
        """Drop one file's chunks and checkpoint entries; returns counts per collection.

        The entries go first, so a delete that is cut short can be repeated.
        """
        if not source_file or "/" in source_file or "\\" in source_file:
            raise ValueError(f"invalid source_file {source_file!r}")
        self.recover()
        counts = delete_counts(self.read(), source_file).collect()
        if not sum(r.n_removed for r in counts):
            raise LookupError(f"no chunks of {source_file!r} in any collection")
        gone = self.checkpoint().filter(F.col("source_file") == source_file)
        if self._exists(self.checkpoint_path):
            self._log(gone, True)
        self._drop(self.parts().filter(F.col("source_file") == source_file).select(
            "strategy", "source_file").distinct())
        return counts

    def reset(self) -> None:
        for path in (self.chunks_path, self.aside_path, self.parts_path, self.checkpoint_path, self.index_path):
            if self._exists(path):
                self._remove(path)
