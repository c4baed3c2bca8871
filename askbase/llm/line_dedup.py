"""Lines repeated across documents, dropped everywhere but in one of them.

Two Bloom filters keep line text from moving. The *once* filters: line hashes
(8 bytes each, deduplicated within a batch) are dealt to shards by hash; a
shard reports a hash that its once filter already holds. The *twice* filter:
the reported hashes, in one filter of at most ``filter_bits`` bits that every
task gets. A Bloom filter never denies what was put in, so a line outside the
twice filter occurs once in the corpus and stays without further work. Only the
others, the suspected repeats, are shuffled, grouped by their exact key and
counted; false positives end there.

Sizes: a once filter grows by equal parts as its shard fills. The twice filter
has 10 bits per report up to its bound; above that more unique lines are
shuffled in vain, with the same result. Per-line groups are aggregated before
the shuffle, so a line in a third of all documents costs a row per task.

Defined cases: a null or empty text is one empty line. A document is an id:
rows that repeat an id count as one document and all keep or lose a line. Null
ids count together as one document, smaller than any other. A text whose lines
all go becomes empty. Keys are compared as bytes, never by hash alone.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import id_key, let, map_columns, raw, skew_join, stored, table, with_columns

MIN_CHARS, MIN_DOCS, PROBES = 20, 3, 4
FILTER_BITS, SEGMENTS, PART_BITS = 1 << 28, 16, 1 << 24
#: Dropped positions up to which the list of drops is sent to every task.
BROADCAST_DROPS = 1_000_000


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> Iterator[tuple[int, bytes]]:
    """(position, key) of the lines whose key is long enough to count."""
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip().lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            yield i, key


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)


class OnceFilter:
    """A Bloom filter that grows by parts of the same size."""

    def __init__(self, bits: int = PART_BITS):
        self.bits, self.parts, self.room = bits, [], 0

    def seen(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each of ``hashes`` (distinct) was in the filter; the new ones are put in."""
        places = _places(hashes, self.bits)
        hit = np.zeros(len(hashes), bool)
        for part in self.parts:
            hit |= part[places].all(axis=1)
        new = np.nonzero(~hit)[0]
        while len(new):
            if not self.room:
                self.parts.append(np.zeros(self.bits, bool))
                self.room = self.bits // 8
            taken, new = new[:self.room], new[self.room:]
            self.parts[-1][places[taken]] = True
            self.room -= len(taken)
        return hit


def line_hashes(documents: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(h, many): hashes of countable lines, once per batch; many: in more documents of it."""
    def run(batches):
        for batch in batches:
            found = [xxhash.xxh64_intdigest(k) for t in batch.column(0).to_pylist()
                     for k in {k for _, k in line_keys(t, min_chars)}]
            h, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)],
                                             names=["h", "many"])

    return documents.select(raw(text_col).alias("t")).mapInArrow(run, "h bigint, many boolean")


def repeats(hashes: DataFrame) -> DataFrame:
    """(h): every hash that occurred twice, and few others; one may be reported more than once."""
    def run(batches):
        once = OnceFilter()
        for batch in batches:
            rows = batch.column(0).to_numpy().view(np.uint64)
            h, first, n = np.unique(rows, return_index=True, return_counts=True)
            many = np.zeros(len(h), bool)
            np.logical_or.at(many, np.searchsorted(h, rows),
                             batch.column(1).to_numpy(zero_copy_only=False))
            again = once.seen(h) | (n > 1) | many
            yield pa.RecordBatch.from_arrays([pa.array(h[again].view(np.int64))], names=["h"])

    return hashes.repartition("h").mapInArrow(run, "h bigint")


def twice_filter(reported: DataFrame, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """Packed bits of the filter over ``reported``, never more than ``filter_bits``."""
    wanted = max(1 << 16, 1 << (10 * reported.count()).bit_length())
    bits = min(filter_bits, wanted) // SEGMENTS

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for s in np.unique(h % np.uint64(SEGMENTS)):
                kept.setdefault(int(s), np.zeros(bits, bool))[
                    _places(h[h % np.uint64(SEGMENTS) == s] // np.uint64(SEGMENTS), bits)] = True
        for s, part in kept.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(part).tobytes()])],
                                             names=["s", "b"])

    parts = (reported.repartition(SEGMENTS, F.pmod("h", F.lit(SEGMENTS)))
             .mapInArrow(run, "s bigint, b binary"))
    packed = np.zeros((SEGMENTS, bits // 8), np.uint8)
    for s, b in parts.toLocalIterator():  # one segment of bounded size at a time
        packed[s] |= np.frombuffer(b, np.uint8)
    return packed


def _holds(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    s = (hashes % np.uint64(SEGMENTS)).astype(np.int64)
    at = _places(hashes // np.uint64(SEGMENTS), packed.shape[1] * 8).astype(np.int64)
    return ((packed[s[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def suspects(documents: DataFrame, id_col: str, text_col: str, packed: np.ndarray,
             min_chars: int) -> DataFrame:
    """(id, th, key, at): the distinct suspected lines of each row and where they stand.

    th, the text's hash, tells rows that repeat an id apart.
    """
    shared = documents.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for batch in batches:
            ids, prints, keys, ats = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where: dict[bytes, list[int]] = {}
                for i, key in line_keys(text, min_chars):
                    where.setdefault(key, []).append(i)
                keys += where
                ats += where.values()
                ids += [doc] * len(where)
                prints += [xxhash.xxh64_intdigest(text, 42)] * len(where)
            h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
            hit = pa.array(_holds(shared.value, h)) if keys else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()).filter(hit),
                 pa.array(np.array(prints, np.uint64).view(np.int64)).filter(hit),
                 pa.array(keys, pa.binary()).filter(hit),
                 pa.array(ats, pa.list_(pa.int32())).filter(hit)], names=["id", "th", "key", "at"])

    return (documents.select(id_key(id_col).alias("id"), raw(text_col).alias("t"))
            .mapInArrow(run, "id bigint, th bigint, key binary, at array<int>"))


def drops(documents: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int,
          filter_bits: int) -> DataFrame:
    """(drop_id, drop_th, at): positions of the lines that each document loses, stored."""
    reported = stored(repeats(line_hashes(documents, text_col, min_chars)), "line-repeats")
    lines = stored(suspects(documents, id_col, text_col, twice_filter(reported, filter_bits),
                            min_chars), "line-suspects")
    common = lines.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"),
                                      F.count("*").alias("rows")).where(F.col("n") >= min_docs)
    common = stored(common.select("key", "keeper", "rows"), "line-common")
    lost = skew_join(lines, common, "key", "rows").where("id != keeper")  # a very common line is no one task's
    return stored(lost.groupBy(F.col("id").alias("drop_id"), F.col("th").alias("drop_th"))
                  .agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")), "line-drops")


def _without(text: Column, at: Column) -> Column:
    keep = F.array_except(F.sequence(F.lit(0), F.size(F.split(text, "\n")) - 1), at)
    return let(F.split(text, "\n"), lambda lines: F.array_join(
        F.transform(keep, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                filter_bits: int = FILTER_BITS) -> DataFrame:
    """``documents`` with shortened texts, and n_lines (before) and n_dropped.

    Columns of the input with these two names are replaced.
    """
    lost = drops(documents, id_col, text_col, min_chars, min_docs, filter_bits)
    size = lost.agg(F.count("*") + F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    side = F.broadcast(lost) if size <= BROADCAST_DROPS else lost
    text = F.coalesce(F.col("text"), F.lit(""))
    held = documents.select(F.struct("*").alias("row"), id_key(id_col).alias("id"),
                            F.col(text_col).alias("text"))
    joined = held.join(side, (F.col("id") == F.col("drop_id"))
                       & (F.xxhash64(raw("text")) == F.col("drop_th")), "left")
    n_lines = F.size(F.split(text, "\n")).cast("bigint")
    out = joined.select(
        "row", n_lines.alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("at").isNull(), text).otherwise(_without(text, F.col("at"))).alias("text"))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                        for c in documents.columns if c not in ("n_lines", "n_dropped")],
                      "n_lines", "n_dropped")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
    SELECT doc_id, n, len(all_lines) AS total, i, all_lines[i] AS line,
           translate(trim(all_lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, row_number() OVER () AS n,
                 string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents) t,
         LATERAL (SELECT unnest(range(1, len(all_lines) + 1)) AS i) u),
common AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, CAST(any_value(total) AS BIGINT) AS n_lines,
       count(*) FILTER (c.key IS NOT NULL AND l.doc_id <> c.keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
                       FILTER (c.key IS NULL OR l.doc_id = c.keeper), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.key = c.key GROUP BY l.n, l.doc_id
"""
