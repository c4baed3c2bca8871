"""Benchmark passages in documents, found with Wu-Manber multi-pattern search.

The alphabet is words. A benchmark item's patterns are its windows of
``window`` consecutive words (an item with fewer words is one pattern); patterns
of one length share tables. For that length m and blocks of two words (one
where m is 1) the shift table says how far the search may move on when a block
ends at the current position: m - block + 1 for a block in no pattern, less for
one that stands nearer a pattern's end, 0 at an end. A word in no pattern at
all allows m. Blocks with shift 0 select a bucket by the pattern's suffix, its
first word narrows the bucket, and direct comparison of all m words confirms.

Documents are read once, in place: nothing of them is shuffled. The patterns
are sent to every task in blocks of about ``block_words`` benchmark words; a
larger benchmark becomes several blocks, searched one after another over the
same row.

Defined cases: a null or wordless text has no words and is not contaminated; a
null or wordless item has no pattern. Repeated items, and items with the same
id, count once. An item without an id is searched for and counted under the
empty id. Repeated documents each get their row.
"""

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm.common import map_columns, raw, table, with_columns

WINDOW, BLOCK_WORDS = 13, 500_000
#: Word characters: digits, letters and everything beyond ASCII; A-Z become a-z.
_WORDS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else
               c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class WuManber:
    """Occurrences of word sequences of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.size = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.far = m - b + 1
        self.vocabulary = {w for p in patterns for w in p}
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list]] = defaultdict(lambda: defaultdict(list))
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                block = pattern[end - b:end]
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
            self.buckets[pattern[-b:]][pattern[0]].append((pattern, items))
        self.buckets = {block: dict(heads) for block, heads in self.buckets.items()}

    def search(self, words: list[bytes]) -> Iterable[tuple[int, list[str]]]:
        """(start, item ids) of every occurrence."""
        m, b, far = self.size, self.block, self.far
        known, shift, buckets = self.vocabulary, self.shift, self.buckets
        at, n = m, len(words)  # at: the end of the window under the search
        while at <= n:
            if words[at - 1] not in known:
                at += m
                continue
            block = tuple(words[at - b:at])
            step = shift.get(block, far)
            if step:
                at += step
                continue
            start = at - m
            for pattern, items in buckets[block].get(words[start], ()):
                if tuple(words[start:at]) == pattern:
                    yield start, items
            at += 1


def tables_of(items: Iterable[tuple[str, bytes]], window: int = WINDOW) -> list[WuManber]:
    by_size: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(dict)
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            owners = by_size[size].setdefault(tuple(words[i:i + size]), [])
            if item not in owners:
                owners.append(item)
    return [WuManber(patterns) for patterns in by_size.values()]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlap that cover the same words."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int):
    """The benchmark's (id, text) pairs in blocks of bounded size, never all at once."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"),
                            raw(text_col).alias("t")).where(F.length("t") > 0)
    held, size = [], 0
    for item, text in rows.toLocalIterator():
        held.append((item, bytes(text)))
        size += text.count(b" ") + 1
        if size >= block_words:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_contamination(documents: DataFrame, benchmark: DataFrame, text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``documents`` with n_words, spans (start, end of hit words) and items (ids, sorted).

    Columns of the input with these names are replaced.
    """
    spark = documents.sparkSession
    out = with_columns(documents, {"n_words": F.lit(None).cast("bigint"),
                                   "spans": F.array().cast("array<struct<start:int,end:int>>"),
                                   "items": F.array().cast("array<string>")})

    def searcher(shared):
        def fn(columns):
            n_words, spans, items = [], [], []
            for text, before, found in zip(*(c.to_pylist() for c in columns)):
                words = words_of(text)
                hits, ids = [(s["start"], s["end"]) for s in before], set(found)
                for tables in shared.value if shared else ():
                    for start, owners in tables.search(words):
                        hits.append((start, start + tables.size))
                        ids.update(owners)
                n_words.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in merged(hits)])
                items.append(sorted(ids))
            return [pa.array(n_words, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(items, pa.list_(pa.string()))]
        return fn

    shares = [spark.sparkContext.broadcast(tables_of(block, window))
              for block in _blocks(benchmark, item_col, item_text_col, block_words)]
    for shared in shares or [None]:
        out = map_columns(out, {"t": raw(text_col), "spans": F.col("spans"), "items": F.col("items")},
                          "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>",
                          searcher(shared))
    return out


def judged(found: DataFrame) -> DataFrame:
    """n_hit, n_items and contaminated (a twentieth of the words or more) beside the spans."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    found = with_columns(found, {"n_hit": n_hit, "n_items": F.size("items").cast("bigint")})
    return with_columns(found, {"contaminated": F.expr("n_hit > 0 AND 20 * n_hit >= n_words")})


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(find_contamination(documents, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        "contaminated")


SQL = r"""
WITH doc AS (
    SELECT n, doc_id, regexp_extract_all(lowered, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT row_number() OVER () AS n, doc_id,
                 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents) a),
item AS (
    SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pattern AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS size,
           array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
    FROM item, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) u
    WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM pattern),
windows AS (
    SELECT n, i, size, array_to_string(w[i:i + size - 1], ' ') AS p
    FROM doc, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) u),
found AS (SELECT n, i, size, item_id FROM windows JOIN pattern USING (size, p)),
hit AS (SELECT n, count(DISTINCT k) AS n_hit
        FROM found, LATERAL (SELECT unnest(range(i, i + size)) AS k) u GROUP BY n),
ids AS (SELECT n, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS all_ids
        FROM (SELECT DISTINCT n, item_id FROM found) d GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(all_ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (n) LEFT JOIN ids USING (n)
"""
