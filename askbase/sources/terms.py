"""An inverted index kept as tables: postings, terms and the corpus's totals.

A text is tokenised once, when the index is built. Postings (term, id, tf, and the
document's length and norm) lie in folders by the term's hash; the postings of very
frequent terms are dealt to ``salts`` parts by id, so that no task has to take all
of a term's. A search takes the postings of its terms and deals them by document, the
queries' weights by query: in each cell of this grid the products are summed in
matrices and the best of each query kept, so a (query, document) pair is never a row.
A small grid is a cogroup of repeated rows. Of a large one both sides are packed and
shuffled once, and the cells are a product of their partitions. Texts are not touched again.
"""

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as rules, vocab
from ..functions.best import first_of_each, objects
from ..functions.sizing import broadcast_if, discard, give_back, shared_dir, stored

BUCKETS, SALTS = 16, 32
#: A term is heavy if it has more than this share of all postings: fewer than 1,000 terms are.
HEAVY_SHARE = 0.001
#: Rows (query, term, weight) up to which they are sent to every task.
SENT_WEIGHTS = 500_000
#: Characters of text a task of the build takes, postings a task writes, and those it makes at once.
PART_CHARS, PART_POSTINGS, BATCH_POSTINGS = 8_000_000, 250_000, 200_000
#: Postings and query weights of a cell, on average; below the first size of weights more cells are not worth it.
CELL_POSTINGS, CELL_WEIGHTS = 500_000, (20_000, 500_000)
#: Rows repeated for a grid up to which its cells are made by repeating rows; tasks of a larger grid for each core.
GRID_ROWS, TASKS_A_CORE = 5_000_000, 4
#: Scores held at once; terms in more than one of so many documents of a cell are summed as a dense matrix.
_SCORES, _DENSE = 2_000_000, 32


def _raw_idf(df, n_docs) -> Column:
    return F.ln(n_docs - df + 0.5) - F.ln(df + 0.5)


def _count_terms(texts: DataFrame) -> DataFrame:
    """(id, dl, norm, term, tf) from texts (id, low) sorted by id, with all rows of an id in one partition.

    Rows that share an id add up where they are equally long; the norm is that of all of them.
    """
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        find = re.compile("[a-z0-9]+").findall
        keys, lengths, sizes, docs, terms, times = [], [], [], [], [], []
        last, own = None, {}

        def close():
            docs.append(sum(map(len, own.values())))
            for dl, counts in own.items():
                keys.append(last)
                lengths.append(dl)
                sizes.append(len(counts))
                terms.extend(counts)
                times.extend(counts.values())
            own.clear()

        def made(id_type):
            tf = np.array(times, np.int64)
            starts = np.cumsum(docs) - docs
            norm = np.sqrt(np.add.reduceat((1 + np.log(tf)) ** 2, starts))
            each = np.repeat(np.arange(len(keys)), sizes)
            out = pa.RecordBatch.from_arrays(
                [pa.array(keys, id_type).take(pa.array(each)), pa.array(np.array(lengths, np.int64)[each]),
                 pa.array(np.repeat(norm, docs)), pa.array(terms, pa.string()), pa.array(tf)],
                names=["id", "dl", "norm", "term", "tf"])
            for held in (keys, lengths, sizes, docs, terms, times):
                held.clear()
            return out

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for key, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own and key != last:
                    close()
                    if len(terms) >= BATCH_POSTINGS:
                        yield made(id_type)
                last, words = key, find(low or "")
                if words:
                    own.setdefault(len(words), Counter()).update(words)
        if own:
            close()
        if terms:
            yield made(id_type)

    return texts.select("id", "low").mapInArrow(run, f"id {kind}, dl bigint, norm double, term string, tf bigint")


def build_index(corpus: DataFrame, path: str, id_col: str = "chunk_id", text: str = "text",
                buckets: int = BUCKETS, salts: int = SALTS, heavy_share: float = HEAVY_SHARE) -> "TermIndex":
    """Write the index of ``corpus`` (one row per id) under ``path`` and open it."""
    spark = corpus.sparkSession
    texts = corpus.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    n_docs, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    # dealt by id once: counting a text's terms and its norm need no further shuffle
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    texts = texts.select("id", F.lower("text").alias("low")).repartition(parts, "id").sortWithinPartitions("id")
    raw = stored(_count_terms(texts), "postings")
    terms = stored(raw.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf_total")), "terms")
    mean = F.avg(_raw_idf(F.col("df"), F.lit(float(n_docs))))
    totals = terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_postings"),
                       (F.coalesce(F.sum("tf_total"), F.lit(0)) / F.lit(float(max(n_docs, 1)))).alias("mean_length"),
                       F.coalesce(mean, F.lit(0.0)).alias("mean_idf")).withColumns(
        {"n_docs": F.lit(n_docs), "id_type": F.lit(corpus.schema[id_col].dataType.simpleString())})
    totals.write.parquet(f"{path}/totals")
    n_postings = spark.read.parquet(f"{path}/totals").first().n_postings
    limit = heavy_share * n_postings
    weighed = terms.withColumn("salts", F.when(F.col("df") > limit, F.lit(salts)).otherwise(F.lit(1)))
    weighed.write.parquet(f"{path}/terms")
    often = F.broadcast(weighed.where("salts > 1").select("term", "salts"))  # fewer than 1 / heavy_share terms
    salt = F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")
    # a bucket of a large index is written by many tasks
    slices = -(-n_postings // (buckets * PART_POSTINGS)) or 1
    slice_of = F.pmod(F.hash("id"), F.lit(slices))
    (raw.join(often, "term", "left").select("term", salt.alias("salt"), "id", "tf", "dl", "norm",
                                            F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
     .repartition(-(-n_postings // PART_POSTINGS) or 1, "bucket", "salt", slice_of).sortWithinPartitions("bucket", "term")
     .write.partitionBy("bucket").parquet(f"{path}/postings"))
    discard(raw, terms)
    give_back(spark)
    return TermIndex(spark, path)


def temporary_index(corpus: DataFrame, id_col: str = "chunk_id", text: str = "text", **how) -> "TermIndex":
    """An index in the shared folder, for a corpus that is searched without a store."""
    return build_index(corpus, shared_dir(corpus.sparkSession, "term-index"), id_col, text, **how)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers of a column's distinct values, and the values; null is one."""
    coded = pc.dictionary_encode(pa.concat_arrays(column.chunks), null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _spread(acc: np.ndarray, row: np.ndarray, w: np.ndarray, start: np.ndarray, length: np.ndarray,
            doc: np.ndarray, v: np.ndarray) -> None:
    """Add each weight times its term's postings to its row; a bounded number of products at once."""
    ends = np.cumsum(length)
    at = 0
    while at < len(ends):
        before = ends[at] - length[at]
        to = max(at + 1, int(np.searchsorted(ends, before + 2 * _SCORES)))
        n = length[at:to]
        place = np.arange(ends[to - 1] - before) + np.repeat(start[at:to] - (ends[at:to] - n - before), n)
        cell = np.repeat(row[at:to] * acc.shape[1], n) + doc[place]
        acc += np.bincount(cell, np.repeat(w[at:to], n) * v[place], acc.size).reshape(acc.shape)
        at = to


def _least(acc: np.ndarray, n: int) -> np.ndarray:
    """A score that at least ``n`` documents of each row reach, from the maxima of groups of columns."""
    groups, width = 4 * n, acc.shape[1] // (4 * n)
    least = np.full(len(acc), np.nextafter(0, 1))
    if width > 1:
        tops = acc[:, :groups * width].reshape(len(acc), groups, width).max(axis=2)
        least = np.maximum(least, np.partition(tops, groups - n, axis=1)[:, groups - n] - 1e-8)
    return least[:, None]


def _cell_search(n: int, id_type: str) -> tuple[Callable, str]:
    """The ``n`` best documents of a cell for each of its queries: a function of postings and weights, its schema."""
    names = ["query_id", "id", "score"]

    def search(postings: pa.Table, weights: pa.Table) -> pa.Table:
        none = pa.table([pa.array([], pa.string()), pa.array([], postings.schema.field("id").type),
                         pa.array([], pa.float64())], names=names)
        if not postings.num_rows or not weights.num_rows:
            return none
        weights = weights.sort_by("query_id")
        query, queries = _coded(weights["query_id"])
        asked, terms = _coded(weights["term"])
        w = weights["w"].to_numpy()
        found = pc.index_in(postings["term"], value_set=terms)
        postings = postings.filter(pc.is_valid(found))
        if not postings.num_rows:
            return none
        term = found.drop_null().to_numpy().astype(np.int64)
        order = np.argsort(term, kind="stable")
        doc, ids = _coded(postings["id"])
        doc, v, term = doc[order], postings["v"].to_numpy()[order], term[order]
        start = np.searchsorted(term, np.arange(len(terms) + 1))
        length = np.diff(start)
        listed = ids.to_pylist()
        by_id = np.empty(len(ids), dtype=np.int64)
        by_id[sorted(range(len(ids)), key=lambda i: (listed[i] is not None, listed[i]))] = np.arange(len(ids))
        dense = length * _DENSE >= len(ids)
        slot = np.cumsum(dense) - 1
        often = dense[term]
        matrix = np.bincount(slot[term[often]] * len(ids) + doc[often], v[often],
                             int(dense.sum()) * len(ids)).reshape(-1, len(ids))
        step = max(1, _SCORES // len(ids))
        out = []
        for first in range(0, len(queries), step):
            rows = min(step, len(queries) - first)
            a, b = np.searchsorted(query, [first, first + rows])
            row, t, value = query[a:b] - first, asked[a:b], w[a:b]
            often = dense[t]
            factor = np.zeros((rows, len(matrix)))
            factor[row[often], slot[t[often]]] = value[often]
            acc = factor @ matrix
            rare = t[~often]
            _spread(acc, row[~often], value[~often], start[rare], length[rare], doc, v)
            q, d = np.nonzero(acc >= _least(acc, n))
            score = acc[q, d]
            order = np.lexsort((by_id[d], -np.round(score, 9), q))
            q = q[order]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < n
            out.append((q[kept] + first, d[order][kept], score[order][kept]))
        q, d, score = (np.concatenate(x) for x in zip(*out))
        return pa.table([queries.take(pa.array(q)), ids.take(pa.array(d)), pa.array(score)], names=names)

    return search, f"query_id string, id {id_type}, score double"


def _bytes(table: pa.Table) -> pa.Scalar:
    """A table as one value; repeated strings are kept once."""
    table = table.combine_chunks()
    for i, field in enumerate(table.schema):
        if pa.types.is_string(field.type):
            table = table.set_column(i, field.name, table.column(i).dictionary_encode())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return pa.scalar(sink.getvalue().to_pybytes(), pa.binary())


def _table(data: pa.Scalar) -> pa.Table:
    table = pa.ipc.open_stream(data.as_buffer()).read_all()
    return table.cast(pa.schema([pa.field(f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type)
                                 for f in table.schema]))


def _packed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of each ``key`` as one row (key, data)."""
    def pack(table: pa.Table) -> pa.Table:
        return pa.table({key: table[key][:1], "data": pa.array([_bytes(table.select(columns)).as_py()], pa.binary())})

    return rows.select(key, *columns).groupBy(key).applyInArrow(pack, f"{key} int, data binary")


def _product_search(search: Callable, n: int) -> Callable:
    """``search`` for rows (down, weights, across, postings): the best ``n`` over all cells of a task."""
    def run(batches):
        weights: dict[int, pa.Table] = {}
        found: dict[int, pa.Table] = {}
        last, postings = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                down, across = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if across != last:
                    last, postings = across, _table(batch.column(3)[i])
                if down not in weights:
                    weights[down] = _table(batch.column(1)[i])
                hits = search(postings, weights[down])
                if down in found:
                    hits = pa.concat_tables([found[down], hits])
                    query = _coded(hits["query_id"])[0]
                    key = -np.round(hits["score"].to_numpy(), 9)
                    hits = hits.take(pa.array(first_of_each(query, key, objects(hits["id"].to_pylist()), n)))
                found[down] = hits
        for hits in found.values():
            yield from hits.to_batches()

    return run


class TermIndex:
    """The tables of an index, and top-n search on them."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self.totals = spark.read.parquet(f"{path}/totals").first()
        self.terms = spark.read.parquet(f"{path}/terms")
        self.postings = spark.read.schema(f"term string, salt int, id {self.totals.id_type}, tf bigint, dl bigint, "
                                          "norm double, bucket int").parquet(f"{path}/postings")

    def term_stats(self) -> DataFrame:
        """Document frequency, total frequency and BM25 idf of every term."""
        return self.terms.select("term", "df", "tf_total", self._idf().alias("idf"))

    def _idf(self) -> Column:
        """A negative idf becomes a quarter of the vocabulary's mean idf."""
        raw = _raw_idf(F.col("df"), F.lit(float(self.totals.n_docs)))
        return F.when(raw < 0, F.lit(self.totals.mean_idf * vocab.BM25_EPSILON)).otherwise(raw)

    def _asked(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, times) with the terms' counts, for terms that the corpus has."""
        asked = queries.select(F.col("query_id").cast("string"), F.explode(rules.tokens("text")).alias("term"))
        return asked.groupBy("query_id", "term").agg(F.count("*").alias("times")).join(self.terms, "term")

    def _top(self, weights: DataFrame, value: Column, n: int, id_col: str, score_type: str,
             sent: int) -> DataFrame:
        """The ``n`` best of each query; weights (query_id, term, salts, w), ``value`` a posting's share."""
        weights = stored(weights.select("query_id", "term", "salts", "df", "w"), "query-weights")
        rows = weights.count()
        terms = stored(weights.select("term", "salts", "df").distinct(), "asked-terms")
        n_terms, n_postings = terms.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        if n_terms <= sent:
            postings = self.postings.join(broadcast_if(terms.select("term"), n_terms, sent), "term", "left_semi")
        else:  # a heavy term meets each part of its postings
            each = terms.select("term", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            postings = self.postings.join(each, ["term", "salt"], "left_semi")
        # a grid of cells that a task can hold, and enough of them for all cores where the weights are many
        spark = postings.sparkSession
        few, many = CELL_WEIGHTS
        cores = spark.sparkContext.defaultParallelism
        across = -(-n_postings // CELL_POSTINGS) or 1
        wanted = -(-4 * cores // across)
        down = max(-(-rows // many), min(wanted, -(-rows // few))) or 1
        large = n_postings * (down - 1) + rows * (across - 1) > GRID_ROWS
        if large:
            down = max(-(-rows // many), min(TASKS_A_CORE * cores, -(-rows // few)))
        every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
        postings = postings.select("id", "term", value.alias("v"), *[] if large else [every(down).alias("down")],
                                   F.pmod(F.xxhash64("id"), F.lit(across)).cast("int").alias("across"))
        weights = weights.select("query_id", "term", "w", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int")
                                 .alias("down"), *[] if large else [every(across).alias("across")])
        search, schema = _cell_search(n, self.totals.id_type)
        if large:  # a task has one part of the queries, and as many postings as leaves no core without a task
            parts = min(across, -(-TASKS_A_CORE * cores // down))
            postings = _packed(postings, "across", ["id", "term", "v"]).withColumnRenamed("data", "postings")
            weights = _packed(weights, "down", ["query_id", "term", "w"]).withColumnRenamed("data", "weights")
            postings = postings.repartitionById(parts, F.pmod("across", F.lit(parts)))
            weights = weights.repartitionById(down, F.col("down"))
            cells = postings.hint("shuffle_replicate_nl").join(weights).select("down", "weights", "across", "postings")
            hits = cells.mapInArrow(_product_search(search, n), schema)
        else:
            tasks = 2 * across * down  # a task holds few cells, however many there are
            postings, weights = (side.repartition(tasks, "down", "across") for side in (postings, weights))
            cells = postings.groupBy("down", "across").cogroup(weights.groupBy("down", "across"))
            hits = cells.applyInArrow(search, schema)
        order = Window.partitionBy("query_id").orderBy("order_key", "id")
        return (hits.withColumn("order_key", -F.round("score", 9))
                .withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= n)
                .select("query_id", F.col("id").alias(id_col), "rank", "score", F.lit(score_type).alias("score_type")))

    def bm25(self, queries: DataFrame, n: int = vocab.POOL_SIZE, id_col: str = "chunk_id",
             sent: int = SENT_WEIGHTS) -> DataFrame:
        """BM25 top ``n`` with positive score for queries (query_id, text)."""
        weights = self._asked(queries).withColumn("w", F.col("times") * self._idf())
        k1, b = vocab.BM25_K1, vocab.BM25_B
        base = k1 * (1 - b + b * F.col("dl") / F.lit(self.totals.mean_length or 1.0))
        value = F.col("tf") * (k1 + 1) / (F.col("tf") + base)
        return self._top(weights, value, n, id_col, "bm25", sent)

    def tfidf_cosine(self, queries: DataFrame, n: int = vocab.POOL_SIZE, id_col: str = "chunk_id",
                     sent: int = SENT_WEIGHTS) -> DataFrame:
        """Sparse cosine: log-tf documents, log-tf times idf queries, both unit length."""
        weight = (1 + F.ln("times")) * F.ln(F.lit(float(self.totals.n_docs)) / F.col("df"))
        asked = self._asked(queries).withColumn("w", weight).where("w <> 0")
        size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
        value = (1 + F.ln("tf")) / F.col("norm")
        return self._top(asked.withColumn("w", F.col("w") / size), value, n, id_col, "tfidf", sent)
