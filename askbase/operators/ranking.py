"""Exact top-n search: vectors, BM25 and sparse cosine.

Vectors are scored with numpy in blocks of queries and parts of the corpus; a task
keeps the best ``n`` of each of its queries, so what is shuffled is at most
groups of the corpus x queries x n rows. Term search runs on an inverted index.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vocab
from ..functions.best import first_of_each, objects
from ..functions.sizing import stored
from ..sources.terms import TermIndex, temporary_index

QUERY_BLOCK, PART_ROWS, SALTS = 4096, 4096, 16
#: Tasks that pack queries, so that few of them do not become as many blocks; blocks that a search task takes, about.
QUERY_TASKS, HELD_BLOCKS = 64, 8
#: Search tasks for each core, so that a task of larger blocks is not waited for.
TASKS_A_CORE = 4
_CELLS = 2_000_000
#: Rows that may be among a block's best, held before they are sorted.
HELD_ROWS = 200_000
#: Places go by scores rounded to nine digits.
MARGIN = 2e-9
#: Relative error of a 32-bit number with room, and the largest length of a vector that is screened in 32 bits.
_UNIT, _SCREENED = 1.2e-7, 1e15


class _Best:
    """The best ``n`` of each query among the rows one task has seen."""

    def __init__(self, n_queries: int, n: int):
        self.n = n
        self.limit = np.full(n_queries, np.inf)
        self.query = np.empty(0, dtype=np.int64)
        self.key = np.empty(0)
        self.score = np.empty(0)
        self.id = np.empty(0, dtype=object)
        self.held: list[tuple] = []
        self.n_held = 0

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        """``score`` is rows x queries, smaller is better. What may be among the best is held until there is much of it."""
        if len(score) > self.n and np.isinf(self.limit).any():
            self.limit = np.fmin(self.limit, np.partition(score, self.n - 1, axis=0)[self.n - 1])
        row, query = np.nonzero(score <= self.limit + MARGIN)
        self.hold(query, score[row, query], ids[row])

    def hold(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((query, score, ids))
        self.n_held += len(query)
        if self.n_held > max(HELD_ROWS, self.n * len(self.limit)):
            self.settle()

    def settle(self) -> None:
        query, score, ids = (np.concatenate(x) for x in zip((self.query, self.score, self.id), *self.held))
        self.held, self.n_held = [], 0
        key = np.round(score, 9)
        order = first_of_each(query, key, ids, self.n)
        self.query, self.key, self.score, self.id = query[order], key[order], score[order], ids[order]
        full = np.bincount(self.query, minlength=len(self.limit)) == self.n
        worst = np.full(len(self.limit), -np.inf)
        np.maximum.at(worst, self.query, self.key)
        self.limit = np.fmin(self.limit, np.where(full, worst, np.inf))

    def batch(self, query_ids: list, id_type: pa.DataType) -> pa.RecordBatch:
        self.settle()
        names = pa.array([query_ids[q] for q in self.query], pa.string())
        return pa.RecordBatch.from_arrays(
            [names, pa.array(list(self.id), id_type), pa.array(self.score, pa.float64()),
             pa.array(self.key, pa.float64())],
            names=["query_id", "id", "score", "order_key"])


def _top(hits: DataFrame, n: int, id_col: str, score_type: str, parts: int) -> DataFrame:
    """The best ``n`` of each query; where many parts of the corpus have hits, first among its rows of one salt."""
    ranked = hits.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for by in [["query_id", "salt"]] * (parts > SALTS) + [["query_id"]]:
        order = Window.partitionBy(*by).orderBy("order_key", "id")
        ranked = ranked.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= n)
    return ranked.select("query_id", F.col("id").alias(id_col), "rank", "score", F.lit(score_type).alias("score_type"))


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    dot = x @ q.T
    if metric == "cosine":
        size = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :]
        return 1.0 - np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
    sizes = (x * x).sum(axis=1)[:, None] + (q * q).sum(axis=1)[None, :]
    squared = sizes - 2 * dot
    row, query = np.nonzero(squared < 1e-3 * sizes)  # too near for the difference of large numbers
    squared[row, query] = ((x[row] - q[query]) ** 2).sum(axis=1)
    return np.sqrt(squared) if metric == "l2" else squared


class _Block:
    """Vectors of queries, and which rows of the corpus can be among the best of each.

    In 32 bits a product of many vectors takes half the time. It is off by no more than a bound,
    so rows whose product is worse than the limit by more than that are left out; the others' distances are
    computed in 64 bits.
    """

    def __init__(self, q: np.ndarray, metric: str, n: int):
        self.q, self.metric, self.n = q, metric, n
        self.size = np.linalg.norm(q, axis=1)
        scale = np.where(self.size > 0, self.size, 1)[:, None]
        self.short = np.ascontiguousarray((q / scale if metric == "cosine" else np.hstack(
            [q, np.ones((len(q), 1))])).astype(np.float32).T)

    def _side(self, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray | float]:
        """The rows in 32 bits, and how far a product with each query may be off."""
        off = (x.shape[1] + 10) * _UNIT
        if self.metric == "cosine":
            return (x / np.where(size > 0, size, 1)[:, None]).astype(np.float32), off
        half = size * size / 2
        return (np.hstack([x, -half[:, None]]).astype(np.float32),
                off * (size.max() * self.size + half.max()) + 1e-30)

    def _product(self, distance: np.ndarray) -> np.ndarray:
        """The product that a row at this distance has with each query."""
        if self.metric == "cosine":
            return 1.0 - distance
        return (self.size ** 2 - (distance ** 2 if self.metric == "l2" else distance)) / 2

    def _distance(self, product: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return 1.0 - product
        squared = np.maximum(self.size ** 2 - 2 * product, 0)
        return np.sqrt(squared) if self.metric == "l2" else squared

    def meet(self, x: np.ndarray, ids: np.ndarray, best: _Best) -> None:
        """Offer the rows of ``x`` that may be among the best."""
        step = max(1, _CELLS // len(self.q))
        size = np.linalg.norm(x, axis=1)
        both = np.concatenate([size, self.size])
        fits = ((both == 0) | (both > 1 / _SCREENED) & (both < _SCREENED)).all()  # not where a number is none
        if not fits or len(x) < 8 * self.n and np.isinf(best.limit).any():
            for at in range(0, len(x), step):
                best.offer(_distances(x[at:at + step], self.q, self.metric), ids[at:at + step])
            return
        short, off = self._side(x, size)
        if np.isinf(best.limit).any():  # the n-th of the maxima of groups of rows is no better than the n-th row
            group = min(step, len(x) // (4 * self.n))
            tops = np.stack([(short[at:at + group] @ self.short).max(axis=0) for at in range(0, len(x), group)])
            tops = np.partition(tops, len(tops) - self.n, axis=0)[len(tops) - self.n].astype(np.float64)
            best.limit = np.fmin(best.limit, self._distance(tops - off))
        least = (self._product(best.limit + MARGIN) - off).astype(np.float32)
        least = np.nextafter(least, np.float32(-np.inf))
        some = max(1, _CELLS // x.shape[1])
        for at in range(0, len(x), step):
            rows, queries = np.divmod(np.flatnonzero(short[at:at + step] @ self.short >= least), len(self.q))
            for a in range(0, len(rows), some):
                row, query = rows[a:a + some] + at, queries[a:a + some]
                score = self._pairs(x[row], size[row], query)
                kept = score <= best.limit[query] + MARGIN
                best.hold(query[kept], score[kept], ids[row[kept]])

    def _pairs(self, x: np.ndarray, size: np.ndarray, query: np.ndarray) -> np.ndarray:
        """The distance of each row of ``x`` to its query."""
        q = self.q[query]
        if self.metric == "cosine":
            size = size * self.size[query]
            dot = np.einsum("ij,ij->i", x, q)
            return 1.0 - np.divide(dot, size, out=np.zeros_like(dot), where=size > 0)
        squared = ((x - q) ** 2).sum(axis=1)
        return np.sqrt(squared) if self.metric == "l2" else squared


def _packed(batches, size: int):
    """Rows (id, vector) as rows of many: ids, their number, the vectors' numbers as bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            ids, vectors = (batch.column(i).slice(at, size) for i in range(2))
            lengths = np.diff(np.asarray(vectors.offsets))
            flat = vectors.flatten()
            flat = flat.to_numpy(zero_copy_only=False).astype(np.float32 if flat.type == pa.float32() else np.float64)
            ragged = len(flat) != len(ids) * lengths[0] or (lengths != lengths[0]).any()
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([-1 if ragged else int(lengths[0])], pa.int64()),
                 pa.array([flat.dtype.itemsize], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
                names=["ids", "width", "bytes", "x"])


def _pack(rows: DataFrame, size: int) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "vector").mapInArrow(lambda batches: _packed(batches, size),
                                                  f"ids array<{kind}>, width bigint, bytes bigint, x binary")


def _vectors(data: bytes, size: int, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"f{size}")).reshape(rows, -1).astype(np.float64)


def knn(corpus: DataFrame, queries: DataFrame, n: int = vocab.POOL_SIZE,
        metric: str = "cosine", id_col: str = "chunk_id", vector: str = "embedding",
        block: int = QUERY_BLOCK, part: int = PART_ROWS) -> DataFrame:
    """Exact nearest neighbours; ``score`` is the distance, smaller is nearer.

    ``queries`` has ``query_id`` and ``vector``; ``metric`` is cosine, l2 or
    l2_sq. Filter ``corpus`` before the call to search a part of it.

    Queries and corpus are packed into rows of many vectors, the queries in numbered
    blocks. One block is sent to the corpus, which stays where it is. Of more, each task takes some
    with a group of the corpus, as a product of partitions: both sides are shuffled once, packed, however
    many blocks there are, and many queries need one group only. Nothing passes through the driver.
    """
    if metric not in ("cosine", "l2", "l2_sq"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = corpus.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).filter(F.col(vector).isNotNull())
    asked = queries.select(F.col("query_id").cast("string").alias("id"), F.col(vector).alias("vector"))
    asked = stored(_pack(asked.filter(F.col("vector").isNotNull()).coalesce(QUERY_TASKS), block)
                   .withColumn("mark", F.monotonically_increasing_id()), "query-blocks")
    # a mark is a task's number and, in the last 33 bits, a block's number in it
    blocks, takers = asked.agg(F.count("*"), F.max(F.shiftright("mark", 33)) + 1).first()
    if not blocks:
        raise ValueError("no query vectors")
    asked = asked.select("mark", F.col("ids").alias("query_ids"), F.col("width").alias("query_width"),
                         F.col("bytes").alias("q_bytes"), F.col("x").alias("q"))
    parts = _pack(rows, part)
    if blocks == 1:
        groups, pairs = SALTS + 1, parts.join(F.broadcast(asked))
    else:
        tasks = TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism
        slots = min(blocks, max(tasks, -(-blocks // HELD_BLOCKS)))
        groups = max(1, tasks // slots)
        number = F.col("mark").bitwiseAND(F.lit((1 << 33) - 1)) * takers + F.shiftright("mark", 33)
        asked = asked.repartitionById(slots, F.pmod(number, F.lit(slots)).cast("int"))
        parts = parts.repartitionById(groups, F.pmod(F.xxhash64("x"), F.lit(groups)).cast("int"))
        pairs = parts.hint("shuffle_replicate_nl").join(asked)
    pairs = pairs.select("mark", "query_ids", "query_width", "q_bytes", "q", "ids", "width", "bytes", "x")

    def score(batches):
        blocks: dict[int, tuple] = {}
        id_type = None
        for batch in batches:
            for i in range(batch.num_rows):
                number, width, size = (batch.column(c)[i].as_py() for c in (0, 6, 7))
                if number not in blocks:
                    names, q_width, q_size = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                    q = _vectors(batch.column(4)[i].as_py(), q_size, len(names))
                    blocks[number] = names, q_width, _Block(q, metric, n), _Best(len(names), n)
                names, q_width, asked, best = blocks[number]
                if width != q_width or width < 0:
                    raise ValueError(f"vectors need {q_width} numbers, as the queries have")
                values = batch.column(5)[i].values
                ids, id_type = objects(values.to_pylist()), values.type
                asked.meet(_vectors(batch.column(8)[i].as_py(), size, len(ids)), ids, best)
        for names, _, _, best in blocks.values():
            yield best.batch(names, id_type)

    return _top(pairs.mapInArrow(score, _hit_schema(corpus, id_col)), n, id_col, "distance", groups)


def _hit_schema(corpus: DataFrame, id_col: str) -> str:
    return f"query_id string, id {corpus.schema[id_col].dataType.simpleString()}, " \
           "score double, order_key double"


def term_stats(corpus: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Document frequency, total frequency and BM25 idf of every term."""
    return temporary_index(corpus, id_col, text).term_stats()


def bm25(corpus: DataFrame | TermIndex, queries: DataFrame, n: int = vocab.POOL_SIZE,
         id_col: str = "chunk_id", text: str = "text") -> DataFrame:
    """BM25 top ``n`` with positive score; statistics come from ``corpus`` as given.

    A corpus that is searched more than once should come as its index.
    """
    index = corpus if isinstance(corpus, TermIndex) else temporary_index(corpus, id_col, text)
    return index.bm25(queries, n, id_col)


def tfidf_cosine(corpus: DataFrame | TermIndex, queries: DataFrame, n: int = vocab.POOL_SIZE,
                 id_col: str = "chunk_id", text: str = "text") -> DataFrame:
    """Sparse cosine: log-tf documents, log-tf times idf queries, both unit length."""
    index = corpus if isinstance(corpus, TermIndex) else temporary_index(corpus, id_col, text)
    return index.tfidf_cosine(queries, n, id_col)
