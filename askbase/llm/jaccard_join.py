"""Similarity join of documents on the Jaccard similarity of their word n-grams, by PartEnum signatures.

A document's set is its distinct word shingles as 64-bit hashes. Sets are put in
bands of nearly equal size: the sizes from l to l / similarity. Similar sets lie
in one band or in two next to each other, and differ in at most
k = (a + b)(1 - s) / (1 + s) elements, a and b being the largest sizes there. For
each such pair of bands the feature domain (all 64-bit values) is cut into parts,
so many that one part holds at most ``ERRORS`` of the k differences, and each part
into ``CELLS`` cells. A signature is a part's content without ``ERRORS`` of its
cells, one for each way to leave them out: two similar sets always share one.

Only distinct sets get signatures. A bucket of sets with one signature has its
smallest key as centre; rows (centre, member), distinct, name all pairs that need
an exact comparison: those inside a centre's group. The members' shingles are then
sent to the group and intersected there by matrix products. A group with more than
``GROUP`` shingles (an average one has a few hundred) is dealt out to blocks, each
together with the centre. If such a group is not one component after that, its
members outside the centre's component meet every block of it. No pair is
missed, none is dropped, and a link is written only where it joins something.

Shuffled: 16 bytes for about 0.33 signatures a shingle, and the shingles of sets
that share a signature. Which sets do is told to the tasks by a Bloom filter of at
most 32 MB; beyond its room more sets are shuffled, with the same result. Sets
and shingles are compared as 64-bit hashes.

Defined cases: a null text is empty. An empty document has no shingles and is
linked with nothing, not with another empty one. With fewer words than the width
the whole sequence is the one shingle. A null id is never a component's id unless
all ids of the component are null. Repeated rows and repeated ids stay as rows.
Other columns of the input are ignored, whatever their names.
"""

from bisect import bisect_left
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import SPACE, raw, skew_join, slices, stored, table
from askbase.llm.line_dedup import FILTER_BITS, _holds, twice_filter
from askbase.llm.simhash import _smallest, components

WIDTH, PERCENT = 3, 90
ERRORS, CELLS = 1, 3
#: Shingles, and sets, that are compared in one go.
GROUP, MEMBERS = 1 << 18, 1024
#: Bytes of texts that a task holds as shingles at a time.
SLICE = 1 << 20
#: Odd multipliers that tell positions in a shingle or a signature apart (fixed values).
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[4]
    x = (x ^ (x >> np.uint64(29))) * ODD[5]
    return x ^ (x >> np.uint64(32))


#: Bytes that part words, and a random number for each byte; capital letters have their small ones' number.
_SPACE = np.isin(np.arange(256), np.frombuffer(SPACE.encode(), np.uint8))
_BYTE = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)
_BYTE[65:91] = _BYTE[97:123]
#: The base of the words' polynomials and its inverse modulo 2^64; bytes hashed in one go.
BASE, INVERSE, PIECE = 0x9E3779B97F4A7C13, pow(0x9E3779B97F4A7C13, -1, 1 << 64), 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[:1] = 1
    return np.cumprod(factors, dtype=np.uint64)


class WordHashes:
    """Hashes of the words of many texts at once: polynomials over the texts' bytes, modulo 2^64."""

    def __init__(self):
        self.up, self.down = _powers(BASE, PIECE), _powers(INVERSE, PIECE)

    def _piece(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the words of ``data``; a word ends before each of ``breaks``."""
        while len(self.up) < len(data):
            self.up, self.down = _powers(BASE, 2 * len(self.up)), _powers(INVERSE, 2 * len(self.up))
        inside = ~_SPACE[data]
        left = np.concatenate([[False], inside[:-1]])
        left[breaks] = False
        right = np.concatenate([inside[1:], [False]])
        right[breaks[breaks > 0] - 1] = False
        starts, ends = np.nonzero(inside & ~left)[0], np.nonzero(inside & ~right)[0]
        sums = np.cumsum(_BYTE[data] * self.up[:len(data)], dtype=np.uint64)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        return starts, _mixed((sums[ends] - before) * self.down[starts] + (ends - starts).astype(np.uint64) * ODD[1])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each text, from one of ``offsets`` to the next, the hashes of its words."""
        starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):  # cut at white space or between texts
                text = offsets[np.searchsorted(offsets, end, "right") - 1]
                gaps = np.nonzero(_SPACE[data[max(at, text):end]])[0]
                end = max(at, text) + int(gaps[-1]) + 1 if len(gaps) else int(text)
                if end <= at:  # a word longer than a piece
                    limit = int(offsets[np.searchsorted(offsets, at, "right")])
                    later = np.nonzero(_SPACE[data[at + PIECE:limit]])[0]
                    end = at + PIECE + int(later[0]) if len(later) else limit
            inner = offsets[(offsets >= at) & (offsets < end)] - at
            s, h = self._piece(data[at:end], inner)
            starts.append(s + at)
            hashes.append(h)
            at = end
        starts, hashes = np.concatenate(starts), np.concatenate(hashes)
        return np.split(hashes, np.searchsorted(starts, offsets[1:-1]))


def _shingled(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` neighbouring words; the same words in another order differ."""
    n = len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = (total ^ (words[i:i + n] * ODD[i % 4])) * ODD[4 + i % 4]
    return _mixed(total)


def shingle_sets(texts: pa.Array, width: int, hashes: WordHashes) -> list[np.ndarray]:
    """For each text (binary, no nulls) its distinct shingles' hashes in ascending order."""
    if not len(texts):
        return []
    bounds = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return [np.unique(_shingled(w, min(width, len(w)))) if len(w) else w
            for w in hashes.words(data, bounds - bounds[0])]


def set_key(features: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(features.tobytes())).view(np.int64))


class PartEnum:
    """Signatures of sets for one similarity."""

    def __init__(self, percent: int = PERCENT, errors: int = ERRORS, cells: int = CELLS):
        self.percent, self.errors, self.cells = percent, errors, cells
        self.tops: list[int] = []  # the largest size of each band
        self.made: dict[int, tuple[np.ndarray, np.ndarray] | None] = {}
        self.kept = np.array(list(combinations(range(cells), cells - errors)))

    def top(self, band: int) -> int:
        """The largest size in a band."""
        while len(self.tops) <= band:
            low = self.tops[-1] + 1 if self.tops else 1
            self.tops.append(low * 100 // self.percent)
        return self.tops[band]

    def band(self, size: int) -> int:
        while self.top(len(self.tops)) < size:
            pass
        return bisect_left(self.tops, size)

    def differences(self, instance: int) -> int:
        """The most elements in which similar sets of bands ``instance`` - 1 and ``instance`` differ."""
        return 2 * self.top(instance) * (100 - self.percent) // (100 + self.percent)

    def _instance(self, number: int):
        """(inner bounds of the cells, one salt for each signature); None if only equal sets are similar."""
        if number not in self.made:
            k = self.differences(number)
            parts = -(-(k + 1) // (self.errors + 1))
            cells = parts * self.cells
            bounds = np.array([-(-(i << 64) // cells) for i in range(1, cells)], np.uint64)
            salts = np.arange(parts * len(self.kept), dtype=np.uint64) + (np.uint64(number) << np.uint64(40))
            self.made[number] = (bounds, _mixed(salts).reshape(parts, -1)) if k else None
        return self.made[number]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """All signatures of a sorted set; none for an empty one."""
        out = [np.zeros(0, np.uint64)]
        if len(features):
            band = self.band(len(features))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(features, dtype=np.uint64)])
            for number in (band, band + 1):
                instance = self._instance(number)
                if instance is None:
                    continue
                bounds, salts = instance
                at = np.concatenate([[0], np.searchsorted(features, bounds), [len(features)]])
                content = _mixed(sums[at[1:]] - sums[at[:-1]]).reshape(-1, self.cells)
                one = salts
                for i in range(self.cells - self.errors):
                    one = (one ^ content[:, self.kept[:, i]]) * ODD[i % 8]
                out.append(_mixed(one).ravel())
        return np.concatenate(out)


def _int64(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def document_sets(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, n_shingles, key) per row; key is null for an empty document."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, SLICE):
            sets = shingle_sets(batch.column(1), width, hashes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "key"])

    return (documents.select(F.col(f"`{id_col}`").alias("doc_id"), raw(f"`{text_col}`").alias("t"))
            .mapInArrow(run, f"doc_id {kind}, n_shingles bigint, key bigint"))


def _distinct_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[dict[int, np.ndarray]]:
    """{key: set} of one slice of texts after another, each key once as far as a bounded memo tells."""
    hashes, met = WordHashes(), set()
    for batch in slices(batches, SLICE):
        found = {}
        for features in shingle_sets(batch.column(0), width, hashes):
            if len(features) and (key := set_key(features)) not in met:
                found[key] = features
                met.add(key)
        if len(met) > 500_000:
            met.clear()
        yield found


def signature_rows(documents: DataFrame, text_col: str, width: int, percent: int) -> DataFrame:
    """(sig, key) for every distinct set; a copy's rows may come again from another task."""
    def run(batches):
        scheme = PartEnum(percent)
        for found in _distinct_sets(batches, width):
            sigs = [scheme.signatures(features) for features in found.values()]
            keys = np.repeat(np.array(list(found), np.int64), [len(s) for s in sigs])
            yield pa.RecordBatch.from_arrays([_int64(np.concatenate([*sigs, np.zeros(0, np.uint64)])), pa.array(keys)],
                                             names=["sig", "key"])

    return documents.select(raw(f"`{text_col}`").alias("t")).mapInArrow(run, "sig bigint, key bigint")


def _centred(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by (sig, key) to distinct (c, x): a bucket's smallest key and each other one."""
    last_sig, last_centre = None, None
    for batch in batches:
        sig, key = (batch.column(i).to_numpy() for i in range(2))
        if not len(sig):
            continue
        first = np.concatenate([[True], sig[1:] != sig[:-1]])
        centre = key[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        if last_sig == sig[0]:
            centre[sig == last_sig] = last_centre
        last_sig, last_centre = sig[-1], centre[-1]
        pairs = np.stack([centre, key])[:, centre != key]
        if pairs.shape[1]:
            pairs = np.unique(pairs, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["c", "x"])


def _joined(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the similar pairs of ``sets``, as far as they join something."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(*sets, assume_unique=True))
        similar = (100 + percent) * common >= percent * int(sizes.sum())
        return (np.ones(1, int), np.zeros(1, int)) if similar else (np.zeros(0, int),) * 2
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, feature, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times > 1
    column = (np.cumsum(shared) - 1)[feature]
    use = shared[feature]
    column, owner = column[use], owner[use]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, (1 << 22) // len(sets))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        block = np.zeros((len(sets), step), np.float32)
        block[owner[a:b], column[a:b] - low] = 1
        common += block @ block.T
    i, j = [], []
    for low in range(0, len(sets), 256):
        need = percent * (sizes[low:low + 256, None] + sizes[None, :])
        a, b = np.nonzero((100 + percent) * common[low:low + 256].astype(np.int64) >= need)
        i.append(a[a + low < b] + low)
        j.append(b[a + low < b])
    i, j = np.concatenate(i), np.concatenate(j)
    low = _smallest(np.arange(len(sets)), i, j)
    apart = np.nonzero(low != np.arange(len(sets)))[0]
    return apart, low[apart]


def _linked(batches: Iterator[pa.RecordBatch], percent: int):
    """Links (u > v) inside each group of rows (g, x, s) sorted by (g, x)."""
    group, keys, sets = None, [], []

    def links():
        if len(sets) < 2:
            return
        i, j = _joined(sets, percent)
        if len(i):
            a, b = np.array(keys)[i], np.array(keys)[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))],
                                             names=["u", "v"])

    for batch in slices(batches):
        for g, x, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if g != group:
                yield from links()
                group, keys, sets = g, [], []
            if not keys or keys[-1] != x:
                keys.append(x)
                sets.append(np.frombuffer(s, np.uint64))
    yield from links()


def _blocks(size: str, per: str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col(size) / F.col(per)).cast("int"))


def similar_sets(documents: DataFrame, sets: DataFrame, text_col: str = "text", width: int = WIDTH,
                 percent: int = PERCENT, group: int = GROUP, members: int = MEMBERS,
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """Links (u > v) between keys of ``sets`` (key, n) that connect all similar ones."""
    pairs = (signature_rows(documents, text_col, width, percent).repartition("sig")
             .sortWithinPartitions("sig", "key").mapInArrow(_centred, "c bigint, x bigint").distinct())
    pairs = stored(pairs, "jaccard-pairs")
    wanted = stored(pairs.select(F.explode(F.array("c", "x")).alias("h")).distinct(), "jaccard-wanted")
    packed = documents.sparkSession.sparkContext.broadcast(twice_filter(wanted, filter_bits))

    def contents(batches):
        for found in _distinct_sets(batches, width):
            keys = np.array(list(found), np.int64)
            use = _holds(packed.value, keys.view(np.uint64)) if len(keys) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[use]), pa.array([found[k].tobytes() for k in keys[use].tolist()], pa.binary())],
                names=["x", "s"])

    texts = (documents.select(raw(f"`{text_col}`").alias("t")).mapInArrow(contents, "x bigint, s binary")
             .groupBy("x").agg(F.first("s").alias("s")))
    texts = stored(texts.join(wanted.withColumnRenamed("h", "x"), "x", "left_semi"), "jaccard-sets")

    def compared(rows: DataFrame, name: str) -> DataFrame:
        """Links inside the groups of rows (g, x)."""
        return stored(rows.join(texts, "x").select("g", "x", "s").repartition("g").sortWithinPartitions("g", "x")
                      .mapInArrow(lambda batches: _linked(batches, percent), "u bigint, v bigint").distinct(), name)

    # a group's room in sets: they are of nearly one size
    sizes = (pairs.groupBy("c").agg((F.count("*") + 1).alias("m"))
             .join(sets.select(F.col("key").alias("c"), "n"), "c")
             .withColumn("per", F.greatest(F.lit(8), F.least(F.lit(members), F.floor(group / F.col("n"))))))
    crowded = stored(sizes.where("m > per").select("c", "m", "per"), "jaccard-crowded")
    held = pairs.unionByName(pairs.select("c", F.col("c").alias("x")).distinct())
    if crowded.isEmpty():
        return compared(held.select(F.col("c").alias("g"), "x"), "jaccard-links")
    blocks = held.join(crowded, "c", "left").withColumn("blocks", F.coalesce(_blocks("m", "per"), F.lit(1)))
    own = F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int")
    first = blocks.select("c", "x", F.explode(F.when(F.col("x") == F.col("c"), F.sequence(F.lit(0), F.col("blocks") - 1))
                                              .otherwise(F.array(own))).alias("block"))
    links = compared(first.select(F.when(F.col("block") == 0, F.col("c")).otherwise(
        F.xxhash64("c", "block")).alias("g"), "x"), "jaccard-links")
    roots = stored(components(links), "jaccard-roots")
    many = held.join(crowded, "c")
    of = roots.select(F.col("fp").alias("x"), "root")
    centres = roots.select(F.col("fp").alias("c"), F.col("root").alias("main"))
    many = (many.join(of, "x", "left").join(centres, "c", "left")
            .withColumn("outside", F.coalesce("root", "x") != F.coalesce("main", "c")))
    many = stored(many.select("c", "x", "m", "per", "outside"), "jaccard-many")
    left = (many.where("outside").groupBy("c").agg(F.count("*").alias("o")))
    if left.isEmpty():
        return links
    both = many.join(left, "c").withColumn("ob", _blocks("o", "per")).withColumn("mb", _blocks("m", "per"))
    block = lambda n, seed: F.pmod(F.xxhash64("x", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    meet = (both.withColumn("p", block("mb", 1)).select("c", "x", "p", F.explode(each("ob")).alias("q"))
            .unionByName(both.where("outside").withColumn("q", block("ob", 2))
                         .select("c", "x", F.explode(each("mb")).alias("p"), "q")))
    rest = compared(meet.select(F.xxhash64("c", "p", "q").alias("g"), "x").distinct(), "jaccard-rest")
    return links.unionByName(rest).distinct()


def jaccard_join(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 percent: int = PERCENT, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, and set_key (null if empty).

    component_id is the smallest id that links reach; two documents link when
    100 * |intersection| >= percent * |union|.
    """
    docs = stored(document_sets(documents, id_col, text_col, width), "jaccard-documents")
    keys = stored(docs.where("key IS NOT NULL").groupBy("key")
                  .agg(F.max("n_shingles").alias("n"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")),
                  "jaccard-keys")
    links = similar_sets(documents, keys, text_col, width, percent, **sizes)
    of = keys.join(components(links).withColumnRenamed("fp", "key"), "key", "left") \
        .withColumn("root", F.coalesce("root", "key"))
    ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = stored(of.select("key", "root", "rows").join(ids, "root").select("key", "component_id", "rows"),
                     "jaccard-classes")
    full = skew_join(docs.where("key IS NOT NULL"), classes, "key", "rows")
    empty = docs.where("key IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id", F.col("key").alias("set_key")]
    return full.select(*columns).unionByName(empty.select(*columns))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
