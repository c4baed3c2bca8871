"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's fingerprint is the bitwise majority of the hashes of its word
shingles. Two fingerprints link when at most ``radius`` of 64 bits differ.

The 64 bit positions are dealt to the non-zero vectors of F2^(radius+1). Mask v
keeps a position when its vector's product with v is 1. Any ``radius``
positions span at most ``radius`` dimensions, so some v is orthogonal to all of
them and its mask ignores them: every pair within the radius agrees on the kept
bits of some mask and meets in that mask's table. No pair is missed.

Only distinct fingerprints enter the tables. A bucket with more than ``crowd``
fingerprints is dealt out again by the same construction over the bits its mask
ignored, which halves the open bits each time: at the second level a bucket
holds at most 2^16. A task cuts crowded ones further before it compares pairs;
at 16 open bits or fewer it spreads labels over the cube of all their values. A
bucket gives at most one link per member (to its local component's smallest),
never all pairs. Components are then found by alternating large and small stars
on the shared folder's tables.

Nulls: a null text counts as empty; a text without words has fingerprint zero
and links like any other. A null id has a fingerprint and a component, but is
never the component's id unless nothing else is in it (then the id is null).
Repeated rows and repeated ids are kept as rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm.common import map_columns, raw, slices, stored, table

SHINGLE, RADIUS, CROWD, SEED = 4, 4, 1024, 42
CUBE = 16  # open bits up to which a task works on all their values


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < shingle:
        return digest(join(words), seed)
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):  # a very long text piece by piece
        part = words[at:at + (1 << 15) + shingle - 1]
        grams = zip(*[part[i:] for i in range(shingle)])
        hashes = np.fromiter((digest(join(g), seed) for g in grams), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint_bits",
                      shingle: int = SHINGLE) -> DataFrame:
    """``df`` with the fingerprint as a signed 64-bit integer."""
    def fn(columns):
        return [pa.array(np.array([fingerprint(t, shingle) for t in columns[0].to_pylist()],
                                  np.uint64).view(np.int64))]

    return map_columns(df, {"text": raw(text_col)}, f"{out} bigint", fn)


def covering_masks(positions: list[int], radius: int) -> list[int]:
    """Masks over ``positions``; any ``radius`` of them are all ignored by some mask."""
    vectors = (1 << (radius + 1)) - 1
    dealt = {p: 1 + i % vectors for i, p in enumerate(positions)}
    return [sum(1 << p for p, m in dealt.items() if (m & v).bit_count() & 1)
            for v in range(1, vectors + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _open_bits(mask: int) -> list[int]:
    return [p for p in range(64) if not mask >> p & 1]


def _smallest(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i] (indexes) until nothing changes."""
    labels = labels.copy()
    while True:
        before = labels.copy()
        low = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, a, low)
        np.minimum.at(labels, b, low)
        labels = np.minimum(labels, labels[labels])
        if (labels == before).all():
            return labels


def _cube(codes: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """For each of distinct ``codes`` of ``bits`` bits the index of its component's smallest.

    ``radius`` steps along the edges of the cube carry to each value the least
    label within the radius: exact, at bits x 2^bits a step for any number of codes.
    """
    own = labels = np.arange(len(codes))
    flips = [np.arange(1 << bits) ^ 1 << b for b in range(bits)]
    while True:
        near = np.full(1 << bits, len(codes))
        near[codes] = labels
        for _ in range(min(radius, bits)):
            near = np.minimum.reduce([near, *(near[f] for f in flips)])
        if (near[codes] == labels).all():
            return labels
        labels = _smallest(labels, np.r_[own, own], np.r_[labels, near[codes]])


def local_components(prints: np.ndarray, known: int, radius: int, direct: int = 256,
                     fold: int = 1 << 20) -> np.ndarray:
    """For each of sorted distinct ``prints`` the index of its component's smallest member.

    All agree on the bits of ``known``. More than ``direct`` are cut by covering
    masks over the other bits until the groups are small or at most ``CUBE`` bits
    are open. Where too few are open for covering masks that all keep some, one of
    radius + 1 parts is kept: any ``radius`` positions leave a part untouched.
    """
    own = labels = np.arange(len(prints))
    todo, a, b, found = [(labels, known)], [], [], 0

    def folded():
        """Labels with the pairs found since; the earlier labels count as links too."""
        return _smallest(labels, np.concatenate([own, *a]), np.concatenate([labels, *b]))

    while todo:
        if found > fold:
            labels, a, b, found = folded(), [], [], 0
        members, mask = todo.pop()
        if len(members) <= direct:
            x = prints[members]
            i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius, 1))
            a.append(members[i])
            b.append(members[j])
            found += len(i)
            continue
        bits = _open_bits(mask)
        if len(bits) <= max(radius, CUBE):
            low = np.zeros(len(members), np.int64)  # within the radius whatever the bits
            if len(bits) > radius:
                codes = sum((prints[members] >> np.uint64(p) & np.uint64(1)).astype(np.int64) << k
                            for k, p in enumerate(bits))
                low = _cube(codes, len(bits), radius)
            a.append(members)
            b.append(members[low])
            found += len(members)
            continue
        subs = covering_masks(bits, radius)
        if not all(subs):
            subs = [sum(1 << p for p in bits[i::radius + 1]) for i in range(radius + 1)]
        for sub in subs:
            keys = prints[members] & np.uint64(sub)
            order = np.argsort(keys, kind="stable")
            cuts = np.nonzero(np.diff(keys[order]))[0] + 1
            todo += [(g, mask | sub) for g in np.split(members[order], cuts) if len(g) > 1]
    return folded()


def _links(batches: Iterator[pa.RecordBatch], masks: dict[int, int], radius: int):
    """Links inside each bucket of rows sorted by (table, key); at most one per member."""
    held: list[np.ndarray] = []

    def of(rows: np.ndarray):
        cuts = np.nonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))[0] + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, rows.shape[1]]
        size = ends - starts
        prints = rows[2].view(np.uint64)
        first = starts[size == 2]
        near = first[np.bitwise_count(prints[first] ^ prints[first + 1]) <= radius]
        u, v = [prints[near + 1]], [prints[near]]
        for s, e in zip(starts[size > 2], ends[size > 2]):
            x = np.unique(prints[s:e])
            low = local_components(x, masks[int(rows[0][s])], radius)
            apart = low != np.arange(len(x))
            u.append(x[apart])
            v.append(x[low[apart]])
        u, v = (np.concatenate(c).view(np.int64) for c in (u, v))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))],
                                          names=["u", "v"])

    for batch in batches:
        rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)
                         for i in range(3)])
        rows = np.concatenate([*held, rows], axis=1)
        last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.argmax(last)) if len(last) else 0  # the last bucket may go on
        held = [rows[:, cut:]]
        if cut:
            yield of(rows[:, :cut])
    if held and held[0].shape[1]:
        yield of(held[0])


def _deal(masks: dict[int, list[tuple[int, int]]]):
    """Rows (t, fp) to one row (number, key, fp) for each of table t's (number, mask)."""
    def run(batches):
        for batch in slices(batches):
            t, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for table in np.unique(t):
                own = fp[t == table]
                for number, mask in masks[int(table)]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), number)), pa.array(own & np.int64(_signed(mask))),
                         pa.array(own)], names=["t", "k", "fp"])
    return run


def near_pairs(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Links (u > v) that connect all of ``prints`` (column fp, distinct) within the radius."""
    layout = "t bigint, k bigint, fp bigint"
    full: dict[int, int] = {}  # table number -> bits on which all of a bucket agree
    first, again = [], {}
    for t, mask in enumerate(covering_masks(list(range(64)), radius), 1):
        first.append((t * 100, mask))
        again[t * 100] = [(t * 100 + s, mask | sub)
                          for s, sub in enumerate(covering_masks(_open_bits(mask), radius), 1)]
        full |= {t * 100: mask, **dict(again[t * 100])}
    keys = prints.select(F.lit(0).cast("bigint").alias("t"), "fp").mapInArrow(_deal({0: first}), layout)
    crowded = stored(keys.groupBy("t", "k").count().where(F.col("count") > crowd)
                     .select(F.col("t").alias("ct"), F.col("k").alias("ck")), "simhash-crowded")
    if crowded.isEmpty():
        buckets = keys
    else:  # a crowded bucket's rows go to one sub-bucket for each mask over its open bits
        both = keys.join(crowded, (F.col("t") == F.col("ct")) & (F.col("k") == F.col("ck")), "left")
        buckets = both.where(F.col("ct").isNull()).select("t", "k", "fp").unionByName(
            both.where(F.col("ct").isNotNull()).select("t", "fp").mapInArrow(_deal(again), layout))
    return (buckets.repartition("t", "k").sortWithinPartitions("t", "k", "fp")
            .mapInArrow(lambda batches: _links(batches, full, radius), "u bigint, v bigint")
            .distinct())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(fp, root): for every linked node the smallest node it can reach.

    Large and small stars in turn. Each round is written to the shared folder,
    so a lost executor repeats one round at most.
    """
    edges = stored(links, "components")
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state = edges.agg(F.count("*"), total).first()
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u != v").distinct())
        edges = stored(small, "components")
        before, state = state, edges.agg(F.count("*"), total).first()
        if before == state:
            break
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def classes(prints: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp)."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-prints")
    roots = components(near_pairs(distinct.select("fp"), radius, crowd))
    of = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return of.select("fp", "root").join(ids, "root")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id, group (hex of its root)."""
    prints = stored(with_fingerprints(documents.select(F.col(id_col).alias("doc_id"),
                                                       F.col(text_col).alias("text")), out="fp")
                    .select("doc_id", "fp"), "simhash-documents")
    return prints.join(classes(prints, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        F.lpad(F.lower(F.hex("root")), 16, "0").alias("group"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             radius: int = RADIUS) -> DataFrame:
    """The document with the smallest id of each group, with its own columns.

    A group whose ids are all null keeps one row; of rows that repeat the kept
    id inside a group one stays.
    """
    columns = documents.columns
    held = documents.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"),
                            F.col(text_col).alias("text"))
    held = stored(with_fingerprints(held, out="fp").drop("text"), "simhash-rows")
    # ids first: they are few and narrow, and a fingerprint that many share stays out of the texts' join
    ids = held.select("doc_id", "fp")
    chosen = stored(ids.join(classes(ids, radius), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                    .select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp"), "root"), "simhash-kept")
    kept = held.join(chosen.distinct(), F.col("doc_id").eqNullSafe(F.col("kept_id"))
                     & (F.col("fp") == F.col("kept_fp")))
    if not chosen.groupBy("root").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["root"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
