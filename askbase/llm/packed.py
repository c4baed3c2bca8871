"""A table of words that every task holds, of bounded size, with exact lookup.

Tasks pack their rows into compressed segments; the driver passes the segments
on without opening them, and each worker builds its own index.
"""

import ctypes
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F


def _numbers(values: pa.Array) -> tuple[np.ndarray, ...]:
    if not pa.types.is_list(values.type):
        return (values.to_numpy(zero_copy_only=False),)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    small = len(flat) == 0 or 0 <= flat.min() <= flat.max() < 1 << 16
    return (pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int32),
            flat.astype(np.uint16 if small else np.int32))


def segments(df: DataFrame) -> list[bytes]:
    """Rows (word as bytes, a number or a list of them) of a table whose size was checked."""
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            words, values = batch.columns
            lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
            part = pack(pickle.dumps((lengths, b"".join(words.to_pylist()), _numbers(values))))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["segment"])

    sorted_rows = df.sortWithinPartitions(df.columns[0])  # neighbours compress well
    return [bytes(r[0]) for r in sorted_rows.mapInArrow(run, "segment binary").collect()]


def give_back() -> None:
    """Free memory goes back to the system, as a worker lives on beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


class Words:
    """Distinct words found by hash and confirmed by their bytes; ``values`` are their numbers."""

    def __init__(self, packed: list[bytes]):
        self.packed, self.hashes = packed, None

    def __getstate__(self):
        return {"packed": self.packed, "hashes": None}

    def open(self) -> "Words":
        if self.hashes is not None:
            return self
        give_back()
        unpack = zstandard.ZstdDecompressor().decompress
        n, size, kinds, shapes = 0, 0, [], []
        for part in self.packed:  # unpacked twice, so that nothing is held twice
            own, words, numbers = pickle.loads(unpack(part))
            n, size = n + len(own), size + len(words)
            kinds.append([v.dtype for v in numbers])
            shapes.append([len(v) for v in numbers])
        self.blob = bytearray(size)
        self.at = np.zeros(n + 1, np.int32 if size < 1 << 31 else np.int64)
        self.values = [np.empty(sum(length), np.result_type(*kind)) for length, kind in zip(zip(*shapes), zip(*kinds))]
        hashes = np.empty(n, np.uint32)
        digest, row, end, ends, packed = xxhash.xxh32_intdigest, 0, 0, [0] * len(self.values), self.packed[::-1]
        self.packed = []
        while packed:
            own, words, numbers = pickle.loads(unpack(packed.pop()))
            place = self.at[row:row + len(own) + 1]
            np.cumsum(own, out=place[1:])
            cut = place.tolist()
            cut[0] = 0
            hashes[row:row + len(own)] = [digest(words[i:j]) for i, j in zip(cut, cut[1:])]
            place[1:] += end
            self.blob[end:end + len(words)] = words
            row, end = row + len(own), end + len(words)
            for k, v in enumerate(numbers):
                self.values[k][ends[k]:ends[k] + len(v)] = v
                ends[k] += len(v)
            if len(packed) % 64 == 0:
                give_back()
        self.rows, done, top = np.empty(n, np.int32), 0, (hashes >> np.uint32(28)).astype(np.uint8)
        for part in range(16):  # sorted by parts, so that little is held beside them
            own = np.nonzero(top == part)[0].astype(np.int32)
            self.rows[done:done + len(own)] = own[np.argsort(hashes[own])]
            done += len(own)
        hashes.sort()
        self.hashes = hashes
        kind = pa.binary() if self.at.itemsize == 4 else pa.large_binary()
        self.texts = pa.Array.from_buffers(kind, n, [None, pa.py_buffer(self.at), pa.py_buffer(self.blob)])
        return self

    def find(self, words: list[bytes]) -> np.ndarray:
        """The row of each word, -1 where it is not in here."""
        self.open()
        last = len(self.hashes)
        if not last:
            return np.full(len(words), -1)
        hashes, rows, at, blob = self.hashes, self.rows, self.at, self.blob
        h = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))
        order = np.argsort(h)  # neighbours are near in memory
        place = np.empty(len(h), np.int64)
        place[order] = np.searchsorted(hashes, h[order])
        place[place == last] = 0
        hit = hashes[place] == h
        row = rows[place]
        same = pc.equal(self.texts.take(pa.array(row)), pa.array(words, self.texts.type)).to_numpy(zero_copy_only=False)
        found = np.where(hit & same, row, np.int64(-1))
        for k in np.nonzero(hit & ~same)[0].tolist():
            p = int(place[k]) + 1
            while p < last and hashes[p] == h[k]:  # another word with the same hash
                if blob[at[rows[p]]:at[rows[p] + 1]] == words[k]:
                    found[k] = rows[p]
                    break
                p += 1
        return found


def most_frequent(words: DataFrame, count: str, weight: Column, room: int) -> Column:
    """Condition for the most frequent rows whose ``weight`` adds up to no more than ``room``.

    Counts in classes a quarter of a doubling apart decide, so that only some
    hundred sums reach the driver.
    """
    level = F.floor(4 * F.log2(F.col(count).cast("double")))
    sums = words.groupBy(level.alias("level")).agg(F.sum(weight).alias("w")).orderBy(F.desc("level"))
    cut = None
    for r in sums.collect():
        room -= r["w"]
        if room < 0:
            break
        cut = r["level"]
    return F.lit(False) if cut is None else level >= F.lit(cut)
