"""Token sequences in training order, as fixed-stride binary shards.

Texts become token ids, cut into sequences of ``length`` tokens (the last one
padded). Sequences are numbered by partition and place in it; a keyed Feistel
network over the smallest even number of bits that holds all numbers permutes
them, walking on while a value lies outside, so every sequence gets exactly one
slot in 0..N-1 and the order can be computed from the key alone. Shard k holds
the slots from k * per_shard on; each record goes straight to its shard's task,
is sorted by slot there and written at the slot's place: record size times the
slot's place in the shard is its offset, so a reader can start at any slot.

Texts are read twice and tokenised twice: first only to count sequences per
partition (one number each reaches the driver), then to make the records, which
are shuffled once. Within a slice of texts each distinct word is tokenised once. Nothing else is stored. The partitions of both passes must
be the same, as they are for tables read from files; each task compares count
and checksum with the first pass and fails if they differ.

A record: document id (8 bytes), sequence number in the document (4), tokens
in use (2), ``length`` tokens of 2 bytes each, a line end. All little endian.

Defined cases: a null or empty text is one sequence with the end token alone. A
null id is stored as the smallest 64-bit number and read back as null. Repeated
rows have sequences, and slots, of their own. Without documents there is no
shard.
"""

import base64
import hashlib
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm.common import NO_ID, id_key, shared_dir, slices, table

LENGTH, PER_SHARD, ROUNDS, MEMO, PACKED = 256, 1 << 15, 6, 600_000, 6 << 20
#: A pattern known to end its parts before a space between two characters that are not white space.
CUT_AT_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
HEAD = np.dtype([("doc", "<i8"), ("seq", "<u4"), ("n", "<u2")])


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """A vocabulary file's byte strings and ids."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

#: What is not among these: characters whose class may differ between two versions of the pattern's engine.
STABLE = r"[^\t\n\r\x20-\x7e\u00a1-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]"


class Tokenizer:
    """Texts to packed 16-bit ids, remembering the encodings of MEMO parts met before.

    A part of ``CUT_AT_SPACES`` takes a space only in front of what follows, so texts are cut at single spaces
    between other characters, and each distinct word of a slice of texts is matched and looked up once.
    Texts with other white space beside a space, and texts under another pattern, are matched whole.
    A worker keeps what it remembers from one task to the next.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        if pattern is None:
            import public_tokenizers
            pattern = public_tokenizers.PATTERN
        self.ranks, self.pattern, self.end = ranks, pattern, max(ranks.values(), default=-1) + 1
        if self.end >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def packer(self):
        """A function of one text: its packed ids."""
        self.made = self.made or self._made()
        return self.made[0]

    def slice_packer(self):
        """A function of an array of texts, some at least: their ids in a row, and where those of each text end.

        With ``counted`` the ids may be left out.
        """
        self.made = self.made or self._made()
        return self.made[1]

    def _made(self):
        import regex
        import tiktoken
        encode = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=self.ranks,
                                   special_tokens={}).encode_ordinary
        unsure = regex.compile(STABLE).search
        parts, memo = regex.compile(self.pattern).findall, {}
        known, some = memo.get, struct.pack

        def ids_of(part: str) -> bytes:
            ids = known(part)
            if ids is None:
                found = encode(part)
                ids = some(f"<{len(found)}H", *found)
                if len(memo) < MEMO:
                    memo[part] = ids
            return ids

        def whole(text: str | None) -> bytes:
            return b"".join(map(ids_of, parts(text or "")))

        length = np.zeros(self.end, np.int64)
        for token, i in self.ranks.items():
            length[i] = len(token)

        def encoded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """The ids of " word" for each word, in a row, and how many each has; none has a space."""
            line = "".join([" " + w for w in words])
            odd = [bool(unsure(w)) for w in words] if unsure(line) else []
            if any(odd):  # matched by the pattern here, as parts of whole texts are
                line = "".join([" " + w for w, o in zip(words, odd) if not o])
            ids = np.array(encode(line), "<u2")
            at = np.cumsum(length[ids])  # each id's last byte tells its word
            data = np.frombuffer(line.encode(), np.uint8)
            opens = np.nonzero(data == 32)[0]
            size = np.diff(np.searchsorted(at, np.r_[opens, len(data)], side="right"))
            if not any(odd):
                return ids, size
            alone = [whole(" " + w) if o else b"" for w, o in zip(words, odd)]
            n = np.array([len(p) // 2 for p in alone], np.int64)
            odd = np.array(odd)
            start = np.zeros(len(words), np.int64)
            start[~odd] = np.cumsum(size) - size
            start[odd] = len(ids) + (np.cumsum(n) - n)[odd]
            n[~odd] = size
            return _runs(np.r_[ids, np.frombuffer(b"".join(alone), "<u2")], start, n), n

        def by_word(texts: pa.Array, counted: bool = False):
            lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            code, words = coded.indices.to_numpy().astype(np.int64), _strings(coded.dictionary)
            cut = np.array([w != "" and w == w.strip() for w in words], bool)  # strip() knows all white space, and more
            odd = (np.diff(at) > 1) & (np.add.reduceat(~cut[code], at[:-1]) > 0)
            # a text's first word has no space in front; odd texts take the place of theirs
            first = [whole(texts[i].as_py() if o else words[c])
                     for i, (o, c) in enumerate(zip(odd.tolist(), code[at[:-1]].tolist()))]
            n_first = np.array([len(p) // 2 for p in first], np.int64)
            ids, size = encoded([w for w, c in zip(words, cut) if c])
            start, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            start[cut], n[cut] = np.cumsum(size) - size, size
            n = n[code]
            n[np.repeat(odd, np.diff(at))] = 0
            n[at[:-1]] = n_first
            ends = np.cumsum(np.add.reduceat(n, at[:-1]))
            if counted:
                return None, ends
            start = start[code]
            start[at[:-1]] = len(ids) + np.cumsum(n_first) - n_first
            return _runs(np.r_[ids, np.frombuffer(b"".join(first), "<u2")], start, n), ends

        def one_by_one(texts: pa.Array, counted: bool = False):
            packed = [whole(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(packed), "<u2"), np.cumsum([len(p) // 2 for p in packed])

        return whole, by_word if self.pattern == CUT_AT_SPACES else one_by_one


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist(), many times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def _runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of many runs one after another."""
    before = np.cumsum(size) - size
    place = np.repeat(start - before, size)
    place += np.arange(len(place))
    return values[place]


def feistel(x: np.ndarray, n: int, key: str, rounds: int = ROUNDS) -> np.ndarray:
    """The slot in 0..n-1 of each number in 0..n-1: a permutation that ``key`` chooses."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key} {i}".encode()).digest()[:8], "little"))
            for i in range(rounds)]

    def once(v):
        left, right = v >> np.uint64(half), v & low
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & low)
        return (left << np.uint64(half)) | right

    with np.errstate(over="ignore"):
        v = once(x.astype(np.uint64))
        out = np.nonzero(v >= np.uint64(n))[0]
        while len(out):  # cycle-walking: on average less than four steps
            v[out] = once(v[out])
            out = out[v[out] >= np.uint64(n)]
    return v.astype(np.int64)


def _mark(batch: pa.RecordBatch) -> bytes:
    """What both passes must find in a slice: ids and texts, whichever way they are sliced."""
    return b"\0".join([x if x is not None else b"" for pair in zip(
        batch.column(0).cast(pa.string()).cast(pa.binary()).to_numpy(zero_copy_only=False),
        batch.column(1).cast(pa.binary()).to_numpy(zero_copy_only=False)) for x in pair] + [b""])


def _source(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(id_key(id_col).alias("id"), F.col(text_col).alias("t"))


def count_sequences(documents: DataFrame, tokenizer, id_col: str, text_col: str, length: int) -> dict:
    """partition -> (sequences, checksum)."""
    def run(batches):
        pack, n, check = tokenizer.value.slice_packer(), 0, xxhash.xxh64()
        for batch in slices(batches, PACKED):
            sizes = np.diff(pack(batch.column(1), counted=True)[1], prepend=0) + 1
            n += int((-(-sizes // length)).sum())
            check.update(_mark(batch))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), pa.array([n]), pa.array([check.hexdigest()])],
            names=["part", "n", "checksum"])

    rows = _source(documents, id_col, text_col).mapInArrow(run, "part bigint, n bigint, checksum string").collect()
    return {r["part"]: (r["n"], r["checksum"]) for r in rows}


def records(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text",
            length: int = LENGTH, ranks: dict[bytes, int] | None = None) -> tuple[DataFrame, int]:
    """(slot, record) for every sequence, and how many there are."""
    spark = documents.sparkSession
    tokenizer = spark.sparkContext.broadcast(Tokenizer(read_ranks() if ranks is None else ranks))
    counted = count_sequences(documents, tokenizer, id_col, text_col, length)
    starts, total = {}, 0
    for part in sorted(counted):
        starts[part] = total
        total += counted[part][0]
    plan = spark.sparkContext.broadcast({p: (starts[p], *counted[p]) for p in counted})
    width = HEAD.itemsize + 2 * length

    def run(batches):
        own, part = tokenizer.value, TaskContext.get().partitionId()
        start, n, checksum = plan.value.get(part, (0, 0, None))
        done, check = 0, xxhash.xxh64()
        pack = own.slice_packer()
        for batch in slices(batches, PACKED):
            found, ends = pack(batch.column(1))
            sizes = np.diff(ends, prepend=0) + 1
            tokens = np.insert(found, ends, own.end)
            count = -(-sizes // length)
            total_here = int(count.sum())
            seq = np.arange(total_here) - np.repeat(np.cumsum(count) - count, count)
            used = np.minimum(np.repeat(sizes, count) - seq * length, length)
            head = np.zeros(total_here, HEAD)
            head["doc"], head["seq"], head["n"] = np.repeat(batch.column(0).to_numpy(), count), seq, used
            body = np.full(total_here * length, own.end, "<u2")
            before = np.cumsum(sizes) - sizes
            body[np.repeat((np.cumsum(count) - count) * length - before, sizes) + np.arange(len(tokens))] = tokens
            made = np.concatenate([head.view(np.uint8).reshape(-1, HEAD.itemsize),
                                   body.view(np.uint8).reshape(-1, 2 * length)], axis=1)
            slots = feistel(np.arange(start + done, start + done + total_here), total, key)
            done += total_here
            check.update(_mark(batch))
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(width), total_here, [None, pa.py_buffer(made.tobytes())]).cast(pa.binary())],
                names=["slot", "record"])
        if checksum is not None and (done, check.hexdigest()) != (n, checksum):
            raise RuntimeError("the documents' partitions changed between the two passes; store them first")

    return _source(documents, id_col, text_col).mapInArrow(run, "slot bigint, record binary"), total


def write_shards(documents: DataFrame, path: str, key: str, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH, per_shard: int = PER_SHARD, ranks: dict[bytes, int] | None = None) -> int:
    """Write ``path``/shard=k/part-..., one file for each shard; gives the number of sequences.

    A shard's file is its records in slot order; the text writer puts the line
    end that closes each record and copies the other bytes as they are.
    """
    made, total = records(documents, key, id_col, text_col, length, ranks)
    if not total:
        return 0
    shard = F.floor(F.col("slot") / per_shard).cast("int")
    placed = (made.withColumn("shard", shard).repartitionById(-(-total // per_shard), F.col("shard"))
              .sortWithinPartitions("shard", "slot"))
    (placed.select("shard", F.col("record").cast("string").alias("value"))
     .write.partitionBy("shard").text(path))
    return total


def read_shards(spark: SparkSession, path: str, start: int = 0, end: int | None = None,
                length: int = LENGTH, per_shard: int = PER_SHARD) -> DataFrame:
    """Sequences of the slots from ``start`` (up to ``end``), whole shards outside skipped.

    slot, shard, offset (of the record in the shard's file), doc_id, seq, n_tokens, tokens (packed).
    """
    stride = HEAD.itemsize + 2 * length + 1
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.regexp_extract("path", r"/shard=(\d+)/", 1).cast("int").alias("shard"), "content")
             .where(F.col("shard") >= start // per_shard))
    if end is not None:
        files = files.where(F.col("shard") <= (end - 1) // per_shard)

    def run(batches):
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)
                slots = shard * per_shard + np.arange(len(data))
                keep = np.nonzero((slots >= start) & (slots < (end if end is not None else slots[-1] + 1)))[0]
                for s in range(0, len(keep), 4096):
                    rows = keep[s:s + 4096]
                    head = np.ascontiguousarray(data[rows, :HEAD.itemsize]).view(HEAD).ravel()
                    used = head["n"].astype(np.int64)
                    body = [data[r, HEAD.itemsize:HEAD.itemsize + 2 * n].tobytes() for r, n in zip(rows, used)]
                    doc = head["doc"].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[rows]), pa.array(np.full(len(rows), shard, np.int32)),
                         pa.array(rows * stride), pa.array(doc, mask=doc == NO_ID),
                         pa.array(head["seq"].astype(np.int64)), pa.array(used), pa.array(body, pa.binary())],
                        names=["slot", "shard", "offset", "doc_id", "seq", "n_tokens", "tokens"])

    return files.mapInArrow(run, "slot bigint, shard int, offset bigint, doc_id bigint, seq bigint, "
                                 "n_tokens bigint, tokens binary")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-shards")
    total = write_shards(table(spark, sf_dir, "documents"), path, key="epoch 0")
    if not total:
        return spark.createDataFrame([], "slot bigint, shard int, offset bigint, doc_id bigint, seq bigint, "
                                         "n_tokens bigint, tokens binary")
    return read_shards(spark, path)
