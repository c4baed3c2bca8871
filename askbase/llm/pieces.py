"""Encoding and decoding with SentencePiece models, as a relational lattice over words.

Text is normalised as such models do (spaces become the word mark, one mark in
front) and cut into units: marks and the letters after them, where no piece
can reach across. The corpus is reduced to distinct units with counts. Their
lattice is a relation: substrings of at most the longest piece's length are
exploded, joined with the piece table on the piece, and the matching edges of a
unit are collected and folded with ``aggregate``:

* a unigram model by the Viterbi fold: for each end the best score of the edges
  that end there, then the way back;
* a BPE model by its own rule, since the sum of its scores is not what it
  maximises (a Viterbi path differs from the model's encoding): the fold merges
  the best-scoring edge that spans two neighbouring pieces, the leftmost on
  ties, until none is left. Where all pieces of a lattice are regular (reached
  by merges of falling scores), one pass over its edges by score does that.

Characters that no piece covers become byte pieces, or the unknown piece.

The encoded units go back to the texts without moving text: units are sent to
every task in compact arrays of at most ``lexicon_bytes``. Where they need
more, the most frequent are sent; the units a document lacks are joined by unit
and attached to it by id.

Defined cases: a null or empty text has no pieces and decodes to an empty text.
A word mark in the text decodes to a space. Units of over ``LONG`` characters
(runs of one letter, encoded blobs) have lattices that grow without bound and
are encoded by the same rule with a heap, or a running table, in one pass.
Repeated rows and ids keep their rows.
"""

import heapq
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import id_key, let, map_columns, slices, stored, table
from askbase.llm.packed import Words, most_frequent, segments

MARK, LONG = "▁", 48
LEXICON_BYTES, TASK_UNITS, UNITS, TEXTS = 256 << 20, 400_000, 50_000, 1 << 20
UNKNOWN_PENALTY = 10.0


class Model:
    """The piece table of a SentencePiece model file."""

    def __init__(self, pieces: dict[str, tuple[int, float]], names: list[str], byte_ids: list[int],
                 unknown: int, kind: str = "bpe"):
        self.pieces, self.names, self.byte_ids = pieces, names, byte_ids
        self.unknown, self.kind = unknown, kind
        self.longest = max(map(len, pieces))
        self.low = min(score for _, score in pieces.values()) - UNKNOWN_PENALTY
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece reaches from one word into the next")
        used = set("".join(pieces))
        apart = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in used)
        self.pattern = f"[{apart}]|{MARK}*[^{MARK}{apart}]+|{MARK}+" if apart else f"{MARK}*[^{MARK}]+|{MARK}+"

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> "Model":
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = {p: (i, sp.get_score(i)) for i, p in enumerate(names)
                 if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))}
        byte_ids = [i for i in range(len(names)) if sp.is_byte(i)]
        return cls(plain, names, byte_ids, sp.unk_id(), kind)

    def spelled(self) -> list[bytes]:
        """What each id stands for."""
        out = [p.replace(MARK, " ").encode() if p in self.pieces else b"" for p in self.names]
        for value, i in enumerate(self.byte_ids):
            out[i] = bytes([value])
        out[self.unknown] = " ⁇ ".encode()
        return out

    def other(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def encode_long(self, unit: str) -> list[int]:
        return self._viterbi(unit) if self.kind == "unigram" else self._merge(unit)

    def irregular(self) -> set[str]:
        """Pieces that BPE does not reach from their characters by merges of falling scores."""
        out = set()
        for p, (i, _) in self.pieces.items():
            if len(p) > 1:
                trace: list[float] = []
                if self._merge(p, trace) != [i] or any(a < b for a, b in zip(trace, trace[1:])):
                    out.add(p)
        return out

    def _merge(self, unit: str, trace: list[float] | None = None) -> list[int]:
        """BPE with a heap of candidate merges over a linked list of pieces; ``trace`` gets their scores."""
        part, n = list(unit), len(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                both = part[i] + part[after[i]]
                if len(both) <= self.longest and both in self.pieces:
                    heapq.heappush(heap, (-self.pieces[both][1], i, after[i], both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if part[i] is None or after[i] != j or j >= n or part[i] + (part[j] or "") != both:
                continue
            if trace is not None:
                trace.append(self.pieces[both][1])
            part[i], part[j], after[i] = both, None, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for p in part if p is not None
                for x in ([self.pieces[p][0]] if p in self.pieces else self.other(p))]

    def _viterbi(self, unit: str) -> list[int]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(unit) + 1):
            options = [(best[s][0] + self.pieces[unit[s:end]][1], s)
                       for s in range(max(0, end - self.longest), end) if unit[s:end] in self.pieces]
            if unit[end - 1] not in self.pieces:
                options.append((best[end - 1][0] + self.low, end - 1))
            best.append(max(options, default=(float("-inf"), end - 1)))
        ids: list[list[int]] = []
        end = len(unit)
        while end:
            start = best[end][1]
            p = unit[start:end]
            ids.append([self.pieces[p][0]] if p in self.pieces else self.other(p))
            end = start
        return [x for part in reversed(ids) for x in part]


def units_of(text: str | None, find) -> list[str]:
    return find(MARK + text.replace(" ", MARK)) if text else []


def _words(text: str) -> list[str]:
    """A text cut at its spaces, but for those beside a space or behind a mark, where a unit goes on."""
    out, held = [], None
    for word in text.split(" "):
        if held is None:
            held = word
        elif not held or held[-1] in (" ", MARK):
            held += f" {word}"
        else:
            out.append(held)
            held = word
    return [*out, held]


def _cut(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """(numbers of the texts' words in a row, the distinct words, whether each is one unit, words per text).

    A unit starts at each space that follows no space or mark, so the units of a text are those of its words.
    """
    texts = pc.fill_null(texts, "")
    lists = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    # words that are empty or end with a mark do not end there
    loose = pc.or_(pc.equal(pc.binary_length(flat), 0), pc.ends_with(flat, MARK)).to_numpy(zero_copy_only=False)
    if loose.any():
        ends = np.cumsum(sizes)
        parts, done = [], 0
        for i in np.unique(np.searchsorted(ends, np.nonzero(loose)[0], side="right")).tolist():
            text = texts[i].as_py()
            own = _words(text) if text else []
            first = int(ends[i] - sizes[i])
            parts += [flat.slice(done, first - done), pa.array(own, pa.string())]
            done, sizes[i] = int(ends[i]), len(own)
        flat = pa.concat_arrays([*parts, flat.slice(done)])
    coded = flat.dictionary_encode()
    several = pc.match_substring_regex(coded.dictionary, f"[\\x00-\\x20{MARK}]").to_numpy(zero_copy_only=False)
    return (coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist(),
            ~several, sizes)


def count_units(documents: DataFrame, text_col: str, model: Model) -> DataFrame:
    """(unit, n): units of the corpus, already added up within a task."""
    pattern = model.pattern

    def run(batches):
        from collections import Counter
        find, total = re.compile(pattern).findall, Counter()

        def flush():
            made = pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                names=["unit", "n"])
            total.clear()
            return made

        for batch in slices(batches, TEXTS):
            code, words, lone, _ = _cut(batch.column(0))
            for word, one, n in zip(words, lone.tolist(), np.bincount(code, minlength=len(words)).tolist()):
                if one:
                    total[MARK + word] += n
                else:
                    for unit in units_of(word, find):
                        total[unit] += n
            if len(total) > TASK_UNITS:
                yield flush()
        yield flush()

    return documents.select(F.col(text_col).alias("t")).mapInArrow(run, "unit string, n bigint")


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """(piece, id, score, odd): as many rows as the vocabulary has."""
    odd = model.irregular() if model.kind == "bpe" else set()
    rows = pa.table({"piece": list(model.pieces), "id": pa.array([i for i, _ in model.pieces.values()], pa.int32()),
                     "score": pa.array([s for _, s in model.pieces.values()], pa.float64()),
                     "odd": pa.array([p in odd for p in model.pieces])})
    return spark.createDataFrame(rows)


def lattice(units: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(unit, edges): every piece in the unit, and each character; ``id`` is null without a piece.

    Rows of a unit come one after another, so that grouping them by its number first finds them sorted.
    """
    size, s, e = F.length("unit"), F.col("s"), F.col("e")
    starts = units.select(F.monotonically_increasing_id().alias("no"), "unit").select("no", "unit", F.explode(F.sequence(F.lit(0), size - 1)).alias("s"))
    rows = starts.select("no", "unit", "s", F.explode(F.sequence(s + 1, F.least(s + longest, size))).alias("e")).select(
        "no", "unit", "s", "e", F.substring("unit", s + 1, e - s).alias("piece"))
    return (rows.join(F.broadcast(pieces), "piece", "left").where("id IS NOT NULL OR e = s + 1")
            .groupBy("no", "unit").agg(F.collect_list(F.struct(
                "s", "e", "id", "score", F.coalesce("odd", F.lit(False)).alias("odd"))).alias("edges")).drop("no"))


def _next_to(bounds: Column, x: Column) -> Column:
    """1-based place of x's start among the boundaries if its end is the next but one, else 0."""
    return let(F.array_position(bounds, x["s"]).cast("int"), lambda p: F.when(
        (p > 0) & (F.get(bounds, p + 1) == x["e"]), p).otherwise(0))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), at)


def _ends(x: Column) -> Column:
    return _bit(x["s"]).bitwiseOR(_bit(x["e"]))


def _reach(x: Column) -> Column:
    """The bits of an edge's ends and of all places between."""
    return _bit(x["e"] + 1) - _bit(x["s"])


def _bits(bounds: Column) -> Column:
    """Boundaries as the bits of a number; units here have at most LONG characters."""
    return F.aggregate(bounds, F.lit(0).cast("bigint"), lambda b, x: b.bitwiseOR(_bit(x)))


def _merge_pass(unit: Column, edges: Column) -> Column:
    """Boundaries of the BPE encoding as bits, for edges of regular pieces.

    In the order of their scores, leftmost first, each edge is merged if it
    spans two neighbours at its turn. What lies between two boundaries that
    still stand has met its merges as if alone, and a regular piece alone is
    complete at its turn, so no edge needs a second look.
    """
    ranked = F.array_sort(F.transform(F.filter(edges, lambda x: x["e"] > x["s"] + 1), lambda x: F.struct(
        (-x["score"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.aggregate(ranked, _bit(F.length(unit) + 1) - 1, lambda b, x: F.when(
        (b.bitwiseAND(_ends(x)) == _ends(x)) & (F.bit_count(b.bitwiseAND(_reach(x))) == 3),
        b.bitwiseAND(F.bitwise_not(_reach(x))).bitwiseOR(_ends(x))).otherwise(b))


def _merge_fold(unit: Column, edges: Column) -> Column:
    """Boundaries of the BPE encoding: the best edge of all is sought for each merge."""
    def best(bounds):
        return F.array_max(F.transform(
            F.filter(edges, lambda x: x["e"] > x["s"] + 1),
            lambda x: let(_next_to(bounds, x), lambda p: F.when(p > 0, F.struct(
                x["score"].alias("score"), (-x["s"]).alias("left"), F.get(bounds, p).alias("mid"))))))

    def step(state, _):
        return F.when(state["done"], state).otherwise(let(best(state["b"]), lambda m: F.struct(
            F.when(m.isNull(), state["b"]).otherwise(F.array_remove(state["b"], m["mid"])).alias("b"),
            m.isNull().alias("done"))))

    start = F.struct(F.sequence(F.lit(0), F.length(unit)).alias("b"), (F.length(unit) < 2).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.length(unit)), start, step, lambda s: s["b"])


def _viterbi_fold(unit: Column, edges: Column, low: float) -> Column:
    """Boundaries of the best path; ``low`` is the score of a character without a piece."""
    def step(best, end):
        here = F.array_max(F.transform(
            F.filter(edges, lambda x: (x["e"] == end) & F.get(best, x["s"]).isNotNull()),
            lambda x: F.struct((F.get(best, x["s"])["score"] + F.coalesce(x["score"], F.lit(low))).alias("score"),
                               x["s"].alias("from"))))
        return F.array_append(best, here)

    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from")))
    best = F.aggregate(F.sequence(F.lit(1), F.length(unit)), start, step)

    def back(path, _):
        return let(F.get(path["best"], F.get(path["b"], F.lit(0)))["from"], lambda s: F.struct(
            path["best"].alias("best"),
            F.when(F.get(path["b"], F.lit(0)) == 0, path["b"]).otherwise(F.array_prepend(path["b"], s)).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.length(unit)),
                       F.struct(best.alias("best"), F.array(F.length(unit)).alias("b")), back, lambda s: s["b"])


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """(unit, ids) for each row of ``units`` (distinct).

    Units are dealt out before they grow into edges: about UNITS a partition,
    whose edges are then grouped where they are made.
    """
    spark = units.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), units.count() // UNITS + 1)
    short = units.where(F.length("unit") <= LONG).select("unit").repartition(parts, "unit")
    edges = lattice(short, piece_table(spark, model), model.longest)
    unit, e = F.col("unit"), F.col("edges")
    bounds = _bits(_viterbi_fold(unit, e, model.low)) if model.kind == "unigram" else F.when(
        F.exists(e, lambda x: x["odd"]), _bits(_merge_fold(unit, e))).otherwise(_merge_pass(unit, e))
    if model.byte_ids:
        first = model.byte_ids[0]
        if model.byte_ids != list(range(first, first + 256)):
            raise ValueError("the byte pieces are not in sequence")

        def other(char):
            return let(F.hex(char.cast("binary")), lambda h: F.transform(
                F.sequence(F.lit(0), F.length(h) - 2, F.lit(2)),
                lambda k: F.conv(F.substring(h, k + 1, F.lit(2)), 16, 10).cast("int") + first))
    else:
        def other(char):
            return F.array(F.lit(model.unknown))

    ids = F.flatten(let(bounds, lambda b: F.transform(
        F.array_sort(F.filter(e, lambda x: b.bitwiseAND(_reach(x)) == _ends(x))),
        lambda x: F.when(x["id"].isNotNull(), F.array(x["id"])).otherwise(
            other(F.substring(unit, x["s"] + 1, F.lit(1)))))))
    folded = edges.select("unit", ids.alias("ids"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            found = [shared.value.encode_long(u) for u in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))],
                                             names=["unit", "ids"])

    long = (units.where(F.length("unit") > LONG).select("unit").mapInArrow(run, "unit string, ids array<int>"))
    return folded.unionByName(long)


class Lexicon(Words):
    """Encoded units: where each one's ids start, and all ids in a row."""

    def open(self) -> "Lexicon":
        if self.hashes is None:
            super().open()
            lengths, self.ids = self.values or (np.zeros(0, np.int32), np.zeros(0, np.uint16))
            self.values = []
            self.first = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=self.first[1:])
        return self


def _flat(texts: pa.Array, find) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each unit of the texts in a row, the distinct units, units per text)."""
    code, words, lone, sizes = _cut(texts)
    names = [MARK + w for w, one in zip(words, lone.tolist()) if one]
    number, more = dict(zip(names, range(len(names)))), []
    start, n = np.empty(len(words), np.int64), np.ones(len(words), np.int64)
    start[lone] = np.arange(len(names))
    for i in np.nonzero(~lone)[0].tolist():
        own = units_of(words[i], find)
        start[i], n[i] = len(names) + len(more), len(own)
        more += [number.setdefault(u, len(number)) for u in own]
    units = _runs(np.r_[np.arange(len(names)), np.array(more, np.int64)], start[code], n[code])
    ends = np.cumsum(sizes)
    total = np.r_[0, np.cumsum(n[code])]
    return units, list(number), total[ends] - total[ends - sizes]


def _runs(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The values of many runs one after another."""
    before = np.cumsum(size) - size
    place = np.repeat(start - before, size)
    place += np.arange(len(place))
    return values[place]


def _encode_texts(texts: pa.Array, tails: pa.Array, lexicon: Lexicon, find, spelled: list[bytes]):
    """(ids of all texts in a row, ids per text, the texts that the ids decode to)."""
    codes, units, sizes = _flat(texts, find)
    names = [u.encode() for u in units]
    row = lexicon.find(names)
    lacking = np.nonzero(row < 0)[0]
    extra = {x["unit"].encode(): x["ids"] for tail in tails.to_pylist() for x in tail or ()} if len(lacking) else {}
    more = [extra[names[k]] for k in lacking]
    base = len(lexicon.ids)
    ids = np.concatenate([lexicon.ids, *[np.array(m, np.int32) for m in more]]) if more else lexicon.ids
    known = np.maximum(row, 0)
    first = lexicon.first if len(lexicon.first) > 1 else np.zeros(2, np.int32)
    start, count = first[known].astype(np.int64), (first[known + 1] - first[known]).astype(np.int64)
    lengths = np.array([len(m) for m in more], np.int64)
    start[lacking], count[lacking] = base + np.cumsum(lengths) - lengths, lengths
    # the slice's own units and their ids, then those of its texts
    ids = _runs(ids, start, count).astype(np.int32)
    start = np.cumsum(count) - count
    said = pc.binary_join(pa.ListArray.from_arrays(
        np.r_[start, len(ids)].astype(np.int32), pa.array(spelled, pa.binary()).take(pa.array(ids))), b"")
    ends = np.cumsum(sizes)
    decoded = pc.binary_join(pa.ListArray.from_arrays(
        np.r_[0, ends].astype(np.int32), said.take(pa.array(codes))), b"")
    out = _runs(ids, start[codes], count[codes])
    total = np.r_[0, np.cumsum(count[codes])]
    return out, total[ends] - total[ends - sizes], decoded


def encode(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
           lexicon_bytes: int = LEXICON_BYTES, keep: list[str] | None = None) -> DataFrame:
    """``documents`` with ``piece_ids``, n_pieces and round_trip: whether the ids decode to the text.

    Columns of the input with these names are replaced; ``keep`` names the others to return, all if it is not given.
    """
    spark, pattern = documents.sparkSession, model.pattern
    counted = stored(count_units(documents, text_col, model).groupBy("unit").agg(F.sum("n").alias("n")),
                     "piece-units")
    known = stored(encode_units(counted, model), "piece-lexicon")
    weight = F.octet_length("unit") + 4 * F.size("ids") + 20
    total = known.agg(F.sum(weight)).first()[0] or 0
    if total <= lexicon_bytes:
        sent, rest = known, None
    else:  # the most frequent units that fit
        sized = known.join(counted, "unit")
        fits = F.length("unit") <= LONG
        head = fits & most_frequent(sized.where(fits), "n", weight, lexicon_bytes)
        sent, rest = sized.where(head).select("unit", "ids"), sized.where(~head).select("unit", "ids")
    shared = spark.sparkContext.broadcast(
        (Lexicon(segments(sent.select(F.col("unit").cast("binary").alias("unit"), "ids"))), model.spelled()))
    held = documents.select(F.struct("*").alias("row"), id_key(id_col).alias("id"))
    text = F.col("row").getField(text_col)
    if rest is not None:
        def lacking(batches):
            find = re.compile(pattern).findall
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                codes, units, sizes = _flat(batch.column(1), find)
                absent = shared.value[0].find([u.encode() for u in units]) < 0
                at = np.nonzero(absent[codes])[0]
                doc = np.repeat(np.arange(len(ids)), sizes)[at]
                pairs = list({(ids[d], units[codes[i]]) for d, i in zip(doc.tolist(), at.tolist())})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in pairs], pa.int64()), pa.array([u for _, u in pairs], pa.string())],
                    names=["tail_id", "unit"])

        pairs = held.select("id", text.alias("text")).mapInArrow(lacking, "tail_id bigint, unit string")
        tails = (pairs.join(rest, "unit").groupBy("tail_id")
                 .agg(F.collect_list(F.struct("unit", "ids")).alias("tail")))
        held = held.join(tails, F.col("id") == F.col("tail_id"), "left").drop("tail_id")
    else:
        held = held.withColumn("tail", F.lit(None).cast("array<struct<unit:string,ids:array<int>>>"))

    names = ["piece_ids", "n_pieces", "round_trip"]
    kept = [c for c in (documents.columns if keep is None else keep) if c not in names]
    at = kept.index(text_col) if text_col in kept else len(kept)  # a text is sent once

    def run(batches):
        find, (lexicon, spelled) = re.compile(pattern).findall, shared.value
        lexicon.open()
        for batch in slices(batches, TEXTS // 2):
            texts = pc.fill_null(batch.column(at), "")
            ids, sizes, decoded = _encode_texts(texts, batch.column(batch.num_columns - 1), lexicon, find, spelled)
            texts = texts.cast(pa.binary())
            spaced = pc.starts_with(decoded, b" ")
            same = pc.if_else(spaced, pc.equal(decoded, pc.binary_join_element_wise(b" ", texts, b"")), pc.equal(decoded, texts))
            made = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids)),
                    pa.array(np.asarray(sizes, np.int64)), same]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + made, names=kept + names)

    sent = [*[F.col("row").getField(c) for c in kept], *[text] * (at == len(kept)), F.col("tail")]
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*[F.col(f"`{c}`") for c in kept]).schema.fields]
    return held.select(*[c.alias(f"c{i}") for i, c in enumerate(sent)]).mapInArrow(
        run, ", ".join([*schema, "piece_ids array<int>, n_pieces bigint, round_trip boolean"]))


def decode(df: DataFrame, model: Model, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids; null ids, and ids outside the vocabulary, give nothing."""
    shared = df.sparkSession.sparkContext.broadcast(model.spelled())

    def fn(columns):
        spelled, texts = dict(enumerate(shared.value)), []
        for ids in columns[0].to_pylist():
            text = b"".join([spelled.get(i, b"") for i in ids or ()])
            texts.append(text.removeprefix(b" ").decode("utf-8", "replace"))
        return [pa.array(texts, pa.string())]

    return map_columns(df, {"ids": F.col(ids_col)}, f"{out} string", fn)


def default_model(path: str | None = None) -> Model:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("piece_bpe_32k.model")
    return Model.load(path)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(documents, default_model(), keep=["doc_id"]).select("doc_id", "n_pieces", "round_trip", "piece_ids")
