"""Spelling variants of a corpus's words, found on a bit-sliced position index.

Words are counted with partial sums in the tasks. Two words are near if one
inserted, deleted or replaced code point makes one of the other. Cut the shorter
word of a near pair, of m code points, at m // 2: the error lies on one side and
the other side is common to both words, as their head or as their tail. So a word is
dealt to four groups, by head and by tail, as the shorter word (m its length) and as
the longer one. A pair is counted by its head, and by its tail only if the heads
differ: exactly once. A group with more than ``crowd`` words is dealt out again with
the zone of the error cut in two, as often as needed; with a zone of one letter its
size is bounded by the alphabet.

Each group gets an index: for each position and letter a bitset over its words, held
in one integer. For a word the recurrence goes through the letters and keeps the
words that agree so far, and those with one letter replaced, put in or left out so far,
read at the same position, one further or one before. A step takes a few
word-parallel operations whatever the group's size. Bits go by count, then by code
points, so the lowest bit of a result is the form and the number of its bits the
number of near words: no pair is ever written.

Forms are followed by pointer doubling on the shared folder's tables.

Defined cases: a null text has no words; a null id counts as an empty one. Repeated
rows count each. Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are
lower-cased. Other columns of the input are ignored, whatever their names.
"""

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm.common import raw, slices, stored, table

LETTERS = re.compile("[a-zÀ-ÿ]+")  # of lower-cased texts
MIN_LENGTH, MIN_COUNT, FACTOR, CROWD = 5, 3, 2, 4096
#: Words counted in a task before they are handed on.
HELD = 200_000


def word_counts(documents: DataFrame, id_col: str, text_col: str, min_length: int,
                change: Callable[[object, Counter], Iterable[tuple[str, int]]] | None) -> DataFrame:
    """(word, n): partial counts of the words that are long enough."""
    def run(batches):
        counts: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                               pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = Counter(w for w in LETTERS.findall(text.lower().decode("utf-8", "replace")) if len(w) >= min_length)
                for word, n in change(doc, own) if change else own.items():
                    if len(word) >= min_length:
                        counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield rows()
                    counts.clear()
        yield rows()

    return (documents.select(F.col(f"`{id_col}`").alias("id"), raw(f"`{text_col}`").alias("t"))
            .mapInArrow(run, "word string, n bigint"))


def vocabulary(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
               min_count: int = MIN_COUNT, change=None) -> DataFrame:
    """(word, n): the words with ``min_count`` occurrences or more; ``change`` may alter a text's words."""
    return (word_counts(documents, id_col, text_col, min_length, change).groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


class PositionIndex:
    """Bitsets of words by position and letter."""

    def __init__(self, words: list[str]):
        places: dict[tuple[int, str], list[int]] = {}
        lengths: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            lengths.setdefault(len(word), []).append(k)
            for place in enumerate(word):
                places.setdefault(place, []).append(k)
        self.size = len(words)
        self.at = {p: self._bits(ks) for p, ks in places.items()}
        self.length = {n: self._bits(ks) for n, ks in lengths.items()}

    def _bits(self, members: list[int]) -> int:
        if len(members) < 16:
            return sum(1 << k for k in members)
        flags = np.zeros(self.size, np.uint8)
        flags[members] = 1
        return int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")

    def near(self, word: str, m: int, known: int = 0, apart: int = 0) -> int:
        """The words of m or m + 1 letters near ``word``, one of the two having m letters.

        All words of the index begin with the same ``known`` letters; those that
        share the first ``apart`` letters with ``word`` (0: none) are left out.
        """
        same = every = (1 << self.size) - 1
        replaced = longer = shorter = shared = 0
        at, own = self.at.get, len(word) == m
        for i in range(known, len(word)):
            letter = word[i]
            hit = at((i, letter), 0)
            if own:
                replaced = (replaced & hit) | (same & ~hit)
                longer = (longer | same) & at((i + 1, letter), 0)  # a letter was put in before this one
            else:
                shorter = (shorter & at((i - 1, letter), 0)) | same  # this letter was left out, or an earlier one
            same &= hit
            if i + 1 == apart:
                shared = same
        if own:
            found = replaced & self.length.get(m, 0) | (longer | same) & self.length.get(m + 1, 0)
        else:
            found = shorter & self.length.get(m, 0)
        return found & (every ^ shared)


def _deal(words: DataFrame, min_length: int) -> DataFrame:
    """(m, head, tail, apart, first, last, word, n): each word with its groups.

    A group's words share ``head`` letters (first) and ``tail`` letters (last); its pairs
    differ in the first ``apart`` letters (0: no matter).
    """
    m = F.explode(F.expr(f"filter(array(length(word), length(word) - 1), m -> m >= {min_length})"))
    both = words.select("word", "n", m.alias("m")).withColumn("h", F.floor(F.col("m") / 2).cast("int"))
    zero = F.lit(0)
    return _named(both.select("word", "n", "m", F.explode(F.array(
        F.struct(F.col("h").alias("head"), zero.alias("tail"), zero.alias("apart")),
        F.struct(zero.alias("head"), (F.col("m") - F.col("h")).alias("tail"), F.col("h").alias("apart")))).alias("g")
    ).select("m", "g.*", "word", "n"))


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("m", "head", "tail", "apart", F.expr("left(word, head)").alias("first"),
                       F.expr("right(word, tail)").alias("last"), "word", "n")


GROUP = ["m", "head", "tail", "apart", "first", "last"]


def groups(words: DataFrame, min_length: int = MIN_LENGTH, crowd: int = CROWD) -> DataFrame:
    """The dealt rows, crowded groups cut until they are small or one letter is open."""
    rows, done, k = _deal(words, min_length), None, 0
    while True:
        sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("size"))
        crowded = stored(sizes.where((F.col("size") > crowd) & (F.col("m") - F.col("tail") - F.col("head") > 1))
                         .select(*[F.col(c).alias(f"c_{c}") for c in GROUP]), f"variants-crowded-{k}")
        if crowded.isEmpty():
            return rows if done is None else done.unionByName(rows)
        match = [F.col(c) == F.col(f"c_{c}") for c in GROUP]
        small = rows.join(crowded, match, "left_anti")
        done = small if done is None else done.unionByName(small)
        middle = F.col("head") + F.floor((F.col("m") - F.col("tail") - F.col("head")) / 2).cast("int")
        cut = rows.join(crowded, match, "left_semi").withColumn("middle", middle)
        rows = stored(_named(cut.select("word", "n", "m", F.explode(F.array(
            F.struct(F.col("middle").alias("head"), F.col("tail").alias("tail"), F.col("apart").alias("apart")),
            F.struct(F.col("head").alias("head"), (F.col("m") - F.col("middle")).alias("tail"),
                     F.col("middle").alias("apart")))).alias("g")).select("m", "g.*", "word", "n")), f"variants-cut-{k}")
        k += 1


def _found(batches: Iterator[pa.RecordBatch]):
    """(word, near, best_n, best) for rows sorted by group, count falling and word."""
    group, words, counts = None, [], []
    out: list[tuple] = []

    def search():
        if len(words) < 2:
            return
        m, head, _, apart = group[:4]
        index = PositionIndex(words)
        for word in words:
            if found := index.near(word, m, head, apart):
                best = (found & -found).bit_length() - 1
                out.append((word, found.bit_count(), counts[best], words[best]))

    def rows():
        w, near, n, best = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(near, pa.int64()), pa.array(n, pa.int64()),
                                           pa.array(best, pa.string())], names=["word", "near", "best_n", "best"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(8)]
        for row in zip(*columns):
            if row[:6] != group:
                search()
                group, words, counts = row[:6], [], []
            words.append(row[6])
            counts.append(row[7])
        if len(out) > 10_000:
            yield rows()
            out.clear()
    search()
    if out:
        yield rows()


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, crowd: int = CROWD) -> DataFrame:
    """(word, n_near, best_n, best) for the words of ``words`` (word, n; distinct) with a near one."""
    dealt = groups(words, min_length, crowd).withColumn("less", -F.col("n"))
    found = (dealt.repartition(*GROUP).sortWithinPartitions(*GROUP, "less", "word").drop("less")
             .mapInArrow(_found, "word string, near bigint, best_n bigint, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last form that forms lead to."""
    now, k = stored(forms.select("word", F.col("form").alias("root")), "variants-roots"), 0
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            f"variants-roots-{k}")
        now, k = moved.select("word", "root"), k + 1
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR,
                      crowd: int = CROWD, change=None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the vocabulary.

    A word's form is its near word of largest count (ties: first in code-point
    order) if that count is at least ``factor`` times the word's.
    """
    words = stored(vocabulary(documents, id_col, text_col, min_length, min_count, change), "variants-words")
    near = near_words(words, min_length, crowd)
    is_form = F.col("best_n") >= factor * F.col("n")
    all_words = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")),
        "variants-forms")
    ends = roots(all_words.where("form IS NOT NULL"))
    return all_words.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def misspelt(doc: object, words: Counter) -> Iterator[tuple[str, int]]:
    """The contract's misspellings: some words of a document lose a letter there."""
    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for word, n in words.items():
        h = zlib.crc32(word.encode(), start)
        if h % 97 == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        yield word, n


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), change=misspelt).select(
        "word", "form", "root", "n", "n_near", "form_n")
