"""Periodic runs of words, found on a Re-Pair grammar of each text.

A run is a stretch of words with smallest period q whose length is at least
max(``least``, ``exponent`` * q) and which no neighbouring word extends with
period q.

Every pair of neighbouring words inside such a run occurs in the text at least
``exponent`` - 1 times. Pairs that occur more rarely therefore bound the stretches
in which runs can lie, and Re-Pair is run on these stretches only: the most
frequent pair of symbols becomes a new symbol, again and again, until none occurs
twice; equally frequent pairs go in order of their first appearance, which keeps
the grammar shallow. What is left of a stretch is folded into a balanced tree.

A run lies in the expansion of one lowest nonterminal and crosses its boundary
there, between its left and its right part. So the runs that cross the boundary are
computed once for each nonterminal, by the prefix function of Main and Lorentz
(longest common extensions to both sides of the boundary), and translated to all
places where the nonterminal stands. A place where its neighbours extend the run
gives a piece; intervals of one period that overlap by that period are one run, and
merging leaves the maximal ones.

Spark deals the texts to tasks; nothing is shuffled or gathered. A task holds a
slice of its texts. Cost is linear in the words for texts without runs, and about
linear times the grammar's depth in the stretches with repeated pairs.

Defined cases: a null or empty text has no words and no runs, and collapses to an
empty text. Columns of the input stay, but for those named like the results.
"""

import hashlib
import zlib
from collections import Counter, deque
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from askbase.llm.common import map_columns, raw, table

LEAST, EXPONENT = 6, 4
Run = tuple[int, int, int]  # start, length, period


def stretches(ids: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """[start, end) of the maximal stretches whose neighbouring pairs all occur ``times`` times or more."""
    if len(ids) < least:
        return []
    pairs = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    _, which, count = np.unique(pairs, return_inverse=True, return_counts=True)
    often = np.concatenate([[False], count[which] >= times, [False]])
    turns = np.nonzero(often[1:] != often[:-1])[0]
    return [(int(s), int(e) + 1) for s, e in zip(turns[::2], turns[1::2]) if e + 1 - s >= least]


class Grammar:
    """Re-Pair over several sequences of small integers: ``rules`` (left, right), ``starts`` of symbols.

    Symbols below ``base`` are words; symbol base + i is rule i.
    """

    def __init__(self, sequences: Sequence[Sequence[int]], base: int):
        self.base, self.rules = base, []
        self.symbols: list[int] = []
        for sequence in sequences:  # None keeps sequences apart
            self.symbols += sequence
            self.symbols.append(None)
        n = len(self.symbols)
        self.after, self.before = list(range(1, n + 1)), list(range(-1, n - 1))
        self.places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            if self.symbols[i] is not None and self.symbols[i + 1] is not None:
                self.places.setdefault((self.symbols[i], self.symbols[i + 1]), []).append(i)
        self._replace_all()
        self.starts: list[list[int]] = [[]]
        at = 0
        while at < n:
            if self.symbols[at] is None:
                self.starts.append([])
            else:
                self.starts[-1].append(self.symbols[at])
            at = self.after[at]
        self.starts.pop()

    def _current(self, pair: tuple[int, int], places: list[int]) -> list[int]:
        """The places where the pair still stands, without overlaps."""
        found, free = [], -1
        for i in places:
            if i > free and self.symbols[i] == pair[0]:
                j = self.after[i]
                if j < len(self.symbols) and self.symbols[j] == pair[1]:
                    found.append(i)
                    free = j if pair[0] == pair[1] else free
        return found

    def _replace_all(self):
        top = max(map(len, self.places.values()), default=0)
        queues: dict[int, deque] = {}
        for pair, places in self.places.items():
            queues.setdefault(len(places), deque()).append(pair)
        for level in range(top, 1, -1):
            queue = queues.get(level, deque())
            while queue:
                pair = queue.popleft()
                places = self._current(pair, self.places.get(pair, ()))
                if len(places) < level:  # fewer by now: wait for that level
                    self.places[pair] = places
                    if len(places) > 1:
                        queues.setdefault(len(places), deque()).append(pair)
                    continue
                del self.places[pair]
                for fresh in self._replace(pair, places):
                    count = min(len(self.places[fresh]), level)
                    if count > 1:
                        queues.setdefault(count, deque()).append(fresh)

    def _replace(self, pair: tuple[int, int], places: list[int]) -> list[tuple[int, int]]:
        """Put a new symbol at ``places``; the new pairs in order of appearance."""
        symbol = self.base + len(self.rules)
        self.rules.append(pair)
        symbols, after, before = self.symbols, self.after, self.before
        for i in places:
            j = after[i]
            k = after[j]
            symbols[i], symbols[j] = symbol, None
            after[i] = k
            if k < len(symbols):
                before[k] = i
        fresh: dict[tuple[int, int], list[int]] = {}
        for i in places:
            h, k = before[i], after[i]
            if h >= 0 and symbols[h] is not None and symbols[h] != symbol:
                fresh.setdefault((symbols[h], symbol), []).append(h)
            if k < len(symbols) and symbols[k] is not None:
                fresh.setdefault((symbol, symbols[k]), []).append(i)
        self.places.update(fresh)
        return list(fresh)


def _z(s: list[int]) -> list[int]:
    """For each position the length of the longest common prefix of ``s`` and its rest."""
    n = len(s)
    z, left, right = [0] * n, 0, 0
    if n:
        z[0] = n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(u: list[int], v: list[int], least: int, exponent: int) -> dict[tuple[int, int], int]:
    """{(start, end): smallest period} of the stretches of u + v that hold words of both, are long
    enough for a run and that no word of u + v extends."""
    found: dict[tuple[int, int], int] = {}
    if len(u) + len(v) < least:
        return found
    for flip in (False, True):  # first the periods whose repeats lie on the right, then on the left
        a, b = (u, v) if not flip else (v[::-1], u[::-1])
        z, first = _z(b) + [0], {}
        for q in range(1, min(2 * len(b) // exponent, (len(u) + len(v)) // exponent) + 1):
            reach, back = q + z[q], 0
            if 2 * reach < exponent * q:  # half of the run lies on this side
                continue
            if first.setdefault(reach, q) < q and not q % first[reach]:  # the same stretch again
                continue
            while back < len(a) and a[-1 - back] == (b[q - 1 - back] if back < q else a[q - 1 - back]):
                back += 1
            if back and back + reach >= max(least, exponent * q):
                start, end = len(a) - back, len(a) + reach
                if flip:
                    start, end = len(u) + len(v) - end, len(u) + len(v) - start
                found[start, end] = min(q, found.get((start, end), q))
    return found


def grammar_runs(sequences: Sequence[Sequence[int]], base: int, least: int, exponent: int) -> list[list[Run]]:
    """The runs of each sequence, by start and period."""
    grammar = Grammar(sequences, base)
    rules = list(grammar.rules)
    tops = []
    for symbols in grammar.starts:  # balanced trees over what Re-Pair left
        while len(symbols) > 1:
            paired = []
            for i in range(0, len(symbols) - 1, 2):
                rules.append((symbols[i], symbols[i + 1]))
                paired.append(base + len(rules) - 1)
            symbols = paired + symbols[len(symbols) - len(symbols) % 2:]
        tops.append(symbols[0] if symbols else None)
    # each nonterminal's places: those of its parents, moved by where it stands in them
    sizes, lengths = [], (lambda x: 1 if x < base else sizes[x - base])
    for left, right in rules:
        sizes.append(lengths(left) + lengths(right))
    texts: dict[int, list[int]] = {}
    own: list[dict[tuple[int, int], int]] = []
    expand = lambda x: [x] if x < base else texts[x]
    last = {}
    for i, (left, right) in enumerate(rules):
        last[left] = last[right] = i
    for i, (left, right) in enumerate(rules):
        u, v = expand(left), expand(right)
        own.append(crossing(u, v, least, exponent))
        texts[base + i] = u + v
        for x in (left, right):  # an expansion is dropped after its last use
            if last[x] == i:
                texts.pop(x, None)
    places: list[list[tuple[int, int]]] = [[] for _ in rules]
    for number, top in enumerate(tops):
        if top is not None and top >= base:
            places[top - base].append((number, 0))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    needed = [bool(x) for x in own]
    for i, (left, right) in enumerate(rules):
        needed[i] = needed[i] or any(x >= base and needed[x - base] for x in (left, right))
    for i in range(len(rules) - 1, -1, -1):
        left, right = rules[i]
        for (start, end), q in own[i].items():
            for number, at in places[i]:
                found.setdefault((number, q), []).append((at + start, at + end))
        if left >= base and needed[left - base]:
            places[left - base] += places[i]
        if right >= base and needed[right - base]:
            shift = lengths(left)
            places[right - base] += [(number, at + shift) for number, at in places[i]]
        places[i] = []
    out: list[list[Run]] = [[] for _ in sequences]
    for (number, q), intervals in found.items():
        intervals.sort()
        start, end = intervals[0]
        for s, e in intervals[1:]:
            if s + q <= end:  # they share a period's length of words
                end = max(end, e)
            else:
                out[number].append((start, end - start, q))
                start, end = s, e
        out[number].append((start, end - start, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def find_runs(words: Sequence[bytes], least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """All runs of ``words`` by start and period."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    parts = stretches(ids, exponent - 1, least)
    if not parts:
        return []
    found = grammar_runs([ids[s:e].tolist() for s, e in parts], len(known), least, exponent)
    return sorted(((start + s, length, q) for (s, _), runs in zip(parts, found) for start, length, q in runs),
                  key=lambda r: (r[0], r[2]))


def collapsed(words: Sequence[bytes], runs: Sequence[Run]) -> bytes:
    """``words`` without those that repeat a run's first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words), bool)
    for start, length, q in runs:
        drop[start + q:start + length] = True
    return b" ".join(w for w, gone in zip(words, drop.tolist()) if not gone)


def with_runs(df: DataFrame, text_col: str = "text", id_col: str | None = None,
              prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``df`` with n_words, runs (start, length, period) by start and period, and collapsed (a text).

    ``prepare`` may make other words of an id and a text's words before the search.
    """
    def fn(columns):
        counts, found, texts = [], [], []
        for doc, text in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            words = text.split()
            if prepare:
                words = prepare(doc, words)
            runs = find_runs(words)
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            texts.append(collapsed(words, runs))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array(found, kind),
                pa.array(texts, pa.binary()).cast(pa.string())]

    doc = F.col(f"`{id_col}`") if id_col else F.lit(None).cast("bigint")
    return map_columns(df, {"id": doc, "text": raw(f"`{text_col}`")},
                       "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
                       fn)


def periodic_tail(doc: object, words: list[bytes]) -> list[bytes]:
    """The contract's periodic texts: a tenth of the ids repeat the words after a point; null ids do not."""
    if doc is None or not words:
        return words
    h = zlib.crc32(str(doc).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", periodic_tail)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("b"),
                        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"),
        (-F.col("b.period")).alias("period"),
        F.expr("1000 * b.length div -b.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
