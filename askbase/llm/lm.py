"""Scoring texts with a log-bilinear language model trained by noise-contrastive estimation.

Tokens are lower-cased words and one end for each text. The ``head`` most
frequent training words and the end are classes of their own. Every other word
with ``least`` or more occurrences is a leaf with a vector of its own, so the
model grows with the corpus: leaves in order of frequency hang below groups,
and groups below up to ``TOP`` classes. Words seen less often share the class
*other*. The probability of a leaf is that of its class, times that of its
group in the class, times its own in the group; each factor is log-bilinear and
normalised, so only siblings are summed over.

A context's two classes give a predicted vector, the sum of their vectors
scaled by the position's weights; its products with the vectors of classes,
groups or leaves, plus biases, are their scores. Training contrasts each next
class with classes drawn from the unigram distribution, and in the last round,
when the contexts have settled, each group and leaf with its siblings, drawn
evenly, so no step sums over all classes or leaves: numpy minibatches run inside the tasks over
all training texts, and after each round the tasks' parameters are averaged,
those of classes weighted by tokens, those of groups and leaves by the times a
task met them. There are as many training tasks as cores, however many files;
how the texts are dealt to them changes the parameters a little. Within
*other* a seen token has its share of the class, discounted by the Good-Turing
share of words seen once, which is the share of the unseen token. The whole is
a distribution over the training tokens and one unseen token, as the unigram
base score is.

Counts cover all training texts. Texts are split into words twice, for the
counts and for their codes (a class or a leaf for each token), which are
stored; training and scoring read the codes. The tasks hold the most frequent
tokens' counts, up to ``lexicon_bytes``; the other tokens of a text (few, as
they are rare) are joined with their counts, so no text is shuffled and no
count of the corpus meets in one place. Leaves with their vectors take up to
``vector_bytes``, the most frequent first (about 900,000 words); the words
beyond are in *other*, as those seen too seldom are.

Defined cases: a null or empty text is one end token. A null id counts as the
empty string for the split. Rows that repeat are scored, and learned from, one
by one. Without any training text every base score is 0 (N = V = 0) and the
model keeps its start, equal classes.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import raw, slices, stored, table
from askbase.llm.packed import Words, give_back, most_frequent, segments

HEAD, DIM, CONTEXT, NOISE, BATCH, ROUNDS, RATE, SEED = 510, 16, 2, 48, 4096, 2, 0.1, 42
LEAST, TOP, SIBLINGS, TREE_BATCH, TREE_RATE = 5, 64, 8, 1 << 18, 0.5
STACK, PIECE = 1 << 19, 1 << 12  # numbers worked on at once, rows of a family scored at once
LEXICON_BYTES, VECTOR_BYTES, COUNTED, CODED, SCORED = 128 << 20, 96 << 20, 24 << 20, 6 << 20, 4 << 20
END, OTHER = 0, 1


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words of some texts as bytes, one after another; where each text's words end)."""
    lower = pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset))
    lists = pc.ascii_split_whitespace(lower)
    flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy())
    kept = pc.greater(pc.binary_length(flat), 0)  # white space around a text leaves an empty part
    ends = np.r_[0, np.cumsum(kept.to_numpy(zero_copy_only=False))][ends]
    return flat.filter(kept).view(pa.binary()), ends


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, c) over the rows of ``texts`` (t: bytes), counted in large slices first."""
    def run(batches):
        for batch in slices(batches, COUNTED):
            met = words_of(batch.column(0))[0].value_counts()
            yield pa.RecordBatch.from_arrays([met.field(0), met.field(1)], names=["token", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([b""], pa.binary()), pa.array([batch.num_rows], pa.int64())],
                                             names=["token", "c"])

    return texts.mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


class LogBilinear:
    """Parameters and their use; contexts are given as class numbers, ``classes`` is the text's start."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        rng = np.random.default_rng(SEED)
        self.unigram = (counts + 1.0) / (counts + 1.0).sum()
        self.context = rng.normal(0, 0.1, (n + 1, DIM)).astype(np.float32)
        self.target = rng.normal(0, 0.1, (n, DIM)).astype(np.float32)
        self.bias = np.log(self.unigram).astype(np.float32)[:, None]
        self.scale = np.ones((CONTEXT, DIM), np.float32)
        self.sums = None  # of the contexts met, when scoring

    NAMES = ("context", "target", "bias", "scale")

    @property
    def classes(self) -> int:
        return len(self.bias)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        return sum(self.context.take(contexts[:, i], axis=0) * self.scale[i] for i in range(CONTEXT))

    def contexts(self, sequence: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """The classes before each one of a text, or of the texts that begin at ``starts``, in columns."""
        n, starts = len(sequence), np.zeros(1, np.int64) if starts is None else starts
        padded = np.r_[np.full(CONTEXT, self.classes, np.int32), sequence]
        out = np.stack([padded[i:i + n] for i in range(CONTEXT)]).T
        sizes = np.diff(starts, append=n)
        for place in range(CONTEXT):
            out[starts[sizes > place] + place, :CONTEXT - place] = self.classes
        return out

    def train(self, contexts: np.ndarray, targets: np.ndarray, rng, squares: dict) -> None:
        """One NCE step with adaptive rates on a minibatch; its noise classes are shared, one drawn several times counts as often."""
        self.sums = None
        noise, times = np.unique(rng.choice(self.classes, NOISE, p=self.unigram), return_counts=True)
        shift = np.log(NOISE * self.unigram).astype(np.float32)
        hidden = self.predicted(contexts)
        met, offset = self.target.take(targets, axis=0), self.bias[:, 0] - shift
        own = np.einsum("ij,ij->i", hidden, met) + offset[targets]
        wrong = hidden @ -self.target[noise].T
        wrong -= offset[noise]
        right = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # 1 - P(data)
        np.exp(np.clip(wrong, -30, 30, out=wrong), out=wrong)
        np.divide(-times.astype(np.float32), np.add(wrong, 1, out=wrong), out=wrong)
        back = right[:, None] * met + wrong @ self.target[noise]
        add = {"target": _sums(targets, right[:, None] * hidden, self.classes),
               "bias": _sums(targets, right[:, None], self.classes),
               "context": np.zeros_like(self.context), "scale": np.zeros_like(self.scale)}
        add["target"][noise] += wrong.T @ hidden
        add["bias"][noise, 0] += np.einsum("ij->j", wrong)
        for i in range(CONTEXT):
            add["context"] += _sums(contexts[:, i], back * self.scale[i], self.classes + 1)
            add["scale"][i] = np.einsum("ij,ij->j", back, self.context.take(contexts[:, i], axis=0))
        for name, g in add.items():
            g /= len(targets)
            squares[name] += g * g
            getattr(self, name)[...] += RATE * g / np.sqrt(squares[name] + 1e-8)

    @property
    def steps(self) -> np.ndarray:
        return (self.classes + 1) ** np.arange(CONTEXT)

    def pairs(self, contexts: np.ndarray) -> np.ndarray:
        """One number for each context."""
        return contexts @ self.steps

    def log_sums(self, contexts: np.ndarray) -> np.ndarray:
        """ln of the sum of exp of all class scores, for each context."""
        out = np.empty(len(contexts))
        for s in range(0, len(contexts), 4096):
            scores = self.predicted(contexts[s:s + 4096]) @ self.target.T + self.bias[:, 0]
            top = scores.max(axis=1)
            scores -= top[:, None]
            out[s:s + 4096] = top + np.log(np.exp(scores, out=scores).sum(axis=1))
        return out

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """ln P(target | context), normalised over the classes; a pair of classes is summed over once."""
        if self.sums is None:
            self.sums = np.full((self.classes + 1) ** CONTEXT, np.nan)
        steps = self.steps
        own = np.empty(len(targets))
        for s in range(0, len(targets), 1 << 16):
            c, t = contexts[s:s + (1 << 16)], targets[s:s + (1 << 16)]
            code = self.pairs(c)
            new = np.unique(code[np.isnan(self.sums[code])])
            self.sums[new] = self.log_sums(new[:, None] // steps % (self.classes + 1))
            own[s:s + (1 << 16)] = np.einsum("ij,ij->i", self.predicted(c), self.target.take(t, axis=0)) + self.bias[t, 0] - self.sums[code]
        return own


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number."""
    width = values.shape[1]
    if width == 1:
        return np.bincount(rows, values.ravel(), n).reshape(n, 1).astype(np.float32)
    half = width // 2  # two numbers are added at a time
    out = np.zeros(n * half, np.complex128)
    at = (np.multiply(rows, half, dtype=np.intp)[:, None] + np.arange(half)).ravel()
    np.add.at(out, at, values.astype(float).view(np.complex128).ravel())
    return out.view(float).reshape(n, width).astype(np.float32)


class Tree:
    """Groups and leaves below the top classes; level 0 holds the leaves, the last level hangs below the classes."""

    def __init__(self, counts: np.ndarray):
        """``counts`` of the leaves, the most frequent first."""
        self.arity = max(2, math.ceil(math.sqrt(len(counts) / TOP)))
        self.levels, self.leaf_counts = [], counts
        below = counts.astype(float)
        for _ in range(2):
            above = np.add.reduceat(below, np.arange(0, len(below), self.arity)) if len(below) else below
            level = np.zeros((len(below), DIM + 1), np.float32)  # the bias is last
            level[:, -1] = np.log(below / np.repeat(above, self.arity)[:len(below)])
            self.levels.append(level)
            below = above
        self.top_counts = below

    def top(self, leaf: np.ndarray) -> np.ndarray:
        return leaf // np.int32(self.arity ** len(self.levels))

    def stacks(self, parent: np.ndarray, width: int, piece: int | None = None):
        """Rows sorted by their family's parent, in stacks of families of about the same size.

        (rows, number and first node of each family); a family's rows are filled up with the row after the last.
        A row takes ``width`` numbers. Families are cut at every ``piece`` rows if given.
        """
        starts = np.nonzero(np.diff(parent, prepend=-1))[0]
        family = np.arange(len(starts))
        if piece:
            starts = np.union1d(starts, np.arange(0, len(parent), piece))
            family = np.cumsum(np.diff(parent[starts], prepend=-1) > 0) - 1
        sizes = np.diff(starts, append=len(parent))
        order = np.argsort(sizes, kind="stable")
        ranked, s = sizes[order], 0
        while s < len(order):
            e = int(np.searchsorted(ranked, ranked[s] * 5 // 4, side="right"))
            e = max(s + 1, min(e, s + STACK // int(ranked[e - 1] * width)))
            own, place = order[s:e], np.arange(ranked[e - 1])
            rows = np.where(place < sizes[own][:, None], starts[own][:, None] + place, len(parent))
            yield rows, family[own], parent[starts[own]].astype(np.int64) * self.arity
            s = e

    def log_probabilities(self, hidden: np.ndarray, leaf: np.ndarray, pair: np.ndarray | None = None) -> np.ndarray:
        """ln P(leaf | its top class, context), contexts with one number ``pair`` being the same.

        A family is summed over once for a context; families of like sizes share a matrix product.
        """
        pair = np.arange(len(leaf)) if pair is None else pair
        out, kinds = np.zeros(len(leaf)), int(pair.max(initial=0)) + 1
        for depth, level in enumerate(self.levels):
            key = (leaf // np.int32(self.arity ** (depth + 1))).astype(np.int64) * kinds + pair
            order = np.argsort(key)
            new = np.diff(key[order], prepend=-1) > 0
            context, sums = _with_bias(hidden, order[new]), np.zeros(int(new.sum()) + 1)
            for rows, _, first in self.stacks(key[order[new]] // kinds, self.arity, PIECE):
                nodes = first[:, None] + np.arange(self.arity)
                scores = context.take(rows, axis=0) @ level.take(nodes, axis=0, mode="clip").transpose(0, 2, 1)
                if nodes.max() >= len(level):  # the last family is not full
                    scores += np.where(nodes < len(level), 0, -np.inf).astype(np.float32)[:, None]
                scores = scores.reshape(-1, self.arity)
                top = scores.max(axis=1)
                scores -= top[:, None]
                sums[rows.ravel()] = top + np.log(np.exp(scores, out=scores) @ np.ones(self.arity, np.float32))
            out[order] -= sums[np.cumsum(new) - 1]
            node = level.take(leaf // np.int32(self.arity ** depth), axis=0)
            out += np.einsum("ij,ij->i", node[:, :-1], hidden) + node[:, -1]
        return out

    def train(self, hidden: np.ndarray, leaf: np.ndarray, rng, squares: list, met: list) -> None:
        """One NCE step for the words met and one for each family's noise, up to ``SIBLINGS`` of it drawn evenly."""
        order = np.argsort(leaf, kind="stable")
        padded, leaf = _with_bias(hidden, order), leaf[order]
        context = padded[:-1]

        def step(depth, rows, g):
            total = squares[depth].take(rows, axis=0) + g * g
            squares[depth][rows] = total
            self.levels[depth][rows] += TREE_RATE * g / np.sqrt(total)

        for depth, level in enumerate(self.levels):
            node = leaf // np.int32(self.arity ** depth)
            parent = node // np.int32(self.arity)
            size = np.minimum(self.arity, len(level) - parent * self.arity)
            shift = np.log(np.minimum(SIBLINGS, size) / size).astype(np.float32)  # of a sibling's expected draws
            own = np.einsum("ij,ij->i", level.take(node, axis=0), context) - shift
            right = 1 / (1 + np.exp(np.clip(own, -30, 30)))  # P(noise)
            starts = np.nonzero(np.diff(node, prepend=-1))[0]
            step(depth, node[starts], np.add.reduceat(right[:, None] * context, starts))
            met[depth][node[starts]] += np.diff(starts, append=len(node))
            heads = np.nonzero(np.diff(parent, prepend=-1))[0]
            drawn = np.full((len(heads), SIBLINGS), -1)
            for k, n in enumerate(size[heads].tolist()):
                drawn[k, :min(SIBLINGS, n)] = rng.permutation(n)[:SIBLINGS]
            for rows, family, first in self.stacks(parent, 2 * (DIM + 1)):
                nodes, some = drawn[family], drawn[family] >= 0
                nodes += first[:, None]
                met_here = padded.take(rows, axis=0)
                scores = level.take(nodes, axis=0, mode="clip") @ met_here.transpose(0, 2, 1) - shift[rows[:, :1, None]]
                wrong = -1 / (1 + np.exp(-np.clip(scores, -30, 30)))
                step(depth, nodes[some], (wrong @ met_here)[some])
                met[depth][nodes[some]] += np.repeat(1e-3 * (rows < len(leaf)).sum(axis=1), some.sum(axis=1))


def _with_bias(hidden: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The contexts in an order, with a 1 for the bias, and a row of zeros after the last."""
    out = np.zeros((len(order) + 1, hidden.shape[1] + 1), np.float32)
    out[:-1, :-1] = hidden.take(order, axis=0)
    out[:-1, -1] = 1
    return out


class Codes:
    """Numbers of tokens: a class below ``base``, or ``base`` and the leaf's number."""

    def __init__(self, words: Words, head: list[bytes], least: int):
        self.words, self.head, self.least, self.code = words, head, least, None

    @property
    def base(self) -> int:
        return len(self.head) + 2

    def open(self) -> "Codes":
        if self.code is None:
            values = self.words.open().values
            self.count = np.r_[values[0] if values else [], 0].astype(np.int64)  # the last one for unknown words
            self.code = np.full(len(self.count), OTHER, np.int32)
            apart = self.words.find([b"", *self.head])
            leaves = np.argsort(-self.count[:-1], kind="stable")
            leaves = leaves[(self.count[leaves] >= self.least) & ~np.isin(leaves, apart)]
            self.code[leaves] = self.base + np.arange(len(leaves))
            self.code[apart[apart >= 0]] = np.r_[END, np.arange(2, self.base)][apart >= 0]
        return self

    def encode(self, flat: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row in the lexicon or -1, code) of each word, and of the end after each text."""
        coded = flat.dictionary_encode()
        row = self.words.find(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        at = coded.indices.to_numpy()
        return (np.insert(row.take(at), ends, self.words.find([b""])[0]), np.insert(self.code[row].take(at), ends, END))


def _encode_batches(shared):
    def run(batches):
        codes, total, kinds = shared.value
        codes.open()
        log_base = np.log10((codes.count + 1.0) / (total + kinds + 1.0))
        log_count = np.log10(np.maximum(codes.count, 1))
        for batch in slices(batches, CODED):
            flat, ends = words_of(batch.column(3))
            row, code = codes.encode(flat, ends)
            size = np.diff(ends, prepend=0) + 1
            found, other = row >= 0, code == OTHER
            at = np.r_[0, np.cumsum(size)]

            def per_text(x, at=at):
                return pa.array(np.add.reduceat(x, at[:-1]))

            mine: list[Counter] = [Counter() for _ in size]
            doc = np.repeat(np.arange(len(size)), size)
            lost = np.nonzero(~found)[0]
            named = lost[lost != at[doc[lost] + 1] - 1]  # the others are ends
            for d, w in zip(doc[named].tolist(), flat.take(pa.array(named - doc[named])).to_pylist()):
                mine[d][w] += 1
            for d in np.setdiff1d(lost, named):
                mine[doc[d]][b""] += 1
            lacking = [[{"token": w, "n": n} for w, n in c.items()] for c in mine]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(size.astype(np.int64)),
                 pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * at).astype(np.int32)),
                                                                pa.py_buffer(code.astype(np.int32))]),
                 per_text(np.where(found, log_base[row], 0.0)), per_text(found.astype(np.int64)),
                 per_text(np.where(found & other, log_count[row], 0.0)), per_text((found & other).astype(np.int64)),
                 pa.array(lacking, pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())])))],
                names=["rid", "doc_id", "held_out", "n_tokens", "seq", "b", "known", "oc", "on", "rare"])
    return run


class Model:
    """The classes' model and the tree below it; ``base`` is the number of classes without leaves."""

    def __init__(self, counts: np.ndarray, leaves: np.ndarray):
        self.base, self.tree = len(counts), Tree(leaves)
        self.words = LogBilinear(np.r_[counts, self.tree.top_counts])

    def read(self, seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, classes, leaves) of all tokens of some texts; a token without leaf has a negative one."""
        leaf = np.frombuffer(b"".join(seqs), np.int32) - np.int32(self.base)
        classes = np.where(leaf < 0, leaf, self.tree.top(leaf)) + np.int32(self.base)
        sizes = np.array([len(s) // 4 for s in seqs])
        return self.words.contexts(classes, np.cumsum(sizes) - sizes), classes, leaf

    def log_probabilities(self, seqs: list[bytes]) -> np.ndarray:
        contexts, classes, leaf = self.read(seqs)
        out = self.words.log_probabilities(contexts, classes)
        at = np.nonzero(leaf >= 0)[0]
        for s in range(0, len(at), 1 << 19):
            part = at[s:s + (1 << 19)]
            own = contexts[part]
            out[part] += self.tree.log_probabilities(self.words.predicted(own), leaf[part], self.words.pairs(own))
        return out


PARAMETERS = "slot string, at int, w binary, v binary"


def _learner(shared, turn: int, with_tree: bool):
    """Trains on one task's texts; gives its parameters in blocks of rows, with weights."""
    def run(batches):
        model = shared.value
        own, tree = model.words, model.tree
        rng = np.random.default_rng((SEED, turn, TaskContext.get().partitionId()))
        squares = {n: np.full_like(getattr(own, n), 1e-6) for n in LogBilinear.NAMES}
        tree_squares = [np.ones_like(x) for x in tree.levels] if with_tree else []
        met = [np.zeros(len(x), np.float32) for x in tree.levels] if with_tree else []
        seen, held, size = 0, [], 0

        def learn():
            contexts, classes, leaf = model.read(held)
            for s in range(0, len(classes), BATCH):
                own.train(contexts[s:s + BATCH], classes[s:s + BATCH], rng, squares)
            at = np.nonzero(leaf >= 0)[0] if with_tree else []
            for s in range(0, len(at), TREE_BATCH):
                part = at[s:s + TREE_BATCH]
                tree.train(own.predicted(contexts[part]), leaf[part], rng, tree_squares, met)
            return len(classes)

        for batch in slices(batches):
            for seq in batch.column(0).to_pylist():
                held.append(seq)
                size += len(seq) // 4
                if size >= 2 * TREE_BATCH:  # about half the tokens are leaves
                    seen, held, size = seen + learn(), [], 0
        if held:
            seen += learn()
        parts = [(n, getattr(own, n), np.full(len(getattr(own, n)), seen, np.float32)) for n in LogBilinear.NAMES]
        for slot, value, weight in parts + [(str(d), tree.levels[d], w) for d, w in enumerate(met)]:
            for at in range(0, len(value), 256):
                w = weight[at:at + 256]
                if w.any():
                    yield pa.RecordBatch.from_pylist(
                        [{"slot": slot, "at": at, "w": w.tobytes(), "v": value[at:at + 256].astype(np.float32).tobytes()}],
                        schema=pa.schema([("slot", pa.string()), ("at", pa.int32()), ("w", pa.binary()), ("v", pa.binary())]))
    return run


def _weighted_mean(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of rows over all tasks, each row weighted by what the task saw of it."""
    total = weight = 0
    for batch in blocks:
        for w, v in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist()):
            w = np.frombuffer(w, np.float32).astype(float)
            total = total + w[:, None] * np.frombuffer(v, np.float32).reshape(len(w), -1)
            weight = weight + w
    mean = (total / np.maximum(weight, 1)[:, None]).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()),
                                      pa.array([weight.astype(np.float32).tobytes()], pa.binary()),
                                      pa.array([mean.tobytes()], pa.binary())], names=["slot", "at", "w", "v"])


def train(seqs: DataFrame, counts: np.ndarray, leaves: np.ndarray, rounds: int = ROUNDS) -> Model:
    """The model after ``rounds`` passes over ``seqs`` (seq: int32 codes); its size is bounded by ``vector_bytes``."""
    spark = seqs.sparkSession
    model = Model(counts, leaves)
    seqs = seqs.coalesce(max(1, spark.sparkContext.defaultParallelism))  # each task gives a set of parameters
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        made = seqs.mapInArrow(_learner(shared, turn, turn == rounds - 1), PARAMETERS)
        for r in made.groupBy("slot", "at").applyInArrow(_weighted_mean, PARAMETERS).collect():
            value = model.tree.levels[int(r["slot"])] if r["slot"].isdigit() else getattr(model.words, r["slot"])
            w = np.frombuffer(r["w"], np.float32)
            block = value[r["at"]:r["at"] + len(w)]
            block[w > 0] = np.frombuffer(r["v"], np.float32).reshape(len(w), -1)[w > 0]
        shared.unpersist()
        give_back()  # the blocks collected
    return model


def _score_batches(shared):
    def run(batches):
        model = shared.value
        for batch in slices(batches, SCORED):
            at = batch.schema.get_field_index("seq")
            seqs = batch.column(at).to_pylist()
            ends = np.cumsum([len(s) // 4 for s in seqs])
            score = np.add.reduceat(model.log_probabilities(seqs) / np.log(10), np.r_[0, ends[:-1]])
            yield batch.set_column(at, "s", pa.array(score))
    return run


def score_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD,
                rounds: int = ROUNDS, lexicon_bytes: int = LEXICON_BYTES, vector_bytes: int = VECTOR_BYTES,
                least: int = LEAST) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    source = documents.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"),
                              held_out(id_col).alias("held_out"), raw(text_col).alias("t"))
    counts = stored(token_counts(source.where(~F.col("held_out")).select("t")), "lm-counts")
    total, kinds = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    named = F.octet_length("token") > 0
    top = counts.where(named).orderBy(F.desc("c"), "token").limit(head).collect()
    names = [bytes(r["token"]) for r in top]
    ends = counts.where(~named).agg(F.max("c")).first()[0] or 0
    once = counts.where("c = 1").count() - sum(r["c"] == 1 for r in top)
    often = counts.where(named & (F.col("c") >= max(least, 2)) & ~F.col("token").isin([bytearray(w) for w in names]))
    weight = F.octet_length("token") + F.lit(28)
    room = most_frequent(often, "c", weight + 4 * (DIM + 1), vector_bytes)
    by_count = often.where(room).groupBy("c").count().orderBy(F.desc("c")).collect()
    leaves = np.repeat([r[0] for r in by_count], [r[1] for r in by_count]).astype(float)
    limit = int(leaves[-1]) if len(leaves) else 1 << 62
    n_other = int(total - ends - sum(r["c"] for r in top) - leaves.sum())
    sent = (most_frequent(counts, "c", weight, lexicon_bytes) | (named & (F.col("c") >= limit))
            | F.col("token").isin([bytearray(w) for w in [b"", *names]]))  # so the rare ones are all of class other
    words = Words(segments(counts.where(sent).select("token", "c")))
    shared = spark.sparkContext.broadcast((Codes(words, names, limit), total, kinds))
    encoded = stored(source.mapInArrow(
        _encode_batches(shared), "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, seq binary, b double, "
        "known bigint, oc double, on bigint, rare array<struct<token:binary,n:bigint>>"), "lm-codes")
    model = train(encoded.where(~F.col("held_out")).select("seq"),
                  np.array([ends, n_other] + [r["c"] for r in top], float), leaves, rounds)
    scored = encoded.drop("rare").mapInArrow(
        _score_batches(spark.sparkContext.broadcast(model)), "rid bigint, doc_id bigint, held_out boolean, "
        "n_tokens bigint, s double, b double, known bigint, oc double, on bigint")
    base = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 1) - F.log10(F.lit(total + kinds + 1.0))
    seen = F.col("c").isNotNull()
    rare = (encoded.select("rid", F.explode("rare").alias("x")).select("rid", "x.token", "x.n")
            .join(counts.where(~sent), "token", "left").groupBy("rid")
            .agg(F.sum(F.col("n") * base).alias("rb"),
                 F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("rk"),
                 F.sum(F.when(seen, F.col("n") * F.log10("c")).otherwise(0.0)).alias("rc"),
                 F.sum(F.when(seen, F.col("n")).otherwise(0)).alias("rn"),
                 F.sum(F.when(seen, 0).otherwise(F.col("n"))).alias("ru")))
    unseen = (once + 0.5) / (n_other + 1.0)
    share = float(np.log10(max(1 - unseen, 1e-12) / max(n_other, 1)))
    joined = scored.join(rare, "rid", "left").fillna(0, ["rb", "rk", "rc", "rn", "ru"])
    score = (F.col("s") + F.col("oc") + F.col("rc") + (F.col("on") + F.col("rn")) * F.lit(share)
             + F.col("ru") * F.lit(float(np.log10(unseen))))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rk")).alias("n_known"),
                         F.lit(total).cast("bigint").alias("train_tokens"),
                         (F.col("b") + F.col("rb")).alias("base_score"), score.alias("score"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
