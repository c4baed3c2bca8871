"""Awkward documents, and slow plain versions of the operators to compare with."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

from askbase.llm import simhash

LINE = "This sentence stands in many documents of the corpus."
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
#: doc_id, text, lang and columns named like the operators' own.
SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, row int, id int, t string, "
          "n_words string, items string, spans int, kept int, quality string, n_lines string, piece_ids string, "
          "status string, fp string, key string, shared int")


def documents():
    words = [f"w{i % 97}x{i % 89}" for i in range(30_000)]
    texts = [
        (1, "alpha beta gamma delta " * 6 + f"\n{LINE}"), (2, f"{LINE}\nBeta Été straße\n\n{LINE}"),
        (3, f"  {LINE.upper()}\t\nother words here"), (3, f"  {LINE.upper()}\t\nother words here"),
        (3, f"same id, another text\n{LINE}"), (4, None), (5, ""), (6, " \n\t\r\n "), (7, " ".join(words)),
        (8, " ".join(words) + " tail"), (None, f"no id\n{LINE}"), (None, None), (9, "x" * 5000),
        (10, f"Before {PASSAGE.upper()} after. Some more words follow."), (11, "short item"),
        (12, "### $$$ %%% &&& " * 20), (13, "Released under the MIT License.\nAll rights reserved."),
        (14, "日本語 \U0001f600\U0001f600 ﬁ \x00 b▁c  two  spaces"), (15, "a b c"), (16, "a b c d"),
        (17, "a b c"), (18, "one two three four five six seven eight " * 2), (19, "\n".join([LINE] * 3)),
    ]
    return [(i, t, None if (i or 0) % 5 == 0 else "en", None, len(t) if t is not None else None, 1, 2, "t", "n", "i",
             3, 4, "q", "l", "p", "s", "f", "k", 5) for i, t in texts]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def line_dedup(rows, min_chars=20, min_docs=3):
    """(id, n_lines, n_dropped, kept text) per row."""
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    number = lambda i: -(1 << 63) if i is None else i
    owners = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                owners[key(x)].add(number(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(owners[key(x)]) < min_docs or max(owners[key(x)]) == number(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(text, items, window=13):
    """(n_words, hit positions, ids)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    own, hit, ids = cut(text), set(), set()
    for item, body in items:
        ws = cut(body)
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if ws else 0):
            for at in range(len(own) - size + 1):
                if own[at:at + size] == ws[k:k + size]:
                    hit.update(range(at, at + size))
                    ids.add("" if item is None else str(item))
    return len(own), hit, ids


def quality_counts(text):
    ws, seen, dup, at = words(text), set(), 0, collections.defaultdict(list)
    for x in (text or "").split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    for i in range(len(ws) - 7):
        at[tuple(ws[i:i + 8])].append(i)
    covered = {k for v in at.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def simhash_groups(rows, radius=4):
    """(id, hex, component) per row, by comparing all pairs."""
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                label[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return [(i, f"{prints[k]:016x}", least.get(root(k))) for k, (i, _) in enumerate(rows)]


def base_scores(rows):
    """(id, held_out, n_tokens, n_known, train_tokens, base_score) per row."""
    tokens = lambda t: words(lower(t)) + [""]
    out_of = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not out_of(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    return [(i, out_of(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), total,
             sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in tokens(t))) for i, t in rows]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def common_length(a, b):
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
    return int(d[-1, -1])


def jaccard_groups(rows, width=3, percent=90):
    """(id, set size, component) per row, by comparing all pairs."""
    def shingles(text):
        ws = words(lower(text))
        return frozenset([tuple(ws)] if 0 < len(ws) < width else zip(*(ws[i:] for i in range(width))))

    sets = [shingles(t) for _, t in rows]
    kinds = list(set(s for s in sets if s))
    label = {s: k for k, s in enumerate(kinds)}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    up = list(range(len(kinds)))
    for a in range(len(kinds)):
        for b in range(a):
            if 100 * min(len(kinds[a]), len(kinds[b])) >= percent * max(len(kinds[a]), len(kinds[b])):
                common = len(kinds[a] & kinds[b])
                if 100 * common >= percent * (len(kinds[a]) + len(kinds[b]) - common):
                    up[root(a)] = root(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[root(label[s])] = min(least.get(root(label[s]), i), i)
    return [(i, len(s), least.get(root(label[s])) if s else i) for (i, _), s in zip(rows, sets)]


def runs(ws, least=6, exponent=4):
    """(start, length, period) by trying every start and period."""
    found = {}
    for q in range(1, len(ws) // exponent + 1):
        s = 0
        while s + q < len(ws):
            e = s + q
            while e < len(ws) and ws[e] == ws[e - q]:
                e += 1
            if e - s >= max(least, exponent * q) and (s, e) not in found:
                found[s, e] = q
            s = e - q + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(ws):
    gone = {k for s, n, q in runs(ws) for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def planted_words(doc_id, text):
    ws, h = words(text), zlib.crc32(str(doc_id).encode())
    if h % 10 or not ws:
        return ws
    g, n = h // 10, len(ws)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def near_words(counts):
    """{word: (near words, largest count, its word)}, by comparing all pairs."""
    out = {}
    for a in counts:
        near = [b for b in counts if one_error(a, b)]
        if near:
            best = min(near, key=lambda b: (-counts[b], b))
            out[a] = len(near), counts[best], best
    return out


def variants(rows, min_count=3, planted=False):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if planted and h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= min_count}
    near = near_words(counts)
    form = {w: (b, m) for w, (_, m, b) in near.items() if m >= 2 * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root][0]
        out[w] = n, near.get(w, (0,))[0], *form.get(w, (None, None)), root
    return out
