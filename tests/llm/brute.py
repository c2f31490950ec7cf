"""Plain versions of the operators, over rows held in memory."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def components(rows, size, percent):
    """{doc_id: (n, component)} of (doc_id, text) rows."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            k = len(x & y)
            if x and y and 100 * k >= percent * (len(x) + len(y) - k):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def ratio(raw, level=3):
    return len(zstandard.ZstdCompressor(level=level).compress(raw)) / len(raw) if raw else 1.0


def tokens(text):
    """Lower-case runs of letters, digits and non-ASCII characters."""
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def tiles(item, text, least):
    """Greedy string tiling by trying every pair of starts, longest first, ties to the earliest."""
    a, b = [True] * len(item), [True] * len(text)
    out = []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and a[i + k] and b[j + k] and item[i + k] == text[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        a[i : i + k] = [False] * k
        b[j : j + k] = [False] * k
        out.append((i, j, k))


def leaked(text, items, least=5, coverage=0.8):
    """Items of (item_id, text) that tiles cover; only those sharing a run of ``least`` words are tried."""
    words = tokens(text)
    runs = {tuple(words[k : k + least]) for k in range(len(words) - least + 1)}
    out = []
    for item_id, item in items:
        own = tokens(item)
        if any(tuple(own[k : k + least]) in runs for k in range(len(own) - least + 1)):
            n = sum(t[2] for t in tiles(own, words, least))
            if n >= coverage * len(own):
                out.append((item_id, len(own), n))
    return out


def targets(sizes, share=Fraction(3, 2), most=2):
    """{source: target} by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, done, left = set(order), {}, share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not above:
            done |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            done[s] = Fraction(most * sizes[s])
            left -= done[s]
        open_ -= above
    return done


def copies(rows, seed=0):
    """[copies] of (doc_id, text, source) rows, in order."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(list)
    for k, (_, _, source) in enumerate(rows):
        by[source].append(k)
    goal = targets({s: sum(size[k] for k in ks) for s, ks in by.items()})
    out = [0] * len(rows)
    for source, ks in by.items():
        total = sum(size[k] for k in ks)
        each = float(goal[source]) / total if total else 0.0
        name = "n" if source is None else f"s{source}"
        offset = int(hashlib.md5(f"mix/{seed}/{name}".encode()).hexdigest()[:8], 16) / 2**32
        ks.sort(key=lambda k: (size[k], hashlib.md5(("" if rows[k][0] is None else str(rows[k][0])).encode()).hexdigest()))
        for r, k in enumerate(ks):
            out[k] = min(2, math.floor((r + 1) * each + offset) - math.floor(r * each + offset))
    return out


def shard_keys(rows):
    return [int(hashlib.md5(f"{'' if i is None else i}/{t or ''}".encode()).hexdigest()[:15], 16) for i, t in rows]


def shards(rows, limit):
    """[bits] of (doc_id, text) rows: split the buckets that are too large, bit by bit."""
    keys = shard_keys(rows)
    size = [len((t or "").encode()) for _, t in rows]
    out = [None] * len(rows)

    def split(ks, bits):
        if len(ks) == 1 or sum(size[k] for k in ks) <= limit or len(bits) == 60:
            for k in ks:
                out[k] = bits
            return
        for bit in "01":
            part = [k for k in ks if f"{keys[k]:060b}"[len(bits)] == bit]
            if part:
                split(part, bits + bit)

    split(list(range(len(rows))), "")
    return out
