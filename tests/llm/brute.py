"""Plain Python versions of the operators' results, over lists of rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def shingles(text, width):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def near_duplicates(rows, width, percent):
    """{doc_id: (n_shingles, component)} of rows (doc_id, text)."""
    sets = {i: shingles(t, width) for i, t in rows}
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b} if sum(len(h) ** 2 for h in holders.values()) < 3e7 else None
    if pairs is None:
        ids = sorted(sets)
        pairs = ((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if not x or not y or min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
            continue
        o = len(x & y)
        if 100 * o >= percent * (len(x) + len(y) - o):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in sets}


def kneser_ney(rows, order, is_held_out):
    """{doc_id: (n_tokens, n_known, base_score, score)}, N: interpolated modified Kneser-Ney by dictionaries."""
    S, E = "<S>", "<E>"
    seqs = {i: [S] * (order - 1) + words((t or "").translate(LOWER)) + [E] for i, t in rows}
    train = [s for i, s in seqs.items() if not is_held_out(i)]
    gram = {order: Counter(tuple(s[j - order + 1 : j + 1]) for s in train for j in range(order - 1, len(s)))}
    for k in range(order - 1, 0, -1):
        gram[k] = Counter(g[1:] for g in gram[k + 1])
    unigram = Counter(x for s in train for x in s[order - 1 :])
    N, V = sum(unigram.values()), len(unigram)

    def discounts(c):
        n1, n2, n3, n4 = (sum(v == k for v in c.values()) for k in (1, 2, 3, 4))
        if not min(n1, n2, n3):
            return [0, 0.5, 1.0, 1.5]
        y = n1 / (n1 + 2 * n2)
        return [0, min(max(1 - 2 * y * n2 / n1, 0), 1), min(max(2 - 3 * y * n3 / n2, 0), 2), min(max(3 - 4 * y * n4 / n3, 0), 3)]

    d = {k: discounts(c) for k, c in gram.items()}
    context: dict = {k: {} for k in gram}
    for k, c in gram.items():
        for g, v in c.items():
            t = context[k].setdefault(g[:-1], [0, 0.0])
            t[0] += v
            t[1] += d[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / (V + 1)
        total, rest = context[len(g)].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        c = gram[len(g)].get(g, 0)
        return max(c - d[len(g)][min(c, 3)], 0) / total + rest / total * p(g[1:])

    out = {}
    for i, s in seqs.items():
        t = s[order - 1 :]
        out[i] = (len(t), sum(unigram[x] > 0 for x in t), sum(math.log10((unigram[x] + 1) / (N + V + 1)) for x in t),
                  sum(math.log10(p(tuple(s[j - order + 1 : j + 1]))) for j in range(order - 1, len(s))))
    return out, N


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2
