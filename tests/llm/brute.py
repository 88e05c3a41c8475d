"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def classes(ids, links):
    """The smallest id that each id is connected with."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text, k=5):
    w = words(text)
    return Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def probability_jaccard(x, y):
    x, y = ({k: 1 + math.log(n) for k, n in c.items()} for c in (x, y))
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in x.keys() & y.keys())


def near_classes(docs, threshold=0.8):
    sets = {i: shingles(t).keys() for i, t in docs}
    holders = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            holders[x].add(i)
    pairs = {p for h in holders.values() for p in combinations(sorted(h), 2)}
    return classes(list(sets), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])])


def remove_repeats(docs, window=20):
    """{id: (n_words, n_removed, sha256 of the kept words)}"""
    seen, cover, texts = {}, {}, {}
    for i, t in sorted(docs):
        w = texts[i] = words(t)
        cover[i] = [False] * len(w)
        for a in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[a : a + window]), (i, a)) != (i, a):
                cover[i][a : a + window] = [True] * window
    return {i: (len(w), sum(cover[i]), hashlib.sha256(" ".join(x for x, c in zip(w, cover[i], strict=True) if not c).encode()).hexdigest()) for i, w in texts.items()}


def targets(source_sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Excess reshared round by round."""
    names = sorted(source_sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    budget, full, out = share * sum(source_sizes.values()), set(), {}
    while True:
        free = [s for s in names if s not in full]
        left = budget - sum(most * source_sizes[s] for s in full)
        out = {s: most * source_sizes[s] if s in full else left * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if out[s] > most * source_sizes[s] + 1e-9}
        if not over:
            return out
        full |= over
