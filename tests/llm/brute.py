"""Plain restatements of the contracts, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[SPACES.sub(" ", t or "")].append(i)
    return sorted((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)


def near(docs):
    sets = {}
    for i, t in docs:
        w = WORDS.findall((t or "").translate(FOLD))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in sets)

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(FOLD))
        m = min(10, len(w))
        for k in range(len(w) - m + 1 if m else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    hit |= {*range(k, k + m)}
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)
