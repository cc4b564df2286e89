"""Plain Python versions of what the corpus operators compute."""

from __future__ import annotations

import re

from treeline.llm import decontaminate

SPACED = re.compile("[^\\x20\\x09-\\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / free for s in names}
        new = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not new:
            return target
        full |= new


def plain_hits(text, items, n=10):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, body in items:
        w = decontaminate.words_of(body)
        for i in range(max(0, len(w) - n + 1)) or ([0] if w else []):
            window = w[i : i + n]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(item))
    return len(words), hit, sorted(found)


def plain_components(rows):
    sets = {}
    for d, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}
