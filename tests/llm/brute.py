"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import Counter


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def shingles(text):
    w = words(text)
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows, threshold=0.8):
    """id -> smallest id of its group, for (id, text) with different ids."""
    bags = {i: shingles(t) for i, t in rows}
    holders = {}
    for i, bag in bags.items():
        for g in bag:
            holders.setdefault(g, []).append(i)
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, bag in bags.items():
        for j in {j for g in bag for j in holders[g] if j < i}:
            if similarity(bag, bags[j]) >= threshold:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in bags}


def leaks(rows, items, threshold=0.8):
    """(id, item_id) with a window of the item's size of that similarity (plain counts as weights).

    A window without a shingle of the item has similarity 0, so only the others are compared.
    """
    out = set()
    texts = []
    for i, t in rows:
        w = words(t)
        texts.append((i, w, [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))]))
    for item, text in items:
        own, n = shingles(text), len(words(text))
        for i, w, grams in texts:
            if not w or not n:
                continue
            if n < 5:
                hit = w == words(text)
            else:
                size, last = n - 4, max(0, len(grams) - (n - 4))
                starts = {k for at, g in enumerate(grams) if g in own for k in range(max(0, at - size + 1), min(at, last) + 1)}
                hit = any(similarity(own, Counter(grams[k : k + size])) >= threshold for k in starts)
            if hit:
                out.add((i, item))
    return out
