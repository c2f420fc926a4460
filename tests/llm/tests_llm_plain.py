"""Plain versions that several tests compare with."""

import re
from itertools import combinations

import xxhash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints):
    """Group of each fingerprint by comparing all."""
    at = {p: p for p in prints}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in combinations(at, 2):
        if (a ^ b).bit_count() <= 2:
            at[find(a)] = find(b)
    return {p: find(p) for p in at}


def plain_hits(text, items, window=10):
    """Words, hit words and sorted items with a window in the text."""
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, found = low(text), set(), set()
    for item, body in items:
        v = low(body)
        grams = [v] if 0 < len(v) < window else [v[i:i + window] for i in range(len(v) - window + 1)]
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i:i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def plain_shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Smallest id of each group of texts linked by a Jaccard similarity of 0.8 or more."""
    sets, at = {i: plain_shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            at[y] = x
    return {find(i) for i in at}
