"""Brute-force versions of the operators, for small tables."""

import itertools
import re
from collections import Counter, defaultdict

import xxhash

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_groups(rows):
    """Fingerprint and smallest id of each row's group; rows are (id, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    fps = [fingerprint(t) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (fps[i] ^ fps[j]).bit_count() <= 3]
    return [(rows[i][0], f"{fps[i]:016x}", rows[c][0]) for i, c in enumerate(components(len(rows), links))]


def contaminated(rows, items, n=13, share=20):
    """Words, hit words, items with hits and the verdict of each row."""
    grams = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall((text or "").translate(LOWER))
        if w:
            size = min(n, len(w))
            for i in range(len(w) - size + 1):
                grams[tuple(w[i:i + size])].add(str(item))
    out = []
    for d, text in rows:
        w = TOKEN.findall((text or "").translate(LOWER))
        hit, seen = set(), set()
        for size in {len(g) for g in grams}:
            for i in range(len(w) - size + 1):
                if (g := tuple(w[i:i + size])) in grams:
                    hit.update(range(i, i + size))
                    seen |= grams[g]
        out.append((d, len(w), len(hit), sorted(seen), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


def without_repeats(rows, window):
    """Words, removed words and kept text of each row."""
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def targets(sizes, weights=(1, 2, 3), most=3):
    """Budget of each source by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: most * sizes[s] for s in over}
