"""Plain versions of the operators' results, over rows in memory."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text, shingle):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, prints, bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, doc in enumerate(ids):
        r = find(i)
        if doc is not None:
            least[r] = min(least.get(r, doc), doc)
    return [least.get(find(i)) for i in range(len(ids))]


def dedup(rows, width):
    """rows of (doc_id, text) -> sorted (doc_id, n_words, n_removed, sha256)."""
    seen = {}
    place = lambda d, k, t: (d is None, d or 0, k, t or "")
    for doc, text in rows:
        w = words(text)
        for k in range(len(w) - width + 1):
            key, at = tuple(w[k : k + width]), (doc is None, doc or 0, k)
            seen[key] = min(seen.get(key, at), at)
    out = []
    for doc, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] < (doc is None, doc or 0, k):
                keep[k : k + width] = [False] * width
        out.append((doc, len(w), keep.count(False), hashlib.sha256(" ".join(x for x, y in zip(w, keep, strict=True) if y).encode()).hexdigest()))
    del place
    return out


def targets(rows, weights, share, most):
    """rows of (source, size) -> target of each source."""
    totals = {}
    for source, size in rows:
        totals[source] = totals.get(source, 0) + size
    order = sorted(totals, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(totals.values()), set(order)
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if target[s] + unit * weight[s] >= most * totals[s]]
        if not over:
            for s in open_:
                target[s] += unit * weight[s]
            break
        for s in over:
            left -= most * totals[s] - target[s]
            target[s] = most * totals[s]
        open_ -= set(over)
    return totals, target


def crc(text):
    return zlib.crc32((text or "").encode())


def top(vectors, asked, k, score):
    out = []
    for q in asked:
        found = [(-score(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q])]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return out


def u4(ids):
    return np.array(ids, dtype="<u4").tobytes()
