"""Plain versions of the operators, row by row, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def substring(rows):
    """op5: {(doc_id, text): (n_words, n_removed, sha256)}"""
    first = {}
    for d, text in rows:
        if d is None:
            continue
        w = words(text)
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            f = first.get(tuple(w[i : i + 13]))
            if f is not None and (d is None or f < d):
                gone[i : i + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def stats(text):
    """op7: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    w = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    hit = [False] * len(w)
    for i, t in enumerate(tri):
        if n[t] > 1:
            hit[i : i + 3] = [True] * 3
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, sum(hit)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    """Component label (least position) of each position, by comparing all pairs."""
    label = list(range(len(items)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(items))]


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def targets(sizes):
    """{source: target} from {source: size}; null last"""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weight[s] for s in free)
        new = {s for s in free if weight[s] * left / w > 3 * sizes[s]}
        if not new:
            return {s: float(3 * sizes[s]) if s in capped else weight[s] * left / w for s in order}
        capped |= new


def crc(text):
    return zlib.crc32((text or "").encode())
