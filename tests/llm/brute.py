"""Plain brute-force versions of the corpus operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def key(d):
    return LAST if d is None else d


def fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    n = min(shingle, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most=3):
    """The class of each fingerprint's index."""
    of = list(range(len(fps)))

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    a = np.array(fps, np.uint64)
    for i, j in zip(*np.nonzero(np.bitwise_count(a[:, None] ^ a[None, :]) <= most), strict=True):
        x, y = find(i), find(j)
        of[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def near_duplicates(rows):
    fps = [fingerprint(t) for _, t in rows]
    classes, least = components(fps), defaultdict(lambda: LAST)
    for c, (d, _) in zip(classes, rows, strict=True):
        least[c] = min(least[c], key(d))
    return [(d, f"{f:016x}", None if least[c] == LAST else least[c]) for (d, _), f, c in zip(rows, fps, classes, strict=True)]


def repeats(rows, width=200):
    texts = [(t or "").encode() for _, t in rows]
    counts, out = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1)), []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if counts[t[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), len(t) - len(kept), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), kept))
    return out


def earlier_windows(rows, width=50):
    texts, first = [(d, (t or "").encode().split()) for d, t in rows], {}
    for d, w in texts:
        for i in range(len(w) - width + 1):
            x = tuple(w[i : i + width])
            first[x] = min(first.get(x, LAST), key(d))
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < key(d):
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def contamination(rows, bench, width=10):
    word, windows, out = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), defaultdict(set), []
    for item, t in bench:
        w = word.findall((t or "").translate(LOWER))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(item)
    for d, t in rows:
        w = word.findall((t or "").translate(LOWER))
        hit, items = [False] * len(w), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit[i : i + n] = [True] * n
                    items |= found
        out.append((d, len(w), sum(hit), tuple(sorted(str(x) for x in items if x is not None))))
    return out


def text_hash(t):
    """XXH64 as a signed long, which orders rows of equal ids; a null's is the seed."""
    return 42 if t is None else int(np.uint64(xxhash.xxh64_intdigest(t, 42)).astype(np.int64))


def mix(rows, share, epochs, weights, seed):
    """Times each row ``(doc_id, text, lang, source)`` is taken."""
    leaf = defaultdict(list)
    for k, (d, t, lang, source) in enumerate(rows):
        source = source or ""
        number = re.search(r"(\d{1,9})$", source)
        leaf[f"domain{(int(number[1]) if number else 0) % 4}", lang or "", source].append((key(d), text_hash(t), len((t or "").encode().split()), k))
    tokens = {p: sum(n for _, _, n, _ in v) for p, v in leaf.items()}
    budgets = {(): math.floor(sum(tokens.values()) * share)}
    for depth, level in enumerate(("domain", "lang", "source")):
        below, known = {}, weights.get(level, {})
        for parent, budget in budgets.items():
            children = {p[depth] for p in leaf if p[:depth] == parent}
            cap = {c: sum(epochs * n for p, n in tokens.items() if p[: depth + 1] == (*parent, c)) for c in children}
            weight = {c: known.get(c, known.get("*", 1)) for c in children}
            left = sorted(children, key=lambda c: (cap[c] / weight[c], c))
            while left:
                c, open_weight = left[0], sum(weight[x] for x in left)
                if budget * weight[c] < cap[c] * open_weight:
                    below |= {(*parent, x): budget * weight[x] // open_weight for x in left}
                    break
                below[*parent, c] = cap[c]
                budget -= cap[c]
                left.pop(0)
        budgets = below
    out = {}
    for p, v in leaf.items():
        whole = budgets[p] // tokens[p] if tokens[p] else 0
        rest, so_far, last, taken = budgets[p] - whole * tokens[p], 0, None, False
        for *row, n, k in sorted((hashlib.md5(f"{seed}:{whole + 1}:{d}".encode()).hexdigest(), d, h, n, k) for d, h, n, k in v):
            taken = taken if row == last else so_far < rest  # repeated rows are taken together
            out[k] = whole + taken
            so_far, last = so_far + n, row
    return {k: n for k, n in out.items() if n}
