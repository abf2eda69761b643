"""Brute-force versions of the operators, in plain Python over (doc_id, text) rows."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeats(rows, width=13):
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text, width, fold=True):
    t = text or ""
    if fold:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    w = WORD.findall(t)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near(rows, width=4, percent=85):
    """doc_id -> (size, component id)."""
    sets = {d: shingles(t, width) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for d, s in sets.items():
        for g in s:
            where.setdefault(g, []).append(d)
    seen = set()
    for d, s in sets.items():
        common = {}
        for g in s:
            for e in where[g]:
                if e < d:
                    common[e] = common.get(e, 0) + 1
        for e, k in common.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k) and (e, d) not in seen:
                seen.add((e, d))
                a, b = find(e), find(d)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def kept_texts(rows, width=13):
    """doc_id -> text left, or None if nothing is removed."""
    rows = list(rows)
    words = {d: WORD.findall(t or "") for d, t in rows}
    first = {}
    for d in sorted(words):
        w = words[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else None
    return out


def best_fit_decreasing(sizes, capacity):
    """Free space of each bin: every size, the largest first, goes to the tightest bin that holds it."""
    free = []
    for n in sorted(sizes, reverse=True):
        tightest = min((k for k, f in enumerate(free) if f >= n), key=lambda k: free[k], default=None)
        if tightest is None:
            free.append(capacity - n)
        else:
            free[tightest] -= n
    return free
