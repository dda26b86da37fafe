"""Brute-force versions of the operators, in plain Python."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text: str | None, k: int) -> set:
    w = WORD.findall((text or "").translate(LOWER))
    return set() if not w else {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def components(docs: list[tuple[int, str | None]], k: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    """id: set size, smallest id of the component."""
    sets = {d: shingle_set(t, k) for d, t in docs}
    up = {d: d for d in sets}

    def top(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((top(a), top(b)))
                    up[q] = p
    return {d: (len(sets[d]), top(d)) for d in sets}


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], k: int = 5, percent: int = 80) -> set[tuple[int, int]]:
    """(id, item) with a window of the item's words whose weighted similarity is high enough."""
    out = set()
    for i, item in items:
        m = WORD.findall((item or "").translate(LOWER))
        want = Counter(tuple(m[j : j + k]) for j in range(len(m) - k + 1)) if len(m) >= k else None
        for d, text in docs if m else ():
            w = WORD.findall((text or "").translate(LOWER))
            if want is None:
                if w == m:
                    out.add((d, i))
                continue
            shingles = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            n = min(len(m) - k + 1, len(shingles))
            if not n or not want.keys() & set(shingles):
                continue
            for at in range(len(shingles) - n + 1):
                have = Counter(shingles[at : at + n])
                low = sum((have & want).values())
                if 100 * low >= percent * (n + len(m) - k + 1 - low):
                    out.add((d, i))
                    break
    return out


def removed(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, bytes]:
    """For each document one byte for each of its bytes: 1 if removed."""
    first: dict[bytes, int] = {}
    data = {d: (t or "").encode() for d, t in docs}
    for d in sorted(data):
        for i in range(len(data[d]) - length + 1):
            first.setdefault(data[d][i : i + length], d)
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out[d] = bytes(gone)
    return out


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)
