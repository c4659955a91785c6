"""Plain single-process versions of the operators, written for clarity."""

from __future__ import annotations

import hashlib
import re
from collections import Counter


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k):
    w = words(lower(text))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, k, percent):
    """{doc_id: (set size, smallest linked id)} of (doc_id, text) rows."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    text = text or ""
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    seen = Counter(windows)
    repeated = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def benchmark_hits(text, items, size=10):
    """(words, hit positions, items) of a text by comparing all windows."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = split(text), set(), set()
    for item, item_text in items:
        v = split(item_text)
        n = min(size, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), hit, found


def base_spans(text):
    out = []
    kinds = ["email", "ip", "card", "phone"]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(d[::-1])]
        return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0

    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text or ""):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text or ""):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text or ""):
        if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text or ""):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(out))


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()
