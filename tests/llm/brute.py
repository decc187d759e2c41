"""Small exact versions in plain Python, for tests."""

import collections
import hashlib
import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def repeated_words(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = plain_words(t)
        gone = [False] * len(w)
        for j in range(len(w) - length + 1):
            k = tuple(w[j : j + length])
            if k in seen:
                gone[j : j + length] = [True] * length
            seen.add(k)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def repeated_bytes(rows, length):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first.setdefault(b[j : j + length], i) < i:
                gone[j : j + length] = b"\1" * length
        out[i] = (len(b), sum(gone), bytes(x for x, g in zip(b, gone) if not g))
    return out


def phrases(items, length):
    out = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        m = min(length, len(w))
        for j in range(len(w) - m + 1) if m else ():
            out[tuple(w[j : j + m])].add(str(i))
    return out


def marked(text, windows):
    w = alnum_words(text)
    hit, items = [0] * len(w), set()
    for m in {len(k) for k in windows}:
        for j in range(len(w) - m + 1):
            if tuple(w[j : j + m]) in windows:
                hit[j : j + m] = [1] * m
                items |= windows[tuple(w[j : j + m])]
    return len(w), sum(hit), sorted(items)


def near_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = plain_words((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            meet = len(sets[a] & sets[b])
            if a < b and meet and 100 * meet >= percent * (len(sets[a]) + len(sets[b]) - meet):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edits_within(a, b, k):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1] <= k


def deduped_lines(rows, edits, least, fuzzy):
    seen, out = [], {}
    for i, t in sorted(rows):
        kept = []
        for line in (t or "").split("\n"):
            s = line.strip(" ")
            if len(s) < least:
                kept.append(line)
                continue
            if not any(s == o or (min(len(s), len(o)) >= fuzzy and abs(len(s) - len(o)) <= edits and edits_within(s, o, edits)) for o in seen):
                kept.append(line)
            if s not in seen:
                seen.append(s)
        out[i] = None if t is None else "\n".join(kept)
    return out


def smallest_capacity(sizes, shards):
    def fits(c):
        n, s = 1, 0
        for x in sizes:
            if x > c:
                return False
            if s + x > c:
                n, s = n + 1, 0
            s += x
        return n <= shards

    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if fits(mid) else (mid + 1, hi)
    return lo


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
