"""The operators' results the plain way, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def shingles(text, k=5):
    ws = spaced((text or "").translate(UPPER))
    return {tuple(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


class Union:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def near_links(sets, percent=75):
    """Pairs of keys of ``sets`` that are linked."""
    at = defaultdict(list)
    for k in sorted(sets):
        for s in sets[k]:
            at[s].append(k)
    shared = Counter()
    for ks in at.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1:]:
                shared[a, b] += 1
    return [(a, b) for (a, b), n in shared.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]


def near_duplicates(rows):
    """doc_id -> (n_shingles, component) of rows (doc_id, text)."""
    sets = {i: shingles(t) for i, t in rows}
    u = Union()
    for a, b in near_links(sets):
        u.join(a, b)
    return {i: (len(s), u.root(i)) for i, s in sets.items()}


def item_words(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(UPPER)) if w]


def contamination(text, items, size=10):
    """(n_words, n_hit, sorted ids of items met)."""
    ws, hit, met = item_words(text), set(), set()
    for i, t in items:
        iw = item_words(t)
        if i is None or not iw:
            continue
        k = min(size, len(iw))
        wins = {tuple(iw[s:s + k]) for s in range(len(iw) - k + 1)}
        for s in range(len(ws) - k + 1):
            if tuple(ws[s:s + k]) in wins:
                hit.update(range(s, s + k))
                met.add(str(i))
    return len(ws), len(hit), sorted(met)


BASE = (("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))


def base_spans(text):
    found = [(m.start(), r, k, m.end()) for r, (k, p, g, n) in enumerate(BASE) for m in re.finditer(p, text or "") if len(m.group(g)) >= n]
    return sorted(found)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    ws = spaced(text)
    lines = [x for x in (text or "").split("\n") if spaced(x)]
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i:i + 8])].append(i)
    again = {p for ps in at.values() if len(ps) > 1 for i in ps for p in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(w.count(c) for w in ws for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def bigrams(text):
    ws = [w for w in re.split("[^a-z0-9]+", text.lower()) if w]
    return set(zip(ws, ws[1:], strict=False))
