"""Source divergence against sums over all terms, on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np

from recordloom.llm.divergence import distance, divergence, runs
from tests.llm import brute


def expected(rows, least, top):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(brute.UPPER))) for text, lang, source in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        df, n = Counter(), defaultdict(Counter)
        for at, source, ws in docs:
            if at == lang:
                df.update(set(ws))
                n[source].update(ws)
        kept = sorted(t for t, k in df.items() if k >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in n.items()}, share(sum(n.values(), Counter()))
        for s in n:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in n if o != s]
            found = [(q[t] - p[s][t], t.encode()) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, rows_ in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                for rank, (value, item) in enumerate(rows_, 1):
                    out[lang, s, part, rank] = (item.decode(), -value)
    return out


def check(spark, rows, least=1, top=50, **sizes):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "text string, lang string, source string, n bigint, p int, term string")
    got = divergence(df, least, top, **sizes).collect()
    assert {(r["lang"], r["source"], r["part"], r["rank"]): (r["item"], r["value"]) for r in got} == expected(rows, least, top)
    assert len(got) == len(expected(rows, least, top))


def test_nulls_empty_texts_and_groups_without_terms(spark):
    rows = [("a b B é", "en", "s"), (None, "en", "t"), ("", None, None), ("12 !!", "de", "s"), ("x", None, "u"), ("a " * 40_000, "en", None), ("é A z", "en", "s"), ("é A z", "en", "s"), ("ÉZ [`{ k", "de", "v")]
    check(spark, rows)
    check(spark, rows, least=2)
    check(spark, rows, least=99)
    check(spark, [(None, None, None)])


def test_many_sources_and_stripes(spark):
    """More sources than a block holds, more terms than a stripe."""
    r = random.Random(1)
    names = [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    rows = [(" ".join(r.choices(names, k=r.randrange(30))), r.choice(["en", "en", "de"]), "hot" if r.random() < 0.3 else f"s{r.randrange(9)}") for _ in range(300)]
    check(spark, rows, least=3, top=5, stripe=16, block=2)


def test_ties_are_ranked_by_bytes(spark):
    check(spark, [("ab é Zz ﬀ 😀", "en", "s"), ("ab é Zz ﬀ 😀", "en", "t"), ("q", "en", "ä"), ("q", "en", "z")])


def test_empty_table(spark):
    assert divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_distance_of_run_length_columns():
    r = np.random.default_rng(3)
    for _ in range(50):
        width = int(r.integers(1, 60))
        columns = []
        for _ in range(2):
            n = r.integers(0, 4, width)
            at = np.flatnonzero(n)
            columns.append((runs(at, n[at], n[at] * 10 + 1, 1, width), n * 10 + 1))
        (a, x), (b, y) = columns
        assert distance(a, b, width) == np.abs(x - y).sum()
        assert len(a[0]) == 1 + np.count_nonzero(np.diff(x))
