"""The registered queries on the given tables, beside SQL or the plain way."""

from __future__ import annotations

import zlib

import pytest

import __spark_entry__ as entry
from recordloom.llm import queries
from tests.llm import brute
from tests.oracle import DATA, compare, connect

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


def rows(df):
    return {r[0]: r for r in df.collect()}


def test_all_are_registered():
    named = entry.queries()
    for n in range(1, 14):
        assert len([q for q in named if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in named and set(entry.oracle_sql()) <= set(named)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_beside_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name]) == []


@pytest.mark.parametrize("name", ["op1_decontamination", "op6_secrets", "op7_licences", "op8_quality_rules"])
def test_no_python_in_native_plans(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"):
        assert node not in plan


def test_near_duplicates(spark, docs):
    want = brute.near_duplicates(docs.items())
    got = rows(queries.QUERIES["op10_near_duplicates"](spark, SF))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i][1]) for i, r in got.items())


def test_passages(spark, docs):
    """Marks as all pairs of paragraphs give them; nearly every document that shares 50 words is found."""
    import numpy as np

    from recordloom.llm.shingles import words
    from recordloom.llm.substrings import LEAST_WORDS, WIDTH, cuts, hashes

    split = {i: words(t) for i, t in docs.items() if t}
    at = {i: [*cuts(hashes(b" ".join(ws))[0], np.array([0])).tolist(), len(ws)] for i, ws in split.items() if len(ws) >= LEAST_WORDS}
    sets = {(i, k): brute.shingles(b" ".join(split[i][a:b]).decode()) for i, c in at.items() for k, (a, b) in enumerate(zip(c, c[1:], strict=False)) if b - a >= WIDTH}
    u = brute.Union()
    for a, b in brute.near_links(sets):
        u.join(a, b)
    groups = {}
    for k in sets:
        groups.setdefault(u.root(k), []).append(k)
    marks = {k: k != min(g) for g in groups.values() if len(g) > 1 for k in g}
    want = set()
    for i, c in at.items():
        k = 0
        while k < len(c):
            end = k
            while (i, end) in marks:
                end += 1
            if end > k and c[end] - c[k] >= LEAST_WORDS:
                want |= {(i, w, marks[i, j]) for j in range(k, end) for w in range(c[j], c[j + 1])}
            k = max(end, k + 1)
    got = set()
    rows_ = queries.QUERIES["op3_substring_dedup"](spark, SF).collect()
    for r in rows_:
        text = docs[r["doc_id"]]
        first = len(brute.spaced(text[:r["start"]]))
        assert len(brute.spaced(text[r["start"]:r["end"]])) == r["n_words"] > 0
        got |= {(r["doc_id"], w, r["removed"]) for w in range(first, first + r["n_words"])}
    assert len(want ^ got) <= 0.01 * len(want)
    runs = {}
    for i, ws in split.items():
        for k in range(len(ws) - 49):
            runs.setdefault(tuple(ws[k:k + 50]), set()).add(i)
    shared = set().union(*(ids for ids in runs.values() if len(ids) > 1))
    assert len(shared - {r["doc_id"] for r in rows_}) <= 0.02 * len(shared)


def test_quality_counts(spark, docs):
    for i, r in rows(queries.QUERIES["op8_quality_rules"](spark, SF)).items():
        want = brute.quality(docs[i])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def answers(text):
    """The ten rules' answers, counted the plain way."""
    ws, lines = brute.spaced(text), [x for x in text.split("\n") if brute.spaced(x)]
    n, chars, symbols, dup, again = brute.quality(text)
    joined = "".join(ws)
    low = lambda x, of, good, bad: -1 if x > bad * of else 1 if x <= good * of else 0
    high = lambda x, of, good, bad: -1 if x < bad * of else 1 if x >= good * of else 0
    return (low(symbols, n, 0.02, 0.15), high(sum(c.isalpha() for c in joined), chars, 0.92, 0.85), low(sum(not any(map(str.isalpha, w)) for w in ws), n, 0.05, 0.2),
            -1 if chars < 3 * n or chars > 7.5 * n else 1 if 3.5 * n <= chars <= 6.5 * n else 0, low(sum(c.isupper() for c in joined), chars, 0.08, 0.25),
            low(sum(c in ".,;:!?" for c in joined), n, 0.4, 1), low(dup, len(lines), 0, 0.3), low(again, n, 0, 0.1), 0 if n > 2000 else high(len(set(ws)), n, 0.45, 0.3),
            high(sum(x.rstrip(" \t\v\f\r")[-1:] in (".", "!", "?") for x in lines), len(lines), 0.5, 0.1))


def test_quality_verdicts(spark):
    """Verdicts as a plain fit over all texts gives them; not those of a filter that all rules must pass."""
    import numpy as np

    sf = f"{DATA}/sf0.01"
    texts = dict(connect(sf).sql("SELECT doc_id, text FROM documents").fetchall())
    got = rows(queries.QUERIES["op8_quality_rules"](spark, sf))
    told = {i: answers(texts[i]) for i, r in got.items() if not r["base_failed"]}
    v = np.array([told[i] for i in told]) + 1                       # bad, none, good as 0, 1, 2
    start = np.array([[0.25, 0.15, 0.60], [0.01, 0.02, 0.97]])
    prior, rate = np.array([0.15, 0.85]), np.repeat(start[:, None], 10, axis=1)
    own = 0.1 * len(v) * np.array([0.15, 0.85])
    for _ in range(400):
        log = np.log(prior) + sum(np.log(rate[:, k, v[:, k]]) for k in range(10)).T
        p = np.exp(log - log.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        prior = (p.sum(axis=0) + own) / (len(v) + own.sum())
        sums = np.array([[[p[v[:, k] == x, c].sum() + own[c] * start[c, x] for x in range(3)] for k in range(10)] for c in range(2)])
        rate = sums / sums.sum(axis=2, keepdims=True)
    for i, (_, good) in zip(told, p, strict=True):
        assert got[i]["p_good"] == pytest.approx(good, abs=1e-3) and (got[i]["kept"] == (good >= 0.5) or abs(good - 0.5) < 1e-3)
    bad = {i: t.count(-1) for i, t in told.items()}
    assert any(got[i]["kept"] for i, n in bad.items() if n == 1)
    assert any(not got[i]["kept"] for i, n in bad.items() if n > 1)


def test_quality_keeps_good_texts(spark):
    sf = f"{DATA}/sf0.1"
    got = rows(queries.QUERIES["op8_quality_rules"](spark, sf))
    label = dict(connect(sf).sql("SELECT doc_id, quality FROM labels").fetchall())
    passed = [i for i in label if not got[i]["base_failed"]]
    assert sum(got[i]["kept"] for i in passed if label[i]) >= 0.99 * sum(label[i] for i in passed)
    assert sum(not got[i]["kept"] for i in passed if not label[i]) >= 0.95 * sum(not label[i] for i in passed)


def test_language_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.01"
    want = dict(connect(sf).sql("SELECT doc_id, lang FROM documents").fetchall())
    got = rows(queries.QUERIES["op9_language_id"](spark, sf))
    held = [i for i, r in got.items() if r["held_out"]]
    assert set(held) == {i for i in want if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(got[i]["lang_pred"] == want[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_on_held_out_rows(spark):
    sf = f"{DATA}/sf0.1"
    want = dict(connect(sf).sql("SELECT doc_id, toxic FROM labels").fetchall())
    got = rows(queries.QUERIES["op4_toxicity"](spark, sf))
    held = [(got[i]["score"], t, got[i]["predicted"]) for i, t in want.items() if got[i]["held_out"]]
    pos, neg = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc >= 0.95
    assert sum(p for _, t, p in held if t) >= 0.85 * len(pos)
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in got.values())


def test_mix(spark, con, docs):
    got = rows(queries.QUERIES["op2_mixing"](spark, SF))
    source = dict(con.sql("SELECT doc_id, source FROM documents").fetchall())
    size, taken = {}, {}
    for i, r in got.items():
        assert r["size"] == len(brute.spaced(docs[i])) and 0 <= r["taken"] <= 3 * r["size"]
        size[source[i]] = size.get(source[i], 0) + r["size"]
        taken[source[i]] = taken.get(source[i], 0) + r["taken"]
    names = sorted(size, key=lambda s: s.encode())
    weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
    want, open_, rest = {}, set(names), float(sum(size.values()))
    while open_:
        x = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if x * weight[s] > 3 * size[s]}
        for s in full or open_:
            want[s] = 3.0 * size[s] if full else x * weight[s]
        rest -= sum(want[s] for s in full)
        open_ = open_ - full if full else set()
    for i, r in got.items():
        assert r["source_size"] == size[source[i]] and r["target"] == pytest.approx(want[source[i]])
    for s in names:
        assert abs(taken[s] - want[s]) <= max(0.03 * want[s], 96)
    again = rows(queries.QUERIES["op2_mixing"](spark, SF))
    assert again == got


def test_pipeline(spark, docs):
    import corpus_pipeline as p

    assert 4 <= len(p.STAGES) <= 5
    got = rows(p.run(spark, SF))
    kept = {i: t for i, t in docs.items() if any(map(str.isalpha, t))}
    near = brute.near_duplicates(kept.items())
    kept = {i: t for i, t in kept.items() if near[i][1] == i}
    items = connect(SF).sql("SELECT item_id, text FROM benchmark").fetchall()
    kept = {i: t for i, t in kept.items() if not brute.contamination(t, items)[1]}
    assert set(got) == set(kept)
