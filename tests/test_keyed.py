"""Keyed datasets against a one-record-at-a-time model."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import keyed as k


class Model:
    """The file as a program sees it: one request after another."""

    def __init__(self, rows, unique=(), repeated=()):
        self.rows = {r["id"]: dict(r) for r in rows}
        self.unique, self.repeated = unique, repeated

    def _clash(self, r, but=None):
        return any(o[a] == r[a] for a in self.unique for i, o in self.rows.items() if i != but)

    def do(self, op, r):
        there = r["id"] in self.rows
        if op == k.WRITE:
            if there or self._clash(r):
                return "22"
            again = any(o[a] == r[a] for a in self.repeated for o in self.rows.values())
            self.rows[r["id"]] = dict(r)
            return "02" if again else "00"
        if not there:
            return "23"
        if op == k.REWRITE:
            if self._clash(r, r["id"]):
                return "22"
            self.rows[r["id"]] = dict(r)
        elif op == k.DELETE:
            del self.rows[r["id"]]
        return "00"


COLS = "id int, a1 int, a2 int, v int"


def frame(spark, rows, extra=""):
    return spark.createDataFrame([tuple(r.values()) for r in rows], (extra + ", " if extra else "") + COLS)


def draw(rnd, n, ids, alts):
    return [{"id": rnd.randrange(ids), "a1": rnd.randrange(alts), "a2": rnd.randrange(5), "v": i} for i in range(n)]


def unique_master(rnd, n, ids, alts):
    out, seen_i, seen_a = [], set(), set()
    for r in draw(rnd, n, ids, alts):
        if r["id"] not in seen_i and r["a1"] not in seen_a:
            out.append(r)
            seen_i.add(r["id"])
            seen_a.add(r["a1"])
    return out


def check(result, master_cols, statuses, model):
    got = {r["seq"]: r["status"] for r in result.outcomes.collect()}
    assert got == statuses
    assert sorted(tuple(r) for r in result.master.select(*master_cols).collect()) == sorted(tuple(r.values()) for r in model.rows.values())


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("unique,repeated", [((), ()), ((), ("a2",)), (("a1",), ("a2",)), (("a1",), ())])
def test_write(spark, seed, unique, repeated):
    rnd = random.Random(seed)
    master = unique_master(rnd, 10, 30, 30)
    reqs = draw(rnd, 60, 30, 40)
    model = Model(master, unique, repeated)
    want = {i: model.do(k.WRITE, r) for i, r in enumerate(reqs)}
    df = frame(spark, [{"seq": i, **r} for i, r in enumerate(reqs)], "seq int")
    spec = k.KeySpec("id", tuple(k.Alternate(a) for a in unique) + tuple(k.Alternate(a, True) for a in repeated))
    check(k.write_batch(frame(spark, master), df, spec, "seq"), ["id", "a1", "a2", "v"], want, model)


@pytest.mark.parametrize("op,fn", [(k.REWRITE, k.rewrite_batch), (k.DELETE, k.delete_batch)])
def test_rewrite_and_delete(spark, op, fn):
    rnd = random.Random(7)
    master, reqs = unique_master(rnd, 20, 30, 99), draw(rnd, 60, 40, 40)
    model = Model(master)
    want = {i: model.do(op, r) for i, r in enumerate(reqs)}
    df = frame(spark, [{"seq": i, **r} for i, r in enumerate(reqs)], "seq int")
    check(fn(frame(spark, master), df, "id", "seq"), ["id", "a1", "a2", "v"], want, model)


@pytest.mark.parametrize("seed", range(3))
def test_mixed_stream(spark, seed):
    """One key has a third of all requests, spread over many blocks."""
    rnd = random.Random(seed)
    master, reqs = unique_master(rnd, 20, 30, 99), draw(rnd, 150, 40, 40)
    ops = [rnd.choice([k.WRITE, k.REWRITE, k.DELETE, k.READ]) for _ in reqs]
    for r in reqs:
        if rnd.random() < 0.33:
            r["id"] = 3
    model = Model(master)
    want = {i: model.do(o, r) for i, (o, r) in enumerate(zip(ops, reqs))}
    df = frame(spark, [{"seq": i, "op": o, **r} for i, (o, r) in enumerate(zip(ops, reqs))], "seq int, op string")
    check(k.apply_batch(frame(spark, master), df, "id", "seq", block_rows=8), ["id", "a1", "a2", "v"], want, model)


@pytest.mark.parametrize("seed", range(2))
def test_mixed_stream_with_unique_alternate(spark, seed):
    rnd = random.Random(100 + seed)
    master, reqs = unique_master(rnd, 12, 12, 12), draw(rnd, 24, 14, 12)
    ops = [rnd.choice([k.WRITE, k.REWRITE, k.REWRITE, k.DELETE, k.READ]) for _ in reqs]
    model = Model(master, ("a1",))
    want = {i: model.do(o, r) for i, (o, r) in enumerate(zip(ops, reqs))}
    df = frame(spark, [{"seq": i, "op": o, **r} for i, (o, r) in enumerate(zip(ops, reqs))], "seq int, op string")
    spec = k.KeySpec("id", (k.Alternate("a1"),))
    check(k.apply_batch_unique(frame(spark, master), df, spec, "seq"), ["id", "a1", "a2", "v"], want, model)


def test_alternate_statuses(spark):
    """Repeated alternates give 02, a taken unique alternate 22."""
    rows = [(0, "K001", "A001", "B001"), (1, "K002", "A002", "B001"), (2, "K003", "A001", "B002")]
    req = spark.createDataFrame(rows, "seq int, id string, alt1 string, alt2 string")
    spec = k.KeySpec("id", (k.Alternate("alt1"), k.Alternate("alt2", True)))
    out = k.write_batch(req.select("id", "alt1", "alt2").limit(0), req, spec, "seq").outcomes
    assert {r["seq"]: r["status"] for r in out.collect()} == {0: "00", 1: "02", 2: "22"}


def test_reading(spark):
    m = spark.createDataFrame([("K1", "A"), ("K3", "B"), ("7", "B")], "id string, alt string")
    req = spark.createDataFrame([("K1",), ("K2",), ("007",)], "ask string")
    assert {r["ask"]: (r["alt"], r["status"]) for r in k.read_key(req, m, "ask", "id", strip_zeros=True).collect()} == {
        "K1": ("A", "00"), "K2": (None, "23"), "007": ("B", "00")}
    by = spark.createDataFrame([("B",), ("Z",)], "ask string")
    assert {r["ask"]: (r["id"], r["status"]) for r in k.read_alternate(by, m, "ask", "alt", "id").collect()} == {"B": ("7", "00"), "Z": (None, "23")}
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(k.start(m, "id", ">=", "K2")) == ["K3"]
    assert ids(k.start(m, "id", "=", "K1")) == ["K1", "K3"] and ids(k.start(m, "id", "=", "K2")) == []
    assert ids(k.start(m, "alt", "NOT <", "A", tie="id")) == ["K1", "7", "K3"]
    assert k.start_status(m, "id", ">", "Z").first()[0] == "23"
    with pytest.raises(ValueError):
        k.start(m, "id", "<", "A")
    n = spark.range(1, 6).select(k.sequential_status(F.col("id"), F.lit(3)))
    assert [r[0] for r in n.collect()] == ["00", "00", "00", "10", "46"]


def test_first_record_loads(spark):
    rows = spark.createDataFrame([(2, "K", "late"), (1, "K", "early"), (3, "L", "x")], "at int, id string, v string")
    assert sorted(tuple(r) for r in k.load(rows, "id", "at").collect()) == [("K", "early"), ("L", "x")]


def test_writes_with_null_alternates(spark):
    """Null alternates share nothing; a null primary key is turned down; it ends."""
    master = spark.createDataFrame([(1, "a")], "id int, alt string")
    requests = spark.createDataFrame([(1, 2, None), (2, 3, None), (3, 4, "a"), (4, None, None), (5, None, "b"), (6, 5, "b"), (7, 6, "b"), (8, 2, None)], "seq int, id int, alt string")
    out = k.write_batch(master, requests, k.KeySpec("id", (k.Alternate("alt"),)), "seq").outcomes
    assert {r.seq: r.status for r in out.collect()} == {1: "00", 2: "00", 3: "22", 4: "22", 5: "22", 6: "00", 7: "22", 8: "22"}


def test_rounds_do_not_grow_with_the_requests_of_a_key(spark, tmp_path):
    """A key that many requests share is settled in as many steps as one that few share."""
    import os

    spec = k.KeySpec("id", (k.Alternate("a"),))
    master = spark.createDataFrame([(1, 10), (2, 20)], "id bigint, a bigint")
    before = spark.sparkContext.getCheckpointDir()
    made = []
    for n in (12, 600):
        spark.sparkContext.setCheckpointDir(str(tmp_path / str(n)))
        rows = [(s, 1, [10, 20, 30][s % 3], ["REWRITE", "DELETE", "WRITE", "READ"][s // 2 % 4]) for s in range(n)]
        got = {r["seq"]: r["status"] for r in k.apply_batch_unique(master, spark.createDataFrame(rows, "seq bigint, id bigint, a bigint, op string"), spec, "seq").outcomes.collect()}
        there, want = True, {}
        for s, _, a, op in rows:
            ok = {"WRITE": not there and a != 20, "REWRITE": there and a != 20}.get(op, there)
            want[s] = "00" if ok else "23" if op != "WRITE" and not there else "22"
            there = there if want[s] != "00" else {"WRITE": True, "DELETE": False}.get(op, there)
        assert got == want
        made.append(sum(len([d for d in dirs if d.startswith("rdd-")]) for _, dirs, _ in os.walk(tmp_path / str(n))))
    spark.sparkContext.setCheckpointDir(before or str(tmp_path))
    assert made[0] == made[1]


def test_rewrite_with_unique_alternate(spark):
    """An alternate that another record holds is turned down, one that was freed is not; nulls share nothing."""
    spec = k.KeySpec("id", (k.Alternate("a"), k.Alternate("b")))
    master = spark.createDataFrame([(1, 10, None), (2, 20, None), (3, 30, "x")], "id bigint, a bigint, b string")
    rows = [(1, 1, 20, None), (2, 2, 25, None), (3, 1, 20, None), (4, 9, 1, None), (5, 3, 10, "y"), (6, 2, 77, "x"), (7, None, 5, None), (8, 1, None, "y")]
    r = k.rewrite_batch(master, spark.createDataFrame(rows, "seq bigint, id bigint, a bigint, b string"), "id", "seq", spec)
    assert {x["seq"]: x["status"] for x in r.outcomes.collect()} == {1: "22", 2: "00", 3: "00", 4: "23", 5: "00", 6: "00", 7: "23", 8: "22"}
    assert sorted(tuple(x) for x in r.master.collect()) == [(1, 20, None), (2, 77, "x"), (3, 10, "y")]


def test_store_opens_only_the_files_in_range(spark, tmp_path):
    from recordloom.sources.keyed_store import write_store

    rows = [(i * 3, f"a{i % 50}", i) for i in range(1_000)]
    df = spark.createDataFrame(rows, "id bigint, alt string, v int").repartition(3)
    store = write_store(df, k.KeySpec("id", (k.Alternate("alt", True),)), str(tmp_path / "store"), files=20)
    every = set(spark.read.parquet(str(tmp_path / "store" / "primary" / "rows")).inputFiles())
    assert len(every) == 20
    late = store.start(">=", 2_700)
    assert sorted(r["id"] for r in late.collect()) == list(range(2_700, 3_000, 3)) and len(late.inputFiles()) <= 4
    assert [r["v"] for r in store.read(300).collect()] == [100] and len(store.read(300).inputFiles()) == 1
    assert store.read(301).count() == 0 and store.start("=", 301).count() == 0 and store.start(">", 2_997).count() == 0
    assert store.start("=", 300).agg({"id": "min"}).first()[0] == 300 and store.start(">", 300).agg({"id": "min"}).first()[0] == 303
    between = store.between(30, 60)
    assert sorted(r["id"] for r in between.collect()) == list(range(30, 61, 3)) and len(between.inputFiles()) <= 2
    assert sorted(r["v"] for r in store.read_alternate("alt", "a7").collect()) == [i for i in range(1_000) if i % 50 == 7]
    assert store.read_alternate("alt", "zz").count() == 0


@pytest.mark.parametrize("settled", [0, 40, 10**6])
def test_writes_are_let_in_side_by_side(spark, monkeypatch, settled):
    """Few requests are left to one task, however many hang together; null keys and alternates too."""
    monkeypatch.setattr(k, "SETTLED", settled, raising=False)
    r = random.Random(5)
    some = lambda n: r.choice([None, *range(n), *range(n), *range(n)])
    held = [(-1, 500), (3, 501), (4, None), (-2, 7)]
    asked = [(i, some(60), some(40), some(300)) for i in range(400)]
    master = spark.createDataFrame([(a, b, 1000 + a) for a, b in held], "id int, alt int, other int")
    requests = spark.createDataFrame(asked, "seq int, id int, alt int, other int").repartition(3)
    spec = k.KeySpec("id", (k.Alternate("alt"), k.Alternate("other")))
    _, rest = k._open_writes(master, requests, spec, "seq")
    assert rest.count() <= settled
    ids, alts, others = {a for a, _ in held}, {b for _, b in held if b is not None}, {1000 + a for a, _ in held}
    want = {}
    for seq, i, a, o in asked:
        free = i is not None and i not in ids and a not in alts and o not in others
        want[seq] = "00" if free else "22"
        if free:
            ids.add(i)
            alts |= {a} - {None}
            others |= {o} - {None}
    done = k.write_batch(master, requests, spec, "seq")
    assert {x["seq"]: x["status"] for x in done.outcomes.collect()} == want
    assert done.master.count() == len(held) + sum(s == "00" for s in want.values())
