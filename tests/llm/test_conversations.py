"""Conversation repair against a search that keeps every survivor's whole string."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from recordloom.llm.conversations import SETTLE, Repair, damaged, repaired

NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
STATE = {"s": 1, "u": 2, "a": 3}
NAME = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, lines) for rows (role, text, must go, truncated)."""
    best = {0: (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            for q, (c, s, lines) in list(out.items()):
                to, way = STATE[NEXT[q]], (c + 2, s + "I", (*lines, NAME[NEXT[q]] + ":"))
                out[to] = min(out.get(to, way), way)
        return out

    for role, text, gone, open_ in rows:
        new = {}
        for q, (c, s, lines) in inserted(best).items():
            ways = [(q, (c + 3, s + "D", lines))]
            if not gone:
                i = role[:1]
                if i == "s" and q == 0 or i and i == NEXT[q]:
                    ways.append((STATE[i], (c + open_, s + "K", (*lines, f"{role}:{text}"))))
                ways.append((STATE[NEXT[q]], (c + 2 + open_, s + "R", (*lines, f"{NAME[NEXT[q]]}:{text}"))))
            for to, way in ways:
                new[to] = min(new.get(to, way), way)
        best = new
    return min(way for q, way in inserted(best).items() if q in (0, 3))


def found(rows):
    r = Repair()
    for row in rows:
        r.row(*row)
    return r.end(), r


def check(rows):
    cost, audit, lines = cheapest(rows)
    got, r = found(rows)
    assert got == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return r


def test_random_conversations():
    r = random.Random(4)
    for k in range(3_000):
        pool = r.choice([["system", "user", "assistant", "tool", ""], ["user", "assistant"], ["assistant", "system"], ["user"], ["system", "user"]])
        check([(r.choice(pool), f"t{k}", r.random() < 0.2, r.random() < 0.3) for k in range(r.randrange(14))])


def test_long_conversations_stay_in_bounded_memory():
    r = random.Random(5)
    for pool, gone in ((["user", "assistant"], 0.1), (["system", "user", "assistant"], 0.5), (["user", "assistant", "tool"], 0.0), (["system"], 0.3)):
        repair = check([(r.choice(pool), "x", r.random() < gone, r.random() < 0.3) for _ in range(3_000)])
        assert repair.most < 4 * SETTLE


def test_ties_that_stay_open():
    """Two whole repairs of a conversation can cost the same to its end."""
    check([("user", "x", False, False)] * 400)
    check([("assistant", "x", False, False)] * 401)
    check([("tool", "x", True, True)] * 300 + [("user", "y", False, False)])


def plain(rows):
    """The result for rows (conv_id, turn, role, text) of a table."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(case, text)
            kept += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, told, counts = set(), [], [0, 0, 0, 0]
        for k, (_, role, text) in enumerate(kept):
            blank, again, open_ = not text.strip(" \t\n\v\f\r"), (role, text) in seen, text.strip(" \t\n\v\f\r")[-1:] not in (".", "!", "?")
            seen.add((role, text))
            if blank or again or open_:
                counts[0 if blank else 1 if again else 2] += 1
            counts[3] += k > 0 and kept[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
            told.append((role, text, blank or again, open_ and not blank))
        turns = {t for t, *_ in kept if t is not None}
        cost, audit, lines = cheapest(told)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, times int, first string, _turn int"
NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 3) for r in rows], SCHEMA)


def test_tables(spark):
    r = random.Random(6)
    texts = [None, "", " \t", "Yes.", "No", "Why?! ", "ok.\n", "é", "x" * 100_000 + "."]
    rows = [(r.choice([None, 1, 2, 3, 4, -5]), r.choice([None, *range(30)]), r.choice([None, "", "user", "assistant", "system", "tool"]), r.choice(texts)) for _ in range(250)]
    rows += [(7, t, "user", "same.") for t in range(200)] + [(8, None, "user", "a.")] + [(9, 4, "user", "twice.")] * 3
    rows += [(c, 0, "user", "alone.") for c in range(100, 140)]
    got = {x["conv_id"]: tuple(x[n] for n in NAMES) for x in repaired(damaged(table_of(spark, rows))).collect()}
    want = plain(rows)
    assert {c for c in want if got.get(c) != want[c]} == set() and got.keys() == want.keys()
    assert any(w[-2] == "" for w in want.values())


def test_empty_table(spark):
    assert repaired(damaged(table_of(spark, []))).count() == 0
