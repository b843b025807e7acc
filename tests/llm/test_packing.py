"""Packing against the tokenizer itself, and plans against what no plan can beat."""

from __future__ import annotations

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

from recordloom.llm.packing import SEQUENCE, Plan, WordIds, best_plan, packed, tokenizer_path
from tests.oracle import DATA


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def check(docs, got, tokenizer):
    """``got`` are the pieces of ``docs`` (doc_id, text), and fill sequences without a gap."""
    want = Counter()
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), SEQUENCE)):
            part = ids[start : start + SEQUENCE]
            want[i, k, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in rows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    return len(rows), sum(r["length"] for r in got)


def test_documents(spark, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    sequences, tokens = check(docs, packed(df).collect(), tokenizer)
    assert sequences <= -(-tokens // SEQUENCE) + 1


def test_odd_tables(spark, tokenizer):
    docs = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (None, "a b"), (4, "long words " * 9_000), (5, "x " * 4_095), (6, "same"), (6, "same"), (6, "other")]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id bigint, text string, piece int, length int, _part int, _at int")
    check(docs, packed(df).collect(), tokenizer)
    assert packed(df.limit(0)).count() == 0


def test_word_ids_are_those_of_whole_texts(tokenizer):
    ids, r = WordIds(tokenizer_path()), random.Random(2)
    letters = "abZ'sdtlvrem019.,;:!?\"()<|>-_ \n\t\x0b\x1f\x00\x85\xa0éÉßüΣİ́​“”…日"
    texts = ["<|endoftext|> hi<|startoftext|>x", "don't 'S it's", "ΣΑΣ İ;", "Ǆ 각 é", *("".join(r.choices(letters, k=r.randrange(30))) for _ in range(4_000))]
    for text in texts:
        want = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert ids.of(text.encode()) == struct.pack(f"<{len(want)}I", *want), text


def planned(counts):
    plan, rows, given = best_plan(counts), defaultdict(list), Counter()
    for length, rank, times, first, offset in plan.slots:
        assert times > 0
        given.update((length, k) for k in range(rank, rank + times))
        for k in range(times):
            rows[first + k].append((offset, length))
    assert given == Counter((length, k) for length, n in counts.items() for k in range(n))
    assert len(rows) == plan.sequences
    for placed in rows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= SEQUENCE
    return plan


@pytest.mark.parametrize(("low", "high", "n", "slack"), [(1, 20, 5_000, 0), (3, 3, 4_000, 0), (1, 4_096, 4_000, 0.02), (1, 1_500, 4_000, 0.001), (1_300, 1_400, 4_000, 0.02), (2_000, 2_100, 2_000, 0.05), (2_049, 2_060, 500, 0)])
def test_plans(low, high, n, slack):
    r = random.Random(low + high)
    counts = Counter(r.randint(low, high) for _ in range(n))
    plan = planned(dict(counts))
    least = max(-(-sum(k * v for k, v in counts.items()) // SEQUENCE), sum(v for k, v in counts.items() if k > SEQUENCE // 2))
    assert plan.least == least and plan.sequences <= least * (1 + slack) + 1


def test_plans_do_not_grow_with_documents():
    r = random.Random(1)
    counts = Counter(min(4_096, int(r.lognormvariate(6.5, 1))) or 1 for _ in range(20_000))
    once, often = Plan(dict(counts)), Plan({k: v * 1_000_000 + r.randrange(1_000) for k, v in counts.items()})
    assert len(often.slots) < 3 * len(once.slots)
    assert often.sequences <= often.least * 1.00001 + 1
