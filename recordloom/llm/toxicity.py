"""Toxicity by weak supervision.

Words and word beginnings that labelled rows show to be toxic make up lexicons;
many lexicon and pattern voters look for them. A generative label model, fitted
by expectation maximisation, estimates how often each voter fires in toxic and
in clean texts and how voters hang together, so that voters which repeat one
another do not count twice. Its posterior, with the label as one more voter, is
what a linear classifier over the lexicon entries learns; the classifier scores
every whole text.

Learning reads a bounded sample: about TOXIC_ROWS and CLEAN_ROWS labelled rows.
Null and empty texts hit nothing and get the score of a text without hits. Rows
that repeat are scored alike, a null doc_id is not held out. If a class has no
labelled row, every score is the share of toxic labels (0 without any). Very long
texts are scored whole. An empty table gives an empty table. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, held_out, may_learn, stored
from recordloom.llm.shingles import words
from recordloom.session import table

TOXIC_ROWS, CLEAN_ROWS = 6_000, 18_000     # labelled rows to learn from, about, at most
ENTRIES = 4_000                            # of the lexicons together, the most telling
BEGINNINGS = (3, 4, 5, 6, 7)               # letters of a word's beginning that can be an entry
LEAST_GAIN, LEAST_ODDS = 15.0, 1.5         # likelihood ratio and log odds that make an entry
WORD_VOTERS = 3                            # the whole words are dealt out to so many lexicons
LABEL_TRUST = 0.95                         # how often a label is taken to be right
CACHE = 1 << 17                            # words whose entries a task keeps
SOME_ENTRIES = 1 << 16                     # counts that a task holds before it hands them on
SLICE = 256                                # texts that a task holds as Python strings
STRIP = b".,;:!?\"'()[]{}|#*$%&<>-_"
THRESHOLD = 0.3


def entries_of(word: bytes) -> list[str]:
    """A word's possible lexicon entries: itself and its beginnings."""
    w = word.strip(STRIP).decode("utf-8", "replace").casefold()
    if not w or not w[0].isalpha():
        return []
    return [f"={w}", *[w[:k] for k in BEGINNINGS if len(w) > k]]


def sliced(texts: pa.Array):
    """The texts, of which few are Python strings at a time."""
    for i in range(0, len(texts), SLICE):
        yield from texts.slice(i, SLICE).to_pylist()


class Finder:
    """Numbers of the lexicon entries in a text. The first CACHE words are kept, frequent ones among them."""

    def __init__(self, lexicon: list[str]):
        self.at = {e: k for k, e in enumerate(lexicon)}
        self.starts = {e.removeprefix("=")[:3] for e in lexicon}
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> set[int]:
        out: set[int] = set()
        cache = self.cache
        for w in set(words(text)):
            hit = cache.get(w)
            if hit is None:
                start = w.strip(STRIP).decode("utf-8", "replace").casefold()[:3]
                hit = tuple(self.at[e] for e in entries_of(w) if e in self.at) if start in self.starts else ()
                if len(cache) < CACHE:
                    cache[w] = hit
            if hit:
                out.update(hit)
        return out


def voters_of(lexicon: list[str]) -> tuple[np.ndarray, int]:
    """The voter of each entry, and how many voters there are besides the patterns."""
    kind = {k: WORD_VOTERS + i for i, k in enumerate(BEGINNINGS)}
    which = [sum(e.encode()) % WORD_VOTERS if e[0] == "=" else kind[len(e)] for e in lexicon]
    return np.array(which, np.int64), WORD_VOTERS + len(BEGINNINGS)


def ballots(hits: list[list[int]], lexicon: list[str]) -> np.ndarray:
    """(texts, voters) of 0 and 1: each lexicon, and two patterns, several whole
    words and several words of any kind."""
    which, n = voters_of(lexicon)
    whole = np.array([e[0] == "=" for e in lexicon], bool)
    out = np.zeros((len(hits), n + 2), np.int8)
    for row, h in zip(out, hits, strict=True):
        if len(h):
            row[which[h]] = 1
            row[n] = whole[h].sum() >= 2
            row[n + 1] = len(h) >= 4
    return out


@dataclass
class LabelModel:
    """P(fires | class) of each voter, and how much of a voter is its own."""

    prior: float
    fires: np.ndarray      # (2, voters)
    own: np.ndarray

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.fires[1] / self.fires[0])
        off = np.log((1 - self.fires[1]) / (1 - self.fires[0]))
        return math.log(self.prior / (1 - self.prior)) + np.where(votes == 1, on, off) @ self.own


def fit_label_model(votes: np.ndarray, weight: np.ndarray, prior: float, rounds: int = 50) -> LabelModel:
    """Expectation maximisation; correlations within the classes set ``own``."""
    v = votes.shape[1]
    model = LabelModel(prior, np.stack([np.full(v, 0.02), np.full(v, 0.5)]), np.full(v, 1 / max(v, 1)))
    x = votes.astype(np.float64)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(model.log_odds(votes), -40, 40)))
        a, b = weight * q, weight * (1 - q)
        fires = np.stack([(b @ x + 0.02) / (b.sum() + 1), (a @ x + 0.5) / (a.sum() + 1)])
        together = np.zeros((v, v))
        for c, w in ((0, b), (1, a)):
            mean = (w @ x) / max(w.sum(), 1e-9)
            d = x - mean
            together += (d * w[:, None]).T @ d
        s = np.sqrt(np.maximum(np.diag(together), 1e-12))
        corr = np.clip(together / np.outer(s, s), 0, 1)
        np.fill_diagonal(corr, 1)
        new = LabelModel(min(max(a.sum() / weight.sum(), 1e-4), 0.5), np.clip(fires, 1e-4, 1 - 1e-4), 1 / corr.sum(axis=1))
        done = np.abs(new.fires - model.fires).max() < 1e-5
        model = new
        if done:
            break
    return model


def fit_linear(hits: list[list[int]], q: np.ndarray, weight: np.ndarray, n: int, decay: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels ``q``."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    cols = np.array([k for h in hits for k in h], np.int64)
    w, bias = np.zeros(n), math.log(max((weight @ q) / weight.sum(), 1e-4) / max(1 - (weight @ q) / weight.sum(), 1e-4))
    seen, seen_b = np.full(n, 1e-6), 1e-6
    for _ in range(steps):                       # gradient steps scaled by what each weight has seen
        z = bias + np.bincount(rows, w[cols], len(hits))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - q)
        gw, gb = np.bincount(cols, g[rows], n) + decay * w, g.sum()
        seen += gw * gw
        seen_b += gb * gb
        w -= 0.5 * gw / np.sqrt(seen)
        bias -= 0.5 * gb / math.sqrt(seen_b)
    return w, bias


@dataclass
class Scorer:
    lexicon: list[str]
    weights: np.ndarray
    bias: float

    def column(self):
        lexicon, weights, bias = self.lexicon, self.weights, self.bias
        find = Finder(lexicon)

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            z = np.array([bias + weights[sorted(h)].sum() if (h := find(t)) else bias for t in sliced(texts)], np.float64)
            return pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))

        return score.asNondeterministic()


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of labelled rows, and how many of each class there are in all."""
    known = labels.where(may_learn(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.when(F.col("toxic") == 1, TOXIC_ROWS / max(counts.get(1, 0), 1)).otherwise(CLEAN_ROWS / max(counts.get(0, 0), 1))
    # bounded, so as many files as there are cores will do: each new file costs the file system's calls, and some start a process
    n = docs.sparkSession.sparkContext.defaultParallelism
    chosen = stored(known.where(draw < share).repartition(n), "chosen")
    return stored(docs.select("doc_id", "text").join(chosen, "doc_id").repartition(n), "sample"), counts


def _entry_counts(batches):
    """Entries with the texts of either class that have them; one that comes in several parts has several rows."""
    found = Counter(), Counter()

    def rows():
        every = list(found[0].keys() | found[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([found[c][e] for e in every], pa.int64()) for c in (1, 0)]], names=["entry", "pos", "neg"])
        for some in found:
            some.clear()
        return out

    for batch in batches:
        for toxic, text in zip(batch.column("toxic").to_pylist(), sliced(batch.column("text")), strict=True):
            found[1 if toxic else 0].update({e for w in set(words(text)) for e in entries_of(w)})
            if len(found[0]) + len(found[1]) >= SOME_ENTRIES:
                yield rows()
    yield rows()


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    sample, counts = _sample(docs, labels)
    n_pos, n_neg = (sample.where(F.col("toxic") == c).count() for c in (1, 0))
    if not n_pos or not n_neg:
        total = counts.get(0, 0) + counts.get(1, 0)
        p = counts.get(1, 0) / total if total else 0.0
        return Scorer([], np.zeros(0), math.log(max(p, 1e-12) / max(1 - p, 1e-12)))
    seen = sample.select("toxic", "text").mapInArrow(_entry_counts, "entry string, pos bigint, neg bigint").groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3")
    p, base = F.col("pos") / (F.col("pos") + F.col("neg")), n_pos / (n_pos + n_neg)
    gain = 2 * (F.col("pos") * F.log(p / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - p) / (1 - base))).otherwise(0.0))
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_neg + 1))
    best = seen.where((gain >= LEAST_GAIN) & (odds >= LEAST_ODDS)).orderBy(gain.desc(), "entry").limit(ENTRIES)
    lexicon = sorted(r["entry"] for r in best.select("entry").collect())

    find = Finder(lexicon)

    @F.arrow_udf("array<int>")
    def hits_of(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(find(t)) for t in sliced(texts)], pa.list_(pa.int32()))

    rows = sorted((r["doc_id"], r["toxic"], r["h"]) for r in sample.select("doc_id", "toxic", hits_of("text").alias("h")).collect())   # the sample's rows
    hits, gold = [r[2] for r in rows], np.array([r[1] for r in rows])
    weight = np.where(gold == 1, counts[1] / n_pos, counts[0] / n_neg) * len(rows) / (counts[0] + counts[1])
    votes = ballots(hits, lexicon)
    model = fit_label_model(votes, weight, counts[1] / (counts[0] + counts[1]))
    trust = math.log(LABEL_TRUST / (1 - LABEL_TRUST))
    q = 1 / (1 + np.exp(-np.clip(model.log_odds(votes) + np.where(gold == 1, trust, -trust), -40, 40)))
    return Scorer(lexicon, *fit_linear(hits, q, weight, len(lexicon)))


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, predicted for each row of ``docs`` (doc_id, text)."""
    out = docs.select("doc_id", scorer.column()(F.col("text")).alias("score"))
    return out.select("doc_id", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
