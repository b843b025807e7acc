"""Language of a text by a convolutional network over its bytes.

Fixed-length windows of UTF-8 bytes pass filters of several widths, the maximum
of each filter over the window, and a softmax. The network is trained in numpy
on windows of a bounded sample of labelled texts and then applied to every
window of every text, batch by batch; a text's language is the one with the
highest mean log probability, windows weighted by their bytes.

Null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing is labelled. A null doc_id is never learned from and is not
held out. Repeated rows each get their own, equal, result. Very long texts are cut
into windows whole. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, held_out, may_learn

WINDOW = 128           # bytes
WIDTHS = (2, 3, 4)     # of filters
FILTERS = 12           # of each width
EMBEDDING = 8          # numbers a byte
SAMPLE_TEXTS = 3_000   # labelled texts to learn from at most (expected number), shared evenly by the languages
SAMPLE_WINDOWS = 4     # windows of each, at pseudorandom places of the whole text
STEPS, BATCH, RATE = 500, 64, 0.01
CHUNK = 2_048          # windows at a time
UNKNOWN = "und"
LEAST_SCORE = 0.35     # below it the pipeline rejects a text


@dataclass
class ByteNet:
    """Weights; ``tables`` are the filters by byte value, made when first used."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]     # (width, EMBEDDING, FILTERS)
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    tables: list = field(default_factory=list)

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """(windows, WINDOW) bytes to (windows, languages)."""
        if not self.tables:
            self.tables = [[np.ascontiguousarray(self.embed @ w[j]) for j in range(len(w))] for w in self.filters]
        top = []
        for t in self.tables:
            n = x.shape[1] - len(t) + 1
            y = t[0][x[:, :n]]
            for j in range(1, len(t)):
                y += t[j][x[:, j : j + n]]
            top.append(y.max(axis=1))
        h = np.maximum(np.concatenate(top, axis=1) + self.bias, 0)
        z = h @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled with zeros."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


def train(examples: list[tuple[str, str]], seed: int = 3) -> ByteNet | None:
    """A network from (language, piece of text); None without examples."""
    examples = sorted(e for e in examples if e[1])
    if not examples:
        return None
    langs = sorted({lang for lang, _ in examples})
    x = np.concatenate([windows(t.encode("utf-8", "surrogatepass")[:WINDOW]) for _, t in examples])
    y = np.array([langs.index(lang) for lang, _ in examples])
    r = np.random.default_rng(seed)
    scale = lambda *s: r.normal(0, 1 / np.sqrt(np.prod(s[:-1])), s).astype(np.float32)
    p = [r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32), *[scale(w, EMBEDDING, FILTERS) for w in WIDTHS],
         np.zeros(len(WIDTHS) * FILTERS, np.float32), scale(len(WIDTHS) * FILTERS, len(langs)), np.zeros(len(langs), np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1):
        at = r.integers(0, len(x), BATCH)
        for a, g, b, c in zip(p, _gradients(p, x[at], y[at]), m, v, strict=True):     # Adam
            b *= 0.9
            b += 0.1 * g
            c *= 0.999
            c += 0.001 * g * g
            a -= RATE * (b / (1 - 0.9**step)) / (np.sqrt(c / (1 - 0.999**step)) + 1e-8)
    return ByteNet(langs, p[0], p[1:-3], p[-3], p[-2], p[-1])


def _gradients(p: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    embed, filters, bias, dense, dense_bias = p[0], p[1:-3], p[-3], p[-2], p[-1]
    e, at, top = embed[x], [], []
    rows = np.arange(len(x))[:, None]
    for w in filters:
        n = x.shape[1] - len(w) + 1
        z = sum(e[:, j : j + n] @ w[j] for j in range(len(w)))
        at.append(z.argmax(axis=1))
        top.append(z.max(axis=1))
    h = np.concatenate(top, axis=1) + bias
    a = np.maximum(h, 0)
    z = a @ dense + dense_bias
    q = np.exp(z - z.max(axis=1, keepdims=True))
    q /= q.sum(axis=1, keepdims=True)
    q[np.arange(len(y)), y] -= 1
    q /= len(y)
    dh = (q @ dense.T) * (h > 0)
    d_embed, d_filters = np.zeros_like(embed), []
    for k, w in enumerate(filters):
        d = dh[:, k * FILTERS : (k + 1) * FILTERS]
        g = np.empty_like(w)
        for j in range(len(w)):          # only the place of the maximum passes a gradient on
            byte = x[rows, at[k] + j]
            g[j] = np.einsum("bfe,bf->ef", embed[byte], d)
            np.add.at(d_embed, byte, d[:, :, None] * w[j].T[None])
        d_filters.append(g)
    return [d_embed, *d_filters, dh.sum(axis=0), a.T @ q, q.sum(axis=0)]


def learn(docs: DataFrame, seed: int = 3) -> ByteNet | None:
    """Trains on pieces of at most about SAMPLE_TEXTS labelled texts."""
    labelled = docs.where(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}   # a row a language
    if not counts:
        return None
    quota = SAMPLE_TEXTS / len(counts)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, quota / n))]), F.col("lang"))
    place = [F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed + 1 + k)), F.greatest(F.length("text") - WINDOW // 2, F.lit(1))).cast("int") + 1 for k in range(SAMPLE_WINDOWS)]
    pieces = labelled.where(draw < share).select("lang", F.explode(F.array(*[F.col("text").substr(s, F.lit(WINDOW)) for s in place])).alias("piece"))
    return train([(r["lang"], r["piece"]) for r in pieces.collect()], seed)


def predictor(net: ByteNet | None):
    """A column function: text to (lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs = np.full(len(texts), UNKNOWN, object)
        scores = np.zeros(len(texts))
        held, rows, n = [], [], 0

        def flush() -> None:
            x = np.concatenate(held)
            lp = np.concatenate([net.log_probs(x[k : k + CHUNK]) for k in range(0, len(x), CHUNK)])
            lp *= (x != 0).sum(axis=1, keepdims=True) + 1e-9       # a window counts by its bytes
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            total = np.add.reduceat(lp, starts, axis=0)
            weight = np.add.reduceat((x != 0).sum(axis=1) + 1e-9, starts)
            mean = total / weight[:, None]
            q = np.exp(mean - mean.max(axis=1, keepdims=True))
            q /= q.sum(axis=1, keepdims=True)
            langs[rows] = np.array(net.langs, object)[q.argmax(axis=1)]
            scores[rows] = np.clip(q.max(axis=1), 0, 1)

        for k, t in enumerate(texts):
            if net is None or t is None or not any(map(str.isalpha, t)):
                continue
            w = windows(t.encode("utf-8", "surrogatepass"))
            held.append(w)
            rows.append(k)
            n += len(w)
            if n >= CHUNK:
                flush()
                held, rows, n = [], [], 0
        if held:
            flush()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return predict.asNondeterministic()      # else a filter on the result would run it once more


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, predictor(net)(F.col("text")).alias("_p")).select(*kept, "_p.lang_pred", "_p.score")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is known well enough, as they came."""
    told = identify(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns], "text"), learn(docs))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    told = identify(docs.select("doc_id", "text"), learn(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
