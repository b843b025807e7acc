"""Passages that repeat, within a text or across texts: paragraph MinHash banding over all words.

Paragraphs are chosen by the words themselves, not by lines: a text is cut where
the hash of two neighbouring words is the smallest among those of the eight words
on either side, 17 words apart on average. The same passage is so cut alike
wherever it stands, wrapped over short lines or inside a longer one, but for its
first and last words. Where no place stands out (a word again and again), cuts
come every 32 words. Every word belongs to one paragraph; those of fewer than five
words are not looked up.

Each paragraph has four minima over its five-word shingles, four bands of one row:
a pair of similarity 0.75 is missed one time in 250, equal ones never. Paragraphs
with equal shingles are one class. Classes that meet in a band are compared on
full sets: exact prefixes of their rarest shingles say which (two sets as near as
asked share one of their first n - ceil(0.75 n) + 1 shingles in any order, so none
is lost), which keeps paragraphs apart that have only a common phrase. Links make
components. Of each component the first place, by doc_id and word, stays and the
others are marked for removal; neighbouring paragraphs with one verdict are one
stretch, and stretches of 24 words or more are returned.

Sizes: a band's rows are read in order, a bucket is never held. Copies that a
task has seen before go past the buckets, dealt by their place, so a group with a
third of all rows has a row a task in each bucket.

Null, empty and short texts give no row, as do rows with a null doc_id. Rows that
repeat a doc_id and text are one text; different texts under one doc_id are told
apart by their hash. Very long texts are cut like others, whole. An empty table
gives an empty table; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, stored
from recordloom.llm.components import contracted
from recordloom.llm.near import links
from recordloom.llm.shingles import _ODD, WIDTH, MinMax, _mixed

SIDE = 8                  # words on either side of a cut that are no better cut
LONGEST, FORCED = 64, 32  # a longer paragraph is cut after so many words
BANDS = 4
PERCENT = 75
LEAST_WORDS = 24
CHUNK = 1 << 17           # bytes that are cut and sketched together
SEGMENT = 1 << 18         # bytes that are hashed at a time
SEEN = 1 << 17            # paragraphs that a task remembers; it starts anew beyond that
MEMBER = 7                # in place of a band's number: a copy of a paragraph that the task has seen

_SPACE = re.compile(rb"[\x09-\x0d ]")
_PLACE = 1 << 24          # paragraphs in a text, at most


def places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, in code points."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
    points = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    return points[np.flatnonzero(space[:-1] & ~space[1:])], points[np.flatnonzero(~space[:-1] & space[1:])]


def cuts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first words of the paragraphs of some texts: ``h`` are the hashes of all their words, end
    to end, ``starts`` where each text begins. A text is cut alike whatever it is put together with."""
    wide = 2 * SIDE + 1
    at = starts
    if len(h) > wide:
        x = _mixed(h[:-1] * _ODD[0] + h[1:] * _ODD[1])
        low = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(x, wide).argmin(axis=1) == SIDE) + SIDE
        text = np.searchsorted(starts, low, "right") - 1
        ends = np.append(starts[1:], len(h))
        inside = (low - starts[text] >= SIDE) & (low + SIDE + 2 <= ends[text])
        at = np.sort(np.concatenate([starts, low[inside]]))
    gaps = np.diff(np.append(at, len(h)))
    long = np.flatnonzero(gaps > LONGEST)
    if len(long):
        forced = [np.arange(a + FORCED, a + g - FORCED // 2, FORCED) for a, g in zip(at[long].tolist(), gaps[long].tolist(), strict=True)]
        at = np.sort(np.concatenate([at, *forced]))
    return at


def _shingles(h: np.ndarray) -> np.ndarray:
    """The hash of the five words from each word on; the last four have none that counts."""
    x = np.zeros(len(h), np.uint64)
    if len(h) >= WIDTH:
        sums = h[: len(h) - WIDTH + 1] * _ODD[0]
        for j in range(1, WIDTH):
            sums += h[j : len(h) - WIDTH + 1 + j] * _ODD[j]
        x[: len(sums)] = _mixed(sums)
    return x


_BASE = 0x9E3779B97F4A7C55
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * SEGMENT, _BASE, np.uint64))))
_INVERSE = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * SEGMENT, pow(_BASE, -1, 1 << 64), np.uint64))))


def hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of some text, A-Z in lower case, and where it begins: all at once, from
    running sums of the bytes times powers of a base, segment by segment."""
    data = data.lower()
    found, begins, at = [], [], 0
    while at < len(data):
        end = len(data)
        if end - at > SEGMENT and (m := _SPACE.search(data, at + SEGMENT)):
            end = m.end()
        b = np.frombuffer(data, np.uint8, end - at, at)
        space = np.concatenate(([True], (b == 32) | ((b >= 9) & (b <= 13)), [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last = edge[::2], edge[1::2]
        n = len(b)
        powers, inverse = (_POWERS, _INVERSE) if n <= 2 * SEGMENT else (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64)))) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * powers[:n])))
        found.append(_mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64) * _ODD[20]))
        begins.append(first + at)
        at = end
    return (np.concatenate(found), np.concatenate(begins)) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _chunks(batch: pa.RecordBatch, text: str = "text", least: int = LEAST_WORDS):
    """The texts of a batch with ``least`` words or more, some at a time: row numbers, words' hashes, first words."""

    def chunk(rows: list[int], texts: list[bytes]):
        h, begins = hashes(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        count = np.diff(np.searchsorted(begins, np.concatenate(([0], ends))))
        some = count >= least
        starts = np.cumsum(count[some]) - count[some]
        return np.array(rows)[some], h[np.repeat(some, count)], starts

    rows, texts, size = [], [], 0
    for k, t in enumerate(batch.column(text)):
        own = t.as_py()
        if own is None or len(own) < 2 * least - 1:
            continue
        rows.append(k)
        texts.append(own)
        size += len(own)
        if size >= CHUNK:
            got = chunk(rows, texts)
            if len(got[0]):
                yield got
            rows, texts, size = [], [], 0
    if rows:
        got = chunk(rows, texts)
        if len(got[0]):
            yield got


class _Sketch:
    def __init__(self):
        r = np.random.default_rng(23)
        self.a = r.integers(1, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    def __call__(self, h: np.ndarray, starts: np.ndarray):
        """Text, number in it, digest and band keys (a row a band) of each paragraph of at least five words."""
        first = cuts(h, starts)
        ends = np.append(first[1:], len(h))
        x = _shingles(h)
        cross = np.zeros(len(h), bool)
        for j in range(1, WIDTH):
            cross[np.maximum(ends - j, first)] = True
        parts = _mixed(x ^ _ODD[9])
        parts[cross] = 0
        whole = np.flatnonzero(ends - first >= WIDTH)
        digest = _mixed(np.add.reduceat(parts, first))[whole]
        keys = np.empty((BANDS, len(whole)), np.uint64)
        for k in range(BANDS):
            y = x * self.a[k] + self.b[k]
            y[cross] = np.uint64(0xFFFFFFFFFFFFFFFF)
            keys[k] = _mixed(np.minimum.reduceat(y, first)[whole] ^ _ODD[10 + k])
        text = np.searchsorted(starts, first, "right") - 1
        number = np.arange(len(first)) - np.searchsorted(first, starts)[text]
        return text[whole], number[whole], digest, keys


def _banded(batches):
    """(doc_id, th, text as bytes) to (key, digest, doc_id, at, band): a row a band, or one for a paragraph seen before."""
    sketch, seen = _Sketch(), {}
    for batch in batches:
        th = batch.column("th").to_numpy()
        for rows, h, starts in _chunks(batch):
            text, number, digest, keys = sketch(h, starts)
            row = rows[text]
            at = th[row] // _PLACE * _PLACE + number
            new, again = [], []
            for k, d in enumerate(digest.tolist()):
                first = seen.get(d)
                if first is None:
                    seen[d] = (batch, int(row[k]), int(at[k]))
                    new.append(k)
                else:
                    if first:
                        again.append((d, first[0].column("doc_id")[first[1]].as_py(), first[2]))
                        seen[d] = ()
                    again.append((d, batch.column("doc_id")[int(row[k])].as_py(), int(at[k])))
            if len(seen) >= SEEN:
                seen.clear()
            kind = batch.schema.field("doc_id").type
            out = [(keys[band][new], digest[new], batch.column("doc_id").take(pa.array(row[new])), at[new], np.full(len(new), band, np.int8)) for band in range(BANDS if new else 0)]
            if again:
                d, ids, a = zip(*again, strict=True)
                d, a = np.array(d, np.uint64), np.array(a, np.int64)
                out.append((_mixed(d ^ _mixed(a.view(np.uint64))), d, pa.array(ids, kind), a, np.full(len(a), MEMBER, np.int8)))
            for key, dig, ids, place, band in out:
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(dig.view(np.int64)), ids, pa.array(place), pa.array(band)],
                                                 names=["key", "digest", "doc_id", "at", "band"])


def _met(batches):
    """Rows in order of key and digest to (key, digest, doc_id, at): with a null key, a
    paragraph that has a copy; else one of a class that meets another in a band."""
    carried = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if carried is None else [*carried, batch]).combine_chunks()
        key, digest, band = (t.column(c).to_numpy() for c in ("key", "digest", "band"))
        same_key = key[1:] == key[:-1]
        same = same_key & (digest[1:] == digest[:-1])
        copies = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        member = band == MEMBER
        first = np.concatenate(([True], ~same_key))
        run = np.cumsum(first) - 1
        several = np.bincount(run[1:][same_key & ~same & ~member[1:]], minlength=int(run[-1]) + 1) > 0
        meets = several[run] & ~np.concatenate(([False], same)) & ~member
        has_copy = member | (copies & (band == 0))
        out = []
        for chosen, null in ((has_copy, True), (meets, False)):
            rows = t.filter(pa.array(chosen))
            if rows.num_rows:
                keys = pa.nulls(rows.num_rows, pa.int64()) if null else rows.column("key")
                out.append(pa.table([keys, *[rows.column(c) for c in ("digest", "doc_id", "at")]], names=["key", "digest", "doc_id", "at"]))
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
        head = int(np.flatnonzero(first)[-1])
        carried = [*t.slice(head, 1).to_batches(), *(t.slice(t.num_rows - 1, 1).to_batches() if head < t.num_rows - 1 else [])]


def _sets(signer: MinMax):
    """(text as bytes, wanted) to (id, n, elements, sig) of the paragraphs that ``wanted`` names."""

    def make(batches):
        for batch in batches:
            wanted = batch.column("wanted")
            of, told = wanted.offsets.to_numpy(), wanted.flatten()
            number, digest = told.field("at").to_numpy() % _PLACE, told.field("digest")
            of = of - of[0]
            for rows, h, starts in _chunks(batch):
                first, x = cuts(h, starts), _shingles(h)
                ends = np.append(first[1:], len(h)) - WIDTH + 1
                count = of[rows + 1] - of[rows]
                at = np.repeat(of[rows] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                unit = np.repeat(np.searchsorted(first, starts), count) + number[at]
                # All their shingles end to end, sorted within each, each once.
                size = ends[unit] - first[unit]
                own = np.repeat(np.arange(len(unit)), size)
                value = x[np.repeat(first[unit] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
                order = np.lexsort((value, own))
                own, value = own[order], value[order]
                new = np.concatenate(([True], (own[1:] != own[:-1]) | (value[1:] != value[:-1])))
                own, value = own[new], value[new]
                begins = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                sig = (signer.signatures(value, begins) >> np.uint64(24)).astype(np.uint8)
                bounds = pa.array(np.append(begins, len(value)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    digest.take(pa.array(at)), pa.array(np.diff(np.append(begins, len(value)))), pa.ListArray.from_arrays(bounds, pa.array(value.view(np.int64))),
                    pa.array([s.tobytes() for s in sig], pa.binary())], names=["id", "n", "elements", "sig"])

    return make


def with_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (id, n, elements, sig) with keys: the rarest elements, of which two sets as near as asked share one."""
    each = sets.select("id", "n", F.explode("elements").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("times"))
    ranked = each.join(often.hint("merge"), "x").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "x"))).alias("_e"))
    least = F.ceil(F.col("n") * percent / 100)
    prefix = F.filter(F.slice("_e", 1, (F.col("n") - least + 1).cast("int")), lambda e: e["times"] > 1)
    keys = ranked.select("id", F.transform(prefix, lambda e: e["x"]).alias("keys"))
    return sets.select("id", "n", "sig").join(keys.hint("merge"), "id")


def spans(found: list[dict], at: list[int], least: int) -> list[tuple]:
    """(first word, word past the last, clusters, removed) of the stretches that some paragraphs of a
    text make; ``at`` are the first words of its paragraphs and its number of words."""
    rows: list[list] = []
    for f in sorted(found, key=lambda f: f["at"] % _PLACE):
        k = f["at"] % _PLACE
        if rows and rows[-1][1] == at[k] and rows[-1][3] == f["removed"]:
            rows[-1][1] = at[k + 1]
            rows[-1][2].append(f["component"])
        else:
            rows.append([at[k], at[k + 1], [f["component"]], f["removed"]])
    # What is repeated is measured with either verdict: a first place may stand inside it.
    out, n = [], 0
    while n < len(rows):
        m = n
        while m + 1 < len(rows) and rows[m + 1][0] == rows[m][1]:
            m += 1
        if rows[m][1] - rows[n][0] >= least:
            out += [tuple(r) for r in rows[n : m + 1]]
        n = m + 1
    return out


def _stretches(least: int):
    """(doc_id, th, text as bytes, found) to the stretches of a text."""
    names = ["doc_id", "th", "start", "end", "n_words", "clusters", "removed"]

    def join(batches):
        for batch in batches:
            found, texts = batch.column("found"), batch.column("text")
            for rows, h, starts in _chunks(batch):
                first = np.append(cuts(h, starts), len(h))
                base = np.append(np.searchsorted(first, starts), len(first) - 1)
                out = []
                for k, row in enumerate(rows.tolist()):
                    own = (first[base[k] : base[k + 1] + 1] - starts[k]).tolist()
                    if told := spans(found[row].as_py(), own, least):
                        begin, end = places(texts[row].as_py())
                        out += [(row, int(begin[a]), int(end[b - 1]), b - a, c, gone) for a, b, c, gone in told]
                if out:
                    row, *rest = zip(*out, strict=True)
                    take = pa.array(row)
                    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), *[pa.array(c, k) for c, k in zip(rest, kinds, strict=True)]], names=names)

    return join


def repeated_passages(docs: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th, start, end, n_words, clusters, removed: the stretches of ``docs``
    (doc_id, text) that are repeated; ``clusters`` are the components of their paragraphs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    place = F.expr(f"th - pmod(th, {_PLACE})").alias("_top")
    banded = rows.mapInArrow(_banded, f"key bigint, digest bigint, doc_id {kind}, at bigint, band tinyint")
    banded = banded.repartition("key").sortWithinPartitions("key", "digest")
    met = stored(banded.mapInArrow(_met, f"key bigint, digest bigint, doc_id {kind}, at bigint"), "met")

    # Classes that meet others, with their sets, and the links among them.
    one = met.where("key IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "at")).alias("p"))
    wanted = one.groupBy(F.col("p.doc_id").alias("doc_id"), F.expr(f"p.at - pmod(p.at, {_PLACE})").alias("_top")).agg(F.collect_list(F.struct(F.col("p.at").alias("at"), "digest")).alias("wanted"))
    texts = rows.select("doc_id", place, "text")
    some = texts.join(wanted.hint("merge"), ["doc_id", "_top"]).dropDuplicates(["doc_id", "_top"]).select("text", "wanted")
    sets = stored(some.mapInArrow(_sets(MinMax(32)), "id bigint, n bigint, elements array<bigint>, sig binary"), "sets")
    sketches = stored(with_prefixes(sets, percent), "sketches")
    found = stored(contracted(links(sketches, lambda ids: sets.join(ids.hint("merge"), "id", "left_semi").select("id", "elements"), percent, streamed=True)), "found")

    # Every place of a class that has copies or links.
    linked = met.join(found.select(F.col("id").alias("digest"), "component").hint("merge"), "digest", "left").where("key IS NULL OR component IS NOT NULL")
    every = linked.select("doc_id", "at", F.coalesce("component", "digest").alias("component")).distinct()
    every = stored(every, "every")
    heads = every.groupBy("component").agg(F.min(F.struct("doc_id", "at")).alias("head"), F.count(F.lit(1)).alias("times")).where("times > 1")
    marked = every.join(heads.hint("merge"), "component").select("doc_id", "at", "component", (F.struct("doc_id", "at") != F.col("head")).alias("removed"))
    per = marked.groupBy("doc_id", F.expr(f"at - pmod(at, {_PLACE})").alias("_top")).agg(F.collect_list(F.struct("at", "component", "removed")).alias("found"))
    again = rows.select("doc_id", "th", place, "text").join(per.hint("merge"), ["doc_id", "_top"]).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "text", "found")
    return again.mapInArrow(_stretches(least), f"doc_id {kind}, th bigint, start int, end int, n_words int, clusters array<bigint>, removed boolean")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))
