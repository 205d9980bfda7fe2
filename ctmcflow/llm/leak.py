"""Evaluation passages in training text, found with an FM-index per training shard.

Texts become words that no case, accent, punctuation, spacing, markup or escape can hide. A task
indexes its documents in shards of bounded size: words are numbered by the shard's own sorted
vocabulary, every document ends in a mark of its own, and the shard keeps its text, the
Burrows-Wheeler transform and the suffix positions sampled in text order. Since all marks differ, the
order of suffixes is that of rotations, and a step back from any row is exact, also over the end of a
document. The index knows nothing of the items: it is written once to the shared folder and searched
by all blocks of items, which are sent to the tasks one after another.

A search takes all short seeds of a block backwards through the wavelet ranks at once, locates them,
and turns them into diagonals (document, item, offset) that are compared word by word. A run of 20 words
with one in six wrong keeps four right words in a row somewhere, so seeds of four words miss nothing.
The corpus is never shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ctmcflow.session import Scratch

SEED = 4
EXACT = 12
FUZZY = 20
ERRORS = 6  # at most one word in so many
SHARD_WORDS = 400_000
LONG_CHARS = 400_000  # a longer text is read in pieces
BLOCK_WORDS = 1_000_000  # words of evaluation items sent to the tasks at a time
PAIRS = 1 << 20  # diagonals, and cells of their comparison, that a task holds at a time
SAMPLE = 8
_INDEX = "doc_id array<long>, hash array<long>, first array<int>, begin array<int>, vocabulary binary, text binary, bwt binary, marked binary, samples binary"
_FOUND = "doc_id long, hash long, eval_id long, first_word int, last_word int"

_INVISIBLE = "­​‌‍⁠﻿"
_ENTITY = r"&(?:amp;)*(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
_TOKEN = re.compile(rf"</?[A-Za-z!][^<>]*>|((?:[^\W_]|[̀-ͯ{_INVISIBLE}]|{_ENTITY})+)")
_PLAIN = re.compile(rf"((?:[^\W_]|[̀-ͯ{_INVISIBLE}])+)")
_PART = re.compile(r"[^\W_]+")


def _fold(raw: str) -> list[str]:
    """The plain words of a raw token: entities resolved, case, accents and invisible characters dropped."""
    while (once := html.unescape(raw)) != raw:
        raw = once
    x = "".join(c for c in raw if c not in _INVISIBLE)
    x = "".join(c for c in unicodedata.normalize("NFKD", x.casefold()) if not unicodedata.combining(c))
    return _PART.findall(x)


def _form(text: str) -> re.Pattern:
    return _TOKEN if "<" in text or "&" in text else _PLAIN


def words(text: str) -> Iterator[tuple[str, int, int]]:
    """(plain word, start, end) with places in the text as it is."""
    for m in _form(text).finditer(text):
        if m[1]:
            for w in _fold(m[1]):
                yield w, m.start(), m.end()


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length until every rank is its own."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype("int64")
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        step = np.r_[0, np.cumsum(s[1:] != s[:-1])]
        rank = np.empty(n, "int64")
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2
        if k >= n:
            return order


class FMIndex:
    """Backward search and location over a text of small non-negative integers whose last one stands nowhere else.

    Made from the transform, a flag for each row whose text position is a multiple of ``SAMPLE``, and those positions.
    """

    @staticmethod
    def transform(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sa = suffix_array(text)
        marked = sa % SAMPLE == 0
        return text[sa - 1], marked, sa[marked]

    @classmethod
    def of(cls, text: np.ndarray) -> FMIndex:
        return cls(*cls.transform(text))

    def __init__(self, bwt: np.ndarray, marked: np.ndarray, samples: np.ndarray):
        n = len(bwt)
        self.n, self.bits = n, max(1, int(bwt.max()).bit_length())
        self.first = np.r_[0, np.cumsum(np.bincount(bwt, minlength=1 << self.bits))]
        self.ones, self.zeros = [], []
        level = bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype("int32"))
            self.zeros.append(int(n - bit.sum()))
            level = np.r_[level[bit == 0], level[bit == 1]]
        self.bwt = bwt
        self.base = self._map(np.arange(1 << self.bits), np.zeros(1 << self.bits, "int64"))
        self.marked, self.samples = marked, samples
        self.mark_rank = np.r_[0, np.cumsum(marked)]

    def _map(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros):
            r = ones[i]
            i = np.where((c >> b) & 1, zeros + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol c stands before place i of the transform."""
        return self._map(c, i) - self.base[c]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern (one per row of the array)."""
        low, high = np.zeros(len(patterns), "int64"), np.full(len(patterns), self.n, "int64")
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, j]
            low[alive] = self.first[c] + self.rank(c, low[alive])
            high[alive] = self.first[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one is met, which takes less than ``SAMPLE`` steps."""
        at, steps = rows.copy(), np.zeros(len(rows), "int64")
        open_ = np.flatnonzero(~self.marked[at])
        for _ in range(SAMPLE):
            if not len(open_):
                break
            c = self.bwt[at[open_]]
            at[open_] = self.first[c] + self.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.marked[at[open_]]]
        if len(open_):
            raise ValueError("broken index: no sampled position within its distance")
        return self.samples[self.mark_rank[at]] + steps


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


class Shard:
    """Documents gathered for one index, and the row it becomes."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.seen = _Seen(self.ids)
        self.docs: list[int] = []
        self.hashes: list[int] = []
        self.first: list[int] = []
        self.begin: list[int] = []
        self.flat: list[int] = []

    def add(self, doc: int, key: int, first: int, numbers) -> None:
        self.docs.append(doc)
        self.hashes.append(key)
        self.first.append(first)
        self.begin.append(len(self.flat))
        self.flat.extend(numbers)
        self.flat.append(-1)

    def row(self) -> pa.RecordBatch:
        names = np.fromiter(map(word_hash, self.ids), "uint64", len(self.ids))
        vocabulary, place = np.unique(names, return_inverse=True)
        text = np.array(self.flat, "int64")
        end = text < 0
        text[~end] = place[text[~end]]
        text[end] = len(vocabulary) + np.arange(len(self.docs))
        bwt, marked, samples = FMIndex.transform(text)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((self.docs, pa.int64()), (self.hashes, pa.int64()), (self.first, pa.int32()), (self.begin, pa.int32()))]
        blobs = [vocabulary, text.astype("int32"), bwt.astype("int32"), np.packbits(marked), samples.astype("int32")]
        return pa.RecordBatch.from_arrays([*lists, *[pa.array([b.tobytes()], pa.binary()) for b in blobs]], names=[c.split()[0] for c in _INDEX.split(", ")])


class _Seen(dict):
    """Written token -> numbers of its plain words, filled as tokens come."""

    def __init__(self, ids: dict[str, int]):
        self.ids = ids

    def __missing__(self, raw: str) -> tuple[int, ...]:
        got = self[raw] = tuple(self.ids.setdefault(w, len(self.ids)) for w in _fold(raw)) if raw else ()
        return got


def index_batches(overlap: int):
    """Indexes documents (doc_id, hash, text) in shards of about ``SHARD_WORDS`` words.

    A text of over ``LONG_CHARS`` characters comes in pieces of so many words that overlap by ``overlap`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for b in batches:
            for doc, key, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                if len(text) <= LONG_CHARS:
                    shard.add(doc, key, 0, chain.from_iterable(map(shard.seen.__getitem__, _form(text).findall(text))))
                else:
                    at, piece = 0, []
                    for w, _, _ in words(text):
                        piece.append(w)
                        if len(piece) == SHARD_WORDS + overlap:
                            long = Shard()
                            long.add(doc, key, at, [long.ids.setdefault(x, len(long.ids)) for x in piece])
                            yield long.row()
                            at += SHARD_WORDS
                            del piece[:SHARD_WORDS]
                    shard.add(doc, key, at, [shard.ids.setdefault(x, len(shard.ids)) for x in piece])
                if len(shard.flat) >= SHARD_WORDS:
                    yield shard.row()
                    shard = Shard()
        if shard.docs:
            yield shard.row()

    return run


def build_index(docs: DataFrame, overlap: int) -> DataFrame:
    """One row per shard of the documents (doc_id, text): write it, and search it as often as needed.

    overlap: words of the longest item that will be searched for (only texts beyond ``LONG_CHARS`` need it).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").filter("doc_id IS NOT NULL AND text <> ''")
    return rows.mapInArrow(index_batches(overlap), _INDEX)


def item_words(evals: DataFrame) -> DataFrame:
    """eval_id, n, words: the hashes of an item's plain words, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.array([word_hash(w) for w, _, _ in words(t)], "uint64") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([x.tobytes() for x in got], pa.binary())], names=["eval_id", "n", "words"])

    rows = evals.select(F.col("eval_id").cast("long").alias("eval_id"), "text").filter("eval_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "eval_id long, n long, words binary")


class Items:
    """A block of evaluation items (hashes of words) with their distinct seeds."""

    def __init__(self, ids: list[int], texts: list[np.ndarray], seed: int = SEED):
        self.ids = np.array(ids, "int64")
        self.length = np.array([len(x) for x in texts], "int64")
        self.start = np.r_[0, np.cumsum(self.length)]
        self.vocabulary, inv = np.unique(np.concatenate([*texts, np.empty(0, "uint64")]), return_inverse=True)
        self.words = inv.reshape(-1).astype("int64")
        count = np.maximum(0, self.length - seed + 1)
        item = np.repeat(np.arange(len(ids)), count)
        place = np.arange(len(item)) - np.repeat(np.r_[0, np.cumsum(count)[:-1]], count) if len(ids) else np.empty(0, "int64")
        grams = self.words[(self.start[item] + place)[:, None] + np.arange(seed)] if len(item) else np.empty((0, seed), "int64")
        self.seeds, inv = np.unique(grams, axis=0, return_inverse=True) if len(item) else (grams, np.empty(0, "int64"))
        o = np.argsort(inv.reshape(-1), kind="stable")
        self.item, self.place = item[o], place[o]
        self.offset = np.r_[0, np.cumsum(np.bincount(inv.reshape(-1), minlength=len(self.seeds)))]


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i]+1, ... count[i] times, all in one array."""
    if not count.sum():
        return np.empty(0, "int64")
    base = np.repeat(start - np.r_[0, np.cumsum(count)[:-1]], count)
    return base + np.arange(count.sum())


def _chunks(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of consecutive entries whose sizes add up to about ``most`` at a time."""
    block = (np.cumsum(sizes) - sizes) // most
    cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(sizes) else np.zeros(1, int)
    for a, z in zip(cut[:-1], cut[1:]):
        yield slice(a, z)


def search_shard(items: Items, fm: FMIndex, vocabulary: np.ndarray, text: np.ndarray, doc_start: np.ndarray, exact: int = EXACT, fuzzy: int = FUZZY, errors: int = ERRORS):
    """(document, item, first word, last word) of every matching stretch; word places count from the document's start."""
    at = np.minimum(np.searchsorted(vocabulary, items.vocabulary), len(vocabulary) - 1)
    number = np.where(vocabulary[at] == items.vocabulary, at, -1)  # the items' words as the shard numbers them
    seeds = number[items.seeds]
    able = np.flatnonzero((seeds >= 0).all(1))
    low, high = fm.search(seeds[able])
    hit = high > low
    able, low, count = able[hit], low[hit], (high - low)[hit]
    where = fm.locate(_ranges(low, count))  # seeds have rows of their own: never more than the text has words
    off = np.r_[0, np.cumsum(count)]
    many = items.offset[able + 1] - items.offset[able]
    entry, of = _ranges(items.offset[able], many), np.repeat(np.arange(len(able)), many)
    doc_end = np.r_[doc_start[1:], len(text)] - 1  # the place of the document's end mark
    words_ = number[items.words]
    for part in _chunks(count[of], PAIRS):
        e, h = entry[part], of[part]
        pos = where[_ranges(off[h], count[h])]
        item, place = np.repeat(items.item[e], count[h]), np.repeat(items.place[e], count[h])
        key = np.unique(np.stack([item, pos - place, np.searchsorted(doc_start, pos, "right") - 1], 1), axis=0)
        key = key[np.argsort(items.length[key[:, 0]], kind="stable")]
        for rows in _chunks(items.length[key[:, 0]], PAIRS):
            yield from _compare(items, words_, text, doc_start, doc_end, key[rows], exact, fuzzy, errors)


def _compare(items, words_, text, doc_start, doc_end, k, exact, fuzzy, errors):
    n = items.length[k[:, 0]]
    m = int(n.max())
    i = np.arange(m)
    at = k[:, 1][:, None] + i
    inside = (i < n[:, None]) & (at >= doc_start[k[:, 2]][:, None]) & (at < doc_end[k[:, 2]][:, None])
    same = inside & (text[np.clip(at, 0, len(text) - 1)] == words_[np.clip(items.start[k[:, 0]][:, None] + i, 0, len(words_) - 1)])
    # exact: right words since the last wrong one
    e = i - np.maximum.accumulate(np.where(same, -1, i), 1) >= exact
    best = e.any(1)
    first = np.where(best, np.argmax(e, 1) - exact + 1, m)
    last = np.where(best, m - 1 - np.argmax(e[:, ::-1], 1), -1)
    # inexact: a right word counts 1, a wrong one 1 - errors; a stretch passes when its sum is not negative
    if m >= fuzzy:
        p = np.c_[np.zeros(len(k), "int64"), np.cumsum(np.where(same, 1, np.where(inside, 1 - errors, -(10**6))), 1)]
        least = np.minimum.accumulate(p, 1)
        ok = p[:, fuzzy:] >= least[:, : m + 1 - fuzzy]
        some = ok.any(1)
        end = m - np.argmax(ok[:, ::-1], 1) - 1  # last word of the last passing stretch
        most = np.maximum.accumulate(p[:, ::-1], 1)[:, ::-1]
        begin = np.argmax(most[:, fuzzy:] >= p[:, : m + 1 - fuzzy], 1)
        first = np.where(some, np.minimum(first, begin), first)
        last = np.where(some, np.maximum(last, end), last)
        best = best | some
    for r in np.flatnonzero(best):
        base = int(k[r, 1] - doc_start[k[r, 2]])
        yield int(k[r, 2]), int(k[r, 0]), base + int(first[r]), base + int(last[r])


def _search(block, params: dict):
    """Searches index rows for the items of a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = block.value
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                read = lambda c, t: np.frombuffer(r[c].as_py(), t)  # noqa: E731, B023
                text, bwt = read("text", "int32").astype("int64"), read("bwt", "int32").astype("int64")
                docs, keys, first, begin = (r[c].values.to_numpy(zero_copy_only=False) for c in ("doc_id", "hash", "first", "begin"))
                vocabulary = read("vocabulary", "uint64")
                rows = []
                if len(vocabulary) and len(items.seeds):
                    fm = FMIndex(bwt, np.unpackbits(read("marked", "uint8"), count=len(bwt)).astype(bool), read("samples", "int32").astype("int64"))
                    for d, item, a, z in search_shard(items, fm, vocabulary, text, begin.astype("int64"), **params):
                        rows.append((int(docs[d]), int(keys[d]), int(items.ids[item]), int(first[d]) + a, int(first[d]) + z))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                c = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return run


def search_index(scratch: Scratch, index: DataFrame, items: DataFrame, exact: int = EXACT, fuzzy: int = FUZZY, errors: int = ERRORS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, hash, eval_id, first_word, last_word of every stretch: a written index against written items (``item_words``).

    Items go out in blocks of about ``block_words`` words; a block's matches are written before the next block is read.
    """
    spark = index.sparkSession
    blocks = max(1, -(-int(items.agg(F.sum("n")).first()[0] or 0) // block_words))
    out = spark.createDataFrame([], _FOUND)
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("eval_id"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        if part:
            part.sort(key=lambda r: r["eval_id"])
            block = spark.sparkContext.broadcast(Items([r["eval_id"] for r in part], [np.frombuffer(r["words"], "uint64") for r in part]))
            found = scratch.put(index.mapInArrow(_search(block, {"exact": exact, "fuzzy": fuzzy, "errors": errors}), _FOUND), "found")
            block.unpersist()
            out = found if b == 0 else out.unionByName(found)
    return out


def stretches(docs: DataFrame, evals: DataFrame, index: DataFrame | None = None, **params) -> DataFrame:
    """Every matching stretch: doc_id, hash (of the text), eval_id, first_word, last_word (of the document, from 0).

    A stretch matches when it holds ``exact`` unbroken words of the item, or ``fuzzy`` or more words of which at most
    one in ``errors`` differs. Null and empty texts match nothing; repeated documents and items each count.
    A null eval_id or doc_id is kept out. Other columns are not read. Without a written index one is made of ``docs``.
    """
    scratch = Scratch(docs.sparkSession, "leak")
    items = scratch.put(item_words(evals), "items")
    if index is None:
        index = scratch.put(build_index(docs, int(items.agg(F.max("n")).first()[0] or 0)), "index")
    return search_index(scratch, index, items, **params)


def leaks(docs: DataFrame, evals: DataFrame, **params) -> DataFrame:
    """doc_id, eval_id: each document and the items that leaked into it, once."""
    return stretches(docs, evals, **params).select("doc_id", "eval_id").distinct()


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, hash, text, places) -> doc_id, hash, word, start_char, end_char of the words asked for."""
    for b in batches:
        rows = []
        for doc, key, text, places in zip(*(b.column(i).to_pylist() for i in range(4))):
            want = set(places)
            rows += [(doc, key, i, s, e) for i, (_, s, e) in enumerate(words(text)) if i in want]
        c = list(zip(*rows)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["doc_id", "hash", "word", "start_char", "end_char"])


def removal_spans(docs: DataFrame, evals: DataFrame, **params) -> DataFrame:
    """doc_id, start_char, end_char, items: overlapping or touching stretches of a document merged, with the number of items.

    Only texts with a match are read again for the places of their words; the places asked of a text are at most its words.
    """
    s = stretches(docs, evals, **params).distinct()
    ends = s.select("doc_id", "hash", F.explode(F.array("first_word", "last_word")).alias("word")).groupBy("doc_id", "hash").agg(F.collect_set("word").alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").filter("doc_id IS NOT NULL AND text <> ''")
    at = texts.join(ends, ["doc_id", "hash"]).select("doc_id", "hash", "text", "places").mapInArrow(_places, "doc_id long, hash long, word int, start_char int, end_char int").distinct()
    s = s.join(at.select("doc_id", "hash", F.col("word").alias("first_word"), "start_char"), ["doc_id", "hash", "first_word"])
    s = s.join(at.select("doc_id", "hash", F.col("word").alias("last_word"), "end_char"), ["doc_id", "hash", "last_word"])
    # spans come from one row per start, at most the words of a text; all stretches are then counted within them
    w = Window.partitionBy("doc_id").orderBy("start_char")
    far = F.max("end_char").over(w.rowsBetween(Window.unboundedPreceding, -1))
    one = s.groupBy("doc_id", "start_char").agg(F.max("end_char").alias("end_char")).withColumn("new", (F.col("start_char") > F.coalesce(far, F.lit(-1))).cast("int"))
    spans = one.withColumn("grp", F.sum("new").over(w)).groupBy("doc_id", "grp").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"))
    inside = s.select("doc_id", F.col("start_char").alias("at"), "eval_id").join(spans, "doc_id").filter("at BETWEEN start_char AND end_char")
    return inside.groupBy("doc_id", "start_char", "end_char").agg(F.count_distinct("eval_id").alias("items"))
