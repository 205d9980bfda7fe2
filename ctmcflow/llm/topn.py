"""Top N items of every group: sorted runs, truncated early, then merged with a loser tree.

1. Every input partition is cut into bounded runs. A run is sorted by (group, score desc,
   item), a repeated (group, item) keeps its best score and only the first N items of each
   group stay. An item of the global top N is in the top N of the run that holds its best
   score, so nothing is lost, and a group with a third of all rows leaves each run with at
   most N rows before anything is shuffled.
2. One shuffle by group. Spark's external sort lays the runs of a group side by side; a
   loser tree merges them, stops after N outputs and seeks to the next group. A group is
   streamed, never held: the merge keeps the first N rows of each run of the current group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RUN_ROWS = 200_000


class LoserTree:
    """Tournament over k sorted sequences; ``pop`` gives the least head in log2(k) comparisons."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, 1 << (len(runs) - 1).bit_length())
        self.loser = [-1] * self.k
        self.winner = self._build(1)

    def _key(self, r: int):
        if r < 0 or r >= len(self.runs) or self.at[r] >= len(self.runs[r]):
            return None
        return self.runs[r][self.at[r]]

    def _less(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return x is not None and (y is None or x < y)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (b, a) if self._less(b, a) else (a, b)
        self.loser[node] = lose
        return win

    def pop(self):
        top = self._key(self.winner)
        if top is None:
            return None
        self.at[self.winner] += 1
        now, node = self.winner, (self.winner + self.k) // 2
        while node >= 1:
            if self._less(self.loser[node], now):
                self.loser[node], now = now, self.loser[node]
            node //= 2
        self.winner = now
        return top


def merge_runs(runs: list[list[tuple]], n: int) -> list[tuple]:
    """First n (score desc, item asc) of sorted runs of (-score, item); a repeated item counts once, at its best."""
    tree, out, seen = LoserTree(runs), [], set()
    while len(out) < n and (top := tree.pop()) is not None:
        if top[1] not in seen:
            seen.add(top[1])
            out.append(top)
    return out


def _cut_run(t: pa.Table, n: int, run: int) -> pa.RecordBatch:
    """One sorted run: best score per (group, item), first n items per group."""
    d = t["g1"].combine_chunks().dictionary_encode()
    g1 = d.indices.to_numpy(zero_copy_only=False)
    g2, item, score = (t[c].to_numpy() for c in ("g2", "item", "score"))
    o = np.lexsort((-score, item, g2, g1))
    a, b, i = g1[o], g2[o], item[o]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (i[1:] != i[:-1])][: len(o)]
    o = o[first]
    o = o[np.lexsort((item[o], -score[o], g2[o], g1[o]))]
    a, b = g1[o], g2[o]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(o)])
    rank = np.arange(len(o)) - np.repeat(start, np.diff(np.r_[start, len(o)]))
    o = o[rank < n]
    return pa.RecordBatch.from_arrays(
        [d.dictionary.take(pa.array(g1[o])), pa.array(g2[o]), pa.array(np.full(len(o), run, "int64")), pa.array(item[o]), pa.array(score[o])],
        names=["g1", "g2", "run", "item", "score"],
    )


def _make_runs(n: int, run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= run_rows:
                yield _cut_run(pa.Table.from_batches(held), n, part * 1_000_000 + k)
                held, rows, k = [], 0, k + 1
        if rows:
            yield _cut_run(pa.Table.from_batches(held), n, part * 1_000_000 + k)

    return run


def _merge(n: int):
    """Rows come sorted by (group, run, score desc, item). Groups that fill from one run pass in bulk."""

    def flush(key, runs, out):
        best = merge_runs(runs, n)
        for r, (neg, item) in enumerate(best, 1):
            out.append((*key, item, -neg, r))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, runs, last = None, [], None
        names = ["g1", "g2", "item", "score", "rank"]
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            d = b.column(0).dictionary_encode()
            words = d.dictionary.to_pylist()
            g1 = d.indices.to_numpy(zero_copy_only=False)
            g2, rn, item, score = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            new = np.r_[True, (g1[1:] != g1[:-1]) | (g2[1:] != g2[:-1])]
            start = np.flatnonzero(new)
            end = np.r_[start[1:], m]
            newrun = np.r_[True, rn[1:] != rn[:-1]] | new
            several = np.add.reduceat(newrun.astype("int64"), start) > 1
            whole = ~several
            whole[-1] = False  # the last group may go on in the next batch
            out: list[tuple] = []
            head = (words[g1[0]], int(g2[0]))
            if key == head:
                whole[0] = False
            elif key is not None:
                flush(key, runs, out)
                key, runs, last = None, [], None
            for s, e in zip(start[~whole], end[~whole]):
                k = (words[g1[s]], int(g2[s]))
                if k != key:
                    if key is not None:
                        flush(key, runs, out)
                    key, runs, last = k, [], None
                cuts = np.r_[s, s + 1 + np.flatnonzero(rn[s + 1 : e] != rn[s : e - 1]), e]
                for x, y in zip(cuts[:-1], cuts[1:]):
                    piece = list(zip((-score[x : min(y, x + n)]).tolist(), item[x : min(y, x + n)].tolist()))
                    if last == rn[x]:
                        runs[-1] = (runs[-1] + piece)[:n]
                    else:
                        runs.append(piece)
                        last = rn[x]
                if len(runs) > 4096:  # merge what is there; the outcome is again one sorted run
                    runs = [merge_runs(runs, n), []]
            # groups of one run are already in order and cut to n
            rows = np.flatnonzero(np.repeat(whole, end - start))
            rank = np.arange(m) - np.repeat(start, end - start) + 1
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [d.dictionary.take(pa.array(g1[rows])), pa.array(g2[rows]), pa.array(item[rows]), pa.array(score[rows]), pa.array(rank[rows].astype("int32"))], names=names
                )
            if out:
                yield _rows(out, names)
        if key is not None:
            out = []
            flush(key, runs, out)
            if out:
                yield _rows(out, names)

    return run


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    c = list(zip(*out))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=names)


def top_n(df: DataFrame, g1: str, g2: str, item: str, score: str, n: int = 3, run_rows: int = RUN_ROWS) -> DataFrame:
    """The n items with the highest score of every group (g1 string, g2 bigint).

    Result: g1, g2, item, score, rank under the given names plus ``rank`` from 1.
    Ties: equal scores rank the smaller item first. A repeated (group, item) counts once, with
    its highest finite score. Rows with a null group or item, or a null or non-finite score, do not
    rank. Groups with fewer than n items give what they have; an empty input gives no rows. Other
    columns of the input, whatever their names, are not read.
    """
    s = F.col(f"`{score}`").cast("double")
    rows = df.select(
        F.col(f"`{g1}`").cast("string").alias("g1"), F.col(f"`{g2}`").cast("long").alias("g2"), F.col(f"`{item}`").cast("long").alias("item"), s.alias("score")
    ).filter("g1 IS NOT NULL AND g2 IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('Infinity')")
    # -0.0 and 0.0 tie
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))
    runs = rows.mapInArrow(_make_runs(n, run_rows), "g1 string, g2 long, run long, item long, score double")
    merged = (
        runs.repartition("g1", "g2")
        .sortWithinPartitions("g1", "g2", "run", F.col("score").desc(), "item")
        .mapInArrow(_merge(n), "g1 string, g2 long, item long, score double, rank int")
    )
    return merged.toDF(g1, g2, item, score, "rank")
