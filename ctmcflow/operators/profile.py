"""Column profile of a table by load, exact: null rates, distinct counts, ranges, quantiles,
pattern violations and Kolmogorov-Smirnov distances between loads.

All columns are unpivoted to (column, value, load, count) with repeats summed inside each chunk,
then range-partitioned and sorted by (column, value) in one shuffle. Equal values never straddle
partitions, so one walk over a sorted partition gives distinct counts, ranges and, per load, the
largest and least gap between the load's cumulative curve and that of all other loads. What lies
before the partition only shifts that gap by a constant, so prefix counts of the partitions turn
the local extremes into the exact distance. Exact quantiles take a second walk that knows the
prefix counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK_ROWS = 100_000
CELLS = 2_000_000  # loads x columns walked at once; more columns are done in further blocks
VALUES = "col short, lng long, num double, txt string, load int, cnt long"
QUANTILES = (0.25, 0.5, 0.75)
COMMON = 0.02  # share of all rows from which a value counts as common to the loads


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "num"
    if isinstance(t, (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "lng"
    return "txt"


def _flat(df: DataFrame, columns: list[str], load: str) -> DataFrame:
    """Columns c0.. as bigint, double or string; NaN is missing, -0.0 is 0.0."""
    out = []
    for i, c in enumerate(columns):
        t, x = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(t, T.TimestampNTZType):
            x = F.unix_micros(F.to_timestamp(x))
        elif isinstance(t, T.TimestampType):
            x = F.unix_micros(x)
        elif isinstance(t, T.DateType):
            x = F.unix_date(x)
        if _kind(t) == "num":
            x = x.cast("double")
            x = F.when(~F.isnan(x), x + F.lit(0.0))
        elif _kind(t) == "lng":
            x = x.cast("long")
        elif not isinstance(t, T.StringType):
            x = F.to_json(x) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else x.cast("string")
        out.append(x.alias(f"c{i}"))
    return df.select(F.col(f"`{load}`").cast("long").alias("load"), *out)


def _unpivot(kinds: list[str], loads: np.ndarray, first: int):
    """One row per (column, value, load) of a chunk, with its count."""
    types = {"lng": pa.int64(), "num": pa.float64(), "txt": pa.string()}
    names = ["col", "lng", "num", "txt", "load", "cnt"]

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        load = pa.array(np.searchsorted(loads, t["load"].to_numpy()).astype("int32"))
        for i, kind in enumerate(kinds):
            g = pa.table({"v": t[f"c{i}"], "load": load}).filter(pc.is_valid(t[f"c{i}"]))
            g = g.group_by(["v", "load"]).aggregate([([], "count_all")])
            if g.num_rows:
                n = g.num_rows
                cols = [pa.array(np.full(n, first + i, "int16"))]
                cols += [g["v"].combine_chunks().cast(types[k]) if k == kind else pa.nulls(n, types[k]) for k in ("lng", "num", "txt")]
                cols += [g["load"].combine_chunks(), g["count_all"].combine_chunks().cast(pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= CHUNK_ROWS:
                yield from cut(held)
                held, rows = [], 0
        if rows:
            yield from cut(held)

    return run


def _segments(batches: Iterator[pa.RecordBatch], kinds: list[str], first: int):
    """(column, values as an array, entry's value number, load, count) of whole values, in order."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        yield from _cut(t, kinds, first, last=False)
        rest = _tail(t, kinds, first)
    if rest is not None:
        yield from _cut(rest, kinds, first, last=True)


def _value(t: pa.Table, kind: str):
    v = t[kind].combine_chunks()
    if kind == "txt":
        d = v.dictionary_encode()
        return d.indices.to_numpy(zero_copy_only=False), d.dictionary
    return v.to_numpy(zero_copy_only=False), None


def _tail_start(t: pa.Table, kinds: list[str], first: int) -> int:
    """Row where the last (column, value) of the table starts."""
    col = t["col"].to_numpy()
    s = int(np.searchsorted(col, col[-1], "left"))
    v = _value(t.slice(s), kinds[col[-1] - first])[0]
    other = np.flatnonzero(v != v[-1])
    return s + (int(other[-1]) + 1 if len(other) else 0)


def _tail(t: pa.Table, kinds: list[str], first: int) -> pa.Table:
    """The last value's rows, summed by load, so that a value of any size stays small."""
    x = t.slice(_tail_start(t, kinds, first))
    g = x.group_by(["col", "lng", "num", "txt", "load"], use_threads=False).aggregate([("cnt", "sum")]).rename_columns(["col", "lng", "num", "txt", "load", "cnt"])
    return g.select(t.column_names)


def _cut(t: pa.Table, kinds: list[str], first: int, last: bool):
    t = t if last else t.slice(0, _tail_start(t, kinds, first))
    if not t.num_rows:
        return
    col = t["col"].to_numpy()
    at = np.flatnonzero(np.r_[True, col[1:] != col[:-1]])
    for s, e in zip(at, np.r_[at[1:], len(col)]):
        c = int(col[s])
        part = t.slice(s, e - s)
        v, words = _value(part, kinds[c - first])
        num = np.cumsum(np.r_[False, v[1:] != v[:-1]])
        load, cnt = part["load"].to_numpy(), part["cnt"].to_numpy()
        o = np.lexsort((load, num))
        num, load, cnt, v = num[o], load[o], cnt[o], v[o]
        k = np.flatnonzero(np.r_[True, (num[1:] != num[:-1]) | (load[1:] != load[:-1])])
        yield c, (v[k], words), num[k], load[k], np.add.reduceat(cnt, k)


def _text(v, words) -> str:
    return words[int(v)].as_py() if words is not None else repr(v.item())


SUMMARY = "part int, col int, load int, n long, values long, low string, high string, dmax double, dmin double, tv double, news double, gain double, loss double"


def _walk(kinds: list[str], first: int, sizes: np.ndarray):
    """Per partition, column and load: count, distinct values, range, and extremes of the local gap.

    sizes[column, load] holds the counts of values. Load -1 stands for all loads together.
    """
    n_loads = sizes.shape[1]
    total = sizes.sum(1)
    names = ["part", "col", "load", "n", "values", "low", "high", "dmax", "dmin", "tv", "news", "gain", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, st = TaskContext.get().partitionId(), None, None

        def close():
            use = np.flatnonzero((st["n"] > 0) | (st["loss"] > 0))  # a common value may be missing in a load
            rows = [(part, now, int(l), int(st["n"][l]), int(st["values"][l]), st["low"][l], st["high"][l], float(st["dmax"][l]), float(st["dmin"][l]), float(st["tv"][l]), float(st["news"][l]), float(st["gain"][l]), float(st["loss"][l])) for l in use]
            rows.append((part, now, -1, int(st["n"].sum()), st["all"], st["first"], st["last"], 0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
            kinds_ = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds_)], names=names)

        for c, (v, words), num, load, cnt in _segments(batches, kinds, first):
            if c != now:
                if now is not None:
                    yield close()
                now = c
                st = {"n": np.zeros(n_loads, "int64"), "values": np.zeros(n_loads, "int64"), "low": np.full(n_loads, None, object), "high": np.full(n_loads, None, object), "dmax": np.zeros(n_loads), "dmin": np.zeros(n_loads), "tv": np.zeros(n_loads), "news": np.zeros(n_loads), "gain": np.zeros(n_loads), "loss": np.zeros(n_loads), "all": 0, "first": _text(v[0], words), "last": None, "seen": 0}
            own_n = np.maximum(sizes[c - first], 1)
            rest_n = np.maximum(total[c - first] - sizes[c - first], 1)
            tot = np.zeros(num[-1] + 1, "int64")
            np.add.at(tot, num, cnt)
            after_all = st["seen"] + np.cumsum(tot)
            t1 = after_all[num]
            t0 = t1 - tot[num]
            o = np.argsort(load, kind="stable")
            l, k = load[o], cnt[o]
            starts = np.flatnonzero(np.r_[True, l[1:] != l[:-1]])
            ls = l[starts]
            cum = np.cumsum(k)
            base = np.r_[0, cum[starts[1:] - 1]]
            length = np.diff(np.r_[starts, len(l)])
            own1 = cum - np.repeat(base, length) + st["n"][l]
            own0 = own1 - k
            hi = own1 / own_n[l] - (t1[o] - own1) / rest_n[l]
            lo = own0 / own_n[l] - (t0[o] - own0) / rest_n[l]
            st["dmax"][ls] = np.maximum(st["dmax"][ls], np.maximum.reduceat(hi, starts))
            st["dmin"][ls] = np.minimum(st["dmin"][ls], np.minimum.reduceat(lo, starts))
            share, others = k / own_n[l], (tot[num][o] - k) / rest_n[l]
            st["tv"][ls] += np.add.reduceat(np.maximum(0, share - others), starts)
            st["news"][ls] += np.add.reduceat(np.where(others == 0, share, 0), starts)
            for x in np.flatnonzero(tot >= COMMON * total[c - first]):  # 1 / COMMON values at most
                held = num == x
                part_of = np.zeros(n_loads)
                part_of[load[held]] = cnt[held] / own_n[load[held]]
                off = np.where(sizes[c - first] > 0, part_of - np.median(part_of[sizes[c - first] > 0]), 0)
                st["gain"] += np.maximum(0, off)
                st["loss"] += np.maximum(0, -off)
            st["n"][ls] += np.add.reduceat(k, starts)
            st["values"][ls] += length
            ends = starts + length - 1
            for x, a, z in zip(ls, starts, ends):
                if st["low"][x] is None:
                    st["low"][x] = _text(v[o[a]], words)
                st["high"][x] = _text(v[o[z]], words)
            st["all"] += int(num[-1]) + 1
            st["seen"] = int(after_all[-1])
            st["last"] = _text(v[-1], words)
        if now is not None:
            yield close()

    return run


def _picks(kinds: list[str], first: int, before: dict, sizes: np.ndarray, quantiles):
    """Values at the wanted ranks: (col, load, q, upper, value). before[(part, col)] has the loads' prefix counts.

    The two neighbours of an interpolated rank come out as rows upper=0 and upper=1.
    """
    names = ["col", "load", "q", "upper", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, seen = TaskContext.get().partitionId(), None, None
        for c, (v, words), num, load, cnt in _segments(batches, kinds, first):
            if c != now:
                now, seen = c, np.array(before.get((part, c), np.zeros(sizes.shape[1], "int64")))
            o = np.argsort(load, kind="stable")
            l, k = load[o], cnt[o]
            starts = np.flatnonzero(np.r_[True, l[1:] != l[:-1]])
            rows = []
            for s, e in zip(starts, np.r_[starts[1:], len(l)]):
                x = l[s]
                ends = seen[x] + np.cumsum(k[s:e])
                n = sizes[c - first][x]
                for q in quantiles:
                    pos = q * (n - 1)
                    for upper, r in ((0, int(np.floor(pos))), (1, int(np.ceil(pos)))):
                        if seen[x] <= r < ends[-1]:
                            rows.append((c, int(x), q, upper, float(v[o[s + int(np.searchsorted(ends, r, "right"))]])))
                seen[x] = ends[-1]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.float64()])], names=names)

    return run


def profile(df: DataFrame, columns: list[str], load: str = "load_id", patterns: dict[str, str] | None = None, quantiles: bool = True) -> DataFrame:
    """One row per load and column, and per column over all loads (load null).

    Columns: load, column_name, n_rows, n_null, null_rate (null or NaN), n_values, n_distinct,
    min_value, max_value (as text), violations (values for which the column's SQL condition in
    ``patterns`` is not true), violation_rate, q25, q50, q75 (numeric columns, linear
    interpolation), ks (distance to all other loads; 0 for a load without values), tv (half the
    sum of absolute differences of value shares) new_share (share of values no other load has) and common_shift (share
    gained or lost against the median of the loads, whichever is larger, by the values that hold at least COMMON of all rows).

    Rows whose load is null are profiled under load -1. An empty table gives no rows. A column of
    nulls has null rates of 1 and null ranges. Arrays and structs are profiled as their JSON text.
    """
    patterns = patterns or {}
    spark = df.sparkSession
    key = "_load"
    while key in df.columns:
        key += "_"
    df = df.withColumn(key, F.coalesce(F.col(f"`{load}`").cast("long"), F.lit(-1)))
    aggs = [F.count("*").alias("_rows")]
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`")
        ok = x.isNotNull() & ~F.isnan(x) if _kind(df.schema[c].dataType) == "num" else x.isNotNull()
        aggs.append(F.count_if(ok).alias(f"v{i}"))
        if c in patterns:
            aggs.append(F.count_if(ok & ~F.coalesce(F.expr(patterns[c]), F.lit(False))).alias(f"b{i}"))
    counts = sorted(df.groupBy(F.col(key).alias("_load")).agg(*aggs).collect(), key=lambda r: r["_load"])
    loads = np.array([r["_load"] for r in counts], "int64")
    rows = []
    per = max(1, CELLS // max(1, len(loads)))
    for first in range(0, len(columns) if counts else 0, per):
        block = columns[first : first + per]
        kinds = [_kind(df.schema[c].dataType) for c in block]
        sizes = np.array([[r[f"v{first + i}"] for r in counts] for i in range(len(block))], "int64")
        flat = _flat(df, block, key)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        runs = flat.mapInArrow(_unpivot(kinds, loads, first), VALUES)
        runs = runs.repartitionByRange(parts, "col", "lng", "num", "txt").sortWithinPartitions("col", "lng", "num", "txt")
        if quantiles:
            runs = runs.persist(StorageLevel.DISK_ONLY)
        summary = runs.mapInArrow(_walk(kinds, first, sizes), SUMMARY).collect()
        picks = {}
        if quantiles:
            before, seen = {}, {}
            for r in sorted(summary, key=lambda r: (r["col"], r["part"])):
                if r["load"] >= 0:
                    acc = seen.setdefault(r["col"], np.zeros(len(loads), "int64"))
                    if (r["part"], r["col"]) not in before:
                        before[r["part"], r["col"]] = acc.copy()
                    acc[r["load"]] += r["n"]
            numeric = [first + i for i, k in enumerate(kinds) if k != "txt"]
            got = runs.filter(F.col("col").isin(numeric)).mapInArrow(_picks(kinds, first, before, sizes, QUANTILES), "col int, load int, q double, upper int, value double").collect()
            for r in got:
                picks[r["col"], r["load"], r["q"], r["upper"]] = r["value"]
            runs.unpersist()
        rows += _assemble(columns, counts, loads, sizes, first, summary, picks, patterns)
    schema = "load long, column_name string, n_rows long, n_null long, null_rate double, n_values long, n_distinct long, min_value string, max_value string, violations long, violation_rate double, q25 double, q50 double, q75 double, ks double, tv double, new_share double, common_shift double"
    return spark.createDataFrame(rows, schema)


def _assemble(columns, counts, loads, sizes, first, summary, picks, patterns) -> list[tuple]:
    """Prefix counts over partitions turn local gaps into exact distances."""
    state: dict = {}
    by = {}
    for r in summary:
        by.setdefault(r["col"], []).append(r)
    out = []
    for i in range(sizes.shape[0]):
        c = first + i
        n = sizes[i]
        rest = n.sum() - n
        own = np.zeros(len(loads), "int64")
        seen = 0
        ks, tv, news, gain, loss = (np.zeros(len(loads)) for _ in range(5))
        distinct = np.zeros(len(loads), "int64")
        low, high = [None] * len(loads), [None] * len(loads)
        all_distinct, all_low, all_high = 0, None, None
        parts: dict = {}
        for r in by.get(c, []):
            parts.setdefault(r["part"], []).append(r)
        for p in sorted(parts):
            whole = next(r for r in parts[p] if r["load"] < 0)
            for r in parts[p]:
                l = r["load"]
                if l < 0:
                    continue
                shift = own[l] / max(1, n[l]) - (seen - own[l]) / max(1, rest[l])
                ks[l] = max(ks[l], abs(shift), abs(r["dmax"] + shift), abs(r["dmin"] + shift))
                tv[l] += r["tv"]
                news[l] += r["news"]
                gain[l] += r["gain"]
                loss[l] += r["loss"]
                distinct[l] += r["values"]
                low[l] = r["low"] if low[l] is None else low[l]
                high[l] = r["high"] if r["n"] else high[l]
            for r in parts[p]:
                if r["load"] >= 0:
                    own[r["load"]] += r["n"]
            seen += whole["n"]
            all_distinct += whole["values"]
            all_low = whole["low"] if all_low is None else all_low
            all_high = whole["high"]
        shares = np.maximum(gain, loss)
        name = columns[c]
        bad = [r[f"b{c}"] if name in patterns else 0 for r in counts]

        def q(l, level):
            a, b = picks.get((c, l, level, 0)), picks.get((c, l, level, 1))
            if a is None or b is None:
                return None
            pos = level * (n[l] - 1)
            return a + (b - a) * (pos - np.floor(pos)) if b != a else a

        for l, r in enumerate(counts):
            nulls = int(r["_rows"] - n[l])
            out.append((int(loads[l]), name, int(r["_rows"]), nulls, nulls / r["_rows"], int(n[l]), int(distinct[l]), low[l], high[l], int(bad[l]), bad[l] / max(1, int(n[l])), *(None if (x := q(l, k)) is None else float(x) for k in QUANTILES), float(ks[l]) if rest[l] and n[l] else 0.0, float(tv[l]) if rest[l] else 0.0, float(news[l]) if rest[l] else 0.0, float(shares[l]) if rest[l] and n[l] else 0.0))
        rows = sum(r["_rows"] for r in counts)
        out.append((None, name, rows, int(rows - n.sum()), float((rows - n.sum()) / rows), int(n.sum()), all_distinct, all_low, all_high, int(sum(bad)), sum(bad) / max(1, int(n.sum())), None, None, None, None, None, None, None))
    return out


# Conditions that the usual form of a value of the micro report meets.
REPORT_PATTERNS = {
    "status": "status RLIKE '^(OK|CHECK|MISSING_[A-Z_]+|PARTIAL.*|EMPTY_[A-Z_]+|LOAD_ERROR.*)$'",
    "sequence": "sequence RLIKE '^[acdefghiklmnpqrstvwy]+$'",
    "system": "system RLIKE '^[a-z]+_nocap$'",
    "dps_dir": "dps_dir RLIKE '^(/[^/ ]+)+$'",
    "tag": "tag RLIKE '^T[0-9]+K$'",
    "qpi_rel": "qpi_rel >= 0 AND qpi_rel < 1e-6",
    "na": "na >= 1",
    "nb": "nb >= 1",
    "mfpt_ab": "mfpt_ab > 0 AND mfpt_ab < 1",
    "mfpt_ba": "mfpt_ba > 0 AND mfpt_ba < 1",
    "pi_sum": "abs(pi_sum - 1) < 1e-6",
}
WATCHED = ["qpi_rel", "na", "mfpt_ab", "status"]


def changed_loads(prof: DataFrame, least: float = 0.1, sigmas: float = 5.0) -> DataFrame:
    """Loads whose column differs as a whole from the bulk of the others: (load_id, column_name, reason).

    Null and violation rates are held against the median over the loads, the curve (ks) against all
    other rows, the shares of common values (common_shift) against the median load, both less their median. A difference counts from
    ``least`` on and beyond what a load of that size shows by chance; isolated values stay below both. The ratio of
    distinct values counts from 0.25 on where the load's size cannot be the reason: ratios only fall and
    distinct values only rise with size.
    """
    rows = prof.filter("load IS NOT NULL")
    rows = rows.withColumn("ratio", F.col("n_distinct") / F.col("n_values"))  # null for a load without values
    mid = rows.groupBy("column_name").agg(*[F.percentile(c, 0.5).alias(f"m_{c}") for c in ("null_rate", "violation_rate", "ks", "common_shift", "ratio", "n_values", "n_distinct")])
    j = rows.join(F.broadcast(mid), "column_name")
    n = F.greatest(F.col("n_rows"), F.lit(1))

    def rate(c: str):
        m = F.col(f"m_{c}")
        p = F.greatest(m, 1.0 / n)
        return F.abs(F.col(c) - m) > F.greatest(F.lit(least), sigmas * F.sqrt(p * (1 - F.least(p, F.lit(0.99))) / n))

    values = F.greatest(F.col("n_values"), F.lit(1))
    # the other loads hold the changed ones too, which lifts every load's distance alike: the median takes that off
    chance = F.greatest(F.lit(least), 1.3 / F.sqrt(values))
    curve = F.col("ks") - F.col("m_ks") > chance
    shares = F.col("common_shift") - F.col("m_common_shift") > chance
    size, distinct = F.col("n_values") / F.col("m_n_values"), F.col("n_distinct") / F.col("m_n_distinct")
    fewer = (F.col("ratio") < F.col("m_ratio") - 0.25) & ((size <= 1.5) | (distinct < 0.75))
    more = (F.col("ratio") > F.col("m_ratio") + 0.25) & ((size >= 1 / 1.5) | (distinct > 1 / 0.75))
    repeats = (values >= 30) & (fewer | more)
    why = F.filter(F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(w)) for x, w in ((rate("null_rate"), "null rate"), (rate("violation_rate"), "unusual form"), (curve, "distribution"), (shares, "values"), (repeats, "distinct values"))]), lambda x: x.isNotNull())
    return j.select(F.col("load").alias("load_id"), "column_name", F.concat_ws(", ", why).alias("reason")).filter("reason <> ''")
