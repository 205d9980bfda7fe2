"""Train / validation / test splits that keep related records together.

Records are tied by keys (one namespace per column). Components of the record-key graph live in a
persisted ``ComponentTable``; each load only brings its distinct key tuples, so a key named by a third
of all rows is one tuple, and no record ever travels in the iteration.

One round: every tuple takes the least root of its keys, larger roots are hooked to it, and
pointer jumping flattens the hooks before they are applied. Rounds end when no hook is left;
roots only fall, so the order of arrival does not change the components. Rounds see the keys of
the load only; what they change is appended, and what they do not touch is never written again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ctmcflow.session import Scratch

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}

# Spellings of a missing name, after lower-casing and dropping blanks and separators.
PLACEHOLDERS = ["", "na", "nan", "none", "null", "tmp", "unknown", "undefined", "missing"]
STATE = "key string, root string, split string"
_KEYS = "key string, root string"
_ROOTS = "root string, now string, split string, batch int"
_SIZES = "root string, split string, n long, batch int"


def plain(c: Column) -> Column:
    """Lower-case letters and digits only, without the ending ``nocap``; placeholders become null."""
    x = F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
    x = F.regexp_replace(x, "(nocap)+$", "")
    return F.when(~x.isin(PLACEHOLDERS), x)


def last_folder(c: Column) -> Column:
    """Last folder of a path; back slashes, doubled and trailing separators and ``.`` parts make no difference.

    A placeholder may itself hold a separator (``n/a``), so a value that is one as a whole names no folder: null.
    """
    x = F.regexp_replace(F.trim(F.regexp_replace(c, "\\s+", " ")), "\\\\", "/")
    x = F.regexp_replace(x, "(/|/\\.(?=/|$)|\\s)+$", "")
    return F.when(plain(c).isNotNull(), F.regexp_extract(x, "([^/]*)$", 1))


def report_keys(df: DataFrame) -> DataFrame:
    """Key columns of the micro report: sequence, system and last folder of dps_dir."""
    return df.withColumns({"k_seq": plain(F.col("sequence")), "k_sys": plain(F.col("system")), "k_dir": plain(last_folder(F.col("dps_dir")))})


def _tagged(keys: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k))) for i, k in enumerate(keys)]), lambda x: x.isNotNull())


def _flatten(scratch: Scratch, hooks: DataFrame) -> DataFrame:
    """Pointer jumping: hooks (old, new) with new < old, until every new is final."""
    while True:
        a, b = hooks.alias("a"), hooks.alias("b")
        nxt = scratch.put(a.join(b, F.col("a.new") == F.col("b.old"), "left").select("a.old", F.coalesce("b.new", "a.new").alias("new"), F.col("b.new").isNotNull().alias("moved")), "jump", keep=2)
        hooks = nxt.select("old", "new")
        if nxt.filter("moved").limit(1).count() == 0:
            return hooks


def merge_components(scratch: Scratch, tuples: DataFrame, labels: DataFrame) -> DataFrame:
    """tuples(ks array<string>): keys that belong together. labels(key, root): the components so far.

    Result: labels(key, root) of the keys in the tuples, root being the least key of the component.
    """
    links = scratch.put(tuples.filter(F.size("ks") > 0).withColumn("tid", F.monotonically_increasing_id()).select("tid", F.explode("ks").alias("key")), "links", keep=1)
    # keys that are not known yet hang on themselves
    labels = scratch.put(links.select("key").distinct().join(labels.select("key", "root"), "key", "left").select("key", F.coalesce("root", "key").alias("root")), "labels", keep=2)
    while True:
        at = links.join(labels, "key").select("tid", "root").distinct()
        least = at.groupBy("tid").agg(F.min("root").alias("new"), F.count("*").alias("n")).filter("n > 1")
        hooks = at.join(least, "tid").filter("root > new").groupBy(F.col("root").alias("old")).agg(F.min("new").alias("new"))
        hooks = scratch.put(hooks, "hooks", keep=2)
        if hooks.limit(1).count() == 0:
            return labels
        hooks = _flatten(scratch, hooks)
        labels = scratch.put(labels.join(hooks, F.col("root") == F.col("old"), "left").select("key", F.coalesce("new", "root").alias("root")), "labels", keep=2)


def fill_deficits(scratch: Scratch, comps: DataFrame, lack: dict[str, float], splits: dict[str, float] = SPLITS, heavy: int = 1000) -> DataFrame:
    """comps(root, n) -> root, split: every split gets about the rows it lacks.

    Components of at least 1/heavy of the rows, of which there can be no more than ``heavy``, go largest first to the
    split that they fit in and that lacks most for its proportion, so that large ones are spread over all splits; one
    that fits nowhere goes where most is lacking. All others stand in the order of a hash, and a component goes to the split in whose part
    of the running sum of rows its middle lies, so that a split misses its share by less than one of them.
    """
    spark = comps.sparkSession
    total = comps.agg(F.sum("n")).first()[0] or 0
    lack, placed = dict(lack), []
    for r in comps.filter(F.col("n") * heavy >= max(1, total)).orderBy(F.desc("n"), "root").collect():
        fits = [s for s in lack if lack[s] >= r["n"]]
        best = max(fits, key=lambda s: lack[s] / splits[s]) if fits else max(lack, key=lambda s: lack[s])
        placed.append((r["root"], best))
        lack[best] -= r["n"]
    ranged = comps.filter(F.col("n") * heavy < max(1, total)).withColumn("h", F.xxhash64("root")).repartitionByRange("h", "root").withColumn("part", F.spark_partition_id())
    ranged = scratch.put(ranged, "ranged", keep=1)
    sums = ranged.groupBy("part").agg(F.sum("n").alias("s"))
    before = sums.withColumn("off", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "off")  # one row per partition
    light = sums.agg(F.sum("s")).first()[0] or 0
    open_ = {s: max(0.0, v) for s, v in lack.items()}
    whole = sum(open_.values()) or 1.0
    mid = F.col("off") + F.sum("n").over(Window.partitionBy("part").orderBy("h", "root")) - F.col("n") / 2.0
    acc, cases = 0.0, []
    for s, v in open_.items():
        acc += v / whole
        cases.append((acc * light, s))
    last = max(open_, key=lambda s: open_[s])
    share = reduce(lambda c, x: F.when(F.col("mid") < x[0], x[1]).otherwise(c), reversed(cases), F.lit(last))
    rest = ranged.join(F.broadcast(before), "part").withColumn("mid", mid).select("root", share.alias("split"))
    return rest.unionByName(spark.createDataFrame(placed, "root string, split string"))


class ComponentTable:
    """The persisted components: three appended tables in a folder that all executors share.

    keys(key, root): every key once, with the root it had when it came. roots(root, now, split, batch): for every
    root its component's present root and split; the row of the latest batch holds. sizes(root, split, n, batch): rows
    that a batch added to a component, and what a change of split took from one split and gave to another. A batch is
    known once its sizes, written last, are there, so a load that was broken off leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.batches = 0
        while self._there(self.batches):
            self.batches += 1

    def _there(self, batch: int) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes/{batch}/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{b}" for b in range(self.batches)])

    def _write(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/{self.batches}")

    @property
    def keys(self) -> DataFrame:
        return self._read("keys", _KEYS)

    @property
    def roots(self) -> DataFrame:
        """root, now, split as of the latest batch."""
        r = self._read("roots", _ROOTS)
        if self.batches > 1:
            r = r.groupBy("root").agg(F.max(F.struct("batch", "now", "split")).alias("m")).select("root", "m.now", "m.split")
        return r.select("root", "now", "split")

    def state(self) -> DataFrame:
        """key, root, split: every key with its present component."""
        return self.keys.join(self.roots, "root").select("key", F.col("now").alias("root"), "split")

    def extend(self, scratch: Scratch, batch: DataFrame, keys: list[str], splits: dict[str, float] = SPLITS) -> None:
        """Bring the keys of a batch into the table.

        A component known before keeps its split. A merge of components with different splits gets the split
        ``quarantine`` (its rows are in two splits already). New components fill the deficits of all rows so far
        (``fill_deficits``). Rows without any key are their own component and never enter the table.
        """
        tuples = scratch.put(batch.groupBy(_tagged(keys).alias("ks")).agg(F.count("*").alias("n")).filter(F.size("ks") > 0), "tuples", keep=1)
        mine = tuples.select(F.explode("ks").alias("key")).distinct()
        roots = self.roots
        known = scratch.put(self.keys.join(mine, "key", "left_semi").join(roots, "root").select("key", F.col("now").alias("root"), "split"), "known", keep=1)
        labels = merge_components(scratch, tuples, known)
        # components known before that are now part of root
        old = known.join(labels.withColumnRenamed("root", "new"), "key").select("root", "new", "split").distinct()
        kept = old.groupBy(F.col("new").alias("root")).agg(F.count_distinct("split").alias("kinds"), F.min("split").alias("one"))
        kept = kept.select("root", F.when(F.col("kinds") == 1, F.col("one")).otherwise(F.lit("quarantine")).alias("kept"))
        size = tuples.select(F.col("ks")[0].alias("key"), "n").join(labels, "key").groupBy("root").agg(F.sum("n").alias("n"))
        comp = scratch.put(size.join(kept, "root", "left"), "comp", keep=1)
        # components that lose their split take the rows they had with them
        lost = old.join(kept.select(F.col("root").alias("new"), F.col("kept").alias("to")), "new").filter("split <> to")
        lost = roots.select("root", "now").join(lost.select(F.col("root").alias("now"), "to"), "now").select("root", "to")
        had = self._read("sizes", _SIZES).join(lost, "root").groupBy("root", "split", "to").agg(F.sum("n").alias("n"))
        turned = had.select("root", F.inline(F.array(F.struct(F.col("split"), (-F.col("n")).alias("n")), F.struct(F.col("to").alias("split"), "n"))))
        turned = scratch.put(turned, "turned", keep=1)
        by_split = self._read("sizes", _SIZES).select("split", "n").unionByName(turned.select("split", "n")).unionByName(comp.select(F.col("kept").alias("split"), "n"))
        have = {r[0]: r[1] for r in by_split.groupBy("split").agg(F.sum("n")).collect()}
        total = sum(have.values()) - have.get("quarantine", 0)
        lack = {s: p * total - have.get(s, 0) for s, p in splits.items()}
        fresh = fill_deficits(scratch, comp.filter("kept IS NULL").select("root", "n"), lack, splits)
        comp = scratch.put(comp.join(fresh, "root", "left").select("root", F.coalesce("kept", "split").alias("split"), "n"), "placed", keep=1)
        # only what the batch has changed: new roots, and all roots whose component was hooked or re-split
        moved = old.join(comp.select(F.col("root").alias("new"), F.col("split").alias("to")), "new").filter("root <> new OR split <> to").select(F.col("root").alias("now"), "new", "to")
        changed = roots.select("root", "now").join(moved, "now").select("root", F.col("new").alias("now"), F.col("to").alias("split"))
        born = comp.join(roots.select("root"), "root", "left_anti").select("root", F.col("root").alias("now"), "split")
        self._write(labels.join(known, "key", "left_anti"), "keys")
        self._write(changed.unionByName(born).withColumn("batch", F.lit(self.batches)), "roots")
        self._write(comp.select("root", "split", "n").unionByName(turned.select("root", "split", "n")).withColumn("batch", F.lit(self.batches)), "sizes")
        self.batches += 1


def with_state(batch: DataFrame, state: DataFrame, keys: list[str], id_col: str, splits: dict[str, float] = SPLITS) -> DataFrame:
    """Root and split of each row. A row without keys is alone: it has no root, and a hash of its id gives its split."""
    ks = _tagged(keys)
    # the table has one row per key; rows of a hot key are the streamed side, which AQE splits where it is skewed.
    # Rows without keys take part under a name of their own that no key has, so they do not meet in one task
    rows = batch.withColumn("_ks", F.when(F.size(ks) > 0, ks[0]).otherwise(F.concat(F.lit("~"), F.xxhash64(id_col).cast("string"))))
    u, acc, cases = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / F.lit(float(1 << 30)), 0.0, []
    for s, p in splits.items():
        acc += p / sum(splits.values())
        cases.append((acc, s))
    alone = reduce(lambda c, x: F.when(u < x[0], x[1]).otherwise(c), reversed(cases[:-1]), F.lit(cases[-1][1]))
    return rows.join(state, rows["_ks"] == state["key"], "left").withColumn("split", F.when(F.col("_ks").startswith("~"), alone).otherwise(F.col("split"))).drop("key", "_ks")


def groups(scratch: Scratch, df: DataFrame) -> DataFrame:
    """report_id and group_seq: the smallest sequence named in the component of each row (null where none is named)."""
    keys = ["k_seq", "k_sys", "k_dir"]
    # names are cleaned once, for the table and for the rows
    rows = scratch.put(report_keys(df.select("report_id", "sequence", "system", "dps_dir")).select("report_id", *keys), "rows", keep=1)
    table = ComponentTable(df.sparkSession, f"{scratch.root}/components")
    table.extend(scratch, rows, keys)
    state = scratch.put(table.state(), "state", keep=1)
    # a sequence key carries its name after the tag
    named = state.filter("key LIKE '0:%'").groupBy("root").agg(F.min(F.expr("substring(key, 3)")).alias("group_seq"))
    by_key = scratch.put(state.join(named, "root", "left").select("key", "root", "split", "group_seq"), "named")
    return with_state(rows, by_key, keys, "report_id").select("report_id", "group_seq", "split")


def incremental(scratch: Scratch, df: DataFrame, cut: int) -> DataFrame:
    """The loads up to ``cut`` first, the later ones against the persisted table: report_id, split, first_split, moved."""
    keys = ["k_seq", "k_sys", "k_dir"]
    rows = scratch.put(report_keys(df.select("report_id", "load_id", "sequence", "system", "dps_dir")).select("report_id", "load_id", *keys), "rows", keep=1)
    table = ComponentTable(df.sparkSession, f"{scratch.root}/components")
    table.extend(scratch, rows.filter(F.col("load_id") <= cut), keys)
    before = scratch.put(table.state().select("key", F.col("split").alias("first_split")), "first")
    table.extend(scratch, rows.filter(F.coalesce(F.col("load_id") > cut, F.lit(True))), keys)
    state = scratch.put(table.state(), "state", keep=1)
    out = with_state(rows, state, keys, "report_id").select("report_id", "load_id", "root", "split", *keys)
    k = _tagged(keys)
    # a row of no early load, or without keys, has a name of its own that no key has
    out = out.withColumn("_k", F.when((F.size(k) > 0) & (F.col("load_id") <= cut), k[0]).otherwise(F.concat(F.lit("~"), F.xxhash64("report_id").cast("string"))))
    return out.join(before, out["_k"] == before["key"], "left").select("report_id", "split", "first_split", (F.coalesce(F.col("first_split") != F.col("split"), F.lit(False))).alias("moved"))
