"""Queries on reports, features and edge tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ctmcflow.functions import sequence as seq
from ctmcflow.operators import graph, stats
from ctmcflow.operators.graph import NET
from ctmcflow.session import Scratch, table


# --- edge tables --------------------------------------------------------------------------------
def clean_edges(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (network, source, target): highest finite log-rate, its reverse log-rate and branching."""
    at = lambda c, i: F.get(c, F.lit(i))
    e = table(spark, sf, "graph_edges").select(NET, at("edge_index", 0).alias("src"), at("edge_index", 1).alias("dst"), at("edge_attr", 0).cast("double").alias("lr"), at("edge_attr", 2).cast("double").alias("b"))
    ok = "src IS NOT NULL AND dst IS NOT NULL AND lr IS NOT NULL AND NOT isnan(lr) AND abs(lr) < double('Infinity')"
    return e.filter(ok).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).groupBy(NET, "src", "dst").agg(F.max("lr").alias("lr"), F.max("b").alias("b"))


def edge_features(spark, sf):
    """Standardised log-rate, reverse log-rate (0 without one), whether a reverse edge exists."""
    e = clean_edges(spark, sf)
    r = e.select(NET, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("lr").alias("rev"))
    j = e.join(r, [NET, "src", "dst"], "left").withColumn("has_reverse", F.col("rev").isNotNull().cast("int"))
    z = graph.standardise(j, {"lr": None, "rev": F.col("has_reverse") == 1}, [NET])
    return z.select(NET, "src", "dst", F.round("z_lr", 6).alias("z_lr"), F.round("z_rev", 6).alias("z_rev"), "has_reverse")


def node_features(spark, sf):
    """In- and outgoing edge statistics of every state that an edge names, and whether it is A or B."""
    e = clean_edges(spark, sf)
    o = e.groupBy(NET, F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.avg("lr").alias("out_mean"), F.max("lr").alias("out_max"), F.sum("b").alias("b_out"))
    i = e.groupBy(NET, F.col("dst").alias("node")).agg(F.count("*").alias("n_in"), F.avg("lr").alias("in_mean"), F.max("lr").alias("in_max"))
    j = o.join(i, [NET, "node"], "full").fillna(0, ["n_out", "n_in"]).fillna(0.0, ["out_mean", "out_max", "b_out", "in_mean", "in_max"])
    size = j.groupBy(NET).agg(F.count("*").alias("n"))
    side = table(spark, sf, "ab_states").groupBy(NET, F.col("state_id").alias("node")).agg(F.max((F.col("side") == "A").cast("int")).alias("is_a"), F.max((F.col("side") == "B").cast("int")).alias("is_b"))
    j = j.join(size, NET).join(side, [NET, "node"], "left").fillna(0, ["is_a", "is_b"])
    return j.select(NET, "node", "n_out", "n_in", *[F.round(c, 5).alias(c) for c in ("out_mean", "out_max", "b_out", "in_mean", "in_max")], F.round((F.col("n_out") + F.col("n_in")) / F.col("n"), 6).alias("deg_frac"), "is_a", "is_b")


def enrich_nodes(spark, sf):
    """Standardised degree and rate features per network."""
    n = node_features(spark, sf)
    z = graph.standardise(n, {"n_out": None, "n_in": None, "out_mean": F.col("n_out") > 0}, [NET])
    return z.select(NET, "node", *[F.round(c, 5).alias(c) for c in ("z_n_out", "z_n_in", "z_out_mean")])


def sparsify_topk(spark, sf):
    return graph.sparsify(clean_edges(spark, sf), "lr", 5).select(NET, "src", "dst")


def ablation_pivot(spark, sf):
    """Edges left per network for each top-k of a grid, one column per k. Sources are cut to the largest k before they are shuffled."""
    e = Scratch(spark, "ablation").put(clean_edges(spark, sf), "edges")
    w = Window.partitionBy(NET, "src").orderBy(F.desc("lr"), "dst")
    top = e.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= 20)
    r = top.groupBy(NET).agg(*[F.count_if(F.col("rn") <= k).alias(f"k{k}") for k in (1, 5, 10, 20)])
    return r.join(e.groupBy(NET).agg(F.count("*").alias("k_all")), NET)


def lograte_moments(spark, sf):
    e = clean_edges(spark, sf)
    return e.groupBy(NET).agg(F.count("*").alias("n"), F.round(F.avg("lr"), 6).alias("mean"), F.round(F.stddev_pop("lr"), 6).alias("std"))


def graph_metrics(spark, sf):
    e = clean_edges(spark, sf)
    nodes = e.select(NET, F.col("src").alias("node")).union(e.select(NET, F.col("dst").alias("node"))).distinct()
    t = graph.topology(nodes, e)
    return t.select(NET, "n", "edges_dir", "edges_und", F.round("density", 6).alias("density"), F.round("deg_mean", 6).alias("deg_mean"), "deg_max", F.round("deg_std", 6).alias("deg_std"))


def message_pass(spark, sf):
    """One step of mean aggregation: every node takes the mean of its neighbours' out-degrees over incoming edges."""
    e = clean_edges(spark, sf)
    h = e.groupBy(NET, "src").agg(F.count("*").cast("double").alias("h"))
    return e.join(h, [NET, "src"]).groupBy(NET, F.col("dst").alias("node")).agg(F.round(F.avg("h"), 6).alias("h_mean"), F.sum("h").alias("h_sum"))


def pooling(spark, sf):
    m = message_pass(spark, sf)
    return m.groupBy(NET).agg(F.round(F.avg("h_mean"), 5).alias("pool_mean"), F.sum("h_sum").alias("pool_add"), F.count("*").alias("n"))


# --- reports ------------------------------------------------------------------------------------
def report(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "micro_report_all")
    return r.withColumn(NET, seq.basename(F.col("dps_dir"))).withColumn("st", F.upper(F.trim("status")))


def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each network that names its folder and has a positive finite mfpt_ab."""
    r = report(spark, sf).filter(f"{NET} RLIKE '^[a-z]+_(19sb|99idps)$' AND mfpt_ab > 0 AND mfpt_ab < 1 AND mfpt_ba > 0 AND mfpt_ba < 1")
    best = r.groupBy(NET).agg(F.max(F.struct("loaded_at", "report_id", "sequence", "n", "nnz_q", "mfpt_ab", "mfpt_ba", "pi_max", "nnz_per_state")).alias("m"))
    return best.select(NET, "m.report_id", "m.n", "m.nnz_q", "m.mfpt_ab", "m.mfpt_ba", "m.pi_max", "m.nnz_per_state")


def micro_report_rows(spark, sf):
    """Validation flags of every report row."""
    r = report(spark, sf)
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    r = r.withColumns({
        "sign_ok": flag((F.col("diag_pos_count") == 0) & (F.col("off_neg_count") == 0)), "stationary_ok": flag(num("qpi_rel").between(0, 1e-10)), "pi_ok": flag(F.abs(num("pi_sum") - 1) < 1e-9),
        "ab_ok": flag((F.col("na") >= 1) & (F.col("nb") >= 1) & (F.col("ab_overlap") == 0)), "mfpt_ok": flag((num("mfpt_ab") > 0) & (num("mfpt_ba") > 0)),
    })
    valid = F.col("sign_ok") * F.col("stationary_ok") * F.col("pi_ok") * F.col("ab_ok") * F.col("mfpt_ok")
    return r.select("report_id", "sign_ok", "stationary_ok", "pi_ok", "ab_ok", "mfpt_ok", valid.alias("valid"), F.round(F.try_divide(F.col("nnz_q").cast("double"), F.col("n")), 6).alias("nnz_per_state"))


def status_counts(spark, sf):
    return report(spark, sf).groupBy(F.coalesce("st", F.lit("MISSING")).alias("status")).agg(F.count("*").alias("n"), F.count_distinct("system").alias("n_systems"))


def status_rollup(spark, sf):
    """Least, median and greatest state count and log10 passage time by status, and over all rows."""
    lt = F.when((F.col("mfpt_ab") > 0) & ~F.isnan("mfpt_ab"), F.log10("mfpt_ab"))
    r = Scratch(spark, "rollup").put(report(spark, sf).select("st", "n", lt.alias("lt")), "rows")
    g = r.rollup("st").agg(F.count("*").alias("rows"), F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.grouping("st").cast("long").alias("total"))
    for c, name in (("n", "n_median"), ("lt", "lt_median")):
        q = stats.quantiles(r, c, [0.5], ["st"]).select(F.col("st").alias("_st"), F.lit(0).cast("long").alias("_total"), F.col("q0").alias(name))
        q = q.unionByName(stats.quantiles(r, c, [0.5]).select(F.lit(None).cast("string").alias("_st"), F.lit(1).cast("long").alias("_total"), F.col("q0").alias(name)))
        g = g.join(q, F.col("st").eqNullSafe(F.col("_st")) & (F.col("total") == F.col("_total")), "left").drop("_st", "_total")
    return g.select("st", "rows", "n_min", "n_median", "n_max", F.round("lt_median", 6).alias("lt_median"), "total")


def report_lines(spark, sf):
    """Text report: one line per system."""
    r = report(spark, sf).filter("system IS NOT NULL").groupBy(F.lower(F.trim("system")).alias("system")).agg(F.count("*").alias("n"), F.count_if(F.col("st") == "OK").alias("ok"), F.max("n").alias("n_max"))
    return r.select(F.format_string("%s rows=%d ok=%d max_n=%d", "system", F.col("n"), F.col("ok"), F.coalesce("n_max", F.lit(0))).alias("line"))


def relerr_between_loads(spark, sf):
    """Passage time of a folder against its row before: log10 of 1 + relative error, and log10 ratio."""
    r = report(spark, sf).filter("dps_dir IS NOT NULL AND mfpt_ab IS NOT NULL AND NOT isnan(mfpt_ab)")
    p = F.lag("mfpt_ab").over(Window.partitionBy("dps_dir").orderBy("loaded_at", "report_id"))
    r = r.withColumn("p", p).filter("p IS NOT NULL")
    both = (F.col("p") > 0) & (F.col("mfpt_ab") > 0)
    return r.select("report_id", F.round(F.log10(F.try_divide(F.abs(F.col("mfpt_ab") - F.col("p")), F.abs("p")) + 1), 6).alias("log_relerr"), F.round(F.when(both, F.log10(F.col("mfpt_ab") / F.col("p"))), 6).alias("log10_ratio"))


def micro_vs_coarse(spark, sf):
    """Newest report of each network against the newest coarse feature row: compression and status."""
    m = latest_report(spark, sf)
    c = table(spark, sf, "graph_features_coarse_t300k").withColumn(NET, seq.basename(F.col("dps_dir"))).filter("n_nodes IS NOT NULL")
    c = c.groupBy(NET).agg(F.max(F.struct("computed_at", "feature_id", "n_nodes")).alias("m")).select(NET, F.col("m.n_nodes").alias("n_coarse"))
    j = m.join(c, NET, "left")
    return j.select(NET, "n", "n_coarse", F.round(1 - F.col("n_coarse") / F.col("n"), 6).alias("compression"), F.when(F.col("n_coarse").isNull(), "MISSING_COARSE").otherwise("OK").alias("status"))


def networks_without_report(spark, sf):
    return table(spark, sf, "networks").join(latest_report(spark, sf), NET, "left_anti").select(NET)


def networks_in_both(spark, sf):
    f = table(spark, sf, "graph_features_coarse_t300k").select(seq.basename(F.col("dps_dir")).alias(NET))
    return table(spark, sf, "networks").select(NET).intersect(f)


def ids_in_any(spark, sf):
    f = table(spark, sf, "graph_features_coarse_t300k").select(seq.basename(F.col("dps_dir")).alias(NET))
    return table(spark, sf, "networks").select(NET).union(f).union(table(spark, sf, "graph_edges").select(NET)).filter(f"{NET} IS NOT NULL").distinct()


def first_of_keys(spark, sf):
    """Passage time under whichever name a record has it, plain numbers only."""
    m = F.from_json("record", "map<string,string>")
    r = table(spark, sf, "raw_kinetics").withColumn("m", m)
    v = F.coalesce(*[F.col("m")[k].try_cast("double") for k in ("MFPT_AB", "MFPTAB", "mfpt_ab")])
    return r.select("file_id", "line_no", F.when(~F.isnan(v) & (F.abs(v) < 1e300), F.round(F.log10(F.when(v > 0, v)), 6)).alias("log10_mfpt")).filter("log10_mfpt IS NOT NULL")


def padded_attributes(spark, sf):
    """edge_attr as five columns, missing places null."""
    e = table(spark, sf, "graph_edges")
    v = lambda i: F.get("edge_attr", F.lit(i)).cast("double")
    return e.select("edge_id", *[F.when(~F.isnan(v(i)) & (F.abs(v(i)) < 1e30), F.round(v(i), 4)).alias(f"a{i}") for i in range(5)])


def sequence_features(spark, sf):
    r = report(spark, sf)
    c = seq.composition(F.col("sequence"))
    return r.select("report_id", *[(F.round(v, 6) if k.startswith(("frac", "hyd")) else v).alias(k) for k, v in c.items()])


def sequence_classes(spark, sf):
    n = table(spark, sf, "networks")
    return n.select(NET, seq.sequence_class(F.col("sequence")).alias("class"), seq.variant_of(F.col(NET)).alias("variant"))


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """Networks with class, size and log10 passage times."""
    m = latest_report(spark, sf).withColumns({"lt_ab": F.log10("mfpt_ab"), "lt_ba": F.log10("mfpt_ba"), "ln_n": F.ln(F.col("n").cast("double"))})
    return table(spark, sf, "networks").select(NET, "landscape_class", "variant").join(m, NET).filter("n > 0")


def log10_targets(spark, sf):
    return targets(spark, sf).select(NET, F.round("lt_ab", 6).alias("lt_ab"), F.round("lt_ba", 6).alias("lt_ba"), F.round(F.col("lt_ab") - F.col("lt_ba"), 6).alias("log_ratio"))


def merged_features(spark, sf):
    """Feature rows with the targets of their network, inner, complete cases only."""
    f = table(spark, sf, "graph_features_coarse_t300k").withColumn(NET, seq.basename(F.col("dps_dir")))
    f = f.filter("density IS NOT NULL AND NOT isnan(density) AND degree_mean IS NOT NULL AND NOT isnan(degree_mean) AND n_nodes > 0")
    return f.select("feature_id", NET, "n_nodes", "density", "degree_mean").join(targets(spark, sf).select(NET, "lt_ab"), NET).withColumn("lt_ab", F.round("lt_ab", 6))


def numeric_columns(spark, sf):
    """Share of usable values of every numeric feature column, and whether it is over one half."""
    f = table(spark, sf, "graph_features_coarse_t300k")
    cols = [c for c, t in f.dtypes if t in ("double", "bigint", "int") and c != "feature_id"]
    ok = {c: (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))) for c in cols}
    a = f.agg(*[F.avg(v.cast("double")).alias(c) for c, v in ok.items()])
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(c, 6).alias("share"), (F.col(c) > 0.5).cast("int").alias("selected")) for c in cols])))


def class_descriptives(spark, sf):
    t = Scratch(spark, "classes").put(targets(spark, sf).filter("landscape_class IS NOT NULL").select("landscape_class", "lt_ab"), "targets")
    q = stats.quantiles(t, "lt_ab", [0.25, 0.5, 0.75], ["landscape_class"]).select("landscape_class", F.col("q1").alias("median"), (F.col("q2") - F.col("q0")).alias("iqr"))
    g = t.groupBy("landscape_class").agg(F.count("*").alias("n"), F.avg("lt_ab").alias("mean"), F.stddev_samp("lt_ab").alias("std"), F.min("lt_ab").alias("min"), F.max("lt_ab").alias("max")).join(q, "landscape_class", "left")
    return g.select("landscape_class", "n", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std", "min", "max", "iqr")])


def kruskal(spark, sf):
    t = targets(spark, sf).filter("landscape_class IS NOT NULL").select(NET, "landscape_class", F.round("lt_ab", 3).alias("v"))
    r = stats.ranks(Scratch(spark, "kw"), t, "v", NET)
    return stats.kruskal(r, "landscape_class").select("n", "k", F.round("h", 6).alias("h"), F.round("eta2", 6).alias("eta2"), F.round("p", 6).alias("p"))


def mann_whitney(spark, sf):
    t = targets(spark, sf).filter("landscape_class IS NOT NULL").select("landscape_class", F.round("lt_ab", 3).alias("v"))
    m = stats.mann_whitney(Scratch(spark, "mw").put(t, "values"), "v", "landscape_class")
    return m.select("g1", "g2", "n1", "n2", "u", F.round("rank_biserial", 6).alias("rank_biserial"), F.round("z", 6).alias("z"), seq.effect_label(F.col("rank_biserial")).alias("effect"))


def mann_whitney_exact(spark, sf):
    """Mann-Whitney tests of the class pairs on unrounded times: p exact for small untied groups, else corrected for ties and continuity; Bonferroni."""
    t = targets(spark, sf).filter("landscape_class IS NOT NULL").select("landscape_class", F.col("lt_ab").alias("v"))
    m = stats.mann_whitney_p(stats.mann_whitney(Scratch(spark, "mwe").put(t, "values"), "v", "landscape_class"))
    m = m.crossJoin(F.broadcast(m.agg(F.count("*").alias("pairs"))))  # one row
    return m.select("g1", "g2", "n1", "n2", "u", "ties", "rank_biserial", "p", F.least(F.lit(1.0), F.col("p") * F.col("pairs")).alias("p_bonferroni"), seq.effect_label(F.col("rank_biserial")).alias("effect"))


def class_pair_tests(spark, sf):
    """Mann-Whitney tests of the class pairs with normal p, Bonferroni's correction over the pairs and flags."""
    m = mann_whitney(spark, sf).select("g1", "g2", "u", "z")
    p = F.least(F.lit(1.0), stats.two_sided(F.col("z")))
    m = m.withColumn("p", p).crossJoin(F.broadcast(m.agg(F.count("*").alias("pairs"))))  # one row
    m = m.withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("pairs")))
    return m.select("g1", "g2", "u", F.round("p", 6).alias("p"), F.round("p_bonferroni", 6).alias("p_bonferroni"), (F.col("p_bonferroni") < 0.05).cast("int").alias("significant_005"), (F.col("p_bonferroni") < 0.01).cast("int").alias("significant_001"))


def pearson_tests(spark, sf):
    """Pearson r of each regressor with the target and its p by Fisher's transform."""
    t = targets(spark, sf).dropna(subset=["lt_ab", *_XS])
    a = t.agg(F.count("*").alias("n"), *[F.corr("lt_ab", x).alias(x) for x in _XS])
    r = a.select("n", F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("r")) for x in _XS])))
    p = stats.two_sided(F.atanh("r") * F.sqrt(F.col("n") - 3))
    return r.select("feature", "n", F.round("r", 5).alias("r"), F.round(p, 5).alias("p"))


def ols_univariate(spark, sf):
    t = targets(spark, sf)
    return t.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.regr_slope("lt_ab", "ln_n"), 6).alias("slope"), F.round(F.regr_intercept("lt_ab", "ln_n"), 6).alias("intercept"), F.round(F.regr_r2("lt_ab", "ln_n"), 6).alias("r2"))


_CORR = ["lt_ab", "lt_ba", "ln_n", "pi_max", "nnz_per_state"]


def corr_matrix(spark, sf):
    t = targets(spark, sf).dropna(subset=_CORR)
    pairs = [(a, b) for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]]
    a = t.agg(*[F.corr(x, y).alias(f"{x}__{y}") for x, y in pairs])
    return a.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.round(f"{x}__{y}", 5).alias("r")) for x, y in pairs])))


def corr_topk(spark, sf):
    return corr_matrix(spark, sf).orderBy(F.abs("r").desc_nulls_last(), "a", "b").limit(3)


def variant_class_pivot(spark, sf):
    t = targets(spark, sf)
    p = t.groupBy("variant").pivot("landscape_class", ["funnel", "glassy", "two_state"]).agg(F.avg("lt_ab"))
    return p.select("variant", *[F.round(c, 6).alias(c) for c in ("funnel", "glassy", "two_state")])


def best_worst(spark, sf):
    """The five slowest and the five fastest networks."""
    t = targets(spark, sf).select(NET, F.round("lt_ab", 6).alias("lt_ab"))
    top = t.orderBy(F.desc("lt_ab"), NET).limit(5).withColumn("kind", F.lit("slowest"))
    return top.unionByName(t.orderBy("lt_ab", NET).limit(5).withColumn("kind", F.lit("fastest")))


def slowest_variant(spark, sf):
    """Per sequence the variant with the longest passage (ties: the later name)."""
    t = targets(spark, sf).withColumn("s", F.split_part(F.col(NET), F.lit("_"), F.lit(1)))
    return t.groupBy("s").agg(F.max(F.struct(F.round("lt_ab", 6), "variant"))["variant"].alias("variant"), F.count("*").alias("n"))


def describe_targets(spark, sf):
    cols = ["lt_ab", "lt_ba", "ln_n"]
    t = Scratch(spark, "describe").put(targets(spark, sf).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in cols]))), "long")
    q = stats.quantiles(t, "v", [0.25, 0.5, 0.75], ["column_name"])
    g = t.groupBy("column_name").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std")).join(q, "column_name", "left")
    return g.select("column_name", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), *[F.round(f"q{i}", 5).alias(p) for i, p in enumerate(("p25", "p50", "p75"))])


def histogram(spark, sf):
    """Passage times in 15 bins of log10 between -12 and -3."""
    t = targets(spark, sf)
    return t.groupBy(F.width_bucket("lt_ab", F.lit(-12.0), F.lit(-3.0), F.lit(15)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def impute_standardise(spark, sf):
    """Modularity with missing or unusable values set to the median, then standardised."""
    f = table(spark, sf, "graph_features_coarse_t300k")
    m = F.when(~F.isnan("modularity") & F.col("modularity").between(-0.5, 1), F.col("modularity"))
    f = f.select("feature_id", m.alias("m"))
    med = stats.quantiles(f, "m", [0.5]).select(F.col("q0").alias("med"))
    x = f.crossJoin(F.broadcast(med)).select("feature_id", F.coalesce("m", "med").alias("x"))  # one row
    s = x.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    return x.crossJoin(F.broadcast(s)).select("feature_id", F.round(F.when(F.col("sd") > 0, (F.col("x") - F.col("mu")) / F.col("sd")).otherwise(0.0), 5).alias("z"))


# --- models -------------------------------------------------------------------------------------
_XS = ["ln_n", "pi_max", "nnz_per_state"]


def design(spark: SparkSession, sf: str, label: str) -> tuple[Scratch, DataFrame]:
    """Complete cases with standardised regressors, written once: models read it many times."""
    t = targets(spark, sf).select(NET, "lt_ab", *_XS).dropna()
    z = graph.standardise(t.withColumn("_all", F.lit(1)), dict.fromkeys(_XS), ["_all"])
    s = Scratch(spark, label)
    return s, s.put(z.select(NET, "lt_ab", *[F.col(f"z_{x}").alias(x) for x in _XS]), "design")


def loocv_ols(spark, sf):
    """Leave-one-out metrics of the model of one regressor."""
    _, d = design(spark, sf, "loo1")
    return stats.loo(d, ["ln_n"], "lt_ab").agg(*stats.metrics("lt_ab", "loo")).select(*[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae")], "n")


def loocv_predictions(spark, sf):
    _, d = design(spark, sf, "loo2")
    return stats.loo(d, ["ln_n"], "lt_ab").select(NET, F.round("loo", 5).alias("loo"))


def model_comparison(spark, sf):
    """Leave-one-out metrics of linear and ridge models over sets of regressors, best first."""
    _, d = design(spark, sf, "cmp")
    out = None
    for k in range(1, len(_XS) + 1):
        for alpha in (0.0, 1.0, 10.0):
            m = stats.loo(d, _XS[:k], "lt_ab", alpha).agg(*stats.metrics("lt_ab", "loo")).withColumns({"n_features": F.lit(k), "alpha": F.lit(alpha)})
            out = m if out is None else out.unionByName(m)
    return out.orderBy(F.desc_nulls_last("r2"), "n_features", "alpha")


def model_zoo(spark, sf):
    """All models of one table, best first: fixed linear, ridge, lasso and elastic-net models by leave-one-out, those that choose their
    penalty and the trees over five folds; protocol says which."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    s, d = design(spark, sf, "zoo")
    cols = ["model", "protocol", "r2", "rmse", "mae", "n"]
    parts = []
    for name, alpha in (("ols", 0.0), ("ridge_1", 1.0), ("ridge_10", 10.0)):
        parts.append(stats.loo(d, _XS, "lt_ab", alpha).agg(*stats.metrics("lt_ab", "loo")).withColumns({"model": F.lit(name), "protocol": F.lit("loo")}))
    grid = [10 ** (-3 + 6 * i / 19) for i in range(20)]
    tried = spark.createDataFrame([], "alpha double, r2 double, rmse double, mae double, n long")
    for a in grid:
        tried = tried.unionByName(stats.loo(d, _XS, "lt_ab", a).agg(*stats.metrics("lt_ab", "loo")).withColumn("alpha", F.lit(a)))
    parts.append(tried.orderBy(F.desc_nulls_last("r2"), "alpha").limit(1).withColumns({"model": F.lit("ridge_cv"), "protocol": F.lit("loo")}))
    parts.append(stats.loo_penalised(d, _XS, "lt_ab", {"lasso_01": (0.1, 1.0), "lasso_1": (1.0, 1.0), "elastic_net": (0.5, 0.5)}).withColumn("protocol", F.lit("loo")))
    cv = spark.createDataFrame(stats.penalised(d, _XS, "lt_ab", NET, {k: PENALISED[k] for k in ("lasso_cv", "elastic_net_cv")}), "model string, alpha double, l1_ratio double, r2 double, rmse double, n long, nonzero int")
    parts.append(cv.withColumns({"protocol": F.lit("five folds"), "mae": F.lit(None).cast("double")}))
    v = s.put(VectorAssembler(inputCols=_XS, outputCol="features").transform(d).withColumn("fold", F.pmod(F.xxhash64(NET), F.lit(5))), "folds")
    for name, m in (("random_forest", RandomForestRegressor(labelCol="lt_ab", numTrees=100, maxDepth=5, seed=42)), ("gradient_boosting", GBTRegressor(labelCol="lt_ab", maxIter=50, maxDepth=3, stepSize=0.1, seed=42))):
        held = [m.fit(v.filter(F.col("fold") != k)).transform(v.filter(F.col("fold") == k)).select("lt_ab", "prediction") for k in range(5)] if v.limit(1).count() else []
        for h in held[1:]:
            held[0] = held[0].unionByName(h)
        if held:
            parts.append(held[0].agg(*stats.metrics("lt_ab", "prediction")).withColumns({"model": F.lit(name), "protocol": F.lit("five folds")}))
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out.orderBy(F.desc_nulls_last("r2"), "model")


def impute_per_fold(spark, sf):
    """Modularity of each fold with missing values set to the median of the other folds and scaled by their mean and deviation."""
    f = table(spark, sf, "graph_features_coarse_t300k")
    m = F.when(~F.isnan("modularity") & F.col("modularity").between(-0.5, 1), F.col("modularity"))
    f = Scratch(spark, "folds").put(f.select("feature_id", (F.col("feature_id") % 5).alias("fold"), m.alias("m")), "rows")
    others = f.select("m", F.explode(F.filter(F.array(*[F.lit(k).cast("long") for k in range(5)]), lambda k: k != F.col("fold"))).alias("fold"))
    med = stats.quantiles(others, "m", [0.5], ["fold"]).select("fold", F.col("q0").alias("med"))
    fit = others.join(med, "fold").groupBy("fold", "med").agg(F.avg(F.coalesce("m", "med")).alias("mu"), F.stddev_pop(F.coalesce("m", "med")).alias("sd"))
    z = (F.coalesce("m", "med") - F.col("mu")) / F.col("sd")
    return f.join(F.broadcast(fit), "fold").select("feature_id", "fold", F.round(F.when(F.col("sd") > 0, z).otherwise(0.0), 5).alias("z"))  # one row per fold


def pearson_t(spark, sf):
    """Pearson r of each regressor with the target, t = r sqrt((n - 2) / (1 - r^2)) and its two-sided p."""
    t = targets(spark, sf).dropna(subset=["lt_ab", *_XS])
    a = t.agg(F.count("*").alias("n"), *[F.corr("lt_ab", x).alias(x) for x in _XS])
    r = a.select("n", F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), F.col(x).alias("r")) for x in _XS])))
    r = r.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))
    return r.select("feature", "n", "r", "t", stats.student_p(F.col("t"), (F.col("n") - 2).cast("double")).alias("p"))


def ols_univariate_all(spark, sf):
    """The target on each regressor alone: slope, intercept, R^2."""
    t = targets(spark, sf).dropna(subset=["lt_ab", *_XS])
    a = t.agg(F.count("*").alias("n"), *[f("lt_ab", x).alias(f"{k}_{x}") for x in _XS for k, f in (("slope", F.regr_slope), ("intercept", F.regr_intercept), ("r2", F.regr_r2))])
    return a.select("n", F.inline(F.array(*[F.struct(F.lit(x).alias("feature"), *[F.round(f"{k}_{x}", 5).alias(k) for k in ("slope", "intercept", "r2")]) for x in _XS])))


def _split_exact(spark, sf) -> DataFrame:
    n = node_features(spark, sf)
    n = n.withColumn("h", (F.col("node") * 7919) % 1000003 + F.col("node") / 1e9)  # mixed order, ties by number
    p = stats.places(n, "h", [NET])
    count = F.greatest(F.lit(1), F.least(F.floor(0.8 * F.col("n")), F.col("n") - 1))
    return p.withColumn("split", F.when((F.col("is_a") + F.col("is_b") > 0) | (F.col("place") < count), "train").otherwise("test"))


def node_split_exact(spark, sf):
    """80/20 split of each network's states by place in a mixed order: int(0.8 n) of them, at least one and not all, and A and B always, train."""
    return _split_exact(spark, sf).select(NET, "node", "split")


def node_baselines(spark, sf):
    """Mean, linear and ridge models of the mean outgoing log-rate from the other node values, pooled over networks: held-out metrics."""
    xs = ["n_in", "in_mean", "in_max", "deg_frac"]
    s = Scratch(spark, "nodes")
    d = s.put(_split_exact(spark, sf).filter("n_out > 0").select("split", "out_mean", *[F.col(x).cast("double").alias(x) for x in xs]), "rows")
    train, test = d.filter("split = 'train'"), d.filter("split = 'test'")
    g, b, _, total, n = stats.gram(train, xs, "out_mean")
    out = test.withColumn("p", F.lit(float(total / n) if n else None).cast("double")).agg(*stats.metrics("out_mean", "p")).withColumn("model", F.lit("mean"))
    for name, alpha in (("ols", 0.0), ("ridge", 1.0)):
        beta = stats._inverse(g, alpha) @ b
        pred = F.lit(float(beta[0])) + sum((F.lit(float(w)) * F.col(x) for w, x in zip(beta[1:], xs)), F.lit(0.0))
        out = out.unionByName(test.withColumn("p", pred).agg(*stats.metrics("out_mean", "p")).withColumn("model", F.lit(name)))
    return out.select("model", *[F.round(c, 5).alias(c) for c in ("r2", "rmse", "mae")], "n")


# name -> (alphas, shares of the absolute penalty)
PENALISED = {
    "lasso_01": ([0.1], [1.0]), "lasso_1": ([1.0], [1.0]), "lasso_cv": ([10 ** (k / 4) for k in range(-12, 5)], [1.0]),
    "elastic_net": ([0.5], [0.5]), "elastic_net_cv": ([10 ** (k / 4) for k in range(-12, 5)], [0.1, 0.3, 0.5, 0.7, 0.9]),
}


def penalised_models(spark, sf):
    """Lasso and elastic-net models, fixed and chosen by cross-validation, by held-out error over five folds."""
    _, d = design(spark, sf, "pen")
    return spark.createDataFrame(stats.penalised(d, _XS, "lt_ab", NET, PENALISED), "model string, alpha double, l1_ratio double, r2 double, rmse double, n long, nonzero int")


def perm_importance(spark, sf):
    """Drop of R^2 when one regressor is shuffled, mean and deviation over replicates."""
    s, d = design(spark, sf, "imp")
    i = s.put(stats.ranks(s, d, "lt_ab", NET).drop("rank"), "indexed")
    g, b, yy, _, n = stats.gram(i, _XS, "lt_ab")
    beta = stats._inverse(g, 0.0) @ b
    base = stats.r2_of(g, b, yy, n)
    out = None
    for j, x in enumerate(_XS):
        sh = stats.shuffled(i, n, 50, x, seed=7 + j)
        pred = F.lit(float(beta[0])) + sum((F.lit(float(beta[1 + k])) * F.col(f"s_{c}" if c == x else c) for k, c in enumerate(_XS)), F.lit(0.0))
        r = sh.withColumn("p", pred).groupBy("rep").agg(stats.metrics("lt_ab", "p")[0]).agg(F.avg(F.lit(base) - F.col("r2")).alias("drop_mean"), F.stddev_pop("r2").alias("drop_std")).withColumn("feature", F.lit(x))
        out = r if out is None else out.unionByName(r)
    return out


def forward_select(spark, sf):
    _, d = design(spark, sf, "fwd")
    return spark.createDataFrame([(k, x, float(r)) for k, x, r in stats.forward_selection(d, _XS, "lt_ab")], "step int, feature string, r2 double")


def perm_test(spark, sf):
    s, d = design(spark, sf, "pt")
    i = s.put(stats.ranks(s, d, "lt_ab", NET).drop("rank"), "indexed")
    r = stats.permutation_test(i, _XS, "lt_ab")
    return spark.createDataFrame([(r["observed"], r["p"], r["n"], r["times"])], "observed double, p double, n long, times int")


def bootstrap_ci(spark, sf):
    _, d = design(spark, sf, "boot")
    return stats.bootstrap(d, _XS, "lt_ab", NET)


def forest_regression(spark, sf):
    """Random forest and boosted trees on a split by hash: held-out metrics."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    _, d = design(spark, sf, "rf")
    v = VectorAssembler(inputCols=_XS, outputCol="features").transform(d).withColumn("h", F.pmod(F.xxhash64(NET), F.lit(5)))
    train, test = v.filter("h > 0"), v.filter("h = 0")
    out = None
    for name, m in (("linear", LinearRegression(labelCol="lt_ab")), ("forest", RandomForestRegressor(labelCol="lt_ab", numTrees=20, seed=42)), ("boosted", GBTRegressor(labelCol="lt_ab", maxIter=10, seed=42))):
        r = m.fit(train).transform(test).agg(*stats.metrics("lt_ab", "prediction")).withColumn("model", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def kmeans_embeddings(spark, sf):
    """Ten clusters of the embeddings: sizes and purity by label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    p = KMeans(k=10, seed=42).fit(e).transform(e)
    c = p.groupBy("prediction", "label").agg(F.count("*").alias("n"))
    return c.groupBy("prediction").agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("purity"))


def node_split(spark, sf):
    """80/20 split of the states of each network by a mixed order of their numbers; A and B always train."""
    n = node_features(spark, sf).select(NET, "node", ((F.col("is_a") + F.col("is_b")) > 0).alias("ab"))
    return n.select(NET, "node", F.when(F.col("ab") | ((F.col("node") * 7919) % 1000 < 800), "train").otherwise("test").alias("split"))


def mean_baseline(spark, sf):
    """Train mean of the mean outgoing log-rate as prediction for test states: error per network."""
    f = node_features(spark, sf).filter("n_out > 0").select(NET, "node", "out_mean")
    j = f.join(node_split(spark, sf), [NET, "node"])
    mu = j.filter("split = 'train'").groupBy(NET).agg(F.avg("out_mean").alias("mu"))
    return j.filter("split = 'test'").join(mu, NET).groupBy(NET).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("out_mean") - F.col("mu"))), 5).alias("mae"))


QUERIES = {f.__name__: f for f in (
    edge_features, node_features, enrich_nodes, sparsify_topk, ablation_pivot, lograte_moments, graph_metrics, message_pass, pooling, micro_report_rows, status_counts, status_rollup, report_lines, relerr_between_loads, micro_vs_coarse,
    networks_without_report, networks_in_both, ids_in_any, first_of_keys, padded_attributes, sequence_features, sequence_classes, log10_targets, merged_features, numeric_columns, class_descriptives, kruskal, mann_whitney, mann_whitney_exact, class_pair_tests, pearson_tests, ols_univariate,
    corr_matrix, corr_topk, variant_class_pivot, best_worst, slowest_variant, describe_targets, histogram, impute_standardise, loocv_ols, loocv_predictions, model_comparison, penalised_models, perm_importance, forward_select, perm_test, bootstrap_ci,
    forest_regression, kmeans_embeddings, node_split, mean_baseline, model_zoo, impute_per_fold, pearson_t, ols_univariate_all, node_split_exact, node_baselines,
)}

_E = """WITH e AS MATERIALIZED (SELECT network_id, edge_index[1] AS src, edge_index[2] AS dst, MAX(CAST(edge_attr[1] AS DOUBLE)) AS lr, MAX(CASE WHEN NOT isnan(edge_attr[3]) THEN CAST(edge_attr[3] AS DOUBLE) END) AS b FROM graph_edges
WHERE edge_index[1] IS NOT NULL AND edge_index[2] IS NOT NULL AND edge_attr[1] IS NOT NULL AND isfinite(edge_attr[1]) GROUP BY 1, 2, 3)"""
_Z = lambda x, c, m="TRUE": f"CASE WHEN STDDEV_POP({x}) FILTER (WHERE {m}) OVER w > 0 AND {m} THEN ({x} - AVG({x}) FILTER (WHERE {m}) OVER w) / STDDEV_POP({x}) FILTER (WHERE {m}) OVER w ELSE 0.0 END"
_NODE = """,
o AS (SELECT network_id, src AS node, COUNT(*) AS n_out, AVG(lr) AS out_mean, MAX(lr) AS out_max, SUM(b) AS b_out FROM e GROUP BY 1, 2), i AS (SELECT network_id, dst AS node, COUNT(*) AS n_in, AVG(lr) AS in_mean, MAX(lr) AS in_max FROM e GROUP BY 1, 2),
j AS (SELECT network_id, node, COALESCE(n_out, 0) AS n_out, COALESCE(n_in, 0) AS n_in, COALESCE(out_mean, 0) AS out_mean, COALESCE(out_max, 0) AS out_max, COALESCE(b_out, 0) AS b_out, COALESCE(in_mean, 0) AS in_mean, COALESCE(in_max, 0) AS in_max FROM o FULL JOIN i USING (network_id, node)),
sd AS (SELECT network_id, state_id AS node, MAX(CAST(side = 'A' AS INT)) AS is_a, MAX(CAST(side = 'B' AS INT)) AS is_b FROM ab_states GROUP BY 1, 2),
nf AS MATERIALIZED (SELECT network_id, node, n_out, n_in, ROUND(out_mean, 5) AS out_mean, ROUND(out_max, 5) AS out_max, ROUND(b_out, 5) AS b_out, ROUND(in_mean, 5) AS in_mean, ROUND(in_max, 5) AS in_max, ROUND((n_out + n_in) / COUNT(*) OVER (PARTITION BY network_id), 6) AS deg_frac, COALESCE(is_a, 0) AS is_a, COALESCE(is_b, 0) AS is_b FROM j LEFT JOIN sd USING (network_id, node))"""
_BASE = "CASE WHEN lower(trim(dps_dir)) <> 'n/a' THEN regexp_replace(lower(regexp_extract(regexp_replace(trim(dps_dir), '[/\\s]+$', ''), '([^/]*)$', 1)), '_nocap$', '') END"
_R = f"WITH r AS (SELECT *, {_BASE} AS network_id, upper(trim(status)) AS st FROM micro_report_all)"
_L = _R + """, lr AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY loaded_at DESC, report_id DESC) AS rn FROM r WHERE regexp_matches(network_id, '^[a-z]+_(19sb|99idps)$') AND mfpt_ab > 0 AND mfpt_ab < 1 AND mfpt_ba > 0 AND mfpt_ba < 1) WHERE rn = 1)"""
_T = _L + """, t AS MATERIALIZED (SELECT n.network_id, n.landscape_class, n.variant, lr.n, lr.pi_max, lr.nnz_per_state, log10(lr.mfpt_ab) AS lt_ab, log10(lr.mfpt_ba) AS lt_ba, ln(CAST(lr.n AS DOUBLE)) AS ln_n FROM networks n JOIN lr ON lr.network_id = n.network_id WHERE lr.n > 0)"""
_COUNT = lambda letters: "(" + " + ".join(f"(length(s) - length(replace(s, '{x}', '')))" for x in letters) + ")"
_HYDRO = " + ".join(f"{v} * {_COUNT(a)}" for a, v in seq.HYDROPATHY.items())
_D = _T + """, d0 AS (SELECT network_id, lt_ab, ln_n FROM t WHERE lt_ab IS NOT NULL AND ln_n IS NOT NULL AND pi_max IS NOT NULL AND nnz_per_state IS NOT NULL AND NOT isnan(pi_max) AND NOT isnan(nnz_per_state)),
d AS (SELECT network_id, lt_ab AS y, (ln_n - AVG(ln_n) OVER ()) / STDDEV_POP(ln_n) OVER () AS x FROM d0),
m AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, COUNT(*) AS n, AVG(x) AS mx, SUM(x * x) - COUNT(*) * AVG(x) * AVG(x) AS sxx FROM d),
l AS (SELECT network_id, y, y - (y - b0 - b1 * x) / (1 - 1.0 / n - (x - mx) * (x - mx) / sxx) AS loo FROM d, m)"""
_FT = "SELECT column_name, ROUND(share, 6) AS share, CAST(share > 0.5 AS INT) AS selected FROM ("
_FCOLS = {"n_nodes": 0, "n_edges_directed": 0, "n_edges_undirected": 0, "density": 1, "degree_mean": 1, "degree_std": 1, "clustering_coeff_mean": 1, "spectral_gap": 1, "pagerank_a": 1, "n_communities": 0, "modularity": 1, "community_size_entropy": 1, "largest_community_frac": 1, "ab_same_community": 0}

SQL = {
    "edge_features": _E + f", j AS (SELECT e.*, r.lr AS rev, CAST(r.lr IS NOT NULL AS INT) AS has_reverse FROM e LEFT JOIN e r ON r.network_id = e.network_id AND r.src = e.dst AND r.dst = e.src) SELECT network_id, src, dst, ROUND({_Z('lr', 'lr')}, 6) AS z_lr, ROUND({_Z('rev', 'rev', 'has_reverse = 1')}, 6) AS z_rev, has_reverse FROM j WINDOW w AS (PARTITION BY network_id)",
    "node_features": _E + _NODE + " SELECT * FROM nf",
    "enrich_nodes": _E + _NODE + f" SELECT network_id, node, ROUND({_Z('n_out', '')}, 5) AS z_n_out, ROUND({_Z('n_in', '')}, 5) AS z_n_in, ROUND({_Z('out_mean', '', 'n_out > 0')}, 5) AS z_out_mean FROM nf WINDOW w AS (PARTITION BY network_id)",
    "sparsify_topk": _E + ", tk AS (SELECT network_id, src, dst FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id, src ORDER BY lr DESC, dst) AS rn FROM e) WHERE rn <= 5) SELECT network_id, src, dst FROM tk UNION SELECT e.network_id, e.src, e.dst FROM e JOIN tk ON tk.network_id = e.network_id AND tk.src = e.dst AND tk.dst = e.src",
    "ablation_pivot": _E + " SELECT network_id, " + ", ".join(f"COUNT(*) FILTER (WHERE rn <= {k}) AS k{k}" for k in (1, 5, 10, 20)) + ", COUNT(*) AS k_all FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id, src ORDER BY lr DESC, dst) AS rn FROM e) GROUP BY 1",
    "lograte_moments": _E + " SELECT network_id, COUNT(*) AS n, ROUND(AVG(lr), 6) AS mean, ROUND(STDDEV_POP(lr), 6) AS std FROM e GROUP BY 1",
    "graph_metrics": _E + """, nd AS (SELECT network_id, src AS node FROM e UNION SELECT network_id, dst FROM e), u AS (SELECT network_id, src, dst FROM e WHERE src <> dst UNION SELECT network_id, dst, src FROM e WHERE src <> dst),
dg AS (SELECT nd.network_id, nd.node, COUNT(u.dst) AS deg FROM nd LEFT JOIN u ON u.network_id = nd.network_id AND u.src = nd.node GROUP BY 1, 2), dr AS (SELECT network_id, COUNT(*) AS edges_dir FROM e WHERE src <> dst GROUP BY 1)
SELECT dg.network_id, COUNT(*) AS n, COALESCE(MAX(edges_dir), 0) AS edges_dir, CAST(SUM(deg) // 2 AS BIGINT) AS edges_und, ROUND(2.0 * (SUM(deg) // 2) / (COUNT(*) * (COUNT(*) - 1)), 6) AS density, ROUND(AVG(deg), 6) AS deg_mean, MAX(deg) AS deg_max, ROUND(STDDEV_POP(deg), 6) AS deg_std FROM dg LEFT JOIN dr ON dr.network_id = dg.network_id GROUP BY 1""",
    "message_pass": _E + ", h AS (SELECT network_id, src, CAST(COUNT(*) AS DOUBLE) AS h FROM e GROUP BY 1, 2) SELECT e.network_id, e.dst AS node, ROUND(AVG(h), 6) AS h_mean, SUM(h) AS h_sum FROM e JOIN h ON h.network_id = e.network_id AND h.src = e.src GROUP BY 1, 2",
    "pooling": _E + ", h AS (SELECT network_id, src, CAST(COUNT(*) AS DOUBLE) AS h FROM e GROUP BY 1, 2), m AS (SELECT e.network_id, e.dst, ROUND(AVG(h), 6) AS h_mean, SUM(h) AS h_sum FROM e JOIN h ON h.network_id = e.network_id AND h.src = e.src GROUP BY 1, 2) SELECT network_id, ROUND(AVG(h_mean), 5) AS pool_mean, SUM(h_sum) AS pool_add, COUNT(*) AS n FROM m GROUP BY 1",
    "micro_report_rows": """WITH f AS (SELECT *, CAST(COALESCE(diag_pos_count = 0 AND off_neg_count = 0, FALSE) AS INT) AS sign_ok, CAST(COALESCE(NOT isnan(qpi_rel) AND qpi_rel BETWEEN 0 AND 1e-10, FALSE) AS INT) AS stationary_ok, CAST(COALESCE(NOT isnan(pi_sum) AND ABS(pi_sum - 1) < 1e-9, FALSE) AS INT) AS pi_ok,
CAST(COALESCE(na >= 1 AND nb >= 1 AND ab_overlap = 0, FALSE) AS INT) AS ab_ok, CAST(COALESCE(NOT isnan(mfpt_ab) AND mfpt_ab > 0 AND NOT isnan(mfpt_ba) AND mfpt_ba > 0, FALSE) AS INT) AS mfpt_ok FROM micro_report_all) SELECT report_id, sign_ok, stationary_ok, pi_ok, ab_ok, mfpt_ok, sign_ok * stationary_ok * pi_ok * ab_ok * mfpt_ok AS valid, ROUND(CAST(nnz_q AS DOUBLE) / NULLIF(n, 0), 6) AS nnz_per_state FROM f""",
    "status_counts": _R + " SELECT COALESCE(st, 'MISSING') AS status, COUNT(*) AS n, COUNT(DISTINCT system) AS n_systems FROM r GROUP BY 1",
    "status_rollup": _R + " SELECT st, COUNT(*) AS rows, MIN(n) AS n_min, quantile_cont(n, 0.5) AS n_median, MAX(n) AS n_max, ROUND(quantile_cont(CASE WHEN mfpt_ab > 0 AND NOT isnan(mfpt_ab) THEN log10(mfpt_ab) END, 0.5), 6) AS lt_median, CAST(GROUPING(st) AS BIGINT) AS total FROM r GROUP BY ROLLUP (st)",
    "report_lines": _R + " SELECT format('{} rows={} ok={} max_n={}', lower(trim(system)), COUNT(*), COUNT(*) FILTER (WHERE st = 'OK'), COALESCE(MAX(n), 0)) AS line FROM r WHERE system IS NOT NULL GROUP BY lower(trim(system))",
    "relerr_between_loads": "WITH p AS (SELECT report_id, mfpt_ab, LAG(mfpt_ab) OVER (PARTITION BY dps_dir ORDER BY loaded_at, report_id) AS p FROM micro_report_all WHERE dps_dir IS NOT NULL AND mfpt_ab IS NOT NULL AND NOT isnan(mfpt_ab)) SELECT report_id, ROUND(log10(ABS(mfpt_ab - p) / NULLIF(ABS(p), 0) + 1), 6) AS log_relerr, ROUND(CASE WHEN p > 0 AND mfpt_ab > 0 THEN log10(mfpt_ab / p) END, 6) AS log10_ratio FROM p WHERE p IS NOT NULL",
    "micro_vs_coarse": _L + f", c AS (SELECT network_id, n_nodes AS n_coarse FROM (SELECT *, {_BASE} AS network_id, ROW_NUMBER() OVER (PARTITION BY {_BASE} ORDER BY computed_at DESC, feature_id DESC) AS rn FROM graph_features_coarse_t300k WHERE n_nodes IS NOT NULL) WHERE rn = 1) SELECT lr.network_id, lr.n, n_coarse, ROUND(1 - n_coarse / lr.n, 6) AS compression, CASE WHEN n_coarse IS NULL THEN 'MISSING_COARSE' ELSE 'OK' END AS status FROM lr LEFT JOIN c ON c.network_id = lr.network_id",
    "networks_without_report": _L + " SELECT network_id FROM networks WHERE network_id NOT IN (SELECT network_id FROM lr)",
    "networks_in_both": f"SELECT network_id FROM networks INTERSECT SELECT {_BASE} FROM graph_features_coarse_t300k",
    "ids_in_any": f"SELECT network_id FROM (SELECT network_id FROM networks UNION SELECT {_BASE} FROM graph_features_coarse_t300k UNION SELECT network_id FROM graph_edges) WHERE network_id IS NOT NULL",
    "padded_attributes": "SELECT edge_id, " + ", ".join(f"CASE WHEN NOT isnan(edge_attr[{i + 1}]) AND ABS(edge_attr[{i + 1}]) < 1e30 THEN ROUND(CAST(edge_attr[{i + 1}] AS DOUBLE), 4) END AS a{i}" for i in range(5)) + " FROM graph_edges",
    "sequence_features": f"""WITH q AS (SELECT report_id, upper(COALESCE(trim(sequence), '')) AS s FROM micro_report_all), c AS (SELECT report_id, s, length(s) AS length, {_COUNT('R')} AS n_r, {_COUNT('K')} AS n_k, {_COUNT('D')} AS n_d, {_COUNT('E')} AS n_e, {_HYDRO} AS hy, {_COUNT('FWY')} AS ar FROM q)
SELECT report_id, length, n_r, n_k, n_d, n_e, n_r + n_k AS n_pos, n_d + n_e AS n_neg, n_r + n_k - n_d - n_e AS net_charge, ROUND(COALESCE(n_r / NULLIF(length, 0), 0), 6) AS frac_r, ROUND(COALESCE((n_r + n_k) / NULLIF(length, 0), 0), 6) AS frac_pos, ROUND(COALESCE((n_d + n_e) / NULLIF(length, 0), 0), 6) AS frac_neg,
ROUND(COALESCE(CAST(hy AS DOUBLE) / NULLIF(length, 0), 0), 6) AS hydropathy_mean, ar AS aromatic_count, ROUND(COALESCE(ar / NULLIF(length, 0), 0), 6) AS frac_aromatic FROM c""",
    # letter by letter, as the rule is stated: one kind for all residues, else mixed
    "sequence_classes": """WITH q AS (SELECT network_id, replace(replace(upper(trim(sequence)), 'ALA_', ''), '_', '') AS s FROM networks),
k AS (SELECT network_id, CASE WHEN contains('DEKRH', c) THEN 'charged' WHEN contains('STNQ', c) THEN 'polar' WHEN contains('AVILMFWP', c) THEN 'hydrophobic' ELSE 'mixed' END AS kind FROM (SELECT network_id, unnest(string_split(s, '')) AS c FROM q WHERE s <> ''))
SELECT n.network_id, CASE WHEN n.sequence IS NULL THEN NULL WHEN COUNT(DISTINCT kind) = 1 THEN MIN(kind) ELSE 'mixed' END AS class, CASE WHEN contains(lower(n.network_id), '19sb') THEN '19sb' WHEN contains(lower(n.network_id), '99idps') THEN '99idps' ELSE 'unknown' END AS variant
FROM networks n LEFT JOIN k USING (network_id) GROUP BY n.network_id, n.sequence""",
    "log10_targets": _T + " SELECT network_id, ROUND(lt_ab, 6) AS lt_ab, ROUND(lt_ba, 6) AS lt_ba, ROUND(lt_ab - lt_ba, 6) AS log_ratio FROM t",
    "merged_features": _T + f" SELECT f.feature_id, t.network_id, f.n_nodes, f.density, f.degree_mean, ROUND(t.lt_ab, 6) AS lt_ab FROM graph_features_coarse_t300k f JOIN t ON t.network_id = {_BASE.replace('dps_dir', 'f.dps_dir')} WHERE density IS NOT NULL AND NOT isnan(density) AND degree_mean IS NOT NULL AND NOT isnan(degree_mean) AND n_nodes > 0",
    "numeric_columns": _FT + " UNION ALL ".join(f"SELECT '{c}' AS column_name, AVG(CAST({c} IS NOT NULL" + (f" AND NOT isnan({c})" if d else "") + " AS INT)) AS share FROM graph_features_coarse_t300k" for c, d in _FCOLS.items()) + ")",
    "class_descriptives": _T + " SELECT landscape_class, COUNT(*) AS n, ROUND(AVG(lt_ab), 6) AS mean, ROUND(quantile_cont(lt_ab, 0.5), 6) AS median, ROUND(STDDEV_SAMP(lt_ab), 6) AS std, ROUND(MIN(lt_ab), 6) AS min, ROUND(MAX(lt_ab), 6) AS max, ROUND(quantile_cont(lt_ab, 0.75) - quantile_cont(lt_ab, 0.25), 6) AS iqr FROM t WHERE landscape_class IS NOT NULL GROUP BY 1",
    "kruskal": _T + """, v AS (SELECT landscape_class AS g, ROUND(lt_ab, 3) AS v FROM t WHERE landscape_class IS NOT NULL), k AS (SELECT g, v, RANK() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v),
a AS (SELECT SUM(n) AS n, COUNT(*) AS k, SUM(rs * rs / n) AS s FROM (SELECT g, COUNT(*)::DOUBLE AS n, SUM(r)::DOUBLE AS rs FROM k GROUP BY 1)), c AS (SELECT SUM(t * t * t - t)::DOUBLE AS ties FROM (SELECT COUNT(*)::DOUBLE AS t FROM v GROUP BY v)),
h AS (SELECT n, k, (12.0 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM a, c) SELECT CAST(n AS BIGINT) AS n, k, ROUND(h, 6) AS h, ROUND(GREATEST(0, (h - k + 1) / (n - k)), 6) AS eta2, ROUND(CASE WHEN k = 3 THEN EXP(-h / 2) END, 6) AS p FROM h""",
    "mann_whitney": _T + """, v AS (SELECT landscape_class AS g, ROUND(lt_ab, 3) AS v FROM t WHERE landscape_class IS NOT NULL), c AS (SELECT g, COUNT(*) AS n FROM v GROUP BY 1),
u AS (SELECT a.g AS g1, b.g AS g2, SUM(CASE WHEN a.v > b.v THEN 1.0::DOUBLE WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS u FROM v a JOIN v b ON a.g < b.g GROUP BY 1, 2), x AS (SELECT g1, g2, c1.n AS n1, c2.n AS n2, u, 1 - 2 * u / (c1.n * c2.n) AS r, (u - c1.n * c2.n / 2) / SQRT(c1.n * c2.n * (c1.n + c2.n + 1) / 12) AS z FROM u JOIN c c1 ON c1.g = g1 JOIN c c2 ON c2.g = g2)
SELECT g1, g2, n1, n2, u, ROUND(r, 6) AS rank_biserial, ROUND(z, 6) AS z, CASE WHEN ABS(r) > 0.5 THEN 'large' WHEN ABS(r) > 0.3 THEN 'medium' ELSE 'small' END AS effect FROM x""",
    "ols_univariate": _T + " SELECT variant, COUNT(*) AS n, ROUND(regr_slope(lt_ab, ln_n), 6) AS slope, ROUND(regr_intercept(lt_ab, ln_n), 6) AS intercept, ROUND(regr_r2(lt_ab, ln_n), 6) AS r2 FROM t GROUP BY 1",
    "variant_class_pivot": _T + " SELECT variant, " + ", ".join(f"ROUND(AVG(CASE WHEN landscape_class = '{c}' THEN lt_ab END), 6) AS {c}" for c in ("funnel", "glassy", "two_state")) + " FROM t GROUP BY 1",
    "best_worst": _T + " SELECT * FROM (SELECT network_id, ROUND(lt_ab, 6) AS lt_ab, 'slowest' AS kind FROM t ORDER BY ROUND(lt_ab, 6) DESC, network_id LIMIT 5) UNION ALL SELECT * FROM (SELECT network_id, ROUND(lt_ab, 6) AS lt_ab, 'fastest' AS kind FROM t ORDER BY ROUND(lt_ab, 6), network_id LIMIT 5)",
    "slowest_variant": _T + " SELECT s, variant, n FROM (SELECT split_part(network_id, '_', 1) AS s, variant, ROW_NUMBER() OVER (PARTITION BY split_part(network_id, '_', 1) ORDER BY ROUND(lt_ab, 6) DESC, variant DESC) AS rn, COUNT(*) OVER (PARTITION BY split_part(network_id, '_', 1)) AS n FROM t) WHERE rn = 1",
    "describe_targets": _T + " " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, ROUND(AVG({c}), 5) AS mean, ROUND(STDDEV_SAMP({c}), 5) AS std, ROUND(quantile_cont({c}, 0.25), 5) AS p25, ROUND(quantile_cont({c}, 0.5), 5) AS p50, ROUND(quantile_cont({c}, 0.75), 5) AS p75 FROM t" for c in ("lt_ab", "lt_ba", "ln_n")),
    "histogram": _T + " SELECT CAST(CASE WHEN lt_ab < -12 THEN 0 WHEN lt_ab >= -3 THEN 16 ELSE FLOOR((lt_ab + 12) / 9.0 * 15) + 1 END AS BIGINT) AS bin, COUNT(*) AS n FROM t GROUP BY 1",
    "impute_standardise": "WITH f AS (SELECT feature_id, CASE WHEN NOT isnan(modularity) AND modularity BETWEEN -0.5 AND 1 THEN modularity END AS m FROM graph_features_coarse_t300k), x AS (SELECT feature_id, COALESCE(m, (SELECT quantile_cont(m, 0.5) FROM f)) AS x FROM f) SELECT feature_id, ROUND(CASE WHEN STDDEV_POP(x) OVER () > 0 THEN (x - AVG(x) OVER ()) / STDDEV_POP(x) OVER () ELSE 0 END, 5) AS z FROM x",
    "loocv_ols": _D + " SELECT ROUND(1 - SUM((y - loo) * (y - loo)) / (VAR_POP(y) * COUNT(*)), 6) AS r2, ROUND(SQRT(AVG((y - loo) * (y - loo))), 6) AS rmse, ROUND(AVG(ABS(y - loo)), 6) AS mae, COUNT(*) AS n FROM l",
    "loocv_predictions": _D + " SELECT network_id, ROUND(loo, 5) AS loo FROM l",
    "node_split": _E + _NODE + " SELECT network_id, node, CASE WHEN is_a + is_b > 0 OR (node * 7919) % 1000 < 800 THEN 'train' ELSE 'test' END AS split FROM nf",
    "mean_baseline": _E + _NODE + ", s AS (SELECT network_id, node, out_mean, CASE WHEN is_a + is_b > 0 OR (node * 7919) % 1000 < 800 THEN 'train' ELSE 'test' END AS split FROM nf WHERE n_out > 0), m AS (SELECT network_id, AVG(out_mean) AS mu FROM s WHERE split = 'train' GROUP BY 1) SELECT s.network_id, COUNT(*) AS n, ROUND(AVG(ABS(out_mean - mu)), 5) AS mae FROM s JOIN m ON m.network_id = s.network_id WHERE split = 'test' GROUP BY 1",
}
SQL["corr_matrix"] = _T + ", c AS (SELECT * FROM t WHERE " + " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _CORR) + ") " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, ROUND(CORR({a}, {b}), 5) AS r FROM c" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])
SQL["corr_topk"] = f"SELECT * FROM ({SQL['corr_matrix']}) ORDER BY ABS(r) DESC NULLS LAST, a, b LIMIT 3"


def _two_sided_sql(z: str) -> str:
    """The error function's approximation in SQL, on the expression z."""
    x, t = f"(ABS({z}) / SQRT(2))", f"(1 / (1 + {stats.ERF_SCALE}::DOUBLE * ABS({z}) / SQRT(2)))"
    return "(" + " + ".join(f"({c}::DOUBLE) * POW({t}, {i})" for i, c in enumerate(stats.ERF, 1)) + f") * EXP(-{x} * {x})"


SQL["class_pair_tests"] = f"""WITH m AS ({SQL['mann_whitney']}), p AS (SELECT g1, g2, u, LEAST(1.0, {_two_sided_sql('z')}) AS p, COUNT(*) OVER () AS pairs FROM m),
b AS (SELECT *, LEAST(1.0, p * pairs) AS pb FROM p) SELECT g1, g2, u, ROUND(p, 6) AS p, ROUND(pb, 6) AS p_bonferroni, (pb < 0.05)::INT AS significant_005, (pb < 0.01)::INT AS significant_001 FROM b"""
_COMPLETE = "FROM t WHERE lt_ab IS NOT NULL AND " + " AND ".join(f"{x} IS NOT NULL" for x in _XS)
_RS = " UNION ALL ".join(f"SELECT '{x}' AS feature, COUNT(*) AS n, CORR(lt_ab, {x}) AS r {_COMPLETE}" for x in _XS)
SQL["pearson_tests"] = _T + f", rs AS ({_RS}) SELECT feature, n, ROUND(r, 5) AS r, ROUND({_two_sided_sql('(0.5 * LN((1 + r) / (1 - r)) * SQRT(n - 3))')}, 5) AS p FROM rs"
SQL["impute_per_fold"] = """WITH f AS (SELECT feature_id, feature_id % 5 AS fold, CASE WHEN NOT isnan(modularity) AND modularity BETWEEN -0.5 AND 1 THEN modularity END AS m FROM graph_features_coarse_t300k),
o AS (SELECT k.fold, f.m FROM f JOIN (SELECT DISTINCT fold FROM f) k ON k.fold <> f.fold), q AS (SELECT fold, quantile_cont(m, 0.5) AS med FROM o GROUP BY 1), s AS (SELECT o.fold, ANY_VALUE(q.med) AS med, AVG(COALESCE(m, q.med)) AS mu, STDDEV_POP(COALESCE(m, q.med)) AS sd FROM o JOIN q USING (fold) GROUP BY 1)
SELECT feature_id, fold, ROUND(CASE WHEN sd > 0 THEN (COALESCE(m, med) - mu) / sd ELSE 0 END, 5) AS z FROM f JOIN s USING (fold)"""
SQL["ols_univariate_all"] = _T + ", d AS (SELECT * " + _COMPLETE + ") " + " UNION ALL ".join(f"SELECT '{x}' AS feature, COUNT(*) AS n, ROUND(regr_slope(lt_ab, {x}), 5) AS slope, ROUND(regr_intercept(lt_ab, {x}), 5) AS intercept, ROUND(regr_r2(lt_ab, {x}), 5) AS r2 FROM d" for x in _XS)
_SPLIT = ", sp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY (node * 7919) % 1000003, node) - 1 AS place, COUNT(*) OVER (PARTITION BY network_id) AS n FROM nf), se AS (SELECT *, CASE WHEN is_a + is_b > 0 OR place < GREATEST(1, LEAST(FLOOR(0.8 * n), n - 1)) THEN 'train' ELSE 'test' END AS split FROM sp)"
SQL["node_split_exact"] = _E + _NODE + _SPLIT + " SELECT network_id, node, split FROM se"
SQL["first_of_keys"] = """WITH p AS (SELECT file_id, line_no, record, CASE WHEN json_valid(record) AND json_type(record) = 'OBJECT' THEN record END AS j FROM raw_kinetics),
v AS (SELECT file_id, line_no, COALESCE(TRY_CAST(trim(j ->> '$."MFPT_AB"') AS DOUBLE), TRY_CAST(trim(j ->> '$."MFPTAB"') AS DOUBLE), TRY_CAST(trim(j ->> '$."mfpt_ab"') AS DOUBLE)) AS v FROM p)
SELECT file_id, line_no, ROUND(log10(v), 6) AS log10_mfpt FROM v WHERE v > 0 AND NOT isnan(v) AND v < 1e300"""
