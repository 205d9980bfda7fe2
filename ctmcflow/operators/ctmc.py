"""Continuous-time Markov chains of many networks at once, from minima and transition states.

Frames: minima(network_id, min_id, energy, log_prod), ts(network_id, ts_order, f, i, e_ts, s_ts),
rates(network_id, src, dst, k), ab(network_id, min_id, side). An edge src -> dst is the matrix entry
(row dst, column src): columns of the generator sum to zero. beta is 1 unless given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ctmcflow.operators.stats import quantiles
from ctmcflow.session import table

KB = 0.0019872041  # fixed value: kcal/mol/K


def part_minima(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_brand").alias("network_id"), F.col("p_partkey").alias("min_id"), ((F.col("p_retailprice") - F.lit(900.0)) / F.lit(10.0)).alias("energy"), (F.col("p_size") / F.lit(50.0)).alias("log_prod"))


def part_ts(spark: SparkSession, sf: str) -> DataFrame:
    """Two minima of a network that share an order are joined by a transition state; parallel ones occur."""
    m = part_minima(spark, sf)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ts_order"), F.col("l_partkey").alias("min_id"))
    # one shuffle and sort: every line meets those of its order and network that come after it
    after = Window.partitionBy("ts_order", "network_id").orderBy("min_id").rowsBetween(1, Window.unboundedFollowing)
    op = li.join(m, "min_id").withColumn("b", F.collect_list(F.struct("min_id", "energy")).over(after)).filter("network_id IS NOT NULL AND ts_order IS NOT NULL AND size(b) > 0")
    pair = op.select("network_id", "ts_order", "min_id", "energy", F.explode("b").alias("b")).filter("min_id < b.min_id")
    pair = pair.select("network_id", "ts_order", F.col("min_id").alias("f"), F.col("b.min_id").alias("i"), "energy", F.col("b.energy").alias("energy_b")).distinct()
    return pair.select(
        "network_id", "ts_order", "f", "i",
        (F.greatest("energy", "energy_b") + (1 + F.col("ts_order") % 7) / F.lit(4.0)).alias("e_ts"),
        ((F.col("ts_order") % 5) / F.lit(50.0)).alias("s_ts"),
    )


def part_ab(minima: DataFrame) -> DataFrame:
    """The two lowest minima of each network as A and B."""
    w = Window.partitionBy("network_id").orderBy("energy", "min_id")
    return minima.withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("network_id", "min_id", F.when(F.col("rn") == 1, "A").otherwise("B").alias("side"))


def edge_barriers(ts: DataFrame, minima: DataFrame) -> DataFrame:
    """Transition states with both end energies and barrier e_ts - min(e_f, e_i), cut at 0. Self-loops and unknown ends drop out."""
    a = minima.select("network_id", F.col("min_id").alias("f"), F.col("energy").alias("e_f"))
    b = minima.select("network_id", F.col("min_id").alias("i"), F.col("energy").alias("e_i"))
    j = ts.filter("f <> i").join(a, ["network_id", "f"]).join(b, ["network_id", "i"])
    return j.withColumn("barrier", F.greatest(F.lit(0.0), F.col("e_ts") - F.least("e_f", "e_i")))


def pair_barriers(barriers: DataFrame) -> DataFrame:
    return barriers.groupBy("network_id", F.least("f", "i").alias("u"), F.greatest("f", "i").alias("v")).agg(F.min("barrier").alias("barrier"))


def tst_rates(ts: DataFrame, minima: DataFrame, beta: float = 1.0) -> DataFrame:
    """Rates k(src -> dst), parallel transition states added up."""
    b = beta * F.lit(1.0)
    j = ts.join(minima.select("network_id", F.col("min_id").alias("f"), F.col("energy").alias("e_f"), F.col("log_prod").alias("p_f")), ["network_id", "f"])
    j = j.join(minima.select("network_id", F.col("min_id").alias("i"), F.col("energy").alias("e_i"), F.col("log_prod").alias("p_i")), ["network_id", "i"])
    way = lambda s, d, e, p: F.struct(F.col(s).alias("src"), F.col(d).alias("dst"), F.exp(-b * (F.col("e_ts") - F.col(e)) + F.col(p) - F.col("s_ts")).alias("k"))
    both = j.filter("f <> i").select("network_id", F.inline(F.array(way("f", "i", "e_f", "p_f"), way("i", "f", "e_i", "p_i"))))
    return both.groupBy("network_id", "src", "dst").agg(F.sum("k").alias("k"))


def waiting_times(rates: DataFrame) -> DataFrame:
    return rates.groupBy("network_id", F.col("src").alias("node")).agg(F.sum("k").alias("escape")).withColumn("tau", 1 / F.col("escape"))


def branching(rates: DataFrame) -> DataFrame:
    """Branching probabilities b = k / escape; they sum to 1 over the targets of a source."""
    return rates.join(waiting_times(rates).select("network_id", F.col("node").alias("src"), "escape"), ["network_id", "src"]).select("network_id", "src", "dst", "k", (F.col("k") / F.col("escape")).alias("b"))


def equilibrium(minima: DataFrame, beta: float = 1.0) -> DataFrame:
    """pi proportional to exp(-beta E - log_prod), shifted by its largest exponent so that nothing overflows."""
    x = minima.withColumn("x", -beta * F.col("energy") - F.col("log_prod"))
    top = x.groupBy("network_id").agg(F.max("x").alias("top"))
    x = x.join(top, "network_id").withColumn("w", F.exp(F.col("x") - F.col("top")))
    total = x.groupBy("network_id").agg(F.sum("w").alias("total"))
    return x.join(total, "network_id").select("network_id", F.col("min_id").alias("node"), (F.col("w") / F.col("total")).alias("pi"))


def generator(rates: DataFrame) -> DataFrame:
    """Entries of Q with the diagonal: columns (sources) sum to zero."""
    diag = waiting_times(rates).select("network_id", F.col("node").alias("src"), F.col("node").alias("dst"), (-F.col("escape")).alias("q"))
    return rates.select("network_id", "src", "dst", F.col("k").alias("q")).unionByName(diag)


def rates_from_generator(q: DataFrame) -> DataFrame:
    """K from Q: everything off the diagonal."""
    return q.filter("src <> dst").select("network_id", "src", "dst", F.col("q").alias("k"))


def branches_from_generator(q: DataFrame, tau: DataFrame) -> DataFrame:
    """B from Q: entries off the diagonal times the waiting time tau(network_id, node, tau) of their source."""
    return rates_from_generator(q).join(tau.select("network_id", F.col("node").alias("src"), "tau"), ["network_id", "src"]).select("network_id", "src", "dst", (F.col("k") * F.col("tau")).alias("b"))


def generator_from_rates(rates: DataFrame, tau: DataFrame) -> DataFrame:
    """Q from K and the waiting times: K less 1 / tau on the diagonal."""
    diag = tau.select("network_id", F.col("node").alias("src"), F.col("node").alias("dst"), (-1 / F.col("tau")).alias("q"))
    return rates.filter("src <> dst").select("network_id", "src", "dst", F.col("k").alias("q")).unionByName(diag)


def generator_sanity(q: DataFrame, sign_tol: float = 1e-12) -> DataFrame:
    """Per network: size, entries, worst column and row sums, wrong signs."""
    col = q.groupBy("network_id", "src").agg(F.sum("q").alias("s")).groupBy("network_id").agg(F.max(F.abs("s")).alias("max_abs_colsum"), F.count("*").alias("n"))
    row = q.groupBy("network_id", "dst").agg(F.sum("q").alias("s")).groupBy("network_id").agg(F.max(F.abs("s")).alias("max_abs_rowsum"))
    sign = q.groupBy("network_id").agg(F.count("*").alias("nnz"), F.count_if((F.col("src") == F.col("dst")) & (F.col("q") > sign_tol)).alias("diag_pos_count"), F.count_if((F.col("src") != F.col("dst")) & (F.col("q") < -sign_tol)).alias("off_neg_count"))
    return col.join(row, "network_id").join(sign, "network_id").withColumn("nnz_per_state", F.col("nnz") / F.col("n"))


def detailed_balance(rates: DataFrame, pi: DataFrame) -> DataFrame:
    """Worst relative violation of pi_j k_ij = pi_i k_ji per network."""
    f = rates.join(pi.select("network_id", F.col("node").alias("src"), "pi"), ["network_id", "src"]).withColumn("flow", F.col("pi") * F.col("k"))
    r = f.select("network_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("flow").alias("back"))
    j = f.join(r, ["network_id", "src", "dst"], "left")
    return j.groupBy("network_id").agg(F.count("*").alias("edges"), F.max(F.abs(F.col("flow") - F.coalesce("back", F.lit(0.0))) / F.col("flow")).alias("worst"))


def stationarity(q: DataFrame, pi: DataFrame) -> DataFrame:
    """Norms of Q pi and |Q| pi and their ratio, per network."""
    j = q.join(pi.select("network_id", F.col("node").alias("src"), "pi"), ["network_id", "src"])
    by = j.groupBy("network_id", "dst").agg(F.sum(F.col("q") * F.col("pi")).alias("a"), F.sum(F.abs("q") * F.col("pi")).alias("b"))
    return by.groupBy("network_id").agg(F.sum(F.abs("a")).alias("qpi_norm1"), F.sum("b").alias("absqpi_norm1")).withColumn("qpi_rel", F.try_divide("qpi_norm1", "absqpi_norm1"))


def truncate(minima: DataFrame, n_max: int | None = None, e_max: float | None = None) -> DataFrame:
    """Only the n_max lowest minima of a network, or those up to e_max above its lowest."""
    w = Window.partitionBy("network_id")
    if e_max is not None:
        low = minima.groupBy("network_id").agg(F.min("energy").alias("low"))
        minima = minima.join(low, "network_id").filter(F.col("energy") - F.col("low") <= e_max).drop("low")
    if n_max is not None:
        minima = minima.withColumn("rn", F.row_number().over(w.orderBy("energy", "min_id"))).filter(F.col("rn") <= n_max).drop("rn")
    return minima


KEEP_STYLES = ("free_energy", "escape_time", "combined", "hybrid")


PRODUCT = "product"  # the reference's own combined rule; the query keep_combined is held to SQL of another one


def keep_states(states: DataFrame, style: str = "hybrid", percent: float = 5.0, min_kept: int = 50) -> DataFrame:
    """Which states a coarse model keeps. states(network_id, node, pi, tau, must): must marks A and B.

    Thresholds are percentiles over the removable states of a network. free_energy drops states with
    -ln pi above its percentile, escape_time those with tau below its (100 - percent)-th, combined those
    that either drops, hybrid those that both drop, product those with tau * pi below its (100 - percent)-th. Then the most probable dropped states come back until
    min_kept states are kept. Result: states plus kept (boolean).
    """
    p = percent / 100.0
    s = states.withColumn("fe", -F.ln(F.greatest(F.col("pi"), F.lit(1e-300))))
    free = s.filter("NOT must").withColumn("both", F.col("tau") * F.col("pi"))
    needed = {"fe_cut": ("fe", p, style != "escape_time" and style != PRODUCT), "tau_cut": ("tau", 1 - p, style != "free_energy" and style != PRODUCT), "both_cut": ("both", 1 - p, style == PRODUCT)}
    for name, (c, at, used) in needed.items():
        if used:
            s = s.join(quantiles(free, c, [at], ["network_id"]).select("network_id", F.col("q0").alias(name)), "network_id", "left")
        else:
            s = s.withColumn(name, F.lit(None).cast("double"))
    high, fast = F.col("fe") > F.col("fe_cut"), F.col("tau") < F.col("tau_cut")
    rule = {"free_energy": high, "escape_time": fast, "combined": high | fast, "hybrid": high & fast, PRODUCT: F.col("tau") * F.col("pi") < F.col("both_cut")}[style]
    s = s.withColumn("drop", F.coalesce(~F.col("must") & rule, F.lit(False)))
    kept = s.groupBy("network_id").agg(F.count_if(~F.col("drop")).alias("n_kept"))
    need = max(min_kept, 2)
    w = Window.partitionBy("network_id").orderBy(F.desc("pi"), "node")
    back = s.filter("drop").select("network_id", "node", "pi").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= need)
    back = back.join(kept, "network_id").filter(F.col("rn") <= need - F.col("n_kept")).select("network_id", "node", F.lit(True).alias("back"))
    s = s.join(back, ["network_id", "node"], "left")
    return s.select("network_id", "node", "pi", "tau", "must", (~F.col("drop") | F.coalesce("back", F.lit(False))).alias("kept"))
