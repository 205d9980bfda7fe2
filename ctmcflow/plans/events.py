"""Queries on the event stream and on text sources that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctmcflow.functions.sequence import basename
from ctmcflow.operators import ctmc
from ctmcflow.plans.networks import with_
from ctmcflow.plans.reports import _BASE, _FCOLS
from ctmcflow.session import Scratch, table
from ctmcflow.sources import models, sinks, text
from ctmcflow.streaming import chain


def ext_event_ctmc(spark, sf):
    return chain.event_chain(table(spark, sf, "events"))


def ext_event_stream(spark, sf):
    """The same counts by a stateful stream."""
    s = Scratch(spark, "stream")
    parts = models.is_folder(spark, f"{sf}/events.parquet")
    steps = chain.run_stream(spark, f"{sf}/events.parquet" if parts else sf, "*.parquet" if parts else "events.parquet", f"{s.root}/steps", f"{s.root}/checkpoint")
    return steps.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.avg(F.col("dwell") / 1e6), 3).alias("dwell_s"))


def ext_event_windows(spark, sf):
    w = chain.windowed_counts(table(spark, sf, "events"))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round(F.col("mean") * F.col("n"), 2).alias("total"))


def source_minima_text(spark, sf):
    """Minima written as text by network and scanned again."""
    s = Scratch(spark, "src1")
    sinks.write_lines(ctmc.part_minima(spark, sf), f"{s.root}/min", ["energy", "log_prod"], ["min_id"])
    return text.scan_minima(spark, f"{s.root}/min").select("network_id", "min_id", "energy", "log_prod")


def source_ts_text(spark, sf):
    s = Scratch(spark, "src2")
    t = ctmc.part_ts(spark, sf).withColumns({"dd": F.lit(1), "zero": F.lit(0.0)})
    sinks.write_lines(t, f"{s.root}/ts", ["e_ts", "s_ts", "dd", "f", "i", "zero", "zero", "zero"], ["ts_order", "f", "i"])
    return text.scan_ts(spark, f"{s.root}/ts").select("network_id", "ts_id", F.round("e_ts", 6).alias("e_ts"), "f", "i")


def source_ab_text(spark, sf):
    """A and B lists with a leading count, written as text and scanned again."""
    s = Scratch(spark, "src3")
    ab = ctmc.part_ab(ctmc.part_minima(spark, sf)).select("network_id", "min_id")
    n = ab.groupBy("network_id").agg(F.count("*").alias("min_id"))
    both = n.withColumn("o", F.lit(0)).unionByName(ab.withColumn("o", F.lit(1)))
    sinks.write_lines(both, f"{s.root}/ab", ["min_id"], ["o", "min_id"])
    return text.scan_ids(spark, f"{s.root}/ab").select("network_id", "min_id")


def sink_union_reports(spark, sf):
    """Feature rows and report rows under the union of their columns."""
    f = table(spark, sf, "graph_features_coarse_t300k").select("feature_id", "dps_dir", "status", "n_nodes")
    r = table(spark, sf, "micro_report_all").select("report_id", "dps_dir", "status", "n")
    return sinks.union_reports([f, r])


def sink_by_network(spark, sf):
    """Edges written by network and read again, network by network."""
    s = Scratch(spark, "sink")
    sinks.write_by_network(table(spark, sf, "graph_edges").select("network_id", "edge_id"), f"{s.root}/edges")
    return spark.read.parquet(f"{s.root}/edges").groupBy("network_id").agg(F.count("*").alias("n"), F.max("edge_id").alias("last"))


def source_ts_tolerant(spark, sf):
    """Transition states among blank, commented, cut and misspelled lines: only whole ones come out."""
    s = Scratch(spark, "src4")
    t = ctmc.part_ts(spark, sf)
    good = F.concat_ws(" ", F.col("e_ts").cast("string"), F.col("s_ts").cast("string"), F.lit("1"), "f", "i", F.lit("0 0 0"))
    bad = F.element_at(F.array(F.lit(""), F.lit("# note 1 2 3"), F.concat_ws(" ", F.col("e_ts").cast("string"), F.lit("1")), F.concat_ws(" ", F.lit("x"), F.col("s_ts").cast("string"), F.lit("1"), "f", "i"), F.concat_ws(" ", F.col("e_ts").cast("string"), F.lit("0.0 1 one two"))), (F.col("ts_order") % 5 + 1).cast("int"))
    lines = t.select("network_id", F.explode(F.array(good, bad)).alias("value"))
    lines.repartition("network_id").write.partitionBy("network_id").text(f"{s.root}/ts")
    return text.scan_ts(spark, f"{s.root}/ts").groupBy("network_id").agg(F.count("*").alias("n"), F.sum("f").alias("sum_f"), F.sum("i").alias("sum_i"), F.round(F.sum("e_ts"), 4).alias("sum_e"))


def source_first_ids(spark, sf):
    """Keep lists whose lines go on after the number, among comments and other lines: the first integer of each line."""
    s = Scratch(spark, "src5")
    m = ctmc.part_minima(spark, sf)
    line, note = F.concat_ws(" ", F.lit(" "), "min_id", F.col("energy").cast("string"), F.lit("12")), F.concat(F.lit("# "), F.col("min_id").cast("string"))
    m.select("network_id", F.explode(F.array(line, note, F.lit(""), F.lit("kept 7"))).alias("value")).repartition("network_id").write.partitionBy("network_id").text(f"{s.root}/ids")
    return text.scan_first_ids(spark, f"{s.root}/ids")


def source_discovery(spark, sf):
    """Folders markov_T<kelvin>K below networks, found by their files, for one temperature."""
    s = Scratch(spark, "src6")
    n = table(spark, sf, "networks").filter("network_id IS NOT NULL AND t_k IS NOT NULL").select("network_id", "t_k")
    # one small file per network and temperature stands for its model
    sinks.write_files(n.select(F.concat(F.lit("markov_T"), F.col("t_k").cast("int"), F.lit("K")).alias("tag"), "network_id", F.lit("x").alias("value")), f"{s.root}/nets", ["network_id", "tag"], "value")
    return text.discover_tagged(spark, f"{s.root}/nets", 300.0).select("network_id", "t_k")


def source_model_fallback(spark, sf):
    """A stored model without K and B: both derived from Q and tau."""
    s = Scratch(spark, "src7")
    minima = ctmc.part_minima(spark, sf)
    rates = s.put(ctmc.tst_rates(ctmc.part_ts(spark, sf), minima), "rates")
    ctmc.generator(rates).write.parquet(f"{s.root}/model/q")
    ctmc.waiting_times(rates).select("network_id", "node", "tau").write.parquet(f"{s.root}/model/tau")
    m = models.load_model(spark, f"{s.root}/model")
    return m["b"].join(m["k"], ["network_id", "src", "dst"]).select("network_id", "src", "dst", F.round("k", 6).alias("k"), F.round("b", 6).alias("b"))


def source_csv(spark, sf):
    """Feature rows written as CSV by variant and read again by name with types; unreadable numbers are null."""
    s = Scratch(spark, "src8")
    f = table(spark, sf, "graph_features_coarse_t300k").select("feature_id", "variant", F.col("n_nodes").cast("string").alias("n_nodes"), F.when(F.col("feature_id") % 5 == 0, "n.a.").otherwise(F.round("density", 6).cast("string")).alias("density"))
    f.write.csv(f"{s.root}/features", header=True)
    return models.read_csv(spark, f"{s.root}/features", "feature_id long, variant string, n_nodes long, density double, absent string")


def source_json_files(spark, sf):
    """Metrics written as JSON files by run and read from the whole folder, the run being the folder."""
    s = Scratch(spark, "src9")
    m = table(spark, sf, "graph_features_coarse_t300k").filter("variant IS NOT NULL").groupBy(F.col("variant").alias("run")).agg(F.count("*").alias("rows"), F.round(F.avg(F.when(~F.isnan("density"), F.col("density"))), 6).alias("density"))
    sinks.write_metrics(m.coalesce(1), f"{s.root}/metrics")
    j = models.read_json_files(spark, f"{s.root}/metrics", "rows long, density double")
    return j.select(F.regexp_replace("run", "^run=", "").alias("run"), "rows", "density")


def dataset_cache(spark, sf):
    """A dataset kept by settings and version: made for one setting, read back for the same, made anew for another version."""
    s = Scratch(spark, "src10")
    made = []

    def make(k: int):
        made.append(k)
        return table(spark, sf, "graph_edges").groupBy("network_id").agg(F.count("*").alias("n")).withColumn("made", F.lit(k))

    root = f"{s.root}/cache"
    a = models.cached(spark, root, {"k": 5}, 1, lambda: make(1))
    b = models.cached(spark, root, {"k": 5}, 1, lambda: make(2))
    c = models.cached(spark, root, {"k": 5}, 2, lambda: make(3))
    return a.withColumn("read", F.lit("first")).unionByName(b.withColumn("read", F.lit("again"))).unionByName(c.withColumn("read", F.lit("next version")))


def sink_resume(spark, sf):
    """Feature rows appended in two runs with an overlap: what the sink holds already is skipped."""
    s = Scratch(spark, "src11")
    f = table(spark, sf, "graph_features_coarse_t300k").select("feature_id", "n_nodes")
    sinks.append_new(f.filter("feature_id % 3 <> 0"), f"{s.root}/out", "feature_id")
    sinks.append_new(f, f"{s.root}/out", "feature_id")
    return spark.read.parquet(f"{s.root}/out")


def sink_keep_lists(spark, sf):
    """Keep lists by network and cut label, written once, not overwritten by a second run, and scanned again."""
    s = Scratch(spark, "src12")
    m = ctmc.part_minima(spark, sf).select("network_id", F.col("min_id").alias("node"), "energy")
    cuts = F.explode(F.array(F.lit(20.0), F.lit(42.5)))
    kept = m.withColumn("cut", cuts).filter("energy <= cut").select("network_id", "cut", "node")
    sinks.write_keep_lists(kept, f"{s.root}/keep")
    sinks.write_keep_lists(kept.filter("cut < 0"), f"{s.root}/keep")
    return spark.read.option("inferSchema", "false").text(f"{s.root}/keep").groupBy("network_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("ids"))


def selected_networks(spark, sf):
    """Networks of the first two hundred sequences by name, whose newest feature row is whole or partial."""
    n = table(spark, sf, "networks").filter("sequence IS NOT NULL")
    some = n.select("sequence").distinct().orderBy("sequence").limit(200)  # the cap is the feature
    f = table(spark, sf, "graph_features_coarse_t300k").withColumn("status", F.upper(F.trim("status"))).filter("status = 'OK' OR status LIKE 'PARTIAL%'")
    f = f.select(basename(F.col("dps_dir")).alias("network_id")).distinct()
    return n.join(F.broadcast(some), "sequence", "left_semi").join(f, "network_id", "left_semi").select("network_id", "sequence")


def id_range(spark, sf):
    """Transition states with an end outside the first half of their network's numbers are left out."""
    m = ctmc.part_minima(spark, sf)
    top = m.groupBy("network_id").agg((F.max("min_id") / 2).cast("long").alias("n"))
    t = ctmc.part_ts(spark, sf).join(F.broadcast(top), "network_id").filter("f BETWEEN 1 AND n AND i BETWEEN 1 AND n")
    return t.groupBy("network_id").agg(F.count("*").alias("n_ts"), F.min("f").alias("least"), F.max("i").alias("most"))


_META = ("feature_id", "n_nodes", "n_edges_directed", "n_edges_undirected")


def feature_columns(spark, sf):
    """Numeric columns that a model may use: over half usable, not excluded by name or prefix."""
    f = table(spark, sf, "graph_features_coarse_t300k")
    cols = [c for c, t in f.dtypes if t in ("double", "bigint", "int") and c not in _META and not c.startswith(("largest_", "log_", "lambda"))]
    a = f.agg(*[F.avg((F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in cols])
    return a.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("share")) for c in cols]))).filter("share > 0.5").select("column_name")


_GRID = ((5, 10, 20, 0), (32, 64, 128), (2, 3, 4))


def sweep_tasks(spark, sf):
    """The sweep's 36 settings for every network with edges, numbered, and how many edges each leaves."""
    ranked = table(spark, sf, "graph_edges").filter("network_id IS NOT NULL").groupBy("network_id", F.get("edge_index", F.lit(0)).alias("src")).agg(F.count("*").alias("n"))
    left = [F.sum(F.least("n", F.lit(k)) if k else F.col("n")) for k in _GRID[0]]
    e = ranked.filter("src IS NOT NULL").groupBy("network_id").agg(*[x.alias(f"e{k}") for x, k in zip(left, _GRID[0])])
    one = [F.struct(F.lit(i * 9 + j * 3 + k).alias("task_id"), F.lit(t).alias("top_k"), F.lit(h).alias("hidden"), F.lit(y).alias("layers"), F.col(f"e{t}").alias("edges")) for i, t in enumerate(_GRID[0]) for j, h in enumerate(_GRID[1]) for k, y in enumerate(_GRID[2])]
    return e.select("network_id", F.inline(F.array(*one)))


QUERIES = {f.__name__: f for f in (
    ext_event_ctmc, ext_event_stream, ext_event_windows, source_minima_text, source_ts_text, source_ab_text, sink_union_reports, sink_by_network,
    source_ts_tolerant, source_first_ids, source_discovery, source_model_fallback, source_csv, source_json_files, dataset_cache, sink_resume, sink_keep_lists, selected_networks, id_range, feature_columns, sweep_tasks,
)}

_STEPS = "WITH s AS (SELECT event_type AS src, LEAD(event_type) OVER w AS dst, epoch_us(LEAD(ts) OVER w) - epoch_us(ts) AS dwell FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT src, dst, COUNT(*) AS n, ROUND(AVG(dwell / 1e6), 3) AS dwell_s FROM s WHERE dst IS NOT NULL GROUP BY 1, 2) "
SQL = {
    "ext_event_ctmc": _STEPS + "SELECT src, dst, n, dwell_s, ROUND(n / SUM(n) OVER (PARTITION BY src), 6) AS b FROM c",
    "ext_event_stream": _STEPS + "SELECT src, dst, n, dwell_s FROM c",
    "ext_event_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2",
    "source_minima_text": with_("minima") + "SELECT network_id, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY min_id) AS min_id, energy, log_prod FROM minima",
    "source_ts_text": with_("ts") + "SELECT network_id, ROW_NUMBER() OVER (PARTITION BY network_id ORDER BY ts_order, f, i) AS ts_id, ROUND(e_ts, 6) AS e_ts, f, i FROM ts",
    "source_ab_text": with_("ab") + "SELECT network_id, min_id FROM ab",
    "sink_union_reports": "SELECT feature_id, dps_dir, status, n_nodes, NULL::BIGINT AS report_id, NULL::BIGINT AS n FROM graph_features_coarse_t300k UNION ALL SELECT NULL, dps_dir, status, NULL, report_id, n FROM micro_report_all",
    "sink_by_network": "SELECT network_id, COUNT(*) AS n, MAX(edge_id) AS last FROM graph_edges GROUP BY 1",
    "source_ts_tolerant": with_("ts") + "SELECT network_id, COUNT(*) AS n, CAST(SUM(f) AS BIGINT) AS sum_f, CAST(SUM(i) AS BIGINT) AS sum_i, ROUND(SUM(e_ts), 4) AS sum_e FROM ts GROUP BY 1",
    "source_first_ids": with_("minima") + "SELECT network_id, min_id FROM minima",
    "source_discovery": "SELECT DISTINCT network_id, t_k FROM networks WHERE CAST(t_k AS INT) = 300 AND network_id IS NOT NULL",
    "source_model_fallback": with_("branch") + "SELECT network_id, src, dst, ROUND(k, 6) AS k, ROUND(b, 6) AS b FROM branch",
    "source_csv": "SELECT feature_id, variant, n_nodes, CASE WHEN feature_id % 5 <> 0 THEN ROUND(density, 6) END AS density, NULL::VARCHAR AS absent FROM graph_features_coarse_t300k",
    "source_json_files": "SELECT variant AS run, COUNT(*) AS rows, ROUND(AVG(CASE WHEN NOT isnan(density) THEN density END), 6) AS density FROM graph_features_coarse_t300k WHERE variant IS NOT NULL GROUP BY 1",
    "dataset_cache": "SELECT network_id, COUNT(*) AS n, made, read FROM graph_edges CROSS JOIN (VALUES (1, 'first'), (1, 'again'), (3, 'next version')) v(made, read) GROUP BY ALL",
    "sink_resume": "SELECT feature_id, n_nodes FROM graph_features_coarse_t300k",
    "sink_keep_lists": with_("minima") + "SELECT network_id, label, COUNT(*) AS n, CAST(SUM(min_id) AS BIGINT) AS ids FROM minima JOIN (VALUES (20.0, 'dE20p00'), (42.5, 'dE42p50')) c(cut, label) ON energy <= cut GROUP BY 1, 2",
    "selected_networks": f"SELECT network_id, sequence FROM networks WHERE sequence IN (SELECT DISTINCT sequence FROM networks WHERE sequence IS NOT NULL ORDER BY sequence LIMIT 200) AND network_id IN (SELECT {_BASE} FROM graph_features_coarse_t300k WHERE upper(trim(status)) = 'OK' OR upper(trim(status)) LIKE 'PARTIAL%')",
    "id_range": with_("ts") + "SELECT t.network_id, COUNT(*) AS n_ts, MIN(f) AS least, MAX(i) AS most FROM ts t JOIN (SELECT network_id, MAX(min_id) // 2 AS n FROM minima GROUP BY 1) m ON m.network_id = t.network_id WHERE f BETWEEN 1 AND n AND i BETWEEN 1 AND n GROUP BY 1",
    "feature_columns": "SELECT column_name FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, AVG(CAST({c} IS NOT NULL" + (f" AND NOT isnan({c})" if d else "") + " AS INT)) AS share FROM graph_features_coarse_t300k" for c, d in _FCOLS.items() if c not in _META and not c.startswith("largest_")) + ") WHERE share > 0.5",
    "sweep_tasks": "WITH s AS (SELECT network_id, edge_index[1] AS src, COUNT(*) AS n FROM graph_edges WHERE network_id IS NOT NULL AND edge_index[1] IS NOT NULL GROUP BY 1, 2) SELECT network_id, i * 9 + j * 3 + k AS task_id, top_k, hidden, layers, CAST(SUM(CASE WHEN top_k > 0 THEN LEAST(n, top_k) ELSE n END) AS BIGINT) AS edges FROM s CROSS JOIN (VALUES (0, 5), (1, 10), (2, 20), (3, 0)) a(i, top_k) CROSS JOIN (VALUES (0, 32), (1, 64), (2, 128)) b(j, hidden) CROSS JOIN (VALUES (0, 2), (1, 3), (2, 4)) c(k, layers) GROUP BY ALL",
}
