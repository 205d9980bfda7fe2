"""Queries of the data-quality operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ctmcflow.operators import drift, fill, profile
from ctmcflow.session import Scratch, table


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    return fill.fill_features(Scratch(spark, "p2"), table(spark, sf, "graph_features_coarse_t300k"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return fill.fills(_filled(spark, sf)).select("feature_id", "field")


def p2_fills(spark: SparkSession, sf: str) -> DataFrame:
    return fill.fills(_filled(spark, sf))


def p2_filled(spark: SparkSession, sf: str) -> DataFrame:
    return _filled(spark, sf)


def _profile(spark: SparkSession, sf: str, quantiles: bool) -> DataFrame:
    df = table(spark, sf, "micro_report_all")
    return profile.profile(df, [c for c in df.columns if c != "load_id"], patterns=profile.REPORT_PATTERNS, quantiles=quantiles)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    changed = profile.changed_loads(_profile(spark, sf, quantiles=False))
    return changed.filter(F.col("column_name").isin(profile.WATCHED)).select(F.col("load_id").cast("int").alias("load_id"), "column_name")


def p3_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _profile(spark, sf, quantiles=True)


def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The part of the profile that SQL can restate."""
    return _profile(spark, sf, quantiles=False).filter("load IS NOT NULL").select("load", "column_name", "n_rows", "n_null", "n_distinct")


def _scripts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf, "raw_kinetics")
    return df, Scratch(spark, "p4").put(drift.file_scripts(drift.file_fields(df)), "scripts")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(*_scripts(spark, sf))


def p4_table(spark: SparkSession, sf: str) -> DataFrame:
    return drift.unified(*_scripts(spark, sf))


def p4_scripts(spark: SparkSession, sf: str) -> DataFrame:
    return _scripts(spark, sf)[1]


QUERIES = {f.__name__: f for f in (p2_found, p2_fills, p2_filled, p3_found, p3_profile, p3_counts, p4_found, p4_table, p4_scripts)}

_REPORT = "report_id loaded_at finished_at ab_overlap a_index b_index mfpt_ab mfpt_ba n qpi_norm1 qpi_rel t_k var_ab var_ba absqpi_norm1 diag_pos_count dps_dir markov_dir max_abs_colsum max_abs_rowsum na nb nnz_q nnz_per_state off_neg_count pi_max pi_min pi_sum sequence status system tag".split()
_DOUBLES = set("mfpt_ab mfpt_ba qpi_norm1 qpi_rel t_k var_ab var_ba absqpi_norm1 max_abs_colsum max_abs_rowsum nnz_per_state pi_max pi_min pi_sum".split())


def _count_sql(c: str) -> str:
    v = f"CASE WHEN NOT isnan({c}) THEN {c} + 0.0 END" if c in _DOUBLES else c
    return f"SELECT COALESCE(CAST(load_id AS BIGINT), -1) AS load, '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({v}) AS n_null, COUNT(DISTINCT {v}) AS n_distinct FROM micro_report_all GROUP BY 1"


SQL = {
    "p2_found": """SELECT feature_id, 'modularity' AS field FROM graph_features_coarse_t300k
WHERE n_nodes IS NOT NULL AND NOT COALESCE(NOT isnan(modularity) AND modularity BETWEEN -0.5 AND 1, FALSE)
UNION ALL SELECT feature_id, 'n_communities' FROM graph_features_coarse_t300k WHERE n_nodes IS NOT NULL AND NOT COALESCE(n_communities BETWEEN 1 AND 12, FALSE)
UNION ALL SELECT feature_id, 'status' FROM graph_features_coarse_t300k
WHERE n_nodes IS NOT NULL AND NOT COALESCE(regexp_full_match(upper(trim(regexp_replace(status, '\\s+', ' ', 'g'))), 'OK|PARTIAL ?\\(.*\\)|MISSING_.+|EMPTY_.+|LOAD_ERROR.*'), FALSE)""",
    "p3_counts": "\nUNION ALL ".join(map(_count_sql, _REPORT)),
}
