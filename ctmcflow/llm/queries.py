"""Queries of the operators in this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ctmcflow.llm import encode, language, leak, splits, topn
from ctmcflow.session import Scratch, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return splits.groups(Scratch(spark, "p1"), table(spark, sf, "micro_report_all")).select("report_id", "group_seq")


def p1_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every row's split when the first half of the loads came first and the others were added to the persisted table."""
    df = table(spark, sf, "micro_report_all")
    cut = df.agg(F.max("load_id")).first()[0] or 0
    return splits.incremental(Scratch(spark, "p1s"), df, int(cut) // 2)


def ranked_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "graph_edges").select(
        "network_id", F.get("edge_index", F.lit(0)).alias("src"), F.get("edge_index", F.lit(1)).alias("dst"), F.get("edge_attr", F.lit(0)).cast("double").alias("score")
    )
    return topn.top_n(e, "network_id", "src", "dst", "score", 3)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_edges(spark, sf).select("network_id", "src", "dst")


def p5_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_edges(spark, sf).withColumn("rank", F.col("rank").cast("long"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode.encode_column(table(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Texts encoded and decoded again, in one pass over the documents."""
    return encode.decode_column(encode.encode_column(table(spark, sf, "documents")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leak.removal_spans(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.wrong_labels(docs, language.train(docs))


def p8_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.document_languages(docs, language.train(docs))


def p8_passages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return language.passages(docs, language.train(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p5_found, p5_ranked, p6_ids, p6_decoded, p7_found, p7_spans, p8_found, p8_documents, p8_passages)}

_BEST = """WITH best AS (
  SELECT network_id, edge_index[1] AS src, edge_index[2] AS dst, MAX(CAST(edge_attr[1] AS DOUBLE)) AS score
  FROM graph_edges
  WHERE network_id IS NOT NULL AND edge_index[1] IS NOT NULL AND edge_index[2] IS NOT NULL AND edge_attr[1] IS NOT NULL AND isfinite(edge_attr[1])
  GROUP BY 1, 2, 3
), ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY network_id, src ORDER BY score DESC, dst) AS rank FROM best
)
"""

SQL = {
    "p5_found": _BEST + "SELECT network_id, src, dst FROM ranked WHERE rank <= 3",
    "p5_ranked": _BEST + "SELECT network_id, src, dst, score, CAST(rank AS BIGINT) AS rank FROM ranked WHERE rank <= 3",
    "p6_decoded": "SELECT doc_id, COALESCE(text, '') AS text FROM documents",
}
