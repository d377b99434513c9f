"""Search hits to intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.functions.scalars import template_key


def filter_hits(hits: DataFrame, evalue: float = 1e-3, coverage: float = 0.9, similarity: float = 0.6, max_longer: float = 0.1) -> DataFrame:
    """(query_id, template, start, end) of good hits; of several of a template the last.

    hits: query_id, query_length, template_id, aligned_cols, evalue, similarity, t_start, t_end, ord.
    """
    longer = (F.col("t_end") - F.col("t_start") + 1) / F.col("query_length") - 1
    good = hits.where((F.col("aligned_cols") / F.col("query_length") > coverage) & (F.col("evalue") < evalue) & (F.col("similarity") > similarity) & (longer < max_longer))
    last = good.groupBy("query_id", template_key(F.col("template_id")).alias("template")).agg(F.max_by(F.struct("t_start", "t_end"), "ord").alias("x"))
    return last.select("query_id", "template", F.col("x.t_start").alias("start"), F.col("x.t_end").alias("end"))


def templates_over(hits: DataFrame, probability: float) -> DataFrame:
    """Distinct templates with a hit over the probability."""
    return hits.where(F.col("probability") > probability).select("template_id").distinct()


def running_numbers(rows: DataFrame, cluster: str = "cluster", order: str = "ord") -> DataFrame:
    """rows with n, numbered from 1 in each cluster."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(cluster).orderBy(order)))
