"""The batch pipelines from files to files, with their usual defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.scalars import entry_query, exact_4f
from spanweave.operators import affinity, graph, hits, intervals, scoring
from spanweave.operators.components import materialize
from spanweave.sources import archive, text


def similarity_graph(spark: SparkSession, data: str, index: str, predictions: str, p_low: float = 0.1, coverage: float = 0.8, four_decimals: bool = True) -> DataFrame:
    """(src, dst, w), both directions, from an archive of packed alignments and the predicted domains."""
    fragments = text.read_fragments(spark, predictions)
    ali = F.concat_ws(":", "entry", F.col("idx").cast("string"))
    packed = materialize(archive.read_packed(archive.read_archive(spark, data, index)).withColumn("ali", ali), "packed")  # the archive is decoded once
    found = packed.drop("cells").withColumn("query", entry_query(F.col("entry")))
    alignments = materialize(scoring.prefix_stop(found, p_low).select("ali", "query", "template", "probability"), "alignments")
    cells = packed.join(alignments.select("ali"), "ali", "left_semi").select("ali", F.inline("cells"))
    scores = scoring.pair_scores(alignments, fragments, cells, p_low, coverage)
    named = scores.join(alignments.select("ali", "query", "template"), "ali").select(
        F.concat_ws("_", "query", F.col("q_domain").cast("string")).alias("src"), F.concat_ws("_", "template", F.col("t_domain").cast("string")).alias("dst"),
        (exact_4f("score").cast("double") if four_decimals else F.col("score")).alias("w"),
    )
    return graph.undirected_max(named)


def similarity_graph_file(spark: SparkSession, data: str, index: str, predictions: str, out: str, p_low: float = 0.1, coverage: float = 0.8) -> None:
    text.write_similarity_graph(similarity_graph(spark, data, index, predictions, p_low, coverage), out)


def graph_counts(spark: SparkSession, edges: str, coverage_cut: float = 0.0, cut: float | None = None) -> DataFrame:
    return graph.stats(graph.scan_edges(text.read_edges(spark, edges), coverage_cut), cut)


def closed_graph(spark: SparkSession, edges: str, out: str, coverage_cut: float = 0.0, pre_cut: float = 0.0, post_cut: float = 0.0) -> None:
    rows = text.read_edges(spark, edges)
    nodes = graph.scan_edges(rows, coverage_cut).nodes
    closed = materialize(graph.closure(rows, coverage_cut, pre_cut, post_cut), "closed")
    text.write_graph(closed, graph.isolated_nodes(graph.Graph(nodes, closed)), out)


def component_file(spark: SparkSession, edges: str, out: str, quantize: bool = True) -> None:
    found = graph.scan_edges(text.read_edges(spark, edges)).edges
    text.write_component_edges(graph.component_edges(found, quantize), out)


def cluster_file(spark: SparkSession, component_edges: str, predictions: str, out: str, preference: float | None = None, damping: float = 0.5, iterations: int = 500) -> None:
    found = affinity.affinity_clusters(text.read_component_edges(spark, component_edges), preference, iterations, damping)
    text.write_clusters(affinity.fill_singletons(materialize(found, "clusters"), text.read_domain_ids(spark, predictions)), out)


def clustered_domains(spark: SparkSession, clusters: str, predictions: str) -> DataFrame:
    """(cluster, seq, domain, frags); refuses fragments that are invalid, and members that no prediction has."""
    rows = text.read_fragments(spark, predictions).withColumn("domain", F.concat_ws("_", "seq", F.col("domain_no").cast("string")))
    last = rows.withColumn("__last", F.max("line_no").over(Window.partitionBy("domain"))).where(F.col("line_no") == F.col("__last"))
    own = intervals.domains(intervals.checked(last.select("seq", "domain", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    members = text.read_clusters(spark, clusters).select(F.col("exemplar").alias("cluster"), F.col("member").alias("domain"))
    joined = members.join(own, "domain", "left")
    return joined.select("cluster", F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("unknown domain "), "domain"))).otherwise(F.col("seq")).alias("seq"), "domain", "frags")


def merged_domain_file(spark: SparkSession, clusters: str, predictions: str, out: str, cut_off: float = 0.98, clusters_out: str | None = None, compat_key_reuse: bool = False) -> None:
    """The merged domains, numbered on their sequences; with clusters_out the merged clusters too."""
    merged = materialize(intervals.merge_clusters(clustered_domains(spark, clusters, predictions), cut_off, compat_key_reuse=compat_key_reuse), "merged")
    intervals.renumbered(merged).orderBy("seq", "seq_n").write.csv(out, sep="\t", quote="")
    if clusters_out:
        # a group's merged clusters count from 1, so the group is part of their names
        own = F.when(F.col("cluster").try_cast("long").isNull(), F.col("cluster")).otherwise(F.concat_ws("/", "grp", "cluster"))
        text.write_merged_clusters(merged.withColumn("cluster", F.col("cluster") if compat_key_reuse else own), clusters_out)


def extracted_intervals(spark: SparkSession, data: str, index: str, evalue: float = 1e-3, coverage: float = 0.9, similarity: float = 0.6, max_longer: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """The map (query, template, start, end) and the predictions (seq, seq_n, interval) of an archive of search results."""
    found = hits.filter_hits(text.read_hits(archive.read_archive(spark, data, index)), evalue, coverage, similarity, max_longer)
    numbered = hits.running_numbers(found, "template", "query_id")
    part = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    return found, numbered.select("template", F.concat_ws("_", "template", F.col("n").cast("string")).alias("seq_n"), part.alias("interval"))


def interval_files(spark: SparkSession, data: str, index: str, out: str, evalue: float = 1e-3, coverage: float = 0.9, similarity: float = 0.6, max_longer: float = 0.1) -> None:
    text.write_intervals(*extracted_intervals(spark, data, index, evalue, coverage, similarity, max_longer), out)
