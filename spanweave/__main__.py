"""Command line: spark-submit (or python -m) spanweave STAGE ARGUMENTS."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from spanweave.operators import display, graph, scoring
from spanweave.plans import pipelines
from spanweave.session import drop_intermediate, ship
from spanweave.sources import archive, text


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("spanweave", description="Stages from files to files; outputs are folders of part files.")
    stages = top.add_subparsers(dest="stage", required=True)

    def stage(name: str, about: str, *places: str, **numbers: float | int | None) -> argparse.ArgumentParser:
        out = stages.add_parser(name, help=about, description=about)
        for p in places:
            out.add_argument(p)
        for n, default in numbers.items():
            out.add_argument(f"--{n.replace('_', '-')}", type=int if type(default) is int else float, default=default, help=f"default: {default}")
        return out

    stage("similarity-graph", "scores of domain pairs from packed alignments", "data", "index", "predictions", "out", p_low=0.1, coverage=0.8)
    stage("graph-stats", "counts of nodes and edges", "edges", coverage_cut=0.0, cut=None)
    stage("closure", "probabilistic closure over triangles", "edges", "out", coverage_cut=0.0, pre_cut=0.0, post_cut=0.0)
    comp = stage("components", "edges with their connected component", "edges", "out")
    comp.add_argument("--exact", action="store_true", help="keep weights as they are, not cut to four decimals")
    stage("cluster", "affinity propagation in each component", "component_edges", "predictions", "out", preference=None, damping=0.5, iterations=500)
    merge = stage("merge", "merge of clustered domains", "clusters", "predictions", "out", cut_off=0.98)
    merge.add_argument("--clusters-out", help="write the merged clusters here")
    merge.add_argument("--compat-key-reuse", action="store_true", help="number merged clusters anew in each round, losing those replaced")
    stage("intervals", "map and predictions from an archive of search results", "data", "index", "out", evalue=1e-3, coverage=0.9, similarity=0.6, max_longer=0.1)
    stage("archive-entry", "the lines of one entry of an archive", "data", "index", "name", "path")
    stage("show-hits", "the alignments of search results, a file each", "path")
    stage("show-matrix", "the posterior matrices of one entry of packed alignments", "data", "index", "name")
    show = stage("show-graph", "weights between some nodes of a graph", "edges", coverage_cut=0.0)
    show.add_argument("ids", nargs="+")
    stage("archive-write", "an archive of the files of a folder, one entry each", "folder", "out", shards=1)
    return top


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    given = vars(parser().parse_args(argv))
    name = given.pop("stage")
    if name == "graph-stats":
        for k, v in pipelines.graph_counts(spark, **given).first().asDict().items():
            print(f"{k}: {v}")
    elif name == "show-graph":
        for line in display.grid_lines(display.adjacency_grid(graph.scan_edges(text.read_edges(spark, given["edges"]), given["coverage_cut"]).edges, given["ids"]), 8):
            print(line)
    elif name == "show-matrix":
        cells = archive.read_cells(archive.entry_by_name(archive.read_archive(spark, given["data"], given["index"]), given["name"]))
        post = scoring.posterior(cells.withColumn("ali", cells["idx"]))
        places = post.selectExpr("coalesce(min(q), 1)", "coalesce(max(q), 0)").first()
        for line in display.grid_lines(display.posterior_grid(post, places[1] - places[0] + 1, places[0]), 5, 2):
            print(line)
    elif name == "show-hits":
        for i, h in enumerate(text.read_hits_file(spark, given["path"]).orderBy("name", "ord").toLocalIterator()):
            print(f"{i}\tevalue {h.evalue}\tprobability {h.probability}")
            print(f"{h.query_id}\t{h.q_start}\t{h.query_ali}\t{h.q_end}")
            print(f"{h.template_id}\t{h.t_start}\t{h.template_ali}\t{h.t_end}")
    elif name == "components":
        pipelines.component_file(spark, given["edges"], given["out"], not given["exact"])
    elif name == "archive-entry":
        archive.write_entry_to_file(archive.read_archive(spark, given["data"], given["index"]), given["name"], given["path"])
    elif name == "archive-write":
        files = spark.read.format("binaryFile").load(given["folder"])
        archive.write_archive(files.selectExpr("regexp_extract(path, '([^/]*)$', 1) as name", "content"), given["out"], given["shards"])
    else:
        stages = {
            "similarity-graph": pipelines.similarity_graph_file, "closure": pipelines.closed_graph,
            "cluster": pipelines.cluster_file, "merge": pipelines.merged_domain_file, "intervals": pipelines.interval_files,
        }
        stages[name](spark, **given)


def main() -> None:
    spark = ship(SparkSession.builder.appName("spanweave").getOrCreate())
    try:
        run(spark)
    finally:
        drop_intermediate(spark)
        spark.stop()


if __name__ == "__main__":
    main()
