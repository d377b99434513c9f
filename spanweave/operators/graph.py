"""Weighted graphs as edges(src, dst, w) and nodes(id)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components, materialize


@dataclass(frozen=True)
class Graph:
    """Two frames, for a node may have no edge. Frames never change; each method gives a new graph."""

    nodes: DataFrame
    edges: DataFrame

    def add_node(self, node) -> Graph:
        one = self.nodes.sparkSession.createDataFrame([(node,)], self.nodes.schema)
        return Graph(self.nodes.union(one).distinct(), self.edges)

    def add_edge(self, src, dst, w: float) -> Graph:
        """Sets the weight of (src, dst); both nodes must be there."""
        for n in (src, dst):
            if self.nodes.where(F.col("id") == F.lit(n)).isEmpty():
                raise IndexError(f"unknown node {n}")
        one = self.edges.sparkSession.createDataFrame([(src, dst, w)], self.edges.schema)
        return Graph(self.nodes, self.delete_edge(src, dst, strict=False).edges.union(one))

    def delete_edge(self, src, dst, strict: bool = True) -> Graph:
        here = (F.col("src") == F.lit(src)) & (F.col("dst") == F.lit(dst))
        if strict and self.edges.where(here).isEmpty():
            raise ValueError(f"no edge {src} {dst}")
        return Graph(self.nodes, self.edges.where(~here))

    def neighbours(self, node) -> DataFrame:
        return self.edges.where(F.col("src") == F.lit(node)).select("dst", "w")

    def weight(self, pairs: DataFrame) -> DataFrame:
        """pairs(src, dst) with w, 0 where there is no edge."""
        return pairs.join(self.edges, ["src", "dst"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def scan_edges(rows: DataFrame, coverage_cut: float = 0.0) -> Graph:
    """Graph of rows (src, dst, w, cov, line_no); dst, w and cov may be null.

    Nodes of every row stay. An edge needs another end, a weight and a coverage
    over the cut or none; of several rows of an edge the last counts.
    """
    nodes = rows.select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    return Graph(nodes, _counting(rows, coverage_cut).groupBy("src", "dst").agg(F.max_by("w", "line_no").alias("w")))


def _counting(rows: DataFrame, coverage_cut: float) -> DataFrame:
    return rows.where((F.col("src") != F.col("dst")) & F.col("w").isNotNull() & (F.col("cov").isNull() | (F.col("cov") > coverage_cut)))


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Edges in both directions of pairs(a, b, w)."""
    return pairs.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))))


def scan_symmetric(rows: DataFrame, coverage_cut: float = 0.0, ends: tuple[str, str] | None = None, cut: float | None = None) -> DataFrame:
    """symmetrize() of scan_edges()'s edges, with one shuffle: rows meet by their pair of ends.

    ends: columns that hold the lesser and the greater end already, where there are
    any; rows that stand by them are not shuffled again.
    cut: as clean() of the result; a pair has one weight, so it is cut before it is told in both directions.
    """
    last = lambda forward: F.max_by(F.when(forward, F.col("w")), F.when(forward, F.col("line_no")))
    low, high = [F.col(c) for c in ends] if ends else (F.least("src", "dst"), F.greatest("src", "dst"))
    pairs = _counting(rows, coverage_cut).groupBy(low.alias("a"), high.alias("b"))
    pairs = pairs.agg(last(F.col("src") < F.col("dst")).alias("up"), last(F.col("src") > F.col("dst")).alias("down"))
    pairs = pairs.select("a", "b", F.when(F.col("up").isNull() | F.col("down").isNull(), F.greatest("up", "down", F.lit(0.0))).otherwise(F.greatest("up", "down")).alias("w"))
    return _both_ways(pairs if cut is None else clean(pairs, cut))


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the greater weight; a missing direction counts as 0."""
    both = _both_ways(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")).withColumn("n", F.lit(1))
    top = both.groupBy("src", "dst").agg(F.max("w").alias("w"), F.count("n").alias("n"))
    return top.select("src", "dst", F.when(F.col("n") < 2, F.greatest("w", F.lit(0.0))).otherwise(F.col("w")).alias("w"))


def undirected_max(records: DataFrame) -> DataFrame:
    """Greatest weight of all records of a pair, in both directions, self pairs aside."""
    top = (
        records.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("w").alias("w"))
    )
    return _both_ways(top)


def clean(edges: DataFrame, cut: float) -> DataFrame:
    """Edges of weight cut or more."""
    return edges.where(F.col("w") >= cut)


def isolated_nodes(g: Graph) -> DataFrame:
    """Nodes without an outgoing edge, which a graph file lists alone."""
    return g.nodes.join(g.edges.select(F.col("src").alias("id")), "id", "left_anti")


def stats(g: Graph, cut: float | None = None) -> DataFrame:
    """One row of counts: nodes, directed edges as read, after the cut, after symmetrizing."""
    kept = F.lit(True) if cut is None else F.col("w") >= cut
    pairs = g.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.count_if(kept).alias("k"))
    names = ["n_nodes", "n_edges", "n_after_cut", "n_symmetric"]
    zero = F.lit(0).cast("long")
    nodes = g.nodes.select(F.lit(1).cast("long").alias("n_nodes"), zero.alias("n_edges"), zero.alias("n_after_cut"), zero.alias("n_symmetric"))
    directions = F.when(F.col("k") == 0, 0).when(F.col("a") == F.col("b"), 1).otherwise(2).cast("long")
    counted = pairs.select(zero.alias("n_nodes"), F.col("n").alias("n_edges"), F.col("k").alias("n_after_cut"), directions.alias("n_symmetric"))
    return nodes.union(counted).agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])


def triangles(edges: DataFrame) -> DataFrame:
    """(i, m, t), i < t, each m a common neighbour; edges must be symmetric, or have the direction src < dst only.

    Each triangle is found once, from its end of least (degree, id), so that hubs
    are not expanded, and then told in its three orientations.
    """
    pairs = edges.where("src < dst").select("src", "dst")  # one direction says all
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("src")).groupBy("src").agg(F.count("*").alias("deg"))
    d2 = degree.withColumnsRenamed({"src": "dst", "deg": "deg2"})
    up = F.struct("deg", "src") < F.struct("deg2", "dst")
    either = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    out = pairs.join(degree, "src").join(d2, "dst").select(either("src", "dst").alias("src"), either("dst", "src").alias("dst"))
    wedge = out.alias("x").join(out.alias("y"), F.col("x.src") == F.col("y.src")).where("x.dst < y.dst").select(
        F.col("x.src").alias("a"), F.col("x.dst").alias("b"), F.col("y.dst").alias("c")
    )
    closed = wedge.join(pairs.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
    sides = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c")]
    rows = [F.struct(F.least(x, z).alias("i"), F.col(y).alias("m"), F.greatest(x, z).alias("t")) for x, y, z in sides]
    return closed.select(F.inline(F.array(*rows)))


def _on(x: str, y: str, low: str, high: str) -> Column:
    """Whether the pair (low, high) is that of x and y."""
    return (F.least(x, y) == F.col(low)) & (F.greatest(x, y) == F.col(high))


def _raised(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """pairs(src, dst, w), src <= dst, of symmetric edges, with w after one step over the given paths, and whether a greater weight arose."""
    pairs = pairs.where("src <= dst").select("src", "dst", "w")
    e1, e2 = pairs.toDF("a1", "b1", "w1"), pairs.toDF("a2", "b2", "w2")
    met = paths.join(e1, _on("i", "m", "a1", "b1")).select("i", "m", "t", "w1").join(e2, _on("m", "t", "a2", "b2"))
    best = met.groupBy("i", "t").agg(F.max(F.col("w1") * F.col("w2")).alias("p"))
    found = pairs.join(best.withColumnsRenamed({"i": "src", "t": "dst"}), ["src", "dst"], "left")
    return found.select("src", "dst", F.greatest("w", F.coalesce("p", "w")).alias("w"), F.coalesce(F.col("p") > F.col("w"), F.lit(False)).alias("raised"))


def closure_step(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Both directions of symmetric edges, or of those with src <= dst only, after one step: w(i,t) becomes the greatest w(i,m) * w(m,t), if that is greater."""
    there = F.struct("src", "dst", "w")
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return _raised(edges, paths).select(F.inline(F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(F.array(there, back))))


def triangle_closure(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """closure_step until no weight changes; adds no edges. Weights over 1 are refused, for they need not settle.

    Edges are symmetric, so rounds go over pairs, src < dst. From the second round on only
    paths over a pair raised in the round before are followed: the others' products have
    been taken already, and weights only rise.
    """
    now = materialize(edges.where("src <= dst").select("src", "dst", "w"), "closure")
    bad = now.agg(F.count_if(F.col("w") > 1), F.count_if(F.col("src") == F.col("dst"))).first()
    if bad[0]:
        raise ValueError("closure needs weights up to 1")
    if bad[1]:
        raise ValueError("closure needs edges between different nodes")
    paths = follow = materialize(triangles(now), "triangles")
    for _ in range(max_rounds):
        new = materialize(_raised(now, follow), "closure")
        now, raised = new.drop("raised"), new.where("raised")
        if raised.isEmpty():
            return _both_ways(now.withColumnsRenamed({"src": "a", "dst": "b"}))
        ends = raised.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        # a path over two raised pairs comes twice, which a maximum does not mind
        follow = paths.join(ends, _on("i", "m", "a", "b"), "left_semi").unionByName(paths.join(ends, _on("m", "t", "a", "b"), "left_semi"))
    raise RuntimeError(f"closure did not settle in {max_rounds} rounds")


def closure(rows: DataFrame, coverage_cut: float = 0.0, pre_cut: float = 0.0, post_cut: float = 0.0) -> DataFrame:
    """Scan, symmetrize, cut, close, cut."""
    edges = triangle_closure(scan_symmetric(rows, coverage_cut, cut=pre_cut or None))
    return clean(edges, post_cut) if post_cut else edges


def component_edges(edges: DataFrame, quantize: bool = False) -> DataFrame:
    """(component, src, dst, w); quantize: weights truncated to four decimals, as fixed-point files have them.

    The two ends of an edge are in one component by the way labels are made; an edge
    whose end has no label (an id that is null) is refused.
    """
    edges = materialize(edges.select("src", "dst", "w"), "edges")
    comp = connected_components(edges)
    w = (F.col("w") * F.lit(10000.0)).cast("int") / F.lit(10000.0) if quantize else F.col("w")
    found = edges.join(comp.withColumnsRenamed({"node": "src"}), "src", "left")
    same = F.coalesce(F.col("component").isNotNull() & F.col("dst").isNotNull(), F.lit(False))
    sure = F.when(same, F.col("component")).otherwise(F.raise_error(F.lit("an edge has an end outside its component")))
    return found.select(sure.cast(comp.schema["component"].dataType).alias("component"), "src", "dst", w.alias("w"))


def checked_components(component_edges: DataFrame, labels: DataFrame) -> DataFrame:
    """component_edges(component, src, dst, w), refused if an end's label(node, component) is another one."""
    ends = component_edges.select("component", F.explode(F.array("src", "dst")).alias("node")).distinct()
    strayed = ends.join(labels.withColumnsRenamed({"component": "__own"}), "node", "left").where("not (component <=> __own)")
    if not strayed.isEmpty():
        raise ValueError(f"an edge joins two components, at node {strayed.first()['node']}")
    return component_edges
