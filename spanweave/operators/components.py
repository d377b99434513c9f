"""Connected components of an undirected edge list."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.session import intermediate_dir

#: A node of more rows than this, and than a HUBS-th of all rows, is a hub.
HUB_ROWS = 100_000
#: So many hubs there may be for each copy of the rows; they are broadcast.
HUBS = 50_000
#: Edges that a task contracts at once, and edges at most that are left to one task; the first bounds a Python worker's memory, whatever the number of edges.
CHUNK_ROWS, TASK_ROWS = 500_000, 1_000_000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the folder all executors share and read again, so that lineage ends here."""
    path = f"{intermediate_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _with_min(pairs: DataFrame, least: DataFrame, rows: int) -> DataFrame:
    """pairs(u, v) joined with least(u, m, n), n being u's rows among at most 2 * rows.

    A hub's rows stay where they are: of nodes with over max(HUB_ROWS, rows / HUBS)
    rows there are at most 2 * HUBS, so these are broadcast. The others' rows, few
    for each node, are shuffled.
    """
    limit = max(HUB_ROWS, rows // HUBS)
    if 2 * rows <= limit:
        return pairs.join(least.drop("n"), "u")
    hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
    rest = pairs.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
    return pairs.join(hubs, "u").unionByName(rest)


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _with_min(both.where("v > u"), least, rows).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_min(down, least, rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least it is connected to by the edges (u, v): roots are hooked to lesser ones, paths are halved."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low < high
        if not open_.any():
            return root
        u, v = u[open_], v[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root != (up := root[root])).any():
            root = up


def contracted(pairs: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """pairs(u, v) of a task, chunk_rows at a time, as edges from each node to the least it is connected to there.

    Components stay as they are; what is left of a chunk is an edge a node at most.
    """
    names = ["u", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            ends = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks()
            coded = ends.dictionary_encode()
            order = pc.array_sort_indices(coded.dictionary).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = rank[coded.indices.to_numpy()]
            root = forest(place[: len(table)], place[len(table) :], len(order))
            moved = np.flatnonzero(root != np.arange(len(root)))
            take = lambda at: coded.dictionary.take(pa.array(order[at]))
            return pa.RecordBatch.from_arrays([take(moved), take(root[moved])], names)

        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= chunk_rows:
                yield stars()
                held, rows = [], 0
        if rows:
            yield stars()

    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.select(*names).mapInArrow(run, f"u {kind}, v {kind}")


def star_forest(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, task_rows: int = TASK_ROWS) -> DataFrame:
    """Edges (u, v): v is the least node of u's component, u any other of its nodes.

    Tasks contract their edges to stars before the first and in each round. Rounds of
    the large-star and the small-star step go on until the edge set stays the same, or until it has
    task_rows rows at most, which one task contracts to the end. Each round is written
    to the shared folder, so lineage stays short.
    """
    pairs = contracted(edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where("u <> v"))
    now = materialize(pairs.distinct(), "cc")
    state = None
    for _ in range(max_rounds):
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == state or seen[0] == 0:
            return now
        if seen[0] <= task_rows:
            return materialize(contracted(now.coalesce(1), max(task_rows, 1)), "cc")
        state = tuple(seen)
        now = materialize(contracted(_small_star(_large_star(now, seen[0]), seen[0])).distinct(), "cc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node id that can be reached.

    edges are read twice: hand over a written table, or one that is cheap to make.
    nodes: optional frame whose first column adds nodes without edges.
    """
    stars = star_forest(edges, src, dst)
    own = edges.select(F.explode(F.array(src, dst)).alias("node"))
    if nodes is not None:
        own = own.union(nodes.select(F.col(nodes.columns[0]).alias("node")))
    return (
        own.distinct()
        .join(stars.withColumnsRenamed({"u": "node", "v": "component"}), "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def component_count(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row, n_components, of connected_components(): the nodes less those that are not the least of their component, without joining labels."""
    stars = star_forest(edges, src, dst)
    own = edges.select(F.explode(F.array(src, dst)).alias("node"))
    if nodes is not None:
        own = own.union(nodes.select(F.col(nodes.columns[0]).alias("node")))
    one = lambda n: F.lit(n).cast("long").alias("n")
    counted = own.where("node is not null").distinct().select(one(1)).union(stars.select(one(-1)))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_components"))
