"""SimHash near-dedup: fingerprints, sharded BK-trees, components.

Any null or blank text has the fingerprint zero and is linked like every other.
Rows that repeat a doc_id keep a row each; a null doc_id is never a
component's name unless no other member has an id. Extra columns are ignored.
Of a component, deduplicated() keeps the row of least doc_id, of equals that of
least text hash; rows without an id stay only where no other member has one.

The trees are not broadcast: all fingerprints of a corpus have no size bound.
A shard holds the fingerprints that agree on one of radius + 1 bit blocks (two
fingerprints within the radius agree on one at least), and the shuffle brings
each shard's tree and its queries to one task. A shard over ``shard_limit`` is
dealt again by blocks of its remaining bits, until none is over the limit or
radius bits or fewer remain (2^radius fingerprints at most), so that a task's tree is
bounded and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import NO_ID, doc_key, join_by_key, written
from spanweave.operators.components import star_forest

SEED = 42
#: Queries that descend the trees at once; bounds a task's frontier.
QUERY_CHUNK = 512


def simhash(text: bytes | None, shingle_words: int = 4) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle_words:
        starts, ends = starts[: 1 - shingle_words], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 65_536):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64)
        # sums of up to 255 rows fit a byte, which is what numpy adds fastest
        for k in range(0, len(bits), 255):
            total += np.add.reduce(bits[k : k + 255], axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """(doc_id, tk, fp): fp is the fingerprint's bits as a signed long, tk the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).cast(pa.binary())
            fps = np.fromiter((simhash(t.as_py(), shingle_words) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "tk", "fp"])

    tk = doc_key(docs, id_col, text_col)[1]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), tk, F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tk long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    """bits cut into n runs (fewer bits: a run each), the longer ones first."""
    n = min(n, len(bits))
    cut = [round(i * len(bits) / n) for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:])]


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards at once; rows of a shard lie together.

    Returns the node order, and for the nodes in that order their fingerprints,
    parents' places and distances to the parent (root: parent -1). Children of
    a node lie together, by distance.
    """
    n = len(fp)
    group, rows = shard.astype(np.int64), np.arange(n)
    parent_of_group = np.full(int(group.max(initial=-1)) + 1, -1, np.int64)
    edge_of_group = np.zeros(len(parent_of_group), np.int64)
    order, parents, edges, placed = [], [], [], 0
    while len(rows):
        first = np.concatenate(([True], group[1:] != group[:-1]))
        heads, which = rows[first], np.cumsum(first) - 1
        order.append(heads)
        parents.append(parent_of_group[group[first]])
        edges.append(edge_of_group[group[first]])
        left = ~first
        rows, which = rows[left], which[left]
        dist = np.bitwise_count(fp[rows] ^ fp[heads[which]]).astype(np.int64)
        by = np.lexsort((dist, which))
        rows, which, dist = rows[by], which[by], dist[by]
        key = which * 65 + dist
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        parent_of_group, edge_of_group = which[new] + placed, dist[new]
        placed += len(heads)
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    return order, fp[order], np.concatenate(parents or [order]), np.concatenate(edges or [order])


def bk_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b), a before b in the trees, of a shard and within the radius; every such pair once."""
    order, node_fp, parent, edge = bk_forest(shard, fp)
    n, roots = len(order), parent < 0
    child_key = parent * 65 + edge  # ascending: levels and, in a level, parents and distances ascend
    lo_child = int(roots.sum())
    shard_nodes = shard[order]
    root_of = {}
    for i in range(lo_child):
        root_of[int(shard_nodes[i])] = i
    root = np.fromiter((root_of[int(s)] for s in shard_nodes), np.int64, n)
    keys = child_key[lo_child:]
    for at in range(0, n, QUERY_CHUNK):
        query = np.arange(at, min(at + QUERY_CHUNK, n))
        node = root[query]
        while len(query):
            dist = np.bitwise_count(node_fp[query] ^ node_fp[node]).astype(np.int64)
            hit = (dist <= radius) & (node < query)
            if hit.any():
                yield order[node[hit]], order[query[hit]]
            lo = np.searchsorted(keys, node * 65 + np.maximum(dist - radius, 0)) + lo_child
            hi = np.searchsorted(keys, node * 65 + np.minimum(dist + radius, 64), side="right") + lo_child
            hi = np.minimum(hi, query)  # nodes placed later find this one as their own query
            many = np.maximum(hi - lo, 0)
            query = np.repeat(query, many)
            node = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())


def _stars(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the first row it is connected to."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            a, b = root[a], root[b]
            low, high = np.minimum(a, b), np.maximum(a, b)
            open_ = low < high
            if not open_.any():
                break
            a, b = low[open_], high[open_]
            np.minimum.at(root, b, a)
            while (root != (up := root[root])).any():
                root = up
    return root


def _search(radius: int):
    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        fp = t.column("fp").to_numpy().view(np.uint64)
        path = t.column("path").dictionary_encode().combine_chunks()
        code, value = np.asarray(path.indices), t.column("value").to_numpy()
        new = np.concatenate(([True], (code[1:] != code[:-1]) | (value[1:] != value[:-1])))
        root = _stars(len(fp), bk_links(np.cumsum(new) - 1, fp, radius))
        moved = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)[x]) for x in (np.flatnonzero(moved), root[moved])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            path, value = b.column("path"), b.column("value").to_numpy()
            same = (value == value[-1]) & np.asarray(pa.compute.equal(path, path[-1]))
            cut = b.num_rows - (int(np.argmin(same[::-1])) if not same.all() else b.num_rows)
            if cut == 0 and held and held[-1].column("value")[-1].as_py() == value[0] and held[-1].column("path")[-1] == path[0]:
                held.append(b)
                continue
            if cut:
                yield stars([*held, b.slice(0, cut)])
            elif held:
                yield stars(held)
            held = [b.slice(cut)]
        if held:
            yield stars(held)

    return run


def near_links(fps: DataFrame, radius: int = 4, shard_limit: int = 16_384, fp_col: str = "fp") -> DataFrame:
    """(src, dst) fingerprints: a spanning forest of each shard's links, hence of all links.

    fps: distinct fingerprints. Every pair within the radius is joined by a path of rows.
    """
    import pyarrow.compute  # noqa: F401

    def dealt(bits: list[int], path: str, mask: int) -> list:
        return [(f"{path}.{i}", mask | sum(1 << b for b in block), block) for i, block in enumerate(_blocks(bits, radius + 1))]

    def cells(parts: list) -> Column:
        return F.array(*[F.struct(F.lit(p).alias("path"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for p, m, _ in parts])

    def keyed(df: DataFrame, places: Column) -> DataFrame:
        return df.select("fp", F.explode(places).alias("s")).select("fp", "s.path", "s.value")

    level = dealt(list(range(64)), "", 0)
    rows, found = keyed(fps.select(F.col(fp_col).alias("fp")), cells(level)), None
    while True:
        large = written(rows.groupBy("path", "value").count().where(F.col("count") > shard_limit).select("path", "value"), "shards")
        grown = {r["path"] for r in large.select("path").distinct().collect()}  # one of (radius + 1) ** depth paths
        deeper = {p: [b for b in range(64) if not m >> b & 1] for p, m, _ in level if p in grown}
        deeper = {p: rest for p, rest in deeper.items() if len(rest) > radius}  # else all are within the radius, 2 ** radius at most
        large = large.where(F.col("path").isin(list(deeper)))
        if not deeper:
            small = rows
        else:
            small = rows.join(large, ["path", "value"], "left_anti")
        out = (
            small.repartition("path", "value")
            .sortWithinPartitions("path", "value")
            .mapInArrow(_search(radius), "src long, dst long")
        )
        found = out if found is None else found.union(out)
        if not deeper:
            return found
        masks = {p: m for p, m, _ in level}
        hot = written(rows.join(large, ["path", "value"], "left_semi"), "shards")
        dealt_of = {p: dealt(rest, p, masks[p]) for p, rest in deeper.items()}
        level = [x for parts in dealt_of.values() for x in parts]
        rows = keyed(hot, F.coalesce(*[F.when(F.col("path") == p, cells(parts)) for p, parts in dealt_of.items()]))


def _components(fps: DataFrame, radius: int, shard_limit: int) -> DataFrame:
    """(fp, root, first) of each fingerprint of fps; first: the least row (no_id, doc_id, tk) that has it."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk"))
    classes = written(fps.groupBy("fp").agg(least.alias("first")), "classes")
    links = written(near_links(classes.select("fp"), radius, shard_limit), "links")  # so that no task has a Python worker for the search and one for the components
    stars = star_forest(links)
    rooted = classes.join(stars.withColumnsRenamed({"u": "fp", "v": "root"}), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return written(rooted, "rooted")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4, shard_limit: int = 16_384
) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    component_id: least doc_id among the texts that links (fingerprints at
    ``radius`` or fewer differing bits) reach from this one.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    rooted = _components(fps, radius, shard_limit)
    names = rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"))
    named = written(rooted.select("fp", "root").join(names, "root").select("fp", "component_id"), "named")
    return fps.select("doc_id", "fp").join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, radius: int = 4, shard_limit: int = 16_384
) -> DataFrame:
    """docs with one row of each component."""
    fps = written(fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    first = F.min("first").alias("first")
    stay = written(_components(fps, radius, shard_limit).groupBy("root").agg(first).select(F.coalesce("first.doc_id", F.lit(NO_ID)).alias("did"), "first.tk"), "stay")
    keys = fps.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), "tk").agg((F.count("*") > 1).alias("repeated"))
    gone = written(keys.select("did", "tk").join(stay, ["did", "tk"], "left_anti"), "gone")
    repeated = written(keys.where("repeated").select("did", "tk").join(stay, ["did", "tk"], "left_semi"), "repeated")
    kept = join_by_key(docs, gone, "left_anti", id_col, text_col)
    if repeated.isEmpty():
        return kept
    once = join_by_key(kept, repeated, "left_anti", id_col, text_col)
    again = join_by_key(kept, repeated, "inner", id_col, text_col).dropDuplicates(["__did", "__tk"]).drop("__did", "__tk")
    return once.union(again)
