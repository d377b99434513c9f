"""Affinity propagation on the components of a similarity graph.

A pair without an edge has similarity 0, so the algorithm's matrices are dense. But while
the diagonal (the preference) is 0 or more, cells without an edge need not be kept:

* a(k, k) is a sum of positive parts, so a row's maximum of a + s is at least its
  diagonal's, hence 0 or more; off the diagonal a is 0 or less. So a cell without an
  edge is a row's maximum only in a tie, where it makes no difference which cell it is.
* Its responsibility is therefore 0 less the maximum, never positive, and adds nothing
  to a column's sum; its availability is the same for all such cells of a column.

So the state is the cells of edges and the diagonal, and one availability ``alpha`` for each
column. Of the other cells a row needs the greatest alpha, as second best when its diagonal
is best: nodes are ordered by alpha, and the first place that none of the row's cells
takes is found among its own number of places. Results are those of the dense form.

Components of up to TASK_CELLS cells are worked through in one task each, in arrays;
larger ones in DataFrame rounds of aggregations and joins over all their cells, written
after each round. Both stop early if a round changes nothing. With a negative preference
the dense form is needed: components of over ``max_nodes`` nodes are then refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import materialize
from spanweave.operators.order import ranked

#: A component of so many cells (edges and diagonal) at most goes to one task: about 200 MB.
TASK_CELLS = 2_000_000


def preference(edges: DataFrame) -> DataFrame:
    """(component, preference): the median of all cells of a component's matrix, absent ones being 0.

    Exact without building the matrix: it is 0 where over half of the cells are absent
    and no weight is negative. Elsewhere equal cells are counted together, the zeros
    without being made, and the counts summed up in the order of the weights.
    """
    ends = edges.select("component", F.explode(F.array("src", "dst")).alias("id")).groupBy("component").agg(F.countDistinct("id").alias("n"))
    sizes = edges.groupBy("component").agg(F.count("*").alias("given"), F.min("w").alias("least")).join(ends, "component").withColumn("total", F.col("n") * F.col("n"))
    sizes = sizes.withColumn("blank", (F.col("given") * 2 < F.col("total")) & (F.col("least") >= 0))
    full = sizes.where("not blank")
    counts = edges.join(full.select("component"), "component", "left_semi").groupBy("component", "w").agg(F.count("*").alias("k"))
    zeros = full.select("component", F.lit(0.0).alias("w"), (F.col("total") - F.col("given")).alias("k"))
    up_to = Window.partitionBy("component").orderBy("w").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.unionByName(zeros).where("k > 0").groupBy("component", "w").agg(F.sum("k").alias("k"))
    counted = counts.withColumn("upto", F.sum("k").over(up_to)).join(full.select("component", "total"), "component")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("w")))
    middle = counted.groupBy("component").agg(at(F.floor((F.col("total") - 1) / 2)).alias("lo"), at(F.floor(F.col("total") / 2)).alias("hi"))
    return sizes.where("blank").select("component", F.lit(0.0).alias("preference")).union(middle.select("component", ((F.col("lo") + F.col("hi")) / 2).alias("preference")))


def propagate(s: np.ndarray, iterations: int = 500, damping: float = 0.5) -> tuple[np.ndarray, bool]:
    """Exemplar of each row of a similarity matrix (the diagonal has the preferences); whether none arose and the best was taken."""
    n = len(s)
    a, r, rows = np.zeros((n, n)), np.zeros((n, n)), np.arange(n)
    for _ in range(iterations):
        both = a + s
        top = both.argmax(1)
        first = both[rows, top]
        both[rows, top] = -np.inf
        second = both.max(1) if n > 1 else np.zeros(n)
        new = s - first[:, None]
        new[rows, top] = s[rows, top] - second
        r = damping * r + (1 - damping) * new
        plus = np.maximum(r, 0)
        plus[rows, rows] = r[rows, rows]
        new = plus.sum(0)[None, :] - plus
        own = new[rows, rows].copy()
        new = np.minimum(new, 0)
        new[rows, rows] = own
        a = damping * a + (1 - damping) * new
    score = np.diag(r + a)
    exemplars = np.flatnonzero(score > 0)
    none = not len(exemplars)
    if none:
        exemplars = np.array([int(np.argmax(score))])
    choice = exemplars[s[:, exemplars].argmax(1)]
    choice[exemplars] = exemplars
    return choice, none


def _free(place: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each row the least place none of its cells takes; place, row: of the cells, size: cells of each row."""
    near = np.flatnonzero(place < size[row])
    near = near[np.lexsort((place[near], row[near]))]
    first = np.searchsorted(row[near], np.arange(len(size)))
    taken = place[near] == np.arange(len(near)) - first[row[near]]
    return np.bincount(row[near], weights=taken, minlength=len(size)).astype(np.int64)


def propagate_cells(n: int, row: np.ndarray, col: np.ndarray, s: np.ndarray, iterations: int = 500, damping: float = 0.5) -> tuple[np.ndarray, bool]:
    """propagate() of the cells (row, col, s) by row and column, the whole diagonal among them and not negative, the others being 0."""
    own, size = np.flatnonzero(row == col), np.bincount(row, minlength=n)
    starts, places = np.concatenate(([0], np.cumsum(size)[:-1])), np.arange(len(s))
    a, r, alpha = np.zeros(len(s)), np.zeros(len(s)), np.zeros(n)
    for _ in range(iterations):
        both = a + s
        first = np.maximum.reduceat(both, starts)
        top = np.minimum.reduceat(np.where(both == first[row], places, len(s)), starts)
        both[top] = -np.inf
        order = np.argsort(-alpha, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        absent = np.append(alpha[order], -np.inf)[_free(place[col], row, size)]
        second = np.maximum(np.maximum.reduceat(both, starts), absent) if n > 1 else np.zeros(1)
        new = s - first[row]
        new[top] = s[top] - second
        new_r = damping * r + (1 - damping) * new
        plus = np.maximum(new_r, 0)
        plus[own] = new_r[own]
        total = np.bincount(col, weights=plus, minlength=n)
        new = total[col] - plus
        clipped = np.minimum(new, 0)
        clipped[own] = new[own]
        new_a, new_alpha = damping * a + (1 - damping) * clipped, damping * alpha + (1 - damping) * np.minimum(total, 0)
        still = np.array_equal(new_r, r) and np.array_equal(new_a, a) and np.array_equal(new_alpha, alpha)
        a, r, alpha = new_a, new_r, new_alpha
        if still:
            break
    score = (r + a)[own]
    chosen = score > 0
    none = not chosen.any()
    if none:
        chosen[int(np.argmax(score))] = True
    exemplars = np.flatnonzero(chosen)
    near = np.flatnonzero(chosen[col])
    choice = np.append(exemplars, n)[_free(np.searchsorted(exemplars, col[near]), row[near], np.bincount(row[near], minlength=n) + 1)]  # the first exemplar without a cell
    near = near[np.lexsort((col[near], -s[near], row[near]))]
    near = near[np.flatnonzero(np.diff(row[near], prepend=-1))]  # of each row the most similar exemplar with a cell, of equals the first
    i, k = row[near], col[near]
    choice[i] = np.where(s[near] > 0, k, np.where(s[near] == 0, np.minimum(k, choice[i]), np.where(choice[i] < n, choice[i], k)))
    choice[exemplars] = exemplars
    return choice, none


def _cells(edges: DataFrame, preference_value: float | None, jitter: bool) -> DataFrame:
    """(component, i, k, s, size, cells, least): the cells of edges and the diagonal; size: of the row, cells: of the component, least: of its diagonal."""
    edges = materialize(edges.groupBy("component", "src", "dst").agg(F.max("w").cast("double").alias("w")), "ap-edges")
    ids = edges.select("component", F.explode(F.array("src", "dst")).alias("i")).distinct()
    pref = preference(edges) if preference_value is None else edges.select("component").distinct().withColumn("preference", F.lit(float(preference_value)))
    pref = materialize(pref, "preferences")
    diagonal = ids.join(pref, "component").select("component", "i", F.col("i").alias("k"), F.col("preference").alias("s"))
    cells = edges.where("src <> dst").select("component", F.col("src").alias("i"), F.col("dst").alias("k"), F.col("w").alias("s")).union(diagonal)
    sums = cells.groupBy("component").agg(F.count("*").alias("cells"), F.greatest(F.max("s"), F.lit(0.0)).alias("top"), F.least(F.min("s"), F.lit(0.0)).alias("low"))
    sums = materialize(sums.join(pref.withColumnRenamed("preference", "least"), "component"), "ap-components")
    rows = cells.groupBy("component", "i").agg(F.count("*").alias("size"))
    cells = cells.join(sums, "component").join(rows, ["component", "i"])
    if jitter:  # a tie breaker of 1e-12 of the range, 0 or more, from a hash, so that results repeat
        part = F.shiftrightunsigned(F.xxhash64("component", "i", "k"), 11) / F.lit(float(1 << 53))
        cells = cells.withColumn("s", F.col("s") + part * (F.col("top") - F.col("low")) * 1e-12)
    return cells.select("component", "i", "k", "s", "size", "cells", "least")


def affinity_clusters(
    edges: DataFrame, preference_value: float | None = None, iterations: int = 500, damping: float = 0.5, jitter: bool = True,
    max_nodes: int = 5000, task_cells: int = TASK_CELLS,
) -> DataFrame:
    """(component, exemplar, member, forced) of edges(component, src, dst, w).

    forced: no exemplar arose in the component, and its best node was taken. max_nodes
    is a limit on components with a negative preference only. Jitter is on the cells of
    edges and the diagonal. Edges given twice count with their greatest weight.
    """
    cells = materialize(_cells(edges, preference_value, jitter), "ap-cells")
    types = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    schema = f"component {types['component']}, exemplar {types['src']}, member {types['src']}, forced boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "k"])
        names = pdf["i"].unique()
        row, col, s = pdf["i"].factorize()[0], np.searchsorted(names, pdf["k"].to_numpy()), pdf["s"].to_numpy()
        if pdf["least"].iloc[0] < 0:
            if len(names) > max_nodes:
                raise ValueError(f"component {pdf['component'].iloc[0]} has {len(names)} nodes; with a negative preference the limit is {max_nodes}")
            dense = np.zeros((len(names), len(names)))
            dense[row, col] = s
            choice, forced = propagate(dense, iterations, damping)
        else:
            choice, forced = propagate_cells(len(names), row, col, s, iterations, damping)
        return pd.DataFrame({"component": pdf["component"].iloc[0], "exemplar": names[choice], "member": names, "forced": forced})

    fits = (F.col("cells") <= task_cells) | (F.col("least") < 0)
    small = cells.where(fits).groupBy("component").applyInPandas(run, schema)
    large = cells.where(~fits).drop("cells", "least")
    return small if large.isEmpty() else small.unionByName(_large_clusters(large, iterations, damping))


def _first_free(cells: DataFrame, places: DataFrame) -> DataFrame:
    """(component, i, free): the least place that no cell of the row takes, where that is not 0; places(component, k, place)."""
    near = cells.join(places, ["component", "k"]).where(F.col("place") < F.col("size")).select("component", "i", "place")
    nth = F.row_number().over(Window.partitionBy("component", "i").orderBy("place")) - 1
    return near.withColumn("nth", nth).groupBy("component", "i").agg(F.count_if(F.col("place") == F.col("nth")).alias("free")).where("free > 0")


def _places(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with place, their number in their component, from 0, in this order."""
    numbered = ranked(nodes, ["component", *order])
    first = numbered.groupBy("component").agg(F.min("__rank").alias("__first"))  # a row for each large component
    return numbered.join(F.broadcast(first), "component").withColumn("place", F.col("__rank") - F.col("__first")).drop("__rank", "__first")


def _at_free(rows: DataFrame, free: DataFrame, places: DataFrame, value: str) -> DataFrame:
    """rows(component, i) with value of the node at their first free place; most have place 0, which is not shuffled to one task."""
    at_0 = F.broadcast(places.where("place = 0").select("component", F.col(value).alias("__at_0")))  # a row for each large component
    other = free.join(places.select("component", F.col("place").alias("free"), F.col(value).alias("__other")), ["component", "free"], "left")
    found = rows.join(other, ["component", "i"], "left").join(at_0, "component", "left")
    return found.withColumn(value, F.when(F.col("free").isNull(), F.col("__at_0")).otherwise(F.col("__other"))).drop("free", "__other", "__at_0")


def _large_clusters(cells: DataFrame, iterations: int, damping: float) -> DataFrame:
    """affinity_clusters() of cells(component, i, k, s, size) by rounds over all of them."""
    own = F.col("i") == F.col("k")
    damped = lambda old, new: F.lit(damping) * old + F.lit(1 - damping) * new
    cells = materialize(cells.withColumns({"a": F.lit(0.0), "r": F.lit(0.0)}), "ap-state")
    nodes = materialize(cells.where(own).select("component", "i", F.lit(0.0).alias("alpha")), "ap-nodes")
    for _ in range(iterations):
        places = _places(nodes.select("component", F.col("i").alias("k"), "alpha", (-F.col("alpha")).alias("down")), ["down", "k"])
        free = _first_free(cells, places.select("component", "k", "place"))
        value = F.col("a") + F.col("s")
        nth = F.row_number().over(Window.partitionBy("component", "i").orderBy(F.desc("v"), "k"))
        two = cells.select("component", "i", "k", value.alias("v")).withColumn("nth", nth).where("nth <= 2")
        best = two.groupBy("component", "i").agg(F.max("v").alias("first"), F.max(F.when(F.col("nth") == 1, F.col("k"))).alias("top"), F.max(F.when(F.col("nth") == 2, F.col("v"))).alias("next"))
        best = _at_free(best, free, places, "alpha").select("component", "i", "first", "top", F.greatest("next", "alpha").alias("second"))
        new_r = damped(F.col("r"), F.col("s") - F.when(F.col("k") == F.col("top"), F.coalesce("second", F.lit(0.0))).otherwise(F.col("first")))
        told = cells.join(best, ["component", "i"]).withColumn("new_r", new_r).withColumn("plus", F.when(own, F.col("new_r")).otherwise(F.greatest("new_r", F.lit(0.0))))
        told = materialize(told.select("component", "i", "k", "s", "size", "a", "new_r", "plus", (F.col("new_r") != F.col("r")).alias("moved")), "ap-told")
        # summed as decimals: the same total in any order
        totals = materialize(told.groupBy("component", "k").agg(F.sum(F.col("plus").cast("decimal(38,20)")).cast("double").alias("total")), "ap-totals")
        rest = F.col("total") - F.col("plus")
        new_a = damped(F.col("a"), F.when(own, rest).otherwise(F.least(rest, F.lit(0.0))))
        cells = told.join(totals, ["component", "k"]).withColumn("new_a", new_a).select(
            "component", "i", "k", "s", "size", F.col("new_a").alias("a"), F.col("new_r").alias("r"), (F.col("moved") | (F.col("new_a") != F.col("a"))).alias("moved")
        )
        cells = materialize(cells, "ap-state")
        new_alpha = damped(F.col("alpha"), F.least("total", F.lit(0.0)))
        nodes = nodes.drop("moved").join(totals.withColumnRenamed("k", "i"), ["component", "i"]).select("component", "i", new_alpha.alias("alpha"), (new_alpha != F.col("alpha")).alias("moved"))
        nodes = materialize(nodes, "ap-nodes")
        if cells.where("moved").isEmpty() and nodes.where("moved").isEmpty():
            break
    score = materialize(cells.where(own).select("component", "i", (F.col("r") + F.col("a")).alias("score")), "ap-scores")
    nth = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("score"), "i"))
    none = score.groupBy("component").agg((F.max("score") <= 0).alias("forced"))
    best = score.withColumn("nth", nth).where("nth = 1").select("component", F.col("i").alias("best"))
    per = F.broadcast(none.join(best, "component"))  # a row for each large component
    exemplars = materialize(score.join(per, "component").where((F.col("score") > 0) | (F.col("forced") & (F.col("i") == F.col("best")))).select("component", F.col("i").alias("k")), "exemplars")
    places = _places(exemplars, ["k"]).withColumn("default", F.col("k"))
    near = materialize(cells.join(exemplars, ["component", "k"]).select("component", "i", "k", "s", "size"), "ap-near")
    nth = F.row_number().over(Window.partitionBy("component", "i").orderBy(F.desc("s"), "k"))
    most = near.withColumn("nth", nth).where("nth = 1").select("component", "i", "k", "s")
    members = score.select("component", "i").join(most, ["component", "i"], "left")
    members = _at_free(members, _first_free(near, places.select("component", "k", "place")), places, "default")
    itself = exemplars.withColumnRenamed("k", "i").withColumn("own", F.lit(True))
    return members.join(itself, ["component", "i"], "left").join(per.select("component", "forced"), "component").select("component", _chosen().alias("exemplar"), F.col("i").alias("member"), "forced")


def _chosen() -> Column:
    """Of the best exemplar with a cell (k, s) and the first without one (default, of similarity 0) the better; of equals the first."""
    other = F.when((F.col("s") > 0) | F.col("default").isNull(), F.col("k")).when(F.col("s") == 0, F.least("k", "default")).otherwise(F.col("default"))
    return F.when(F.col("own"), F.col("i")).otherwise(F.coalesce(other, F.col("default"), F.col("k")))


def fill_singletons(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """clusters(exemplar, member) and each id in none of them as its own."""
    known = clusters.select(F.explode(F.array("exemplar", "member")).alias("id")).distinct()
    alone = ids.select(F.col(ids.columns[0]).alias("id")).distinct().join(known, "id", "left_anti")
    return clusters.select("exemplar", "member").union(alone.select("id", F.col("id").alias("member")))
