"""Graphs and matrices as grids: a column for each of a stated, bounded list of ends or places."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.scalars import exact_decimals

#: A grid has so many columns at most; a larger one is refused, not cut.
COLUMNS = 500


def _bounded(columns: list) -> list:
    if len(columns) > COLUMNS:
        raise ValueError(f"a grid of {len(columns)} columns; the limit is {COLUMNS}")
    return columns


def adjacency_grid(edges: DataFrame, ids: list) -> DataFrame:
    """(id, a column for each of ids): the weight of the edge from id to it with two decimals, empty where there is none.

    Rows are those of ids too, with or without edges; edges of other nodes are left out.
    """
    columns = [str(x) for x in _bounded(ids)]
    kind = edges.schema["src"].dataType
    rows = edges.sparkSession.createDataFrame([(x,) for x in ids], f"id {kind.simpleString()}")
    inside = edges.join(F.broadcast(rows.select(F.col("id").alias("src"))), "src", "left_semi").where(F.col("dst").isin(ids))
    told = inside.groupBy("src", "dst").agg(F.max("w").alias("w")).select("src", "dst", exact_decimals("w", 2).alias("w"))
    grid = told.groupBy("src").pivot("dst", ids).agg(F.max("w")).toDF("__src", *columns)
    return rows.join(grid, F.col("id") == F.col("__src"), "left").select("id", *[F.coalesce(grid[f"`{c}`"], F.lit("")).alias(c) for c in columns])


def posterior_grid(post: DataFrame, columns: int, first: int = 1) -> DataFrame:
    """(ali, t, q<first>, ...): rows t of each alignment's posterior cells(ali, q, t, p), with one decimal in the given columns; 0 where there is no cell or none of any size."""
    places = _bounded(list(range(first, first + columns)))
    told = post.select("ali", "t", "q", F.when(F.col("p") == 0, "0").otherwise(exact_decimals("p", 1)).alias("p"))
    grid = told.groupBy("ali", "t").pivot("q", places).agg(F.max("p")).toDF("ali", "t", *[f"q{q}" for q in places])
    return grid.select("ali", "t", *[F.coalesce(f"q{q}", F.lit("0")).alias(f"q{q}") for q in places])


def grid_lines(grid: DataFrame, width: int, keys: int = 1) -> Iterator[str]:
    """Lines of a grid for a terminal, by its first ``keys`` columns: a header, a rule and a line a row; cells cut and filled to the width. Grids are for the eye: rows come to the driver one by one."""
    cell = lambda v: f"{v!s:.{width - 1}}".ljust(width)
    yield "".join(map(cell, ["", *grid.columns[1:]])).rstrip()
    yield "-" * (width * len(grid.columns))
    for row in grid.orderBy(*grid.columns[:keys]).toLocalIterator():
        yield "".join(map(cell, row)).rstrip()
