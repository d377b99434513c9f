"""A global order of rows, numbered without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import materialize


def ranked(rows: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """rows, written in the order of these columns, nulls first, with __rank from 0; with a weight also __ahead, the sum of it over the rows before.

    Rows are range partitioned and sorted in their task; tasks are counted, and a row's
    rank is its place in the task and the counts of earlier tasks. The columns must tell
    rows apart where it matters which one comes first, and none may be random.
    """
    place = F.monotonically_increasing_id()  # task << 33 | place in the task
    sorted_ = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in order]).sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])
    sorted_ = materialize(sorted_.withColumn("__at", place).withColumn("__task", F.shiftright("__at", 33)), "ordered")
    own = F.lit(0) if weight is None else F.col(weight)
    tasks = sorted_.groupBy("__task").agg(F.count("*").alias("n"), F.sum(own).alias("w"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    zero = F.lit(0).cast("long")
    tasks = tasks.select("__task", F.coalesce(F.sum("n").over(earlier), zero).alias("__n"), F.coalesce(F.sum("w").over(earlier), zero).alias("__w"))
    out = sorted_.join(F.broadcast(tasks), "__task").withColumn("__rank", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__n"))
    if weight is not None:
        before = F.sum(weight).over(Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("__ahead", F.coalesce(before, zero) + F.col("__w"))
    return out.drop("__task", "__at", "__n", "__w")
