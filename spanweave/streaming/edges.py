"""Normal forms kept up to date over a stream of records.

The running_ functions are for output mode update, with a checkpoint: a row tells what
a key has now, and replaces the row before. Their state is one value for each key. A stream
that is stopped and started again goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.operators.components import star_forest


def running_undirected_max(records: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the greatest weight of a pair so far.

    A maximum only grows; join with itself reversed for both directions.
    """
    pairs = records.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w")
    return pairs.groupBy("a", "b").agg(F.max("w").alias("w"))


def running_last_edges(rows: DataFrame, coverage_cut: float = 0.0) -> DataFrame:
    """(src, dst, w): of rows (src, dst, w, cov, line_no) the edges as graph.scan_edges gives them, the last line so far counting.

    line_no orders the records, not their arrival, so a late record does not replace a later line's.
    """
    kept = rows.where((F.col("src") != F.col("dst")) & F.col("w").isNotNull() & (F.col("cov").isNull() | (F.col("cov") > coverage_cut)))
    return kept.groupBy("src", "dst").agg(F.max_by("w", "line_no").alias("w"))


def _path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def components_so_far(folder: str, src: str = "src", dst: str = "dst") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: keeps the star forest (u, v) of all edges so far in the folder, one for each batch, see read_components.

    A batch's forest is that of its edges and of the forest before, so no edge is kept
    for longer than its batch. A batch that is run again after a failure reads the same
    forest and writes its own anew. The forest before the last is deleted.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        edges = batch.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
        files, before = _path(spark, f"{folder}/batch={number - 1}")
        if files.exists(before):
            edges = edges.union(spark.read.parquet(f"{folder}/batch={number - 1}").select("u", "v"))
        star_forest(edges).select("u", "v").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        files, old = _path(spark, f"{folder}/batch={number - 2}")
        files.delete(old, True)

    return fold


def read_components(spark: SparkSession, folder: str) -> DataFrame:
    """(u, v): each node that is not the least of its component, and the least, after the last whole batch."""
    files, at = _path(spark, folder)
    done = [int(s.getPath().getName().split("=")[1]) for s in files.listStatus(at) if files.exists(_path(spark, f"{s.getPath()}/_SUCCESS")[1])]
    return spark.read.parquet(f"{folder}/batch={max(done)}")
