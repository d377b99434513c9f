"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import intermediate_dir

#: Java/re pattern of the ASCII white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
#: Stand-in for a null doc_id inside joins.
NO_ID = -(2**63)
#: Keys (did, tk) up to so many are broadcast: 50 MB as a hash table. Beyond, both sides of a join are shuffled.
BROADCAST_KEYS = 500_000


#: Bytes at most in a batch between Spark and a Python worker, where rows hold whole texts: it bounds what either side holds at once.
BATCH_BYTES = 8 << 20


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Jobs inside run with these settings (``__`` stands for a point)."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch_bytes: int | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    The job drops its shuffle files when it ends, for its rows are in a table then.
    """
    spark = df.sparkSession
    path = f"{intermediate_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small = {} if batch_bytes is None else {"spark__sql__execution__arrow__maxBytesPerBatch": str(batch_bytes)}
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **small):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(did, tk): a row's key in joins. Rows of one key are repeats of one row."""
    return [
        F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("did"),
        F.xxhash64(F.col(text_col)).alias("tk"),
    ]


def small(keys: DataFrame) -> bool:
    """Whether a written table is of few enough rows to be broadcast as keys."""
    return keys.count() <= BROADCAST_KEYS


def only_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows, without those whose (did, tk) is not in keys if that is cheap to tell: a filter before a join, not instead of it."""
    return rows.join(F.broadcast(keys), ["did", "tk"], "left_semi") if small(keys) else rows


def join_by_key(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text", broadcast: bool | None = None) -> DataFrame:
    """docs joined to the written table keys(did, tk, ...), whose columns get the prefix "__", so that none clashes.

    keys are broadcast if they are few (``broadcast``: if the caller has found them small); else both sides are shuffled.
    """
    few = small(keys) if broadcast is None else broadcast
    keys = keys.toDF(*[f"__{c}" for c in keys.columns])
    did, tk = doc_key(docs, id_col, text_col)
    return docs.join(F.broadcast(keys) if few else keys, (did == keys["__did"]) & (tk == keys["__tk"]), how)
