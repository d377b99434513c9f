"""Embeddings as whole-number vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written


def whole_vectors(df: DataFrame, scale: int, vec_col: str, **others: str) -> tuple[DataFrame, int]:
    """(the columns named by ``others``, x) as a written table, and the vectors' length; x is floor(scale * component), a long.

    Rows whose vector is null or holds a null or a component that is not finite are
    left out. Vectors that are shorter than the longest count as filled up with zeros.
    Products beyond a long's range are taken as its nearest end.
    """
    c = F.col(vec_col)
    whole = c.isNotNull() & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("long"))
    rows = written(df.where(whole).select(*[F.col(old).alias(new) for new, old in others.items()], x.alias("x")), "vectors")
    size = rows.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size["least"] != size["most"]:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(size["most"]) - F.size("x"))
        rows = rows.withColumn("x", F.concat("x", zeros))
    return rows, size["most"] or 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column, each list of the same length, as rows of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(column), width)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """matrix() the other way round."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(rows.reshape(-1), kind))
