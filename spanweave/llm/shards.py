"""Shards along a Hilbert curve through metadata, in DataFrame functions only.

Each dimension (a column, or an expression) is quantised to 2^bits places: a number by
its highest bit and the two below it, so that a place is a fifth of its values wide;
anything else by the rank of its value among the distinct ones, in order, nulls first.
The places' index on a Hilbert curve (Skilling's transposition) orders the rows, those of
one index by id and checksum; runs of the order are the shards. So a shard holds few
values of each dimension, and a reader that knows the least and the greatest of a
shard's values passes most shards over, whichever dimension it filters by.

law ``rows``: counts of shards are at most one apart. law ``bytes``: a shard ends at the
first row that has half its bytes beyond its share of all bytes, so that it misses its share by
the size of a row at most.

The order is made by one range partitioning of (index, id, checksum, row number): rows
have their place in their task, tasks are counted, and the counts of earlier tasks are
added. Row numbers are given once, in a written table, and tell repeated rows apart, so
that no group of equal rows, ids or places has to stay in one task; nothing random
decides where a row goes, so a task that is run again gives the same rows.

Null texts have no bytes, and 0 as their checksum; null ids come first in their place of the
curve. Repeated rows have slots of their own. Texts of any length are read once. An
empty table gives an empty result; with fewer rows than shards some shards are empty.
Columns of the input that are named like a result are replaced, others are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written
from spanweave.llm.decontaminate import let
from spanweave.operators.order import ranked

SHARDS = 24
BITS = 6
#: Distinct values whose places are broadcast; of more, only the least value of each place is, which every row is compared with.
BROADCAST_VALUES = 10_000
RESULT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def log_place(value: Column, bits: int = BITS) -> Column:
    """A number's place: four for each doubling, from 0; negative ones, and nulls, are at 0, what is beyond the last place is there."""
    v = F.greatest(value, F.lit(0)).cast("long")
    e = F.length(F.bin(v)) - 1
    place = F.when(e >= 2, 4 * (e - 1) + F.call_function("shiftright", v, F.greatest(e - 2, F.lit(0))).bitwiseAND(F.lit(3).cast("long"))).otherwise(v)
    return F.least(F.coalesce(place, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def hilbert_index(places: list[Column], bits: int = BITS) -> Column:
    """The index, a long, on a Hilbert curve through 2^bits places of each dimension."""
    n = len(places)
    if n * bits > 63:
        raise ValueError("the index has 63 bits at most")
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turned(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        own, first = F.get(x, i), F.get(x, F.lit(0))
        swap = F.when(own.bitwiseAND(q) != 0, F.lit(0)).otherwise(first.bitwiseXOR(own).bitwiseAND(q - 1))
        flip = F.when(own.bitwiseAND(q) != 0, q - 1).otherwise(swap)
        return let(F.struct(swap.alias("swap"), flip.alias("flip")), lambda t: F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(t["flip"])).when(k == i, v.bitwiseXOR(t["swap"])).otherwise(v)))

    def gray(x: Column) -> Column:
        g = [F.get(x, F.lit(0))]
        for k in range(1, n):
            g.append(g[-1].bitwiseXOR(F.get(x, F.lit(k))))
        return F.array(*g)

    def woven(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        turn = F.lit(0)
        for b in range(1, bits):
            turn = turn.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)))

        def taken(t: Column) -> Column:
            out = F.lit(0).cast("long")
            for k in range(n):
                v = F.get(x, F.lit(k)).bitwiseXOR(t).cast("long")
                for b in range(bits):
                    out = out + F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - k)
            return out

        return let(turn, taken)

    return let(let(F.aggregate(steps, F.array(*[p.cast("int") for p in places]), turned), gray), woven)


def rank_place(rows: DataFrame, col: str, out: str, bits: int = BITS) -> DataFrame:
    """rows with out, the place of col by its value's rank among the distinct ones."""
    values = ranked(rows.select(F.col(col).alias("__v")).distinct(), ["__v"])
    n = values.count()
    values = values.select("__v", F.floor(F.col("__rank") * (1 << bits) / F.lit(max(n, 1))).cast("int").alias(out))
    if n <= BROADCAST_VALUES:
        return rows.join(F.broadcast(values), F.col(col).eqNullSafe(F.col("__v"))).drop("__v")
    least = [r["v"] for r in values.where(F.col(out) > 0).groupBy(out).agg(F.min("__v").alias("v")).orderBy(out).collect()]  # 2^bits - 1 values
    return rows.withColumn(out, F.coalesce(F.size(F.filter(F.array(*map(F.lit, least)), lambda v: v <= F.col(col))), F.lit(0)))


def sharded(
    docs: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text",
    dimensions: tuple[str, ...] = ("lang", "source", "size"), bits: int = BITS,
) -> DataFrame:
    """docs with size, text_crc32, law, shard, slot (in the shard, from 0), grown_shard (null) and curve, the place on the curve.

    dimensions: columns of docs, or ``size``: the text's UTF-8 bytes plus 8.
    """
    return cut_along(measured(docs, text_col), shards, law, id_col, dimensions, bits)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with size and text_crc32, and without columns named like another result."""
    docs = docs.drop(*RESULT)
    return docs.withColumns({"size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8, "text_crc32": F.coalesce(F.crc32(F.col(text_col)), F.lit(0).cast("long"))})


def cut_along(rows: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", dimensions: tuple[str, ...] = ("lang", "source", "size"), bits: int = BITS) -> DataFrame:
    """sharded() of rows that are measured already, with or without their texts."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no law {law}")
    rows = written(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    places = [f"__p{i}" for i in range(len(dimensions))]
    for d, p in zip(dimensions, places):
        numeric = rows.schema[d].dataType.typeName() in ("byte", "short", "integer", "long")
        rows = rows.withColumn(p, log_place(F.col(d), bits)) if numeric else rank_place(rows, d, p, bits)
    rows = rows.withColumn("curve", hilbert_index([F.col(p) for p in places], bits)).drop(*places)
    done = ranked(rows, ["curve", id_col, "text_crc32", "__row"], "size" if law == "bytes" else None)
    if law == "rows":
        done = done.withColumn("shard", F.expr(f"cast(__rank * {shards} div {max(n, 1)} as int)")).withColumn("slot", F.expr(f"__rank - (shard * {n}L + {shards - 1}) div {shards}"))
    else:
        done = done.withColumn("shard", F.expr(f"cast((__ahead * 2 + size) * cast({shards} as decimal(10,0)) div {2 * max(total, 1)} as int)"))
        first = done.groupBy(F.col("shard").alias("__s")).agg(F.min("__rank").alias("__first"))
        done = done.join(F.broadcast(first), F.col("shard") == F.col("__s")).withColumn("slot", F.col("__rank") - F.col("__first")).drop("__s", "__first", "__ahead")  # a row a shard
    return done.withColumn("law", F.lit(law)).withColumn("grown_shard", F.lit(None).cast("int")).drop("__row", "__rank")


def write_shards(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write docs, each shard as a folder shard=N of files in the order of its slots. Returns (shard, rows, bytes)."""
    done = sharded(docs, **options)
    done.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    return back.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))
