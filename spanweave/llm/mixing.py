"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in the order of a hash of their id and numbers, form blocks. With
share w of the slots, block k of a source is released at slot floor(k / w) and
is due by slot ceil((k + 1) / w); each slot goes to the released block that is due
first. Shares are the weights themselves, in whole-number arithmetic, so that at
any slot of the mix a source is less than one block from its target. When a source
has its blocks, the others share its slots by their weights, from that time on and
with what they had; so every row gets a place and none comes twice. The driver works
out the slots, of a few microseconds and 16 bytes a block; the rows look theirs up.

No task holds a source: a source's rows are dealt to buckets of about
``bucket_rows``, numbered there, and moved up by the sizes of earlier buckets, which
are summed in two levels, so that a task sums the square root of a source's buckets.
The driver gets a row for each source, of which there may be any number.

A null source is a source of its own; a source without a weight, or with one of
zero, comes after all others. Rows that repeat an id have places of their own, in
the order of a hash of their content; rows that are alike in all columns may change
places. Texts, of any length, are carried along and count as rows; an empty table
gives an empty result. Columns of the input that clash with the result's are replaced.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from array import array
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.llm.common import written

RESULT = ["block", "slot", "offset", "position"]
#: Above so many sources, or blocks, the tables of sources and of slots are joined by shuffle.
BROADCAST_SOURCES, BROADCAST_BLOCKS = 100_000, 4_000_000
#: Above so many buckets their places are joined by shuffle, which moves the rows a second time.
BROADCAST_BUCKETS = 500_000


def whole_weights(weights: list) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    exact = [Fraction(w) for w in weights]
    common = math.lcm(*[x.denominator for x in exact])
    return [x.numerator * (common // x.denominator) for x in exact]


def due_slots(blocks: list[int], weights: list[int]):
    """at(i, k): the time by which source i has its share of k blocks, times weights[i].

    All sources have had v times their weight, or all their blocks, at time
    sum(min(v * weight, blocks)); k blocks are due where v = k / weights[i].
    """
    order = sorted(range(len(blocks)), key=lambda i: Fraction(blocks[i], weights[i]))
    ends = [blocks[i] / weights[i] for i in order]
    ended = [0, *itertools.accumulate(blocks[i] for i in order)]  # blocks of the sources that have ended
    going = [0, *itertools.accumulate(weights[i] for i in reversed(order))][::-1]  # weights of those that have not

    def at(i: int, k: int) -> int:
        w = weights[i]
        j = bisect.bisect_right(ends, k / w)
        while j < len(order) and blocks[order[j]] * w <= k * weights[order[j]]:  # what the floats rounded
            j += 1
        while j and blocks[order[j - 1]] * w > k * weights[order[j - 1]]:
            j -= 1
        return ended[j] * w + going[j] * k

    return at


def schedule(sizes: dict, weights: dict, block_rows: int) -> dict:
    """For each source the slots of its blocks and the positions of their first rows."""
    slots_of = {s: (array("q"), array("q")) for s in sizes}
    slot = position = 0
    weighted = [s for s, n in sizes.items() if n and (weights.get(s) or 0) > 0]
    rest = [s for s, n in sizes.items() if n and not (weights.get(s) or 0) > 0]
    for sources, parts in ((weighted, [weights[s] for s in weighted]), (rest, [1] * len(rest))):
        if not sources:
            continue
        sources, parts = zip(*sorted(zip(sources, parts), key=lambda x: (x[0] is None, str(x[0]))))
        blocks, parts, start = [-(-sizes[s] // block_rows) for s in sources], whole_weights(parts), slot
        at = due_slots(blocks, parts)
        waiting, ready = [(0, i, 0) for i in range(len(sources))], []  # the next block of each: (release, source, block)
        for t in range(sum(blocks)):
            while waiting and waiting[0][0] <= t:
                _, i, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-at(i, k + 1) // parts[i]), i, k))
            due, i, k = heapq.heappop(ready)
            assert t < due, "a block missed its deadline"
            slots, positions = slots_of[sources[i]]
            slots.append(start + t)
            positions.append(position)
            position += min(block_rows, sizes[sources[i]] - k * block_rows)
            if k + 1 < blocks[i]:
                heapq.heappush(waiting, (at(i, k + 1) // parts[i], i, k + 1))
        slot += sum(blocks)
    return slots_of


def _before(sizes: DataFrame) -> DataFrame:
    """(s, b, before): rows of a source in the buckets before b; sizes(s, b, run, count), runs being of following buckets."""
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    runs = sizes.groupBy("s", "run").agg(F.sum("count").alias("size"))
    runs = runs.select(
        F.col("s").alias("s3"), F.col("run").alias("run3"),
        F.coalesce(F.sum("size").over(earlier(Window.partitionBy("s").orderBy("run"))), zero).alias("before_run"),
    )
    inside = F.coalesce(F.sum("count").over(earlier(Window.partitionBy("s", "run").orderBy("b"))), zero)
    return (
        sizes.withColumn("inside", inside).join(runs, F.col("s").eqNullSafe(F.col("s3")) & (F.col("run") == F.col("run3")))
        .select(F.col("s").alias("__s2"), F.col("b").alias("__b2"), (F.col("before_run") + F.col("inside")).alias("__before"))
    )


def _hash(docs: DataFrame, fits) -> Column:
    """Of the columns whose type fits; maps and variants have no hash."""
    names = [f"`{f.name}`" for f in docs.schema.fields if fits(kind := f.dataType.simpleString()) and "map<" not in kind and "variant" not in kind]
    return F.xxhash64(*names) if names else F.lit(0).cast("long")


def _numbered(docs: DataFrame, sizes: dict, source_col: str, id_col: str, bucket_rows: int) -> DataFrame:
    """docs with __s, the source, and __n, the row's place in it from 0; sizes: rows of each source."""
    counts = [(s, math.ceil(n / bucket_rows)) for s, n in sizes.items()]
    columns = zip(("__s1", "__buckets", "__run"), (pa.string(), pa.int64(), pa.int64()))
    rows = [(s, n, math.isqrt(n - 1) + 1) for s, n in counts]
    buckets = docs.sparkSession.createDataFrame(pa.table({c: pa.array([x[i] for x in rows], t) for i, (c, t) in enumerate(columns)}))
    if len(sizes) <= BROADCAST_SOURCES:
        buckets = F.broadcast(buckets)
    # columns without strings are cheap to read, and tell apart rows that repeat an id
    form = _hash(docs, lambda kind: not any(x in kind for x in ("string", "binary", "char")))
    content = _hash(docs, lambda kind: True)
    dealt = (
        docs.withColumn("__s", F.col(source_col).cast("string")).withColumn("__h", F.xxhash64(F.col(id_col).cast("string"), form))
        .join(buckets, F.col("__s").eqNullSafe(F.col("__s1")))  # a row for each source
        .withColumn("__b", F.pmod("__h", "__buckets")).withColumn("__run", F.floor(F.col("__b") / F.col("__run")))
    )
    before = _before(dealt.groupBy(F.col("__s").alias("s"), F.col("__b").alias("b"), F.col("__run").alias("run")).count())
    if sum(n for _, n in counts) <= BROADCAST_BUCKETS:
        before = F.broadcast(before)
    placed = dealt.withColumn("__r", F.row_number().over(Window.partitionBy("__s", "__b").orderBy("__h", F.col(id_col), content)) - 1)
    return (
        placed.join(before, placed["__s"].eqNullSafe(before["__s2"]) & (placed["__b"] == before["__b2"]))
        .withColumn("__n", F.col("__r") + F.col("__before"))
        .drop("__s1", "__buckets", "__run", "__s2", "__b2", "__before", "__r", "__b", "__h")
    )


def mix(
    docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id",
    block_rows: int = 16, quantum: int = 1000, bucket_rows: int = 256, temperature: float = 0.5,
) -> DataFrame:
    """docs with block, slot, offset (in the block) and position (in the mix, from 0).

    weights: of each source (key None: null); None: size to the power ``temperature``.
    """
    docs = docs.drop(*RESULT)
    sizes = {r["s"]: r["n"] for r in docs.groupBy(F.col(source_col).cast("string").alias("s")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        weights = {s: n**temperature for s, n in sizes.items()}
    plan = schedule(sizes, weights, block_rows)
    spark = docs.sparkSession
    numbered = _numbered(docs, sizes, source_col, id_col, bucket_rows).withColumn("block", F.floor(F.col("__n") / block_rows)).withColumn("offset", F.col("__n") % block_rows)
    # a row for ``quantum`` blocks of a source
    parts = [(s, c, slots[c * quantum : (c + 1) * quantum], places[c * quantum : (c + 1) * quantum]) for s, (slots, places) in plan.items() for c in range(-(-len(slots) // quantum))]
    columns = zip(("__s2", "__part", "__slots", "__places"), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))
    table = spark.createDataFrame(pa.table({c: pa.array([x[i] for x in parts], t) for i, (c, t) in enumerate(columns)}))
    if sum(len(slots) for slots, _ in plan.values()) <= BROADCAST_BLOCKS:
        table = F.broadcast(table)
    placed = numbered.withColumn("__part1", F.floor(F.col("block") / quantum)).join(table, F.col("__s").eqNullSafe(F.col("__s2")) & (F.col("__part1") == F.col("__part")))
    nth = (F.col("block") % quantum).cast("int")
    return placed.withColumn("slot", F.get("__slots", nth)).withColumn("position", F.get("__places", nth) + F.col("offset")).select(*docs.columns, *RESULT)
