"""Table functions in SQL, archives decoded once, and four decimals on the JVM."""

import random
import struct

import pytest
from pyspark.sql import functions as F
from test_core import HHR, packed_alignments

from spanweave.functions import scalars
from spanweave.functions.tables import register_tables
from spanweave.sources import archive, text


def test_table_functions(spark):
    ident = [(i, i, 240) for i in range(1, 5)]
    good = packed_alignments("x|q1|y", 9, [("a|t1|b", 8, 95, -7, ident, ident[:2], []), ("t2", 7, 5, 3, [], ident, ident)])
    entries = spark.createDataFrame([("q1", good), ("cut", good[:-9]), ("empty", b""), ("none", None), ("bad", b"\xff\xfe"), ("h", HHR.encode())], "name string, content binary")
    register_tables(spark)
    entries.createOrReplaceTempView("entries_")
    try:
        rows = spark.sql("select d.* from entries_, lateral decode_alignments(name, content) d where name in ('q1', 'cut')")
        want = archive.read_packed(entries.where("name in ('q1', 'cut')"))
        assert rows.columns == want.columns and sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
        assert rows.count() == 3  # what follows the damage is left out
        cells = spark.sql("select d.entry, d.idx, inline(d.cells) from entries_, lateral decode_alignments(name, content) d where name = 'q1'")
        assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, archive.read_cells(entries.where("name = 'q1'")).collect()))
        hits = spark.sql("select h.* from entries_, lateral decode_hits(name, content) h")
        assert sorted(map(tuple, hits.where("name = 'h'").collect())) == sorted(map(tuple, text.read_hits(entries.where("name = 'h'")).collect())) and hits.where("name = 'h'").count() == 2
        assert spark.sql("select count(*) from entries_, lateral decode_alignments(name, content) d where name in ('empty', 'none')").first()[0] == 0
        found, errors = text.hits_and_errors(entries.where("name in ('h', 'bad')"))
        assert found.count() == 2 and [r.name for r in errors.collect()] == ["bad"]
    finally:
        spark.catalog.dropTempView("entries_")


def test_four_decimals_are_those_of_the_binary_value(spark):
    rng = random.Random(9)
    values = [0.0, -0.0, 0.03125, 0.00015, 0.00005, -0.00005, 0.99995, 0.99994999999, 1.0, -2.5, 9.99995, 1e-300, 5e-324, 123456789.00005, 2.0**52 + 0.5, 2.0**62, float("nan"), float("inf"), float("-inf")]
    values += [rng.uniform(-1, 1) for _ in range(60_000)] + [rng.randrange(10**6) / 10**rng.randrange(1, 9) for _ in range(60_000)] + [(2 * rng.randrange(10**5) + 1) / 2**rng.randrange(1, 20) for _ in range(60_000)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(60_000)]
    values = [v for v in values if not 2.0**63 <= abs(v) < float("inf")] + [None]
    # five decimals and a half unit of the last place on either side
    values += [k / 100_000 * (1 + e * 2.0**-52) for k in range(5, 40_000, 10) for e in (-1, 0, 1)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalars.exact_4f("v").alias("t")).collect()
    assert len(rows) == len(values) and all(r.t == (None if r.v is None else format(r.v, ".4f")) for r in rows)
    for digits in (1, 2, 7):
        told = spark.createDataFrame([(v,) for v in values[:3000]], "v double").select("v", scalars.exact_decimals("v", digits).alias("t")).collect()
        assert all(r.t == format(r.v, f".{digits}f") for r in told)
    with pytest.raises(Exception, match="from 2.63 on"):
        spark.range(1).select(scalars.exact_4f(F.col("id") + F.lit(1e19))).collect()
