"""Streams, stopped and started again, against the batch forms."""

import random

from spanweave.operators import graph, hits
from spanweave.operators.components import star_forest
from spanweave.streaming import edges as streams

ROWS = "src string, dst string, w double, cov double, line_no long"


def run_twice(spark, tmp_path, parts, schema, start):
    """The stream over the first half of the files, stopped, and over all of them."""
    for half in (parts[: len(parts) // 2], parts[len(parts) // 2 :]):
        for rows in half:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        query = start(stream).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()


def last_told(spark, tmp_path, keys):
    """What each key was told last, of the batches' outputs in order."""
    now = {}
    for path in sorted((tmp_path / "out").iterdir(), key=lambda p: int(p.name)):
        for r in spark.read.parquet(str(path)).collect():
            now[tuple(r[k] for k in keys)] = tuple(r)
    return sorted(now.values())


def told(tmp_path):
    return lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/{n}")


def test_last_edges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abcdef"), rng.choice("abcdef"), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice([None, 0.2, 0.7]), i) for i in range(240)]
    late = rng.sample(rows, len(rows))  # lines arrive in any order
    parts = [late[i : i + 60] for i in range(0, 240, 60)]
    run_twice(spark, tmp_path, parts, ROWS, lambda s: streams.running_last_edges(s, 0.3).writeStream.outputMode("update").foreachBatch(told(tmp_path)))
    want = graph.scan_edges(spark.createDataFrame(rows, ROWS), 0.3).edges.collect()
    assert last_told(spark, tmp_path, ("src", "dst")) == sorted(map(tuple, want))


def test_hits(spark, tmp_path):
    rng = random.Random(2)
    schema = "query_id string, query_length int, template_id string, aligned_cols int, evalue double, similarity double, t_start int, t_end int, ord int"
    rows = [(f"q{rng.randrange(5)}", 20, f"sp|T{rng.randrange(4)}|x", rng.choice([15, 19, 20]), rng.choice([1e-5, 1.0]), rng.choice([0.5, 0.9]), 1 + i, 18 + i, i) for i in range(160)]
    late = rng.sample(rows, len(rows))
    run_twice(spark, tmp_path, [late[i : i + 40] for i in range(0, 160, 40)], schema, lambda s: hits.filter_hits(s).writeStream.outputMode("update").foreachBatch(told(tmp_path)))
    want = hits.filter_hits(spark.createDataFrame(rows, schema)).collect()
    assert last_told(spark, tmp_path, ("query_id", "template")) == sorted(map(tuple, want)) and len(want) > 10


def test_components_so_far(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]
    parts = [rows[i : i + 15] for i in range(0, 60, 15)]
    fold = streams.components_so_far(f"{tmp_path}/forest")
    run_twice(spark, tmp_path, parts, "src long, dst long", lambda s: s.writeStream.foreachBatch(fold))
    want = sorted(map(tuple, star_forest(spark.createDataFrame(rows, "src long, dst long")).collect()))
    assert sorted(tuple(r)[:2] for r in streams.read_components(spark, f"{tmp_path}/forest").collect()) == want
    assert len(list((tmp_path / "forest").iterdir())) == 2
    fold(spark.createDataFrame(parts[-1], "src long, dst long"), 3)  # the last batch once more, as after a failure
    assert sorted(tuple(r)[:2] for r in streams.read_components(spark, f"{tmp_path}/forest").collect()) == want
