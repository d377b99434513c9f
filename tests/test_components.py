"""Components by contraction in tasks, in one task and in rounds."""

import random

import pytest

from spanweave.operators import components


def brute(rows):
    least = {n: n for r in rows for n in r}
    while True:
        new = dict(least)
        for a, b in rows:
            new[a] = new[b] = min(new[a], new[b])
        if new == least:
            return {n: c for n, c in least.items() if n != c}
        least = new


@pytest.mark.parametrize("kind, task_rows", [("long", 0), ("string", 0), ("string", 1000)])
def test_star_forest(spark, kind, task_rows):
    rng = random.Random(5)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 470)] + [(500, 500 + i) for i in range(50)]
    rows = [(f"n{a}é", f"n{b}é") for a, b in rows] if kind == "string" else rows
    df = spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(4)
    got = {r.u: r.v for r in components.star_forest(df, task_rows=task_rows).collect()}
    assert got == brute(rows)


def test_a_task_contracts_by_chunks(spark):
    rows = [(i, i + 1) for i in range(100)]
    df = spark.createDataFrame(rows, "u long, v long").coalesce(1)
    whole = components.contracted(df).collect()
    assert sorted(map(tuple, whole)) == [(i, 0) for i in range(1, 101)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        parts = components.contracted(df, 30).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    assert len(parts) == 100 and {r.v for r in parts} == {0, 30, 60, 90}
