"""Affinity propagation on kept cells against the dense form, in one task and in rounds over all cells."""

import random

import numpy as np
import pytest

from spanweave.operators import affinity
from spanweave.operators.order import ranked

COMPONENTS = "component string, src string, dst string, w double"


def test_kept_cells_give_the_dense_result():
    """To the bit: so with ties, weights under 0 and preferences of 0 too."""
    rng = np.random.default_rng(0)
    for _ in range(250):
        n, low, decimals = int(rng.integers(1, 25)), rng.choice([0, -1]), rng.choice([1, 2, 8])
        s = np.where(rng.random((n, n)) < rng.choice([0.05, 0.2, 0.6, 1]), np.round(rng.uniform(low, 1, (n, n)), decimals), 0)
        np.fill_diagonal(s, rng.choice([0, 0.3, 0.01, max(0, np.median(s))]))
        rounds, damping = int(rng.choice([1, 3, 20, 200])), float(rng.choice([0.5, 0.7]))
        row, col = np.nonzero((s != 0) | np.eye(n, dtype=bool))
        want, forced = affinity.propagate(s, rounds, damping)
        got, also = affinity.propagate_cells(n, row, col, s[row, col], rounds, damping)
        assert got.tolist() == want.tolist() and also == forced


def random_components(spark):
    rng, rows = random.Random(3), []
    for c, n, dense, low in (("a", 12, 0.3, 0), ("b", 16, 0.15, 0), ("c", 6, 0.9, 0), ("d", 9, 0.4, -0.5), ("e", 2, 1, 0)):
        rows += [(c, f"n{i:02}", f"n{k:02}", round(rng.uniform(low, 1), 2)) for i in range(n) for k in range(n) if i != k and rng.random() < dense]
    return spark.createDataFrame(rows + [("a", "n00", "n00", 0.5)], COMPONENTS)


@pytest.mark.parametrize("rounds, jitter, preference, task_cells", [(3, True, None, 0), (2, False, 0.2, 60)])
def test_rounds_over_all_cells_give_the_result_of_one_task(spark, rounds, jitter, preference, task_cells):
    """With 60 some components go to a task each, the others through rounds."""
    edges = random_components(spark)
    one = sorted(map(tuple, affinity.affinity_clusters(edges, preference, rounds, jitter=jitter).collect()))
    assert sorted(map(tuple, affinity.affinity_clusters(edges, preference, rounds, jitter=jitter, task_cells=task_cells).collect())) == one


def test_a_negative_preference_is_dense_and_bounded(spark):
    edges = random_components(spark)
    with pytest.raises(Exception, match="negative preference"):
        affinity.affinity_clusters(edges, -0.5, 5, max_nodes=10).count()
    got = {(r.component, r.member): r.exemplar for r in affinity.affinity_clusters(edges.where("component = 'c'"), -0.5, 30, jitter=False).collect()}
    rows = edges.where("component = 'c'").collect()
    names = sorted({r.src for r in rows})
    s = np.zeros((6, 6))
    for r in rows:
        s[names.index(r.src), names.index(r.dst)] = r.w
    np.fill_diagonal(s, -0.5)
    choice, _ = affinity.propagate(s, 30)
    assert got == {("c", n): names[k] for n, k in zip(names, choice)}


def test_preference_of_sparse_and_full_components(spark):
    rng, rows = random.Random(5), []
    for c, n, dense, low in (("sparse", 9, 0.2, 0), ("full", 7, 1, 0), ("half", 8, 0.55, 0), ("under", 8, 0.3, -1)):
        rows += [(c, f"n{i}", f"n{k}", round(rng.uniform(low, 1), 1)) for i in range(n) for k in range(n) if i != k and rng.random() < dense]
    got = {r.component: r.preference for r in affinity.preference(spark.createDataFrame(rows, COMPONENTS)).collect()}
    for c in got:
        own = [r for r in rows if r[0] == c]
        n = len({x for r in own for x in r[1:3]})
        assert got[c] == pytest.approx(np.median([r[3] for r in own] + [0] * (n * n - len(own))))
    assert len(got) == 4


def test_ranked_numbers_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i, rng.randrange(9)) for i in range(700)]
    out = ranked(spark.createDataFrame(rows, "k string, i long, w long").repartition(5), ["k", "i"], "w").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    assert [(r.k, r.i, r.w) for r in sorted(out, key=lambda r: r["__rank"])] == order and sorted(r["__rank"] for r in out) == list(range(700))
    ahead = {r.i: r["__ahead"] for r in out}
    done = 0
    for _, i, w in order:
        assert ahead[i] == done
        done += w
