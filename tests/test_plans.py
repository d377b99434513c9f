"""What the catalog's inputs cost, and steps that do the work of two."""

import random
import re

import pytest

from spanweave.operators import components, graph, scoring
from spanweave.plans import catalog

SF = "/root/testdata/sf0.001"


def nodes(df, kind):
    return df._jdf.queryExecution().optimizedPlan().toString().count(kind)


def test_inputs_are_derived_once(spark):
    rows = catalog.edge_rows(spark, SF)
    assert nodes(rows.select("src", "dst"), "Join ") == 3  # two scans of purchases, each a join, and their meeting: no degrees
    assert nodes(rows, "Union") == 0
    assert nodes(catalog._cells(spark, SF), "Union") == 0 and nodes(catalog._cells(spark, SF), "Relation ") == 1


@pytest.mark.parametrize("rows, names", [("edge_rows", "orders lineitem"), ("_cells", "lineitem")])
def test_inputs_are_those_of_the_sql(spark, rows, names):
    got = getattr(catalog, rows)(spark, SF)
    if rows == "edge_rows":
        want = catalog._derived(spark, SF, catalog.EDGES, "select * from rows_", *names.split())
    else:
        want = catalog._derived(spark, SF, catalog.CELLS, "select ali, kind, 0 as ord, q, t, power(2.0D, floor(c / 16) - 15) * (1 + (c % 16) / 16.0D) as p from coded", *names.split())
    assert got.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_scan_symmetric_is_both_steps(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.choice(["a", "b", "c", "d", None]), rng.choice([None, -0.5, 0.2, 0.7, 1.0]), rng.choice([None, 0.0, 0.3]), i) for i in range(60)]
    df = spark.createDataFrame(rows + [("x", "y", -1.0, None, 90), ("z", "y", -1.0, None, 91), ("y", "z", -2.0, None, 92)], "src string, dst string, w double, cov double, line_no long")
    said = lambda edges: sorted(map(tuple, edges.collect()))
    assert said(graph.scan_symmetric(df, 0.1)) == said(graph.symmetrize(graph.scan_edges(df, 0.1).edges))


@pytest.fixture(scope="module")
def odd(tmp_path_factory, spark):
    """Purchases made twice, of no customer, part or quantity, of zero with either sign, and orders that are not there."""
    rng, at = random.Random(7), str(tmp_path_factory.mktemp("odd"))
    orders = [(o, rng.choice([None, 1, 2, 3, 7, 14, 15])) for o in [None, *range(40)]]
    lines = [(rng.choice([None, *range(45)]), rng.choice([None, 1, 2]), rng.choice([None, 0.0, -0.0, float("nan"), 1.5, 2.0])) for _ in range(160)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{at}/lineitem.parquet")
    return at


def same(got, want):
    return want.count() > 0 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_edges_of_odd_purchases_are_those_of_the_sql(spark, odd):
    of = lambda with_, select: catalog._derived(spark, odd, with_, select, "orders", "lineitem")
    assert same(catalog.edge_rows(spark, odd), of(catalog.EDGES, "select * from rows_"))
    assert same(catalog._symmetric(spark, odd), of(catalog.SYM, "select * from sym"))
    assert same(catalog.QUERIES["edge_last_wins"](spark, odd), of(catalog.SYM, "select * from last"))


def test_symmetric_edges_take_two_shuffles_and_no_degrees(spark):
    """After orders have met their lines: purchases by part and quantity (once for both sides), pairs by their ends."""
    plan = catalog._symmetric(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # the two sides' are alike, so one is reused
    assert plan.count("count(") == 0


def test_customers_without_another_do_not_go_to_the_join(spark):
    bought = spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0), (3, 5, 1.0), (None, 5, 1.0), (1, 5, 2.0), (1, 5, 2.0), (None, 6, 1.0), (4, 6, 1.0)], "c long, p long, n double")
    said = lambda df: sorted((r.c, r.p, r.n) for r in df.collect())
    lesser, greater = catalog._meeting(bought)
    assert said(lesser) == [(1, 5, 1.0), (2, 5, 1.0)] and said(greater) == [(2, 5, 1.0), (3, 5, 1.0)]


@pytest.mark.parametrize("cut", [-2.0, 0.0, 0.5, 2.0])
def test_cut_while_scanning_is_that_of_clean(spark, cut):
    rng = random.Random(5)
    rows = [(rng.choice("abcdef"), rng.choice("abcd"), rng.choice([None, -0.5, 0.5, 0.7, float("nan")]), rng.choice([None, 0.0, 0.3]), i) for i in range(60)]
    df = spark.createDataFrame(rows + [("x", "y", -1.0, None, 90)], "src string, dst string, w double, cov double, line_no long")
    said = lambda edges: sorted(map(str, edges.collect()))
    assert said(graph.scan_symmetric(df, 0.1, cut=cut)) == said(graph.clean(graph.scan_symmetric(df, 0.1), cut))


def test_clean_edges_are_cut_before_they_are_told_in_both_directions(spark, odd):
    got = catalog.QUERIES["graph_clean"](spark, odd)
    assert same(got, catalog._derived(spark, odd, catalog.SYM, "select * from sym where w >= 0.5", "orders", "lineitem"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index(">= 0.5")


def random_pairs(spark, kind="long"):
    rng = random.Random(11)
    rows = {(a, b): rng.randrange(1, 100) / 100 for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.4}
    rows = {tuple(sorted(map(str, k))): w for k, w in rows.items()} if kind == "string" else rows
    return rows, spark.createDataFrame([(*k, w) for k, w in rows.items()], f"src {kind}, dst {kind}, w double")


@pytest.mark.parametrize("kind", ["long", "string"])
def test_closure_of_one_direction_is_that_of_both(spark, kind):
    rows, pairs = random_pairs(spark, kind)
    w = rows | {(b, a): v for (a, b), v in rows.items()}
    ids = sorted({n for k in w for n in k})
    paths = sorted((i, m, t) for i in ids for m in ids for t in ids if i < t and (i, t) in w and (i, m) in w and (m, t) in w)
    want = {(i, t): max([v] + [w[i, m] * w[m, t] for m in ids if (i, m) in w and (m, t) in w]) for (i, t), v in w.items()}
    both = pairs.union(pairs.select("dst", "src", "w"))
    for edges in (pairs, both):
        found = graph.triangles(edges)
        assert sorted(map(tuple, found.collect())) == paths
        stepped = graph.closure_step(edges, found).collect()
        assert len(stepped) == len(w) and {(r.src, r.dst): r.w for r in stepped} == want
    assert sorted(map(tuple, graph.triangle_closure(pairs).collect())) == sorted(map(tuple, graph.triangle_closure(both).collect()))


def test_component_count_is_that_of_the_labels(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (4, 5), (7, 7), (8, None)], "src long, dst long")
    nodes = spark.createDataFrame([(1,), (9,), (9,), (10,)], "id long")
    for more in (None, nodes):
        labels = components.connected_components(edges, more)
        assert components.component_count(edges, more).first()[0] == labels.select("component").distinct().where("component is not null").count()
    assert components.component_count(edges.where("false")).first()[0] == 0


def test_nations_are_asked_for_each_pair_once(spark):
    got = catalog._blocks(spark, SF)
    assert same(got, catalog._derived(spark, SF, f"{catalog.SYM}, {catalog._BLOCKS}", "select * from blocks", "orders", "lineitem", "customer"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join ")


def test_masses_of_equal_pairs_without_arrays(spark):
    cells = [(1, k, 0, q, t, 0.25) for k in "BF" for q in (1, 2, 3) for t in (1, 2)]
    pairs = spark.createDataFrame([(1, 1, 3, 1, 2, 1)] * 2 + [(2, 1, 1, 1, 1, 1)], "ali int, qs int, qe int, ts int, te int, off int")
    found = scoring.masses(pairs, spark.createDataFrame(cells, "ali int, kind string, ord int, q int, t int, p double"))
    assert sorted(map(tuple, found.collect())) == [(1, 1, 3, 1, 2, 1, 1.0, 1.0, 1.5, 1.5)] * 2 + [(2, 1, 1, 1, 1, 1, 0.0, 0.0, 0.0, 0.0)]
    assert nodes(found, "collect_list") == 0


def test_a_worker_holds_a_bounded_chunk():
    assert components.CHUNK_ROWS <= 500_000


def test_cells_and_pairs_are_dealt_once(spark):
    """Masses stay where lines and pairs of an alignment were dealt to; lines go with three columns, alike for all steps."""
    plan = catalog.QUERIES["pair_score"](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    kinds = {re.sub(r"#\d+L?|, \[plan_id=\d+\]|^[ :+-]*", "", x) for x in plan if "Exchange hashpartitioning" in x}
    assert {x for x in kinds if "(ali, " in x and not re.search(r"\(ali, \d+\)", x)} == set()
    scans = {re.sub(r"#\d+L?|^[ :+*()\d-]*", "", x) for x in plan if "FileScan" in x and "lineitem" in x}
    assert len(scans) == 1 and "FileScan parquet [l_orderkey,l_partkey,l_linenumber]" in scans.pop()
    found = scoring.masses(catalog._pairs(spark, SF).repartition("ali"), catalog._cells(spark, SF))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 3  # lines, distinct orders of lines and these by ali


def test_lines_alike_in_number_and_part_are_placed_as_in_the_sql(spark, tmp_path):
    rng = random.Random(13)
    rows = [(o, rng.choice([1, 2]), s, rng.choice([1, 2, 3]), float(s % 5), None) for s, o in enumerate([1, 2, 3] * 12)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = catalog._derived(spark, str(tmp_path), catalog.CELLS, "select ali, kind, 0 as ord, q, t, power(2.0D, floor(c / 16) - 15) * (1 + (c % 16) / 16.0D) as p from coded", "lineitem")
    assert same(catalog._cells(spark, str(tmp_path)), want)


def test_shells_of_equal_pairs_are_told_as_often_and_not_added_up(spark):
    post = spark.createDataFrame([(1, 1, 1, 0.25), (1, 2, 2, 0.5)], "ali int, q int, t int, p double")
    pairs = spark.createDataFrame([(1, 1, 1, 1)] * 2 + [(2, 1, 1, 1)], "ali int, qs int, ts int, off int")
    assert sorted(map(tuple, scoring.starts_after(pairs, post).collect())) == [(1, 1, 1, 1, 0.25)] * 2 + [(2, 1, 1, 1, 0.0)]


def test_scores_take_the_last_of_a_repeated_place_and_whole_alignments(spark):
    cells = [("B", 0, 1, 1, 0.5), ("F", 0, 2, 2, 0.5), ("P", 1, 1, 1, 0.5), ("P", 0, 1, 1, 0.25), ("P", 0, 2, 2, 0.5), ("P", 0, 4, 4, 0.125)]
    cells = [(a, *c) for a, lacks in ((1, ""), (2, "F"), (3, "P"), (4, "B")) for c in cells if c[0] != lacks]
    cells = spark.createDataFrame(cells, "ali int, kind string, ord int, q int, t int, p double")
    alignments = spark.createDataFrame([(a, "a", "b", 100) for a in (1, 2, 3, 4, 5)], "ali int, query string, template string, probability int")
    fragments = spark.createDataFrame([("a", 1, 1, 0, 1, 2), ("b", 1, 2, 0, 1, 2)], "seq string, domain_no int, line_no int, frag_no int, start int, end int")
    assert [tuple(r) for r in scoring.pair_scores(alignments, fragments, cells, 0.01).collect()] == [(1, 1, 1, 1 / 64)]
