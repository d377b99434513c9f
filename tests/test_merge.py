"""Relations by position against all pairs; merges in waves against merges one after the other."""

import random

import pytest

from spanweave.operators import intervals

MEMBER = "cluster string, seq string, domain string, frags array<struct<start:bigint,end:bigint,pos:int>>"


def random_members(seed, seqs, clusters, shared=False):
    """Sequences cut into fragments that domains of random clusters take; with ``shared`` some fragments are in two domains, as after merges."""
    rng, rows = random.Random(seed), []
    for q in range(seqs):
        own = {}
        for pos in range(1, rng.randrange(2, 9)):
            for c in rng.sample(clusters, 2 if shared and rng.random() < 0.3 else 1):
                own.setdefault(c, []).append((10 * pos, 10 * pos + 5, pos))
        rows += [(c, f"s{q}", f"{c}{q}", f) for c, f in own.items()]
    return rows


@pytest.mark.parametrize("shared", [False, True])
def test_relations_are_those_of_all_pairs(spark, shared):
    members = spark.createDataFrame(random_members(1, 200, ["x", "y", "z", "w"], shared), MEMBER)
    got = sorted(map(tuple, intervals.relations(members).collect()))
    assert got == sorted(map(tuple, intervals.member_pairs(members).where("relation is not null").collect()))
    assert {r[5] for r in got} == {0, 1, 2, 3}


def grown(rows):
    """All of a sequence's clusters in one group: the first sequence has a member of each."""
    return rows + [(c, "all", f"{c}all", [(10 * i, 10 * i + 5, i)]) for i, c in enumerate(sorted({r[0] for r in rows}), 1)]


@pytest.mark.parametrize("seed, names, cut, rounds, reuse", [(2, "xyz", 0.3, 2, False), (4, "xyz", 0.2, 1, True)])
def test_waves_merge_as_one_after_the_other(spark, seed, names, cut, rounds, reuse):
    members = spark.createDataFrame(grown(random_members(seed, 25, list(names))), MEMBER)
    said = lambda df: sorted((r.grp, r.cluster, r.seq, r.domain, tuple(map(tuple, r.frags))) for r in df.collect())
    one = said(intervals.merge_clusters(members, cut, rounds, reuse))
    assert any(r[1].isdigit() for r in one)  # something merged
    assert said(intervals.merge_clusters(members, cut, rounds, reuse, task_members=0)) == one


def test_groups_of_either_size(spark):
    """Groups that share no sequence: the larger in waves, the smaller in a task."""
    rows = [("a", "s1", "a1", [(1, 2, 1)]), ("b", "s1", "b1", [(3, 4, 2)])]
    rows += [(c, f"t{i}", f"{c}{i}", [(1 + 5 * k, 4 + 5 * k, 1 + k)]) for i in range(4) for k, c in enumerate("xy")]
    done = intervals.merge_clusters(spark.createDataFrame(rows, MEMBER), task_members=3)
    assert sorted((r.cluster, r.domain) for r in done.collect()) == [("1", "a1+b1"), *[("1", f"x{i}+y{i}") for i in range(4)]]


def test_sequences_of_one_shape_are_merged_once(spark, monkeypatch):
    """Copies of sequences, with other coordinates and domains, count but are not worked through; merged as each by itself."""
    few = random_members(6, 12, list("xyz"))
    rows = [(c, f"{s}.{k}", f"{d}.{k}", [(k + a, k + b, p) for a, b, p in f]) for c, s, d, f in few for k in range(9 if s < "s5" else 4)]
    clusters = {}
    for c, *m in rows:
        clusters.setdefault(c, []).append(tuple(m))
    want = intervals.merge_group(clusters, 0.2)
    assert len(want) > 3
    want = sorted((str(c), s, d, tuple(f)) for c, v in want.items() for s, d, f in v)
    said = lambda df: sorted((r.cluster, r.seq, r.domain, tuple(map(tuple, r.frags))) for r in df.collect())
    waves, seen = intervals._merge_in_waves, []
    monkeypatch.setattr(intervals, "_merge_in_waves", lambda members, *more: seen.append(members.count()) or waves(members, *more))
    members = spark.createDataFrame(rows, MEMBER)
    assert said(intervals.merge_clusters(members, 0.2, task_members=len(few))) == want and not seen
    assert said(intervals.merge_clusters(members.where("cluster < 'z'"), 0.2, rounds=1, task_members=0)) == said(intervals.merge_clusters(members.where("cluster < 'z'"), 0.2, rounds=1))
    assert seen[0] <= len(few)
