"""Relations of interval domains on the same sequence, and the merge of their clusters.

fragments(seq, domain, start, end); domains(seq, domain, frags), frags being an
array of structs (start, end, pos) by start; members(cluster, seq, domain, frags).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.operators.components import connected_components, materialize
from spanweave.operators.order import ranked

#: A group of so many members of different shapes at most is merged in one task.
TASK_MEMBERS = 1_000_000
#: Numbers from here on are clusters with a name; numbered clusters come before them.
_NAMED = 1 << 40
RELATIONS = ["upstream", "downstream", "included", "encloses"]


def positions(fragments: DataFrame) -> DataFrame:
    """fragments with pos, a fragment's ordinal on its sequence, from 1."""
    return fragments.withColumn("pos", F.row_number().over(Window.partitionBy("seq").orderBy("start", "end")))


def neighbours(fragments: DataFrame) -> DataFrame:
    """fragments with the domains of the fragments before and after on the sequence."""
    w = Window.partitionBy("seq").orderBy("start", "end")
    return fragments.withColumn("up", F.lag("domain").over(w)).withColumn("down", F.lead("domain").over(w))


def domains(fragments: DataFrame) -> DataFrame:
    return positions(fragments).groupBy("seq", "domain").agg(F.array_sort(F.collect_list(F.struct("start", "end", "pos"))).alias("frags"))


def invalid_domains(fragments: DataFrame) -> DataFrame:
    """Fragments that end before they start, start before 1, or overlap or enclose the next of their sequence."""
    w = Window.partitionBy("seq").orderBy("start", "end")
    return fragments.withColumn("__next", F.lead("start").over(w)).where("start > end or start < 1 or __next <= end").drop("__next")


def checked(fragments: DataFrame) -> DataFrame:
    """fragments, refused if one is invalid."""
    bad = invalid_domains(fragments).first()
    if bad is not None:
        raise ValueError(f"invalid fragment {bad['start']}-{bad['end']} of domain {bad['domain']} on {bad['seq']}")
    return fragments


def find_neighbours(a: Column, b: Column) -> tuple[Column, Column]:
    """The fragments of b next to a on either side, if no fragment of b lies beside or inside a's span; else nulls."""
    before = F.size(F.filter(b, lambda f: f["end"] < a[0]["start"]))
    after = F.size(F.filter(b, lambda f: f["start"] > F.element_at(a, -1)["end"]))
    clear = before + after == F.size(b)
    left = F.when(clear & (before > 0), F.get(b, before - 1))
    return left, F.when(clear & (after > 0), F.get(b, before))


def relation(a: Column, b: Column) -> Column:
    """0 to 3 as in RELATIONS, or null: how a lies to b."""
    left, right = find_neighbours(a, b)
    b_left, b_right = find_neighbours(b, a)
    first, last = lambda x: x[0]["pos"], lambda x: F.element_at(x, -1)["pos"]
    near_left, near_right = left["pos"] + 1 == first(a), last(a) == right["pos"] - 1
    encloses = (b_left["pos"] + 1 == first(b)) & (last(b) == b_right["pos"] - 1)
    return (
        F.when(left.isNull() & right.isNull(), F.when(encloses, 3))
        .when(left.isNull(), F.when(near_right, 0))
        .when(right.isNull(), F.when(near_left, 1))
        .otherwise(F.when(near_left & near_right, 2))
    )


def member_pairs(members: DataFrame) -> DataFrame:
    """(seq, cluster_a, domain_a, cluster_b, domain_b, relation) of members of different clusters on one sequence."""
    a = members.select("seq", F.col("cluster").alias("cluster_a"), F.col("domain").alias("domain_a"), F.col("frags").alias("fa"))
    b = members.select("seq", F.col("cluster").alias("cluster_b"), F.col("domain").alias("domain_b"), F.col("frags").alias("fb"))
    return a.join(b, "seq").where("cluster_a <> cluster_b").select("seq", "cluster_a", "domain_a", "cluster_b", "domain_b", relation(F.col("fa"), F.col("fb")).alias("relation"))


def relations(members: DataFrame) -> DataFrame:
    """(seq, cluster_a, domain_a, cluster_b, domain_b, relation): the pairs of member_pairs() that have a relation.

    Such members are neighbours in position: the first begins right after the last place
    of the second or the other way round, or it fills the room between two consecutive
    fragments of the second. So members meet by sequence and position, one row for each
    end and each gap, and never all members of a sequence.
    """
    side = lambda x, *more: (F.col("cluster").alias(f"cluster_{x}"), F.col("domain").alias(f"domain_{x}"), *more)
    first, last = F.col("frags")[0]["pos"], F.element_at("frags", -1)["pos"]
    before = members.select("seq", *side("a", (last + 1).alias("at"))).join(members.select("seq", *side("b", first.alias("at"))), ["seq", "at"]).drop("at")
    steps = F.transform(F.slice("frags", F.lit(2), F.greatest(F.size("frags") - 1, F.lit(0))), lambda f, i: F.struct((F.get("frags", i)["pos"] + 1).alias("lo"), (f["pos"] - 1).alias("hi")))
    room = members.where(F.size("frags") > 1).select("seq", *side("b", F.inline(F.filter(steps, lambda g: g["hi"] >= g["lo"]))))
    inside = members.select("seq", *side("a", first.alias("lo"), last.alias("hi"))).join(room, ["seq", "lo", "hi"]).drop("lo", "hi")
    turned = lambda k: F.struct("seq", F.col("cluster_b").alias("cluster_a"), F.col("domain_b").alias("domain_a"), F.col("cluster_a").alias("cluster_b"), F.col("domain_a").alias("domain_b"), F.lit(k).alias("relation"))
    both = lambda df, k: df.where("cluster_a <> cluster_b").select(F.inline(F.array(F.struct("seq", "cluster_a", "domain_a", "cluster_b", "domain_b", F.lit(k).alias("relation")), turned(k + 1))))
    return both(before, 0).union(both(inside, 2))


def cluster_intersections(members: DataFrame) -> DataFrame:
    """Pairs of clusters that share a sequence."""
    own = members.select("cluster", "seq").distinct()
    return own.select(F.col("cluster").alias("cluster_a"), "seq").join(own.select(F.col("cluster").alias("cluster_b"), "seq"), "seq").where("cluster_a <> cluster_b").select("cluster_a", "cluster_b").distinct()


def relation_shares(members: DataFrame) -> DataFrame:
    """(cluster_a, cluster_b, p_up, p_down, p_inc, p_enc): pairs of each relation over the size of b, where there is any."""
    size = members.groupBy(F.col("cluster").alias("cluster_b")).agg(F.count("*").alias("n"))
    counts = relations(members).groupBy("cluster_a", "cluster_b").agg(*[F.count_if(F.col("relation") == i).alias(f"c{i}") for i in range(4)])
    return counts.join(size, "cluster_b").select("cluster_a", "cluster_b", *[(F.col(f"c{i}") / F.col("n")).alias(f"p_{k}") for i, k in enumerate(("up", "down", "inc", "enc"))])


def best_relation(shares: DataFrame, cut_off: float = 0.98) -> DataFrame:
    """The relation of greatest share, the first of equals, where it is over the cut-off."""
    top = F.greatest("p_up", "p_down", "p_inc", "p_enc")
    which = F.when(F.col("p_up") == top, 0).when(F.col("p_down") == top, 1).when(F.col("p_inc") == top, 2).otherwise(3)
    return shares.select("cluster_a", "cluster_b", which.alias("relation"), top.alias("share")).where(F.col("share") > cut_off)


def merge_once(members: DataFrame, cluster_a: str, cluster_b: str, relation_no: int) -> DataFrame:
    """members after two clusters' pairs of one relation became the members of a new cluster a+b."""
    name = f"{cluster_a}+{cluster_b}"
    pairs = relations(members.where(F.col("cluster").isin(cluster_a, cluster_b))).where((F.col("cluster_a") == cluster_a) & (F.col("cluster_b") == cluster_b) & (F.col("relation") == relation_no))
    of = lambda c, d, f: members.where(F.col("cluster") == c).select("seq", F.col("domain").alias(d), F.col("frags").alias(f))
    merged = pairs.join(of(cluster_a, "domain_a", "fa"), ["seq", "domain_a"]).join(of(cluster_b, "domain_b", "fb"), ["seq", "domain_b"]).select(
        F.lit(name).alias("cluster"), "seq", F.concat_ws("+", "domain_a", "domain_b").alias("domain"), F.array_sort(F.concat("fa", "fb")).alias("frags")
    )
    gone = pairs.select(F.col("cluster_a").alias("cluster"), "seq", F.col("domain_a").alias("domain")).union(pairs.select("cluster_b", "seq", "domain_b"))
    return members.join(gone.distinct(), ["cluster", "seq", "domain"], "left_anti").select("cluster", "seq", "domain", "frags").union(merged)


def _beside(a: list, b: list) -> tuple:
    before = sum(f[1] < a[0][0] for f in b)
    after = sum(f[0] > a[-1][1] for f in b)
    if before + after != len(b):
        return None, None
    return (b[before - 1] if before else None), (b[before] if after else None)


def _relate(a: list, b: list) -> int | None:
    left, right = _beside(a, b)
    if left is None and right is None:
        left, right = _beside(b, a)
        return 3 if left and right and left[2] + 1 == b[0][2] and b[-1][2] == right[2] - 1 else None
    if left is None:
        return 0 if a[-1][2] == right[2] - 1 else None
    if right is None:
        return 1 if left[2] + 1 == a[0][2] else None
    return 2 if left[2] + 1 == a[0][2] and a[-1][2] == right[2] - 1 else None


def merge_round(clusters: dict, cut_off: float, first: int = 1) -> tuple[dict, int]:
    """(clusters, merges) after one round: each pair of keys in order, integers first; merged clusters get the keys from first on."""
    merged: dict = {}
    order = sorted(clusters, key=lambda k: (isinstance(k, str), k))
    for ka in order:
        for kb in order:
            if ka == kb:
                continue
            on: dict = {}
            for m in clusters[kb]:
                on.setdefault(m[0], []).append(m)
            pairs = [(x, y, _relate(x[2], y[2])) for x in clusters[ka] for y in on.get(x[0], ())]
            if not pairs:
                continue
            counts = [sum(r == i for _, _, r in pairs) for i in range(4)]
            best = max(counts)
            if not best / len(clusters[kb]) > cut_off:
                continue
            taken = [(x, y) for x, y, r in pairs if r == counts.index(best)]
            gone = {id(x) for p in taken for x in p}
            clusters[ka] = [x for x in clusters[ka] if id(x) not in gone]
            clusters[kb] = [x for x in clusters[kb] if id(x) not in gone]
            merged[first + len(merged)] = [(x[0], f"{x[1]}+{y[1]}", sorted(x[2] + y[2])) for x, y in taken]
    return {k: v for k, v in clusters.items() if v} | merged, len(merged)


def merge_group(clusters: dict, cut_off: float, max_rounds: int = 1000, compat_key_reuse: bool = False, rounds: int | None = None) -> dict:
    """clusters: key -> list of (seq, domain, frags). merge_round again until nothing merges, or so many rounds.

    Merged clusters get fresh keys. compat_key_reuse: they count from 0 in each round, so
    that a later round's clusters replace an earlier round's of the same key, and are lost.
    """
    fresh = 0 if compat_key_reuse else 1
    for _ in range(max_rounds if rounds is None else rounds):
        clusters, n = merge_round(clusters, cut_off, fresh)
        if not n:
            return clusters
        fresh += 0 if compat_key_reuse else n
    if rounds is None:
        raise RuntimeError(f"clusters still merge after {max_rounds} rounds")
    return clusters


def _wave_round(members: DataFrame, cut_off: float) -> tuple[DataFrame, DataFrame] | None:
    """merge_round() over all clusters, in waves: (the members that stay, the merged pairs of members), or None without any.

    Pairs of clusters act on each other only if they share a cluster. So in a wave all
    pairs are worked through at once that are the first left for both their clusters, by one join with
    their related members; what they take is gone for the next wave. Pairs without
    related members take nothing and are passed over. seq is a struct(shape, n), and a member
    counts for the n sequences of its shape; domain is an array of numbers of members.
    """
    n = F.col("seq.n")
    met = materialize(relations(members), "relations")
    sizes = materialize(members.groupBy("cluster").agg(F.sum(n).alias("n")), "sizes")
    left = materialize(met.select("cluster_a", "cluster_b").distinct(), "pairs")
    gone = taken = None
    while not left.isEmpty():
        pair = F.struct("cluster_a", "cluster_b")
        first = left.select(F.explode(F.array("cluster_a", "cluster_b")).alias("c"), pair.alias("pair")).groupBy("c").agg(F.min("pair").alias("first"))
        of = lambda x: first.select(F.col("c").alias(f"cluster_{x}"), F.col("first").alias(f"first_{x}"))  # noqa: E731, B023
        ready = materialize(left.join(of("a"), "cluster_a").join(of("b"), "cluster_b").where((F.col("first_a") == pair) & (F.col("first_b") == pair)).select("cluster_a", "cluster_b"), "ready")
        live, now = met.join(ready, ["cluster_a", "cluster_b"], "left_semi"), sizes
        if gone is not None:
            for x in "ab":
                live = live.join(gone.select(F.col("cluster").alias(f"cluster_{x}"), "seq", F.col("domain").alias(f"domain_{x}")), [f"cluster_{x}", "seq", f"domain_{x}"], "left_anti")
            now = sizes.join(gone.groupBy("cluster").agg(F.sum(n).alias("less")), "cluster", "left").select("cluster", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"))
        counts = live.groupBy("cluster_a", "cluster_b").agg(*[F.sum(F.when(F.col("relation") == i, n).otherwise(0)).alias(f"c{i}") for i in range(4)])
        top = F.greatest(*[f"c{i}" for i in range(4)])
        which = F.when(F.col("c0") == top, 0).when(F.col("c1") == top, 1).when(F.col("c2") == top, 2).otherwise(3)
        passed = counts.join(now.withColumnRenamed("cluster", "cluster_b"), "cluster_b").where(top / F.col("n") > cut_off).select("cluster_a", "cluster_b", which.alias("relation"))
        new = materialize(live.join(passed, ["cluster_a", "cluster_b", "relation"], "left_semi").drop("relation"), "taken")
        if not new.isEmpty():
            own = new.select("seq", F.inline(F.array(*[F.struct(F.col(f"cluster_{x}").alias("cluster"), F.col(f"domain_{x}").alias("domain")) for x in "ab"]))).distinct()
            gone, taken = (own, new) if gone is None else (gone.unionByName(own), taken.unionByName(new))
        left = materialize(left.join(ready, ["cluster_a", "cluster_b"], "left_anti"), "pairs")
    if taken is None:
        return None
    of = lambda x: members.select("seq", F.col("cluster").alias(f"cluster_{x}"), F.col("domain").alias(f"domain_{x}"), F.col("frags").alias(f"f{x}"))
    merged = taken.join(of("a"), ["seq", "cluster_a", "domain_a"]).join(of("b"), ["seq", "cluster_b", "domain_b"])
    stay = members.join(gone, ["cluster", "seq", "domain"], "left_anti")
    return stay, merged.select(F.struct("cluster_a", "cluster_b").alias("pair"), "seq", F.concat("domain_a", "domain_b").alias("domain"), F.array_sort(F.concat("fa", "fb")).alias("frags"))


def _merge_in_waves(members: DataFrame, cut_off: float, compat_key_reuse: bool, rounds: int | None, max_rounds: int = 1000) -> DataFrame:
    """merge_clusters() of members(grp, cluster, seq, domain, frags) by waves over all groups."""
    key = lambda grp, named, num, name: F.struct(grp.alias("grp"), named.alias("named"), num.cast("long").alias("num"), name.alias("name")).alias("cluster")
    now = materialize(members.select(key(F.col("grp"), F.lit(True), F.lit(0), F.col("cluster").cast("string")), "seq", "domain", "frags"), "members")
    for _ in range(max_rounds if rounds is None else rounds):
        done = _wave_round(now, cut_off)
        if done is None:
            break
        stay, merged = done
        merged = materialize(merged, "merged")
        pairs = ranked(merged.select("pair").distinct().withColumn("grp", F.col("pair.cluster_a.grp")), ["grp", "pair"])
        # a row for each group: where its numbers start
        start = pairs.groupBy("grp").agg(F.min("__rank").alias("__first"))
        used = now.where("not cluster.named").groupBy("cluster.grp").agg((F.max("cluster.num") + 1).alias("__next"))
        fresh = F.lit(0) if compat_key_reuse else F.coalesce("__next", F.lit(1))
        numbered = pairs.join(start, "grp").join(used, "grp", "left").select("pair", key(F.col("grp"), F.lit(False), F.col("__rank") - F.col("__first") + fresh, F.lit("")))
        numbered = materialize(numbered, "numbers")
        if compat_key_reuse:
            stay = stay.join(numbered.select("cluster"), "cluster", "left_anti")
        now = materialize(stay.select("cluster", "seq", "domain", "frags").unionByName(merged.join(numbered, "pair").select("cluster", "seq", "domain", "frags")), "members")
    else:
        if rounds is None:
            raise RuntimeError(f"clusters still merge after {max_rounds} rounds")
    name = F.when(F.col("cluster.named"), F.col("cluster.name")).otherwise(F.col("cluster.num").cast("string"))
    return now.select("cluster.grp", name.alias("cluster"), "seq", "domain", "frags")


def _met(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places with equal keys."""
    order = np.argsort(right, kind="stable")
    lo, hi = (np.searchsorted(right[order], left, side) for side in ("left", "right"))
    a = np.repeat(np.arange(len(left)), hi - lo)
    nth = np.arange(len(a)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    return a, order[lo[a] + nth]


def _task_relations(seq: np.ndarray, cluster: np.ndarray, places: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """relations() of a task's members, by number: (a, b, relation); places: each member's positions in order."""
    first, last = (np.array([p[k] for p in places], np.int64) for k in (0, -1))
    room = [(i, x + 1, y - 1) for i, p in enumerate(places) for x, y in zip(p, p[1:]) if y > x + 1]
    owner, lo, hi = np.array(room, np.int64).reshape(-1, 3).T
    wide = int(last.max()) + 2
    a, b = _met(seq * wide + last + 1, seq * wide + first)
    start = np.unique(np.concatenate((seq * wide + first, seq[owner] * wide + lo)), return_inverse=True)[1]
    c, d = _met(start[: len(seq)] * wide + last, start[len(seq) :] * wide + hi)
    d = owner[d]
    kinds = np.repeat(np.arange(4), [len(a), len(a), len(c), len(c)])
    a, b = np.concatenate((a, b, c, d)), np.concatenate((b, a, d, c))
    other = cluster[a] != cluster[b]
    return a[other], b[other], kinds[other]


def _task_round(seq: np.ndarray, cluster: np.ndarray, weight: np.ndarray, places: list, cut_off: float) -> tuple[np.ndarray, list]:
    """merge_round() of members that count ``weight`` times: which stay, and for each merge its pairs of members (x, y)."""
    code = np.unique(cluster, return_inverse=True)[1]
    a, b, kind = _task_relations(seq, code, places)
    order = np.lexsort((code[b], code[a]))
    a, b, kind, n = a[order], b[order], kind[order], weight[a[order]]
    stays, size = np.ones(len(seq), bool), np.bincount(code, weights=weight)
    begins = np.flatnonzero(np.diff(code[a], prepend=-1) | np.diff(code[b], prepend=-1))
    pair = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(a))))
    most = np.bincount(pair * 4 + kind, weights=n, minlength=4 * len(begins)).reshape(-1, 4).max(1)  # what is left of a pair has no more
    merges = []
    for top, lo, hi, whole in zip(most, begins, np.append(begins[1:], len(a)), code[b[begins]]):
        if not size[whole] or not top / size[whole] > cut_off:
            continue
        live = lo + np.flatnonzero(stays[a[lo:hi]] & stays[b[lo:hi]])
        counts = np.bincount(kind[live], weights=n[live], minlength=4)
        if not counts.max() / size[whole] > cut_off:
            continue
        live = live[kind[live] == counts.argmax()]
        gone = np.unique(np.concatenate((a[live], b[live])))
        stays[gone] = False
        np.subtract.at(size, code[gone], weight[gone])
        merges.append((a[live], b[live]))
    return stays, merges


def merge_weighted(names: list, seq: np.ndarray, weight: np.ndarray, places: list, cut_off: float, rounds: int | None = None, compat_key_reuse: bool = False, max_rounds: int = 1000) -> tuple[list, np.ndarray, list]:
    """merge_group() of members that count ``weight`` times, over arrays: the clusters, sequences and parts (numbers of members) of what it leaves.

    Relations are looked up once a round, and a pair of clusters sees its own only.
    """
    known, rank = np.unique(np.array(names, object), return_inverse=True)
    cluster, parts, fresh = _NAMED + rank.astype(np.int64), [(i,) for i in range(len(names))], 0 if compat_key_reuse else 1
    for _ in range(max_rounds if rounds is None else rounds):
        stays, merges = _task_round(seq, cluster, weight, places, cut_off) if len(seq) else (None, None)
        if not merges:
            break
        if compat_key_reuse:
            stays &= cluster >= len(merges)
        x, y = (np.concatenate(v) for v in zip(*merges))
        left, number = np.flatnonzero(stays), np.repeat(np.arange(len(merges)), [len(m[0]) for m in merges])
        places = [places[i] for i in left] + [sorted(places[i] + places[k]) for i, k in zip(x, y)]
        parts = [parts[i] for i in left] + [parts[i] + parts[k] for i, k in zip(x, y)]
        cluster, seq, weight = np.append(cluster[left], number + fresh), np.append(seq[left], seq[x]), np.append(weight[left], weight[x])
        fresh += 0 if compat_key_reuse else len(merges)
    else:
        if rounds is None:
            raise RuntimeError(f"clusters still merge after {max_rounds} rounds")
    return [known[c - _NAMED] if c >= _NAMED else str(c) for c in cluster], seq, parts


def merge_clusters(members: DataFrame, cut_off: float = 0.98, rounds: int | None = None, compat_key_reuse: bool = False, task_members: int = TASK_MEMBERS) -> DataFrame:
    """(grp, cluster, seq, domain, frags) after merging until nothing merges, or after so many rounds.

    What happens on a sequence follows from its shape, the clusters and positions of its
    members, and from the decisions on pairs of clusters, which count sequences. So sequences of one
    shape fare alike: shapes are merged, each counting for all its sequences, and
    each sequence's members are then put together as its shape's were.

    Clusters act on each other only through shared sequences, and a merged cluster
    has only its parents' sequences, so the components of the cluster-shape
    graph stay apart: each is one group. Groups of up to task_members members of shapes are
    worked through in order, each in one task; larger ones in waves over all their
    members, with the same result. With compat_key_reuse keys must meet across groups,
    so all members are one group.
    """
    own = F.struct(F.col("cluster").cast("string").alias("cluster"), F.transform("frags", lambda f: f["pos"]).alias("at"), F.col("domain").cast("string").alias("domain"), "frags")
    seqs = members.where("cluster is not null").groupBy("seq").agg(F.array_sort(F.collect_list(own)).alias("own"))
    shape = F.transform("own", lambda m: F.struct(m["cluster"].alias("cluster"), F.transform(m["at"], lambda p: F.struct(p.alias("pos"))).alias("frags")))
    seqs = materialize(seqs.withColumn("shape", F.sha2(F.to_json(shape), 256)), "sequences")
    known = seqs.groupBy("shape").agg(F.count("*").alias("n"), F.first(shape).alias("of"))
    known = materialize(known.select(F.struct("shape", "n").alias("seq"), F.posexplode("of").alias("no", "m")).select("seq", "no", "m.cluster", "m.frags"), "shapes")
    links = known.select(F.concat(F.lit("c:"), "cluster").alias("src"), F.concat(F.lit("s:"), "seq.shape").alias("dst")).distinct()
    group = connected_components(links).where(F.col("node").startswith("c:")).select(F.substring("node", 3, 1 << 30).alias("cluster"), F.col("component").alias("grp"))
    grouped = materialize(known.withColumn("grp", F.lit("all")) if compat_key_reuse else known.join(group, "cluster"), "grouped")
    sizes = materialize(grouped.groupBy("grp").agg((F.count("*") > task_members).alias("large")), "groups")
    large = sizes.where("large").select("grp")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        no, (seq, shapes) = pdf["no"].to_numpy(), pdf["shape"].factorize()
        cluster, at, parts = merge_weighted(pdf["cluster"].tolist(), seq, pdf["n"].to_numpy(), [p.tolist() for p in pdf["at"]], cut_off, rounds, compat_key_reuse)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "cluster": cluster, "shape": shapes[at], "parts": [no[list(p)] for p in parts]})

    flat = grouped.join(large, "grp", "left_anti").select("grp", "cluster", "seq.shape", "seq.n", "no", F.transform("frags", lambda f: f["pos"]).alias("at"))
    done = flat.groupBy("grp").applyInPandas(run, "grp string, cluster string, shape string, parts array<int>")
    if not large.isEmpty():
        waves = _merge_in_waves(grouped.join(large, "grp", "left_semi").withColumn("domain", F.array("no")), cut_off, compat_key_reuse, rounds)
        done = done.unionByName(waves.select("grp", "cluster", "seq.shape", F.col("domain").alias("parts")))
    told = materialize(done.groupBy("shape").agg(F.collect_list(F.struct("grp", "cluster", "parts")).alias("done")), "merged")
    of = seqs.join(told, "shape").select("seq", "own", F.inline("done"))
    part = lambda field: F.transform("parts", lambda i: F.get("own", i)[field])
    domain = F.when(F.size("parts") == 1, F.get(part("domain"), 0)).otherwise(F.array_join(part("domain"), "+"))
    frags = F.array_sort(F.flatten(part("frags"))).cast("array<struct<start:bigint,end:bigint,pos:int>>")
    return of.select("grp", "cluster", F.col("seq").cast("string").alias("seq"), domain.alias("domain"), frags.alias("frags"))


def renumbered(members: DataFrame) -> DataFrame:
    """(seq, seq_n, intervals): domains numbered from 1 on their sequence, by cluster and place."""
    n = F.row_number().over(Window.partitionBy("seq").orderBy("cluster", F.col("frags")[0]["start"], "domain"))
    text = F.array_join(F.transform("frags", lambda f: F.concat_ws("-", f["start"].cast("string"), f["end"].cast("string"))), ",")
    return members.select("seq", F.concat_ws("_", "seq", n.cast("string")).alias("seq_n"), text.alias("intervals"))
