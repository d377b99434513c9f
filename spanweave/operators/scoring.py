"""Scores of domain pairs from sparse alignment matrices.

fragments(seq, domain_no, line_no, frag_no, start, end); alignments(ali, query,
template, ...); cells(ali, kind, ord, q, t, p), kind B, F or P.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def domain_bounds(fragments: DataFrame) -> DataFrame:
    """(seq, domain_no, first, last, len, end_key): bounds of a domain and its place in the order of visits.

    last is the end of the fragment that starts last; visits go by the least
    fragment end, then by the place in the file.
    """
    return fragments.groupBy("seq", "domain_no").agg(
        F.min("start").alias("first"), F.max_by("end", F.struct("start", "end")).alias("last"),
        F.sum(F.col("end") - F.col("start") + 1).alias("len"), F.min(F.struct("end", "line_no", "frag_no")).alias("visit"),
    )


def match_offset(length: Column, coverage: float = 0.8) -> Column:
    """Places by which a match may miss a domain's bound."""
    half = F.abs(F.ceil((length - 10) / F.lit(2.0)))
    return F.greatest(F.lit(1), F.least(half, F.ceil(length * (F.lit(1.0) - F.lit(coverage))))).cast("int")


def prefix_stop(alignments: DataFrame, p_low: float = 0.1) -> DataFrame:
    """Alignments of an entry before the first that is to itself or under p_low (probability in percent)."""
    stop = ((F.col("query") == F.col("template")) | (F.col("probability") / F.lit(100.0) < p_low)).cast("int")
    seen = F.max(stop).over(Window.partitionBy("entry").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return alignments.withColumn("__stop", seen).where("__stop = 0").drop("__stop")


def position_profile(cells: DataFrame) -> DataFrame:
    """(ali, q, p): share of an alignment's mass at each query position."""
    by = cells.groupBy("ali", "q").agg(F.sum("p").alias("s"))
    return by.select("ali", "q", F.try_divide("s", F.sum("s").over(Window.partitionBy("ali"))).alias("p"))


#: Masses of a pair: the kind and the axis of the cells, and the last place that counts; F cells are counted from the last place back, so theirs are negative.
_MASSES = {"qstart": ("B", "q", "qs + off"), "qend": ("F", "q", "off - qe"), "tstart": ("B", "t", "ts + off"), "tend": ("F", "t", "off - te")}


def masses(pairs: DataFrame, cells: DataFrame, *names: str) -> DataFrame:
    """pairs(ali, qs, qe, ts, te, off, ...) with the masses qstart, qend, tstart and tend, or those named; 0 without cells.

    A pair's bounds stand among the cells of its alignment, by place, and are told the running
    sum. So cells are added up once, whatever the number of pairs, and rows are linear in both.
    """
    names = names or tuple(_MASSES)
    keys = [c for c in pairs.columns if c != "ali"]
    of = {kind: [F.struct(F.lit(i).alias("of"), (F.col(axis) if kind == "B" else -F.col(axis)).cast("long").alias("place")) for i, (k, axis, _) in enumerate(_MASSES[n] for n in names) if k == kind] for kind in "BF"}
    told_in = lambda make: F.when(F.col("kind") == "B", make(of["B"])).otherwise(make(of["F"]))
    once = len(of["B"]) == len(of["F"]) == 1
    # both are dealt by ali, unless they are so already; the union, the sums and the groups then stay where they are
    entries = cells.repartition("ali").where("kind in ('B', 'F')")
    if once:
        entries = entries.select("ali", "p", *[told_in(lambda x: x[0][c]).alias(c) for c in ("of", "place")])  # noqa: B023
    else:
        entries = entries.select("ali", "p", F.inline(told_in(lambda x: F.array(*x))))
    bounds = F.array(*[F.struct(F.lit(i).alias("of"), F.expr(_MASSES[n][2]).cast("long").alias("place")) for i, n in enumerate(names)])
    asked = pairs.repartition("ali").select("ali", F.lit(None).cast("double").alias("p"), F.struct(*keys).alias("pair"), F.inline(bounds))
    both = entries.withColumn("pair", F.lit(None).cast(asked.schema["pair"].dataType)).unionByName(asked)
    up_to = Window.partitionBy("ali", "of").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumn("mass", F.coalesce(F.sum("p").over(up_to), F.lit(0.0))).where("pair is not null")
    mass = [F.max(F.when(F.col("of") == i, F.col("mass"))).alias(n) for i, n in enumerate(names)]
    met = told.groupBy("ali", "pair").agg(F.count_if(F.col("of") == 0).cast("int").alias("__same"), *mass)  # equal pairs are told as often as they are given
    return met.withColumn("__same", F.explode(F.sequence(F.lit(1), "__same"))).select(*["ali" if c == "ali" else f"pair.{c}" for c in pairs.columns], *names)


def posterior(cells: DataFrame) -> DataFrame:
    """(ali, q, t, p) of the P cells, the last of a repeated place."""
    return cells.where("kind = 'P'").groupBy("ali", "q", "t").agg(F.max_by("p", "ord").alias("p"))


def _sizes(post: DataFrame) -> DataFrame:
    return post.groupBy("ali").agg(F.max("q").alias("ncol"), F.max("t").alias("nrow"))


#: Blocks of a posterior matrix: the first column and row, the side k, whether the block counts at all, and the shell of a cell at row r, column c.
_BLOCKS = {
    "sa": ("qs", "ts", "least(off, ncol - qs + 1, nrow - ts + 1)", "true", "greatest"),
    "eb": ("qe - k + 1", "te - k + 1", "least(off, qe, te)", "qe > 0 and te > 0 and qe < ncol and te < nrow", "least"),
    "sb": ("qs - k + 1", "ts - k + 1", "least(off, qs, ts)", "true", "least"),
    "ea": ("qe", "te", "least(off, ncol - qe + 1, nrow - te + 1)", "true", "greatest"),
}


def _greatest(sized: DataFrame, cells: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """keys of sized(keys, bounds, ncol, nrow) with the greatest shell sum of each named block, 0 without any.

    A block asks for its k columns, so a pair meets the P cells of these columns only, by
    (ali, q), and an alignment of many cells is not held by one task. Of a repeated place the last
    cell counts, as in posterior, but places are looked through only where a block meets them.
    """
    blocks = []
    for of, name in enumerate(names):
        q0, t0, k, counts, _ = _BLOCKS[name]
        q0, t0 = q0.replace("k", f"({k})"), t0.replace("k", f"({k})")
        blocks.append(f"if({counts} and {k} > 0, named_struct('of', {of}, 'q0', cast({q0} as int), 't0', cast({t0} as int), 'k', cast({k} as int)), null)")
    asked = sized.select(*keys, F.inline_outer(F.filter(F.expr(f"array({', '.join(blocks)})"), lambda x: x.isNotNull())))
    asked = asked.select(*keys, "of", "q0", "t0", "k", F.explode_outer(F.expr("sequence(q0, q0 + k - 1)")).alias("q"))
    cells = cells.select(F.col("ali").alias("__ali"), F.col("q").alias("__q"), "t", "p", F.col("ord").alias("__ord"))
    r, c = F.col("t") - F.col("t0"), F.col("q") - F.col("q0")
    outer = F.col("of").isin([i for i, x in enumerate(names) if _BLOCKS[x][4] == "greatest"])
    shell = F.when(outer, F.greatest(r, c)).otherwise(F.least(r, c))
    met = asked.join(cells, (F.col("ali") == F.col("__ali")) & (F.col("q") == F.col("__q")) & (r >= 0) & (r < F.col("k")), "left")
    met = met.select(*keys, "of", shell.alias("__shell"), "q", "t", "p", "__ord").repartition("ali")  # dealt once for all groups
    last = met.groupBy(*keys, "of", "__shell", "q", "t").agg(F.max_by("p", "__ord").alias("p"))
    sums = last.groupBy(*keys, "of", "__shell").agg(F.sum("p").alias("__s"))
    return sums.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("of") == i, F.col("__s"))), F.lit(0.0)).alias(x) for i, x in enumerate(names)])


def _shells(pairs: DataFrame, post: DataFrame, *names: str) -> DataFrame:
    """pairs with the greatest shell sum of each named block, 0 without any; equal pairs are told as often as they are given."""
    given = pairs.groupBy(*pairs.columns).agg(F.count("*").cast("int").alias("__same"))
    best = _greatest(given.join(_sizes(post), "ali", "left"), post.withColumn("ord", F.lit(0)), given.columns, *names)
    return best.withColumn("__same", F.explode(F.sequence(F.lit(1), "__same"))).select(*pairs.columns, *names)


def starts_after(pairs: DataFrame, post: DataFrame) -> DataFrame:
    """pairs(ali, qs, ts, off, ...) with sa: greatest shell sum of the block that begins at (qs, ts)."""
    return _shells(pairs, post, "sa")


def ends_before(pairs: DataFrame, post: DataFrame) -> DataFrame:
    """pairs(ali, qe, te, off, ...) with eb: greatest shell sum of the block that ends at (qe, te); 0 on the last row or column."""
    return _shells(pairs, post, "eb")


def starts_before(pairs: DataFrame, post: DataFrame) -> DataFrame:
    """pairs with sb: as ends_before, for the block that ends at (qs, ts), wherever that is."""
    return _shells(pairs, post, "sb")


def ends_after(pairs: DataFrame, post: DataFrame, strict: bool = False) -> DataFrame:
    """pairs with ea: greatest shell sum of the block of up to off places from (qe, te) on. A place out of the matrix gives 0, or with ``strict`` an error."""
    if strict:
        far = (F.col("qe") > F.col("ncol")) | (F.col("te") > F.col("nrow"))
        sure = F.when(far, F.raise_error(F.concat_ws(" ", F.lit("a domain ends outside the matrix of"), F.col("ali").cast("string"))).cast("int")).otherwise(F.col("qe"))
        pairs = pairs.join(_sizes(post), "ali", "left").select(*[sure.alias(c) if c == "qe" else F.col(c) for c in pairs.columns])
    return _shells(pairs, post, "ea")


def parts(spark: SparkSession) -> int:
    """Partitions to deal narrow rows to by number, so that adaptive execution does not make few large tasks of them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pair_scores(alignments: DataFrame, fragments: DataFrame, cells: DataFrame, p_low: float = 0.1, coverage: float = 0.8) -> DataFrame:
    """(ali, q_domain, t_domain, score) of the domain pairs that reach the end of the pruning ladder.

    Query domains are visited in order until one has too little end mass, those
    of too little start mass are passed over; the same then for the template's.
    Alignments that lack a kind of cells are passed over. The score is the product
    of the probability, the four masses and the two shell sums, in that order.
    """
    visits = F.dense_rank().over(Window.partitionBy("seq").orderBy("visit"))
    bounds = domain_bounds(fragments).withColumn("visit", visits)
    q = bounds.select(F.col("seq").alias("query"), F.col("domain_no").alias("q_domain"), F.col("first").alias("qs"), F.col("last").alias("qe"), match_offset(F.col("len"), coverage).alias("off"), F.col("visit").alias("q_visit"))
    t = bounds.select(F.col("seq").alias("template"), F.col("domain_no").alias("t_domain"), F.col("first").alias("ts"), F.col("last").alias("te"), F.col("visit").alias("t_visit"))
    cells = cells.where("ali is not null")  # said here, all steps read one shuffle
    # alignments and cells are dealt by ali once, and steps stay there
    own = alignments.select("ali", "query", "template", (F.col("probability") / F.lit(100.0)).alias("prob")).repartition(parts(cells.sparkSession), "ali")
    up_to = lambda w: w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # the query's side of the ladder first: a template's domains meet only what is left
    m = own.join(q, "query").select("ali", "template", "prob", "q_domain", "qs", "qe", "off", "q_visit")
    m = masses(m, cells, "qstart", "qend")
    m = m.withColumn("s1", F.col("prob") * F.col("qend")).withColumn("s2", F.col("s1") * F.col("qstart"))
    q_stop = F.max((F.col("s1") < p_low).cast("int")).over(up_to(Window.partitionBy("ali").orderBy("q_visit")))
    m = m.withColumn("q_stop", q_stop).where(F.col("q_stop") == 0).where(F.col("s2") >= p_low).select("ali", "template", "q_domain", "qs", "qe", "off", "s2")
    m = m.join(t, "template").select("ali", "q_domain", "t_domain", "qs", "qe", "ts", "te", "off", "s2", "t_visit")
    m = masses(m, cells, "tstart", "tend")
    m = m.withColumn("s3", F.col("s2") * F.col("tend")).withColumn("s4", F.col("s3") * F.col("tstart"))
    t_stop = F.max((F.col("s3") < p_low).cast("int")).over(up_to(Window.partitionBy("ali", "q_domain").orderBy("t_visit")))
    m = m.withColumn("t_stop", t_stop).where(F.col("t_stop") == 0).where(F.col("s4") >= p_low).select("ali", "q_domain", "t_domain", "qs", "qe", "ts", "te", "off", "s4")
    p_cell = F.col("kind") == "P"
    whole = cells.repartition("ali").groupBy("ali").agg(*[F.max(F.col("kind") == k).alias(k) for k in "BFP"], F.max(F.when(p_cell, F.col("q"))).alias("ncol"), F.max(F.when(p_cell, F.col("t"))).alias("nrow"))
    sized = m.join(whole.where("B and F and P").select("ali", "ncol", "nrow"), "ali")
    best = _greatest(sized, cells.where(p_cell), ["ali", "q_domain", "t_domain", "s4"], "sa", "eb")
    return best.select("ali", "q_domain", "t_domain", (F.col("s4") * F.col("sa") * F.col("eb")).alias("score")).where("score <> 0")


def scores_over_one(scores: DataFrame) -> DataFrame:
    """One row: how many scores there are (n), and how many are over 1 (n_over), which sums over overlapping cells can give."""
    return scores.agg(F.count("*").alias("n"), F.count_if(F.col("score") > 1).alias("n_over"))
