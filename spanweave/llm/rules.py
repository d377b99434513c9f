"""Quality rules with risk-controlled cutoffs.

Base counts come from each whole text. Every rule compares a ratio with a cutoff
chosen per stratum (``lang``) so that few good documents fall. The good documents
(quality 1, base rule passed) of a stratum are halved by a hash of doc_id:

1. On one half each rule's aim is the strictest cutoff of its grid above which at
   most a share ``aim`` lies. A path of LEVELS steps goes from no cutoff to all aims.
2. On the other half, which had no part in the path, k of n fall under the cutoffs
   of a step (any rule counts). The step holds if P(Binomial(n, risk) <= k) <= d,
   the exact test of "more than a share ``risk`` of good documents falls"; d is
   ``error`` over the number of strata (Bonferroni). Steps are tested in order up to
   the first that fails, which needs no further correction.

So with probability 1 - ``error``, in no stratum do the rules together reject more
than ``risk`` of the good documents that pass the base rule; what the base rule
rejects comes on top. A stratum without a proven step, or without labels, keeps all
that pass the base rule; with the defaults it needs 72 good documents in the second
half at least (one stratum), 86 (four).

Null, empty and blank texts have zero counts and fail the base rule; very long texts
are counted whole. A null stratum is one, an empty one another. Rows that repeat a
doc_id are judged each, but are one trial, which falls if any of them does; a doc_id
with several labels counts by the least quality. All labelled rows are counted, no
sample. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
#: Cutoffs of each rule's ratio, from loose to strict.
GRIDS = {
    "symbols": [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "long_words": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0, 8.0],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
}
#: Steps from no cutoff to the aims.
LEVELS = 20
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"


def base_counts(text: str | None) -> tuple[int, ...]:
    """In the order of COUNTS."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    if n > 3:
        runs = list(zip(words, words[1:], words[2:]))
        many = Counter(runs)
        if len(many) < len(runs):
            last = -1
            for i, r in enumerate(runs):
                if many[r] > 1:
                    repeat += i + 2 - max(last, i - 1)
                    last = i + 2
    capitals = sum(map(raw.count, (bytes([c]) for c in range(65, 91))))
    chars = len(text) - sum(map(text.count, BLANKS))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat, lines, capitals


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum) and the base counts of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in COUNTS.split(", ")]
        for b in batches:
            rows = [base_counts(t.as_py()) for t in b.column(2)]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "stratum", *names])

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text")
    ).mapInArrow(run, f"doc_id long, stratum string, {COUNTS}")


def ratios() -> dict:
    over = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols": over("n_symbols", "word_chars"), "dup_lines": over("n_dup_lines", "n_lines"), "repeats": over("n_repeat_words", "n_words"),
        "long_words": over("word_chars", "n_words"), "capitals": over("n_capitals", "word_chars"),
    }


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k)."""
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    total = 0.0
    for i in range(k, -1, -1):  # falls fast below the mode
        term = math.exp(log(i))
        total += term
        if term < 1e-18 * max(total, 1e-300) and i < n * p:
            break
    return min(total, 1.0)


def aims(above: dict[str, list[int]], n: int, aim: float) -> dict[str, int]:
    """How many steps of its grid each rule may take; above: documents above each cutoff, in the grid's order."""
    return {rule: next((i for i, k in enumerate(ks) if k > n * aim), len(ks)) for rule, ks in above.items()}


def proven_level(fallen: list[int], n: int, risk: float, level: float) -> int:
    """The last level before the first whose risk is not proven; fallen: of n documents, those that fall at levels 1, 2, ..."""
    for i, k in enumerate(fallen):
        if k > n * risk or binomial_cdf(k, n, risk) > level:
            return i
    return len(fallen)


def base_failed(min_words: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cutoffs(counts: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05, aim: float = 0.002, min_words: int = 50) -> DataFrame:
    """A row for each stratum with good documents: s, and cut_<rule> (null: none)."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    exceeded = [sum(F.when(r > c, 1).otherwise(0) for c in GRIDS[k]).alias(k) for k, r in ratios().items()]
    good = counts.where(~base_failed(min_words)).join(quality.where("quality = 1"), "doc_id").select("doc_id", F.col("stratum").alias("s"), *exceeded)
    good = good.groupBy("doc_id", "s").agg(*[F.max(k).alias(k) for k in GRIDS]).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    good = written(good, "good")
    each = good.where("half = 0").select("s", F.inline(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("over")) for k in GRIDS])))
    names = ", ".join(f"aim_{r} int" for r in GRIDS)

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        above, n = {}, 0
        for rule, grid in GRIDS.items():
            mine = pdf[pdf["rule"] == rule]
            n = int(mine["count"].sum())
            # who exceeds i cutoffs is above the i lowest, the last i of the grid
            above[rule] = [int(mine.loc[mine["over"] >= len(grid) - i, "count"].sum()) for i in range(len(grid))]
        return pd.DataFrame([{"s": pdf["s"].iloc[0]} | {f"aim_{r}": i for r, i in aims(above, n, aim).items()}])

    paths = written(each.groupBy("s", "rule", "over").count().groupBy("s").applyInPandas(path, f"s string, {names}"), "paths")
    # a rule falls at the first level whose cutoff, the ceil(aim * level / LEVELS)-th of its grid, is exceeded
    first = []
    for rule, grid in GRIDS.items():
        need, steps = F.lit(len(grid) + 1) - F.col(rule), F.col(f"aim_{rule}")
        first.append(F.when(need <= steps, F.floor((need - 1) * LEVELS / steps) + 1).otherwise(LEVELS + 1))
    tried = good.where("half = 1").join(paths.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")))
    fallen = written(tried.select("s", *[c for c in paths.columns if c != "s"], F.least(*first).cast("int").alias("level")).groupBy(*paths.columns, "level").count(), "fallen")
    strata = good.select("s").distinct().count()

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["count"].sum())
        best = proven_level([int(pdf.loc[pdf["level"] <= t, "count"].sum()) for t in range(1, LEVELS + 1)], n, risk, error / max(1, strata))
        row = {"s": pdf["s"].iloc[0]}
        for rule, grid in GRIDS.items():
            i = math.ceil(int(pdf[f"aim_{rule}"].iloc[0]) * best / LEVELS)
            row[f"cut_{rule}"] = grid[i - 1] if i else None
        return pd.DataFrame([row]).astype({f"cut_{r}": "float64" for r in GRIDS})

    return fallen.groupBy("s").applyInPandas(decide, "s string, " + ", ".join(f"cut_{r} double" for r in GRIDS))


def quality_rules(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    risk: float = 0.05, error: float = 0.05, aim: float = 0.002, min_words: int = 50, broadcast_strata: int = 100_000,
) -> DataFrame:
    """(doc_id, the base counts, base_failed, kept, failed_rules) of each row."""
    counts = written(counted(docs, id_col, text_col, stratum_col), "counts")
    cuts = written(cutoffs(counts, labels, risk, error, aim, min_words), "cutoffs")
    if cuts.count() <= broadcast_strata:
        cuts = F.broadcast(cuts)
    judged = counts.join(cuts, counts["stratum"].eqNullSafe(cuts["s"]), "left")
    failed = F.array_compact(F.array(*[F.when((r > F.col(f"cut_{k}")) & ~F.isnan(f"cut_{k}"), F.lit(k)) for k, r in ratios().items()]))
    base = base_failed(min_words)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"),
    )
