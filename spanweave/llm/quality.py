"""Quality classifier: document evidence and hierarchical empirical Bayes by site.

A logistic model of a document's words and form gives the odds that it is good
(quality 1 and not toxic). It is fitted on at most ``fit_rows`` labelled documents, the
least by a hash of doc_id, with one text of each; nothing else is sampled. Summed over
all documents, labels where there are any, else the classifier's probabilities, give each host (``host_col``) and path (host and
``path_col``) a posterior: a path shrinks toward its host, a host toward the
corpus, by prior weights estimated from the spread between hosts and between
paths (method of moments). A document's odds move by the difference between its
path's posterior, worked out without the document itself, and the corpus's,
times ``site_weight``.

Null, empty and blank texts have the evidence of a text without words; very long ones
are read whole. Null hosts and paths are a site each, empty ones another. Rows that repeat a doc_id are judged each; a doc_id
with several labels counts as good only if all are. Without labels, or with one
kind only, everything is kept. An empty table gives an empty result. Extra columns are ignored. Site posteriors are
broadcast up to ``broadcast_sites`` rows, else joined by shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import doc_key, small, written

BITS = 18
_STRIP = b".,;:!?\"'()[]|"
_SYMBOL = re.compile(rb"[#*$%&|<>]")


def features(text: bytes | None) -> tuple[np.ndarray, list[float]]:
    """Hashes of the distinct lower-case words and of their first four bytes, and ratios of form."""
    text = text or b""
    words = text.split()
    n, chars = max(1, len(words)), max(1, sum(map(len, words)))
    folded = {w.strip(_STRIP) for w in text.lower().split()}
    folded.discard(b"")
    folded |= {w[:4] + b"*" for w in folded}
    hashed = np.unique(np.fromiter((zlib.crc32(w) >> (32 - BITS) for w in folded), np.int32, len(folded)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    form = [
        min(1.0, 8 * len(_SYMBOL.findall(text)) / chars), min(1.0, text.count(b"!") / n), min(1.0, 2 * text.count(b" | ") / n),
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, chars / n / 20), np.log1p(len(words)) / 10, 1.0 if len(words) < 20 else 0.0, 1.0,
    ]
    return hashed, form


def telling_words(with_any: np.ndarray, with_good: np.ndarray, n: int, n_good: int, least_z: float = 4.0) -> np.ndarray:
    """Which words differ in their shares of good and of other rows by least_z standard errors."""
    n, n_good = max(2, n), max(1, n_good)
    n_bad, p = max(1, n - n_good), with_any / n
    apart = with_good / n_good - (with_any - with_good) / n_bad
    return (with_any >= 3) & (np.abs(apart) >= least_z * np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_good + 1 / n_bad)))


class Sums:
    """of(x): for each of n groups the sum of x[index] over its places; group: each place's group, in order.

    Worked out in blocks of about ``block`` places, so that x[index] is never there as a whole.
    """

    def __init__(self, group: np.ndarray, index: np.ndarray, n: int, block: int = 300_000):
        self.index, self.n = index, n
        self.starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, np.int64)
        self.which = group[self.starts]
        cut = np.unique(np.searchsorted(self.starts, np.arange(0, len(group), block))).tolist()
        self.blocks = [(i, k, self.starts[i], self.starts[k] if k < len(self.starts) else len(group)) for i, k in zip(cut, [*cut[1:], len(self.starts)]) if i < k]

    def of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, k, s, e in self.blocks:
            out[self.which[i:k]] = np.add.reduceat(x[self.index[s:e]], self.starts[i:k] - s)
        return out


def fit(at: np.ndarray, cols: np.ndarray, form: np.ndarray, good: np.ndarray, m: int, rounds: int = 300, rate: float = 0.3, l2: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Weights of m words and of the form, by Adagrad; row at[i] has word cols[i], rows in order."""
    y = good.astype(float)
    w, v = np.zeros(m), np.zeros(form.shape[1])
    gw, gv = np.full(m, 1e-8), np.full(form.shape[1], 1e-8)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both kinds count alike
    by_row = Sums(at, cols, len(y))
    by = np.argsort(cols, kind="stable").astype(np.int32)
    by_word = Sums(cols[by], at[by], m)
    del by
    for _ in range(rounds):
        z = by_row.of(w) + form @ v
        err = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        dw, dv = by_word.of(err) + l2 * w, form.T @ err + l2 * v
        gw += dw * dw
        gv += dv * dv
        w -= rate * dw / np.sqrt(gw)
        v -= rate * dv / np.sqrt(gv)
    return w, v


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labelled ids: good if all their labels are."""
    return (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min((F.coalesce("quality", F.lit(1)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    )


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> tuple[np.ndarray, np.ndarray] | None:
    """The document model, or None if the labels are of one kind.

    The rows' words are counted where they are; the driver gets 2 ** BITS counts
    at most and, of each row, the words that tell.
    """
    told = known(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t.as_py()) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("tk"), b.column("good"), pa.array([h for h, _ in got], pa.list_(pa.int32())), pa.array([f for _, f in got], pa.list_(pa.float64()))],
                ["doc_id", "tk", "good", "words", "form"],
            )

    schema = "doc_id long, tk long, good boolean, words array<int>, form array<double>"
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), "text")
    one = named.join(F.broadcast(told), "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("tk", "text")).alias("x"))  # one text of an id
    rows = written(one.select("doc_id", "x.tk", "good", "x.text").mapInArrow(featured, schema), "features")
    kinds = {r["good"]: r["count"] for r in rows.groupBy("good").count().collect()}
    if len(kinds) < 2:
        return None
    counts = (
        rows.select("good", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good")).toArrow()
    )
    with_any, with_good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    with_any[counts.column("w").to_numpy()] = counts.column("n").to_numpy()
    with_good[counts.column("w").to_numpy()] = counts.column("n_good").to_numpy()
    telling = telling_words(with_any, with_good, sum(kinds.values()), kinds[True])

    def only_telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words")
            keep = telling[words.flatten().to_numpy()]
            ends = np.concatenate(([0], np.cumsum(keep)))[np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy())))]
            kept = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(words.flatten().to_numpy()[keep]))
            yield pa.RecordBatch.from_arrays([kept if c == "words" else b.column(c) for c in b.schema.names], b.schema.names)

    got = rows.mapInArrow(only_telling, schema).toArrow().combine_chunks()
    # the same sums whatever order the rows come in
    order = np.lexsort((got.column("tk").to_numpy(), got.column("doc_id").to_numpy()))
    got = got.select(["good", "words", "form"]).take(pa.array(order)).combine_chunks()
    words = got.column("words").chunk(0)
    at = np.repeat(np.arange(len(order), dtype=np.int32), words.value_lengths().to_numpy())
    place = np.cumsum(telling, dtype=np.int32) - 1
    form = got.column("form").chunk(0).flatten().to_numpy().reshape(len(order), -1)
    good = got.column("good").to_numpy().astype(bool)
    cols = place[words.flatten().to_numpy()]
    del got, words
    w, v = fit(at, cols, form, good, int(telling.sum()))
    full = np.zeros(1 << BITS, np.float32)
    full[telling] = w
    return full, v


def document_odds(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(did, tk, host, path, logit) of each row; docs has did, tk, host, path and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, form = shared.value
        for b in batches:
            z = [float(words[h].sum() + np.dot(f, form)) for h, f in (features(t.as_py()) for t in b.column("text").cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("did", "tk", "host", "path")] + [pa.array(z, pa.float64())], ["did", "tk", "host", "path", "logit"])

    return docs.mapInArrow(run, "did long, tk long, host string, path string, logit double")


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang",
    fit_rows: int = 20_000, keep_from: float = 0.6, site_weight: float = 0.25, broadcast_sites: int = 100_000,
) -> DataFrame:
    """(did, tk, p_document, p_site, p_good, kept) of each row; did and tk as in common.doc_key."""
    named = docs.select(
        *doc_key(docs, id_col, text_col), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text")
    )
    model = fitted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, fit_rows)
    if model is None:
        return named.select("did", "tk", *[F.lit(1.0).alias(c) for c in ("p_document", "p_site", "p_good")], F.lit(True).alias("kept"))
    told = written(known(labels), "labels")
    odds = written(document_odds(named, model), "odds").withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
    odds = odds.join(F.broadcast(told) if small(told) else told, F.col("did") == F.col("doc_id"), "left").withColumn("e", F.coalesce(F.col("good").cast("double"), "p"))
    paths = written(odds.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.col("e").cast("decimal(20,9)")).cast("double").alias("total")), "paths")
    hosts = paths.groupBy(F.col("host").alias("host1")).agg(F.sum("n").alias("host_n"), F.sum(F.col("total").cast("decimal(30,9)")).cast("double").alias("host_total"))

    def weight(df: DataFrame, n: str, total: str, mean) -> float:
        """By moments, the weight m of a site's prior Beta(m * mean, m * (1 - mean))."""
        t = df.agg(F.sum(n).alias("n"), F.sum(total).alias("t"), F.count("*").alias("k"), F.sum((F.col(total) / F.col(n) - mean) ** 2 * F.col(n)).alias("s")).first()
        if not t["n"] or t["k"] < 2:
            return 1000.0
        inner = t["t"] / t["n"] * (1 - t["t"] / t["n"])
        return float(np.clip(inner / max(t["s"] / t["n"] - inner * t["k"] / t["n"], 1e-9) - 1, 1.0, 1e4))

    whole = hosts.agg(F.sum("host_n").alias("n"), F.sum("host_total").alias("t")).first()
    mean = whole["t"] / whole["n"] if whole["n"] else 0.5
    m_host = weight(hosts, "host_n", "host_total", F.lit(mean))
    of_path = paths.join(hosts, F.col("host").eqNullSafe(F.col("host1")))
    m_path = weight(of_path, "n", "total", F.col("host_total") / F.col("host_n"))
    sites = written(of_path.select(F.col("host").alias("host1"), F.col("path").alias("path1"), "n", "total", "host_n", "host_total"), "sites")
    if sites.count() <= broadcast_sites:
        sites = F.broadcast(sites)
    host_mean = (F.col("host_total") - F.col("e") + m_host * mean) / (F.col("host_n") - 1 + m_host)
    site = (F.col("total") - F.col("e") + m_path * host_mean) / (F.col("n") - 1 + m_path)
    site = F.greatest(F.least(site, F.lit(1 - 1e-6)), F.lit(1e-6))
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    moved = F.col("logit") + site_weight * (F.log(F.col("p_site") / (1 - F.col("p_site"))) - float(np.log(mean / (1 - mean))))
    return (
        odds.join(sites, F.col("host").eqNullSafe(F.col("host1")) & F.col("path").eqNullSafe(F.col("path1"))).withColumn("p_site", site).withColumn("p_good", 1 / (1 + F.exp(-moved)))
        .select("did", "tk", F.col("p").alias("p_document"), "p_site", "p_good", (F.col("p_good") >= keep_from).alias("kept"))
    )
