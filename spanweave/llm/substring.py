"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one document. A word goes if a
window covers it whose word sequence also starts earlier: in a document with a
smaller doc_id, or further up in the same document.

1. Each window has an anchor, its phrase of PHRASE words with the least hash.
   Equal windows have equal anchors, so anchors that come once in the whole corpus
   are in no recurring window and are passed over; the others are dealt to shards by
   their hash. A document goes to every shard that has one of its anchors: the
   stretches of it whose windows have that anchor do, about 26 words each.
2. A shard confirms, by their words, which phrases recur, compiles them to an
   Aho-Corasick automaton and streams its stretches through it, which locates every
   occurrence.
3. Windows around located phrases are compared word by word in the shard; the
   earliest of equal ones stays. Hashes only pass things over and deal things out;
   they never make two windows equal.

A shard takes SHARD_STRETCHES stretches and so as many phrases at most. An anchor with
more than HOT of them is dealt to several shards by document, each of which tells its
earliest of each window; of these the earliest stays.

Documents with the word sequence of an earlier document lose all words, if a
window fits, and take no part in steps 1 to 3 (their SHA-256 are compared). Null
texts have no words. A null doc_id counts as the smallest. Rows that repeat a doc_id
and text are one document and get equal results; the same doc_id with another text
is another document, placed by the text's hash. Very long texts are read whole; an
empty table gives an empty result. Extra columns stay, but for those named like a
result, which the result replaces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import BATCH_BYTES, BROADCAST_KEYS, doc_key, join_by_key, only_keys, written

PHRASE = 8
SHARD_STRETCHES = 20_000
HOT = 2_000
_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """A text's words, joined by one space."""

    def __init__(self, text: bytes | None):
        self.words = text.split() if text else []
        self.n, self.joined = len(self.words), b" ".join(self.words)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``joined`` each word starts and ends."""
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n) + 1) - 1
        return np.concatenate(([0], ends[:-1] + 1)) if self.n else ends, ends

    def phrases(self) -> np.ndarray:
        """Hashes of the runs of PHRASE words."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, self.n)
        n = max(0, self.n - PHRASE + 1)
        x = np.zeros(n, np.uint64)
        for j in range(PHRASE):
            x = (x ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        return _mix(x)


def window_hashes(phrases: np.ndarray, window: int) -> np.ndarray:
    """Of the hashes of the phrases that make up each window."""
    n = len(phrases) - (window - PHRASE)
    x = np.zeros(n, np.uint64)
    for j in [*range(0, window - PHRASE, PHRASE), window - PHRASE]:
        x = _mix(x ^ phrases[j : j + n])
    return x


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    have = 1
    while 2 * have <= k:
        x, have = np.minimum(x[:-have], x[have:]), 2 * have
    return x if have == k else np.minimum(x[: len(x) - (k - have)], x[k - have :])


def _anchors(window: int):
    span = window - PHRASE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, sha, anchors = [], [], []
            for t in b.column("text").cast(pa.binary()):
                w = Words(t.as_py())
                n_words.append(w.n)
                sha.append(hashlib.sha256(w.joined).digest())
                if w.n < window:
                    anchors.append(np.zeros(0, np.int64))
                    continue
                phrases = w.phrases()
                least, whole = sliding_min(phrases, span), window_hashes(phrases, window)
                order = np.argsort(whole, kind="stable")
                again = least[order[1:]][whole[order[1:]] == whole[order[:-1]]]
                anchors.append(np.concatenate((np.unique(least), np.unique(again))).view(np.int64))
            sizes = np.concatenate(([0], np.cumsum([len(a) for a in anchors]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), b.column("tk"), pa.array(n_words, pa.int64()), pa.array(sha, pa.binary()), lists],
                ["did", "tk", "n_words", "sha", "anchors"],
            )

    return run


_STRETCH = "a long, parts int, did long, tk long, start int, n int, p0 int, p1 int, words binary"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], [name for name, _ in fields])


def _stretches_of(window: int):
    """(did, tk, text, wanted) to stretches: n windows from word ``start`` on that have the anchor a; bytes p0 to p1 are the first one's phrase."""
    span = window - PHRASE + 1

    def of(text: bytes, named: np.ndarray, parts: np.ndarray) -> list[list]:
        w = Words(text)
        starts, ends = w.places()
        phrases = w.phrases()
        least = sliding_min(phrases, span)
        lo = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        hi = np.concatenate((lo[1:], [len(least)]))
        anchor, by = least[lo].view(np.int64), np.argsort(named)
        place = by[np.minimum(np.searchsorted(named, anchor, sorter=by), len(named) - 1)]
        here = named[place] == anchor
        lo, hi, anchor, part = lo[here], hi[here], anchor[here], parts[place[here]]
        at = lo.copy()
        for j in range(span - 1, -1, -1):
            at = np.where(phrases[lo + j].view(np.int64) == anchor, lo + j, at)
        begin, end = starts[lo], ends[hi + window - 2]
        cut = [w.joined[s:e] for s, e in zip(begin.tolist(), end.tolist())]
        return [*(x.tolist() for x in (anchor, part, lo, hi - lo, starts[at] - begin, ends[at + PHRASE - 1] - begin)), cut]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(9)]
            held = 0
            for did, tk, text, wanted in zip(b.column("did").to_pylist(), b.column("tk").to_pylist(), b.column("text").cast(pa.binary()), b.column("wanted")):
                a, part, start, n, p0, p1, cut = of(text.as_py(), *(wanted.values.field(f).to_numpy() for f in ("a", "parts")))
                for column, values in zip(rows, (a, part, [did] * len(a), [tk] * len(a), start, n, p0, p1, cut)):
                    column.extend(values)
                held += sum(map(len, cut))
                if held > 16_000_000:
                    yield _batch(rows, _STRETCH)
                    rows, held = [[] for _ in range(9)], 0
            yield _batch(rows, _STRETCH)

    return run


def recurring_phrases(stretches: list[bytes], p0: list[int], p1: list[int], elsewhere: list[bool]) -> set[bytes]:
    """Phrases that come in two stretches, or twice in one, by their words; those that come elsewhere too are taken as told."""
    seen: set[bytes] = set()
    out: set[bytes] = set()
    for words, s, e, more in zip(stretches, p0, p1, elsewhere):
        phrase = words[s:e]
        if more or phrase in seen or words.find(phrase, s + 1) >= 0:
            out.add(phrase)
        seen.add(phrase)
    return out


def automaton_of(phrases: set[bytes]) -> ahocorasick.Automaton:
    """Finds phrases that stand between blanks."""
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for p in phrases:
        out.add_word(f" {p.decode('latin-1')} ", 1)
    out.make_automaton()
    return out


_LOST = "did long, tk long, lo int, hi int, words binary"


def _settled(parts: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Of a shard's stretches, by anchor and place: runs lo to hi of windows that start earlier elsewhere;
    and, for anchors that other shards have too, the earliest of each window with its words."""
    span = window - PHRASE + 1
    t = pa.Table.from_batches(parts)
    a, many, did, tk, start, n, p0, p1, stretches = (t.column(f.split(" ")[0]).to_pylist() for f in _STRETCH.split(", "))
    out: list[list] = [[] for _ in range(5)]
    phrases = recurring_phrases(stretches, p0, p1, [x > 1 for x in many])
    if not phrases:
        return _batch(out, _LOST)
    joined = b" " + b" \n ".join(stretches) + b" "
    # words lie between the blanks; a stretch of m words has m + 1 of them
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    found = np.fromiter((end for end, _ in automaton_of(phrases).iter(joined.decode("latin-1"))), np.int64)
    located = np.zeros(len(blanks) + 1, np.int32)
    located[np.searchsorted(blanks, found) - PHRASE + 1] = 1
    before = np.cumsum(located)
    windows = np.array(n)
    first = np.concatenate(([0], np.cumsum(windows + window)[:-1]))  # a stretch's first blank
    begin = np.repeat(first - np.concatenate(([0], np.cumsum(windows)[:-1])), windows) + np.arange(windows.sum())
    has = (before[np.minimum(begin + span, len(blanks))] > before[begin]).tolist()
    begins, ends = (blanks[begin] + 1).tolist(), blanks[begin + window].tolist()
    anchor, at, seen, whole, last = None, 0, set(), set(), None
    for i, words in enumerate(stretches):
        here, at = at, at + n[i]
        if a[i] != anchor:
            anchor, seen, whole = a[i], set(), set()
        place = (did[i], tk[i], start[i])
        if (anchor, *place) == last:  # a repeat of the row
            continue
        last, runs = (anchor, *place), []
        if words in whole:
            runs.append([0, n[i]])
        else:
            whole.add(words)
            for j in range(n[i]):
                if not has[here + j]:
                    continue
                w = joined[begins[here + j] : ends[here + j]]
                if w not in seen:
                    seen.add(w)
                    if many[i] > 1:
                        for column, value in zip(out, (*place[:2], place[2] + j, place[2] + j + 1, w)):
                            column.append(value)
                elif runs and runs[-1][1] == j:
                    runs[-1][1] = j + 1
                else:
                    runs.append([j, j + 1])
        for lo, hi in runs:
            for column, value in zip(out, (*place[:2], place[2] + lo, place[2] + hi, None)):
                column.append(value)
    return _batch(out, _LOST)


def _shards(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for b in batches:
            k = b.column("k").to_numpy()
            cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if held and k[s] != shard:
                    yield _settled(held, window)
                    held = []
                shard = k[s]
                held.append(b.slice(s, e - s))
        if held:
            yield _settled(held, window)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's runs of windows, in order, those that touch made one."""
    for b in batches:
        los, his = [], []
        for runs in b.column("runs").to_pylist():
            lo, hi = [], []
            for r in sorted((r["lo"], r["hi"]) for r in runs):
                if hi and r[0] <= hi[-1]:
                    hi[-1] = max(hi[-1], r[1])
                else:
                    lo.append(r[0])
                    hi.append(r[1])
            los.append(lo)
            his.append(hi)
        yield pa.RecordBatch.from_arrays(
            [b.column("did"), b.column("tk"), pa.array([False] * len(los), pa.bool_()), pa.array(los, pa.list_(pa.int32())), pa.array(his, pa.list_(pa.int32()))],
            ["did", "tk", "whole", "lo", "hi"],
        )


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shard_stretches: int = SHARD_STRETCHES, hot: int = HOT) -> DataFrame:
    """(did, tk, whole, lo, hi) of the documents that lose words.

    whole: the document repeats an earlier one; else lo and hi bound the runs of
    windows that start earlier elsewhere. Each (did, tk) comes once.
    """
    if window < PHRASE:
        raise ValueError(f"window must have {PHRASE} words or more")
    texts = docs.select(*doc_key(docs, id_col, text_col), F.col(text_col).alias("text"))
    seen = written(texts.mapInArrow(_anchors(window), "did long, tk long, n_words long, sha binary, anchors array<long>"), "anchors", BATCH_BYTES)
    key = ["did", "tk"]
    first = seen.groupBy("sha").agg(F.min(F.struct(*key)).alias("f")).select("f.did", "f.tk")
    first = written(first, "firsts")
    copies = seen.where(F.col("n_words") >= window).select(*key).distinct().join(first, key, "left_anti")
    places = seen.join(first, key, "left_semi").select(*key, F.explode("anchors").alias("a"))
    recurring = written(places.groupBy("a").count().where("count > 1"), "recurring")
    shards = max(1, math.ceil((recurring.agg(F.sum("count")).first()[0] or 0) / shard_stretches))
    parts = F.ceil(F.col("count") / hot).cast("int").alias("parts")
    wanted = written(places.join(recurring.select("a", parts), "a").groupBy(*key).agg(F.collect_set(F.struct("a", "parts")).alias("wanted")), "wanted")
    cut = only_keys(texts, wanted.select(*key)).join(wanted, key).select(*key, "text", "wanted").mapInArrow(_stretches_of(window), _STRETCH)
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(*key), F.col("parts"))).otherwise(F.lit(0))
    dealt = cut.withColumn("k", F.pmod(F.xxhash64("a", part), F.lit(shards)))
    found = written(
        dealt.repartition("k").sortWithinPartitions("k", "a", "did", "tk", "start").mapInArrow(_shards(window), _LOST),
        "lost-windows", BATCH_BYTES,
    )
    firsts = found.where("words is not null").select(*key, "lo", "words")
    earliest = firsts.groupBy("words").agg(F.min(F.struct(*key, "lo")).alias("f")).select("words", "f.*")
    late = firsts.join(earliest, ["words", *key, "lo"], "left_anti").select(*key, "lo", (F.col("lo") + 1).alias("hi"))
    runs = found.where("words is null").select(*key, "lo", "hi").union(late)
    lost = runs.groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("runs")).mapInArrow(_merged, "did long, tk long, whole boolean, lo array<int>, hi array<int>")
    none = F.array().cast("array<int>")
    return written(lost.union(copies.select(*key, F.lit(True), none, none)), "lost")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, shard_stretches: int = SHARD_STRETCHES, hot: int = HOT) -> DataFrame:
    """docs with n_words, n_removed, kept_sha256 and kept_text.

    kept_text: the text as it was if nothing goes; else the kept stretches of
    it, joined by one space. kept_sha256: of the kept words joined by one space.
    """
    docs = docs.drop("n_words", "n_removed", "kept_sha256", "kept_text")
    lost = repeated_windows(docs, id_col, text_col, window, shard_stretches, hot)
    size = lost.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("lo")), F.lit(0)).alias("runs")).first()
    joined = join_by_key(docs, lost, "left", id_col, text_col, size["rows"] + size["runs"] <= BROADCAST_KEYS).drop("__did", "__tk")
    fields = docs.schema.fieldNames()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, sha, kept = [], [], [], []
            for text, whole, lo, hi in zip(b.column(text_col).cast(pa.binary()), b.column("__whole").to_pylist(), b.column("__lo"), b.column("__hi")):
                text = text.as_py()
                w = Words(text)
                stay = np.ones(w.n, bool)
                if whole:
                    stay[:] = False
                elif lo.is_valid:
                    for s, e in zip(lo.as_py(), hi.as_py()):
                        stay[s : e - 1 + window] = False
                n_words.append(w.n)
                n_removed.append(w.n - int(stay.sum()))
                if not n_removed[-1]:
                    sha.append(hashlib.sha256(w.joined).hexdigest())
                    kept.append(text)
                    continue
                edge = np.diff(np.concatenate(([0], stay.astype(np.int8), [0])))
                runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                sha.append(hashlib.sha256(b" ".join(x for s, e in runs for x in w.words[s:e])).hexdigest())
                kept.append(b" ".join(_stretches(text, runs)))
            yield pa.RecordBatch.from_arrays(
                [b.column(f) for f in fields] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
                [*fields, "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return joined.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def _stretches(text: bytes, runs: list[tuple[int, int]]) -> Iterator[bytes]:
    """The text of runs of words, with its own white space inside."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([0], (~np.isin(raw, [32, 9, 10, 11, 12, 13])).astype(np.int8), [0]))
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    for s, e in runs:
        yield text[begin[s] : end[e - 1]]
