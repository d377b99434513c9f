"""Language ID with bit-sliced Bloom filters of character n-grams.

A slot of the filter is a bit mask of languages. All n-grams that a language was taught
(``gram`` code points of the lower-cased text, whose runs of other than letters are
one space) are put in. A look-up ANDs a gram's slots and so returns all languages that
have it. A language's share of a text's n-grams, corrected for false positives
((found - expected) / (n - expected), expected being what the filter's rate for that
language lets in among n), decides; ties go to the first language by name. Shares over
texts of all learned documents are counted; nothing is sampled.

A filter has SLOTS slots for each distinct gram, a language's bits being as full as its
own grams make them. Grams are dealt by hash to as many shards as keep a shard's
filter within ``filter_bytes``, whatever the number of grams or languages; a shard's
filter is built in one task. One shard is broadcast and texts are read once. Of several
shards one after the other is broadcast, and texts are read once for each; a text's
counts of all shards are added up before the languages are compared.

Null texts and texts without a letter are ``und`` with score 0; so are all if
nothing was learned. Null languages teach nothing. Rows that repeat a doc_id are
learned and judged each; very long texts are read whole, each n-gram of them counted.
An empty table teaches nothing and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written

GRAM = 4
HASHES = 3
SLOTS = 8
FILTER_BYTES = 32 << 20
_letters: list[np.ndarray] = []


def grams(text: str | None, gram: int = GRAM) -> np.ndarray:
    """Hashes of a text's n-grams, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters[0][code]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    code = np.where(is_letter, code, np.uint32(32))
    keep = is_letter.copy()
    keep[0] |= not is_letter[0]
    keep[1:] |= is_letter[:-1]
    code = np.concatenate(([32], code[keep], [32])).astype(np.uint64)
    if len(code) < gram:
        code = np.concatenate((code, np.full(gram - len(code), 32, np.uint64)))
    h = np.zeros(len(code) - gram + 1, np.uint64)
    for i in range(gram):
        h = h * np.uint64(0x110000) + code[i : len(code) - gram + 1 + i]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(i) * b) & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def _mask_type(languages: int) -> type:
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(languages, 64) <= 8 * np.dtype(t).itemsize)


class Filter:
    """Bit-sliced Bloom filter of grams h, the i-th of language k[i]; languages beyond 64 take further slices."""

    def __init__(self, languages: int, h: np.ndarray, k: np.ndarray):
        self.languages, kind = languages, _mask_type(languages)
        self.size = 1 << max(10, (SLOTS * max(1, len(np.unique(h))) - 1).bit_length())
        self.slices = np.zeros((-(-max(1, languages) // 64), self.size), kind)
        for i, cells in enumerate(self.slices):
            own = k // 64 == i
            bit = np.left_shift(np.uint64(1), (k[own] % 64).astype(np.uint64)).astype(kind)
            for s in _slots(h[own], self.size):
                np.bitwise_or.at(cells, s, bit)
        filled = [float((self.slices[j // 64] >> kind(j % 64) & kind(1)).mean()) for j in range(languages)]
        self.false = np.array([f**HASHES for f in filled])

    def found(self, h: np.ndarray) -> np.ndarray:
        """How many of the grams each language has."""
        slots, out = _slots(h, self.size), np.zeros(self.languages, np.int64)
        for i, cells in enumerate(self.slices):
            masks = cells[slots[0]]
            for s in slots[1:]:
                masks = masks & cells[s]
            for j in range(64 * i, min(64 * i + 64, self.languages)):
                out[j] = np.count_nonzero(masks & cells.dtype.type(1 << j % 64))
        return out


def decided(languages: list[str], n: int, found: np.ndarray, expected: np.ndarray) -> tuple[str, float]:
    """The language of the greatest corrected share of n grams."""
    if not n or not languages:
        return "und", 0.0
    share = np.clip((found - expected) / np.maximum(n - expected, 1e-9 * n), 0, 1)
    best = int(np.argmax(share))
    return languages[best], float(share[best])


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)


@dataclass(frozen=True)
class Model:
    """What was learned: languages by name, and a written table (shard, size, slices, false) of a filter for each shard."""

    languages: list[str]
    shards: int
    filters: DataFrame | None

    def filter(self, shard: int) -> Filter:
        row = self.filters.where(F.col("shard") == shard).first()
        out = Filter.__new__(Filter)
        out.languages, out.size, out.false = len(self.languages), row["size"], np.array(row["false"])
        out.slices = np.frombuffer(bytes(row["slices"]), _mask_type(len(self.languages))).reshape(-1, out.size)
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", filter_bytes: int = FILTER_BYTES) -> Model:
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's distinct grams by language."""
        for b in batches:
            by: dict[str, list] = {}
            held = 0

            def told() -> Iterator[pa.RecordBatch]:
                for lang, parts in by.items():
                    h = np.unique(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], ["lang", "h"])
                by.clear()

            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                h = grams(text.as_py())
                by.setdefault(lang, []).append(h)
                held += len(h)
                if held > 8_000_000:
                    yield from told()
                    held = 0
            yield from told()

    taught = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = written(taught.mapInArrow(tell, "lang string, h long").distinct(), "grams")
    names = sorted(r["lang"] for r in known.select("lang").distinct().collect())  # a row a language
    if not names:
        return Model([], 1, None)
    languages = len(names)
    slot_bytes = np.dtype(_mask_type(languages)).itemsize * -(-languages // 64)
    shards = max(1, math.ceil(known.select("h").distinct().count() * SLOTS * 2 * slot_bytes / filter_bytes))  # sizes are powers of two, so up to twice the slots
    number = {x: i for i, x in enumerate(names)}

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            h = pdf["h"].to_numpy(np.int64)
            yield pd.DataFrame({"shard": _shard(h.view(np.uint64), shards).astype(np.int32), "h": h, "k": pdf["lang"].map(number).astype(np.int32)})

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Filter(languages, pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["k"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "size": [f.size], "slices": [f.slices.tobytes()], "false": [f.false.tolist()]})

    rows = known.mapInPandas(dealt, "shard int, h long, k int").groupBy("shard")
    return Model(names, shards, written(rows.applyInPandas(build, "shard int, size long, slices binary, false array<double>"), "filters"))


def _counts(model: Model, shard: int, df: DataFrame, text_col: str) -> DataFrame:
    """(__row, n, found, expected) of df(__row, text), by one shard of the filter."""
    shared, shards, nothing = df.sparkSession.sparkContext.broadcast(model.filter(shard)), model.shards, [0] * len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found, expected = [], [], []
            for t in b.column(text_col):
                h = grams(t.as_py())
                h = h[_shard(h, shards) == shard]
                n.append(len(h))
                found.append(shared.value.found(h).tolist() if len(h) else nothing)
                expected.append((len(h) * shared.value.false).tolist())
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(expected, pa.list_(pa.float64()))], ["__row", "n", "found", "expected"])

    return df.select("__row", text_col).mapInArrow(run, "__row long, n long, found array<long>, expected array<double>")


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    if not model.languages:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    if model.shards == 1:
        return _identify_at_once(docs, model, text_col)
    docs = written(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    parts = None
    for shard in range(model.shards):
        part = written(_counts(model, shard, docs, text_col), "language-counts")
        parts = part if parts is None else parts.union(part)
    # a row has one list for each shard
    each = parts.groupBy("__row").agg(F.sum("n").alias("n"), F.collect_list("found").alias("found"), F.collect_list("expected").alias("expected"))
    added = lambda c: F.aggregate(F.slice(c, F.lit(2), F.size(c)), F.get(F.col(c), F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda a, b: a + b)).alias(c)
    each = each.select("__row", "n", added("found"), added("expected"))
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [decided(names, n, np.array(f), np.array(e)) for n, f, e in zip(*(b.column(c).to_pylist() for c in ("n", "found", "expected")))]
            yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["__row", "lang_pred", "score"])

    return docs.join(each.mapInArrow(run, "__row long, lang_pred string, score double"), "__row").drop("__row")


def _identify_at_once(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    shared, names = docs.sparkSession.sparkContext.broadcast(model.filter(0)), model.languages
    fields = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = []
            for t in b.column(text_col):
                h = grams(t.as_py())
                said.append(decided(names, len(h), shared.value.found(h), len(h) * shared.value.false))
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], [*fields, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows that are not held out (crc32 of the id mod 4 is 2)."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    model = learn(docs.where(~held), text_col, lang_col, filter_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).drop("text")
