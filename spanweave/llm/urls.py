"""URL filter with a Bloom filter cascade.

The first level encodes the listed keys; each further level encodes what the one
before wrongly lets in, of the other side: unlisted keys of the corpus that pass
the first, listed keys that pass the second, and so on until none is left. A
key's verdict is the parity of the first level that refuses it. Every key of the
corpus takes part, so membership is exact for all of them, and neither the list nor
the corpus's keys are joined to the pages; listed keys no page has are left out.

Keys stand for themselves by 128 bits of hash, of which each level makes places of
its own. Two keys of the same 128 bits, one listed and one not, would end the job with
an error (at 10^10 keys a chance of 10^-19); no wrong verdict is given.

Keys are dealt to shards by hash, about ``shard_keys`` each, and a shard's levels
are built in one task. The cascade is broadcast if it has ``broadcast_bytes`` at
most; else pages and levels meet by shard, a shard's pages in groups of about
``group_rows``, as many as its count asks for, whatever its hosts' sizes.

A null url, or one without "://", has an empty host and path; an empty host is
never listed. Very long urls are read whole. Rows that repeat a page_id are judged
each; keys that repeat in the list, and null ones, add nothing; extra columns are
ignored. Empty tables of pages give an empty result, an empty list lists nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); the longest that fits wins.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def host_path(url: Column) -> tuple[Column, Column]:
    parts = r"://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(h: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The places of each row of h, two hashes of a key, in a level."""
    own = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = _mixed((h[:, 0].view(np.uint64) ^ own) + _mixed(h[:, 1].view(np.uint64) + own))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    for i in range(hashes):
        yield ((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)


def build_levels(listed: np.ndarray, rest: np.ndarray, false_share: float = 0.05) -> list[tuple[int, int, bytes]]:
    """Levels (bits, hashes, filter) that tell the keys of listed from those of rest; either has two hashes a row."""
    levels, inside, outside = [], listed, rest
    while len(inside):
        bits = max(64, math.ceil(-len(inside) * math.log(false_share) / math.log(2) ** 2))
        hashes = max(1, round(bits / len(inside) * math.log(2)))
        hashes = min(hashes, 16)
        cells = np.zeros(bits, bool)
        for s in _slots(inside, len(levels), bits, hashes):
            cells[s] = True
        passed = np.ones(len(outside), bool)
        for s in _slots(outside, len(levels), bits, hashes):
            passed &= cells[s]
        levels.append((bits, hashes, np.packbits(cells).tobytes()))
        inside, outside = outside[passed], inside
        if len(levels) > 200:
            raise ValueError("a listed and an unlisted key have the same 128 bits of hash")
    return levels


def in_levels(h: np.ndarray, levels: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Whether each key is listed: it passes an odd number of levels before one refuses it (or none is left)."""
    out, alive = np.zeros(len(h), bool), np.arange(len(h))
    for k, (bits, hashes, packed) in enumerate(levels):
        cells, passed = np.frombuffer(packed, np.uint8), np.ones(len(alive), bool)
        for s in _slots(h[alive], k, bits, hashes):
            passed &= (cells[s >> 3] >> (7 - (s & 7)) & 1).astype(bool)
        out[alive[~passed]] = k % 2 == 1
        alive = alive[passed]
    out[alive] = len(levels) % 2 == 1
    return out


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(key, F.lit(1)).alias("h2")]


def _pair(frame: pd.DataFrame, h: str, h2: str) -> np.ndarray:
    return np.column_stack([frame[h].to_numpy(np.int64), frame[h2].to_numpy(np.int64)]).reshape(-1, 2)


def build_cascade(keys: DataFrame, shard_keys: int = 1_000_000) -> tuple[DataFrame, int]:
    """keys: (key, listed), each key once. Rows (shard, levels), and the number of shards."""
    n = max(1, math.ceil(keys.count() / shard_keys))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h, listed = _pair(pdf, "h", "h2"), pdf["listed"].to_numpy(bool)
        levels = build_levels(h[listed], h[~listed])
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "levels": [[{"bits": a, "hashes": b, "cells": c} for a, b, c in levels]]})

    rows = keys.select(*_hashes("key"), "listed").withColumn("shard", F.pmod("h", F.lit(n)))
    return rows.groupBy("shard").applyInPandas(build, "shard long, levels array<struct<bits:long,hashes:int,cells:binary>>"), n


def with_membership(df: DataFrame, key_col: str, listed: DataFrame, out_col: str, shard_keys: int = 1_000_000, broadcast_bytes: int = 32_000_000, group_rows: int = 100_000) -> DataFrame:
    """df with out_col: whether its key_col is in the first column of listed, by a cascade over all keys of df. A null key is not."""
    of = lambda rows, key, is_listed: rows.select(key.cast("string").alias("key"), F.lit(is_listed).alias("listed"), F.lit(not is_listed).alias("used"))
    both = of(df, F.col(key_col), False).unionByName(of(listed, F.col(listed.columns[0]), True)).where("key is not null")
    keys = written(both.groupBy("key").agg(F.max("listed").alias("listed"), F.max("used").alias("used")).where("used").select("key", "listed"), "keys")
    built, n = build_cascade(keys, shard_keys)
    cascade = written(built, "cascade")
    size = cascade.select(F.sum(F.aggregate("levels", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x["cells"]))).alias("b")).first()["b"] or 0
    hashed = df.select("*", *[x.alias(f"__{i}") for i, x in enumerate(_hashes(key_col))], F.col(key_col).isNotNull().alias("__some"))
    fields = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{out_col}` boolean"
    if size <= broadcast_bytes:
        shards = {r["shard"]: [(x["bits"], x["hashes"], bytes(x["cells"])) for x in r["levels"]] for r in cascade.collect()}
        shared = df.sparkSession.sparkContext.broadcast(shards)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = np.column_stack([b.column("__0").to_numpy(), b.column("__1").to_numpy()]).reshape(-1, 2)
                shard, out = np.mod(h[:, 0], n), np.zeros(len(h), bool)
                for s in np.unique(shard).tolist():
                    at = shard == s
                    out[at] = in_levels(h[at], shared.value.get(s, []))
                out &= b.column("__some").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), pa.array(out)], [*fields, out_col])

        return hashed.mapInArrow(run, schema)
    plain = [f"`{f.name}`" for f in df.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]  # a row that is made again goes to the same group
    left = hashed.withColumn("__shard", F.pmod("__0", F.lit(n)))
    groups = written(left.groupBy("__shard").agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("int").alias("__groups")), "groups")  # a row a shard
    left = left.join(F.broadcast(groups), "__shard").withColumn("__salt", F.pmod(F.xxhash64(*plain, F.lit(7)), F.col("__groups")).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.col("__groups") - 1)).alias("__salt")
    right = cascade.withColumnsRenamed({"shard": "__shard"}).join(F.broadcast(groups), "__shard").select("__shard", "levels", salts)

    def meet(pages: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        steps = [(x["bits"], x["hashes"], bytes(x["cells"])) for x in levels["levels"].iloc[0]] if len(levels) else []
        return pages[fields].assign(**{out_col: in_levels(_pair(pages, "__0", "__1"), steps) & pages["__some"].to_numpy(bool)})

    keys_ = ["__shard", "__salt"]
    return left.groupBy(*keys_).cogroup(right.groupBy(*keys_)).applyInPandas(meet, schema)


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] | None = None, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """(page_id, host, path, rule, verdict). listed: the block list, its hosts in the first column."""
    host, path = host_path(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    told = with_membership(parts, "host", listed.where(F.col(listed.columns[0]) != ""), "on_list", **options)
    found = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    return told.withColumn("r", found).select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("on_list"), "block").otherwise("allow")).alias("verdict"),
    )
