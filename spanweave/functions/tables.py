"""Table functions for SQL: search results and packed alignments, one row of an archive at a time.

After register_tables(spark):

    select d.* from entries, lateral decode_alignments(name, content) d
    select h.* from entries, lateral decode_hits(name, content) h

Content that is null, empty, not UTF-8 (hits) or malformed gives no rows; of damaged
alignments those before the damage are given.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from spanweave.sources.archive import ALIGNMENTS, decode_alignments
from spanweave.sources.text import HIT_FIELDS, parse_hits


@udtf(returnType=f"{ALIGNMENTS}, cells array<struct<kind:string,ord:int,q:int,t:int,p:double>>")
class DecodeAlignments:
    def eval(self, name: str, content: bytes) -> Iterator[tuple]:
        query, length, found = decode_alignments(bytes(content or b""))
        for i, (template, n, probability, similarity, m) in enumerate(found):
            yield name, query, length, i, template, n, probability, similarity, [(kind, o, *cell) for kind in "BFP" for o, cell in enumerate(m[kind])]


@udtf(returnType=f"name string, {HIT_FIELDS}")
class DecodeHits:
    fields = [f.split()[0] for f in HIT_FIELDS.split(",")]

    def eval(self, name: str, content: bytes) -> Iterator[tuple]:
        try:
            hits = parse_hits(bytes(content or b"").decode().split("\n"))
        except (ValueError, IndexError):  # UnicodeDecodeError is a ValueError
            return
        for h in hits:
            yield (name, *(h.get(f) for f in self.fields))


def register_tables(spark: SparkSession) -> SparkSession:
    spark.udtf.register("decode_alignments", DecodeAlignments)
    spark.udtf.register("decode_hits", DecodeHits)
    return spark
