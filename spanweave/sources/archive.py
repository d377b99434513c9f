"""Archives of many small entries (index and data file), and packed alignment matrices."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.sources.archive_source import FORMAT, open_archive, open_path, pairs, register

ALIGNMENTS = "entry string, query string, query_length int, idx int, template string, template_length int, probability int, similarity double"
CELLS = "entry string, idx int, kind string, ord int, q int, t int, p double"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="name string, offset long, length long")


def _shard(path: Column) -> Column:
    """A file's name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def read_archive(spark: SparkSession, data_path: str, index_path: str, task_bytes: int = 128 << 20, ranges: bool = True) -> DataFrame:
    """(name, content): each entry without its closing zero byte.

    Either path may name one file, a folder or a pattern. One index and one data file
    belong together whatever their names; of more, those whose names agree up to the
    extension (as write_archive names them), and an index without data file is refused.

    Only the bytes of the entries asked for are read, see archive_source. That needs a
    store pyarrow can open (local or mounted folders, HDFS, S3, GCS); with ranges=False
    data files come through Spark's reader instead, whole, so they may have 2 GB each.
    """
    known = pairs(data_path, index_path)
    if ranges:
        return open_archive(spark, data_path, index_path, task_bytes)
    index = spark.read.csv(index_path, sep="\t", schema="name string, offset long, length long").select("*", _shard(F.col("_metadata.file_path")).alias("shard"))
    whole = spark.read.format("binaryFile").load(data_path).select(_shard(F.col("path")).alias("shard"), "content")
    if len(known) == 1:
        index, whole = index.withColumn("shard", F.lit("")), whole.withColumn("shard", F.lit(""))
    cut = F.expr("substring(content, cast(offset + 1 as int), cast(length - 1 as int))")
    return index.join(whole, "shard").select("name", cut.alias("content"))


def write_archive(entries: DataFrame, out: str, shards: int = 1) -> DataFrame:
    """Write entries(name, content) as data and index files of so many shards under the folder out.

    Entries go to shards by a hash of their name and stand there in the order of their
    names; the last byte of each gives way to the zero byte, names are cut to 64 signs.
    A shard is streamed by one task; files get their names when all tasks have ended, and
    a job that fails leaves none. Returns (shard, data, index, entries, bytes) of what was
    written. out is on a store pyarrow can write.
    """
    spark = register(entries.sparkSession)
    rows = entries.select(F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("shard"), "name", "content")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "name").write.format(FORMAT).mode("append").save(out)
    system, inner = open_path(out)
    if not any(i.base_name.endswith(".ffindex") for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))):
        return spark.createDataFrame([], "shard int, data string, index string, entries long, bytes long")
    index = spark.read.csv(f"{out}/part-*.ffindex", sep="\t", schema="name string, offset long, length long").groupBy(F.col("_metadata.file_path").alias("index")).agg(F.count("*").alias("entries"), F.sum("length").alias("bytes"))
    number = F.regexp_extract("index", r"part-(\d+)\.ffindex$", 1).cast("int").alias("shard")
    return index.select(number, F.regexp_replace("index", r"ffindex$", "ffdata").alias("data"), "index", "entries", "bytes")


def write_entry_to_file(entries: DataFrame, name: str, path: str) -> None:
    """The lines of one entry, each closed by a line end; refuses a name that is not there and content that is not text."""
    row = lines_of(entry_by_name(entries, name)).first()
    if row is None or row["lines"] is None:
        raise ValueError(f"no entry {name}" if row is None else f"entry {name} is not UTF-8")
    system, inner = open_path(path)
    with system.open_output_stream(inner) as out:
        for line in row["lines"]:
            out.write(f"{line}\n".encode())


def lines_of(entries: DataFrame) -> DataFrame:
    """(name, lines); lines is null if the content is not UTF-8."""
    return entries.select("name", F.split(F.try_validate_utf8(F.col("content").cast("string")), "\n").alias("lines"))


def entry_by_name(entries: DataFrame, name: str) -> DataFrame:
    return entries.where(F.col("name") == name).limit(1)


def packed(entries: DataFrame) -> DataFrame:
    """(name, offset, length, payload) of one shard, as a frame: the last byte of an entry gives way to the zero byte; names to 64 signs.

    Entries of a column ``shard`` are packed apart, in the order of their names.
    """
    if "shard" not in entries.columns:
        entries = entries.withColumn("shard", F.lit(0))
    payload = F.concat(F.expr("substring(content, 1, greatest(length(content) - 1, 0))"), F.lit(b"\0"))
    rows = entries.select("shard", F.substring("name", 1, 64).alias("name"), payload.alias("payload")).withColumn("length", F.length("payload").cast("long"))
    ahead = F.sum("length").over(Window.partitionBy("shard").orderBy("name").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return rows.withColumn("offset", ahead)


def _name(data: bytes, at: int) -> tuple[str, int]:
    end = data.index(b"\0", at)
    name = data[at:end].decode()
    return (name.split("|")[1] if "|" in name else name), end + 1


def _matrix(data: bytes, at: int) -> tuple[list, int]:
    cells = []
    while True:
        (q,) = struct.unpack_from(">H", data, at)
        at += 2
        if not q:
            return cells, at
        (t,) = struct.unpack_from(">H", data, at)
        at += 2
        while c := data[at]:
            p = 2.0 ** ((c >> 4) - 15) * (1 + (c & 15) / 16)
            if p > 1:
                raise ValueError(f"probability {p}")
            cells.append((q, t, p))
            t, at = t + 1, at + 1
        at += 1


def decode_alignments(data: bytes) -> tuple[str | None, int | None, list]:
    """(query, its length, alignments); what follows a damaged alignment is left out."""
    out: list = []
    try:
        query, at = _name(data, 0)
        (length,) = struct.unpack_from(">H", data, at)
    except (ValueError, IndexError, struct.error):
        return None, None, out
    at += 2
    while at < len(data) - 2:
        try:
            template, at = _name(data, at)
            t_length, prob, sim = struct.unpack_from(">HBh", data, at)
            at += 5
            matrices = {}
            for kind in "BFP":
                matrices[kind], at = _matrix(data, at)
            if any(q > length for kind in "BF" for q, _, _ in matrices[kind]):
                break
        except (ValueError, IndexError, struct.error):
            break
        out.append((template, t_length, prob, sim / 10, matrices))
    return query, length, out


def _decoded(entries: DataFrame, with_cells: bool) -> DataFrame:
    """Alignment rows, with their cells as an array of (kind, ord, q, t, p) if asked for."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    own = [f.split() for f in ALIGNMENTS.split(",")]
    part = pa.struct([(f, kinds[k]) for f, k in (x.split() for x in CELLS.split(",")[2:])])
    schema = pa.schema([*((f, kinds[k]) for f, k in own), *([("cells", pa.list_(part))] if with_cells else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                query, length, found = decode_alignments(data)
                rows = [(name, query, length, i, t, n, p, s) for i, (t, n, p, s, _) in enumerate(found)]
                columns = [pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema) if f.name != "cells"]
                if with_cells:
                    each = [(kind, o, *cell) for *_, m in found for kind in "BFP" for o, cell in enumerate(m[kind])]
                    ends = np.cumsum([0] + [sum(map(len, m.values())) for *_, m in found])
                    flat = pa.StructArray.from_arrays([pa.array([x[c] for x in each], f.type) for c, f in enumerate(part)], fields=list(part))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    cells = ", cells array<struct<kind:string,ord:int,q:int,t:int,p:double>>" if with_cells else ""
    return entries.where("length(content) > 0").select("name", "content").mapInArrow(run, ALIGNMENTS + cells)


def read_packed(entries: DataFrame) -> DataFrame:
    """entries(name, content) to alignment rows with their cells, an array of (kind, ord, q, t, p): one pass for both."""
    return _decoded(entries, True)


def read_alignments(entries: DataFrame) -> DataFrame:
    """entries(name, content) to alignment rows."""
    return _decoded(entries, False)


def read_cells(entries: DataFrame) -> DataFrame:
    """entries(name, content) to cells of kinds B, F and P."""
    return read_packed(entries).select("entry", "idx", F.inline("cells"))


def read_alignments_file(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows of packed files that are not in an archive; the entry is the file's path."""
    files = spark.read.format("binaryFile").load(path)
    return read_alignments(files.select(F.col("path").alias("name"), "content"))


def dense_profile(cells: DataFrame, lengths: DataFrame) -> DataFrame:
    """(ali, kind, profile): share of a matrix's mass at each query position 0 to query_length, of lengths(ali, query_length).

    A matrix without cells has a vector of NaN, as a share of nothing. One alignment is one array of its query's length.
    """
    by = cells.groupBy("ali", "kind", "q").agg(F.sum("p").alias("p"))
    sums = by.groupBy("ali", "kind").agg(F.map_from_entries(F.collect_list(F.struct("q", "p"))).alias("at"), F.sum("p").alias("total"))
    kinds = lengths.select("ali", "query_length", F.explode(F.array(F.lit("B"), F.lit("F"))).alias("kind"))
    share = lambda q: F.when(F.col("total") > 0, F.coalesce(F.try_element_at("at", q), F.lit(0.0)) / F.col("total")).otherwise(F.lit(float("nan")))
    return kinds.join(sums, ["ali", "kind"], "left").select("ali", "kind", F.transform(F.sequence(F.lit(0), "query_length"), share).alias("profile"))
