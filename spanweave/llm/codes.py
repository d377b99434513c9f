"""Product codes of vectors: a codebook for each part of the dimensions, searched by exponion.

A component x is the whole number floor(scale * x); vectors are cut into ``parts``
equal runs, which have a codebook each. A codebook starts as that part of the first
``entries`` rows by id (null ids last, equal ids by vector). A round gives every part
its nearest entry (squared Euclidean distance, ties to the lower index) and then puts
floor(mean) of its parts in place of each entry that has any; after the last round the
parts are given their entries once more.

Search starts at the entry a of the round before (of no round: entry 0). Let u be the
part's distance to a. An entry j that is as near has d(a, j) <= d(a, x) + d(x, j) <= 2u,
so a's list of entries, sorted by distance from a, is scanned up to 2u and no further;
in squares, up to 4 * u^2. All distances are whole numbers without rounding: sums under
2^53 go through doubles, others through longs, and vectors whose distances would not fit
a long are refused with an OverflowError (components of 2^28 / scale and less always fit 16 dimensions).

Each round reads the rows with their entries from a written table and writes the next
one, whose tasks add one row of sums each; so the vectors are never shuffled, and only the
sums of entries, as many as a codebook has numbers, come to the driver.

Rows whose vector is null or holds a null or a component that is not finite are left
out. Shorter vectors count as filled up with zeros, to the longest and to a multiple of
``parts``. Repeated rows are coded each and weigh each; fewer rows than ``entries`` make a
smaller codebook. An empty table gives an empty result. Null labels are one label. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import small, written
from spanweave.llm.vectors import lists, matrix, whole_vectors

#: Parts whose neighbour lists are scanned at once.
CHUNK = 512


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the rows of c."""
    most = max((int(max(a.max(), -a.min())) for a in (x, c) if a.size), default=0)
    bound = 4 * most * most * max(1, x.shape[1])
    if bound >= 1 << 61:
        raise OverflowError(f"squared distances of components up to {most} do not fit a long")
    if bound < 1 << 53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    d = x @ c.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (c * c).sum(1)[None, :]
    return d


class Codebook:
    """Entries of one part, with each entry's list of entries by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = squared(entries, entries)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.near = np.take_along_axis(between, self.order, axis=1).astype(np.int64)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, and the squared distance; start: any entry, best a near one."""
        code, error = start.copy(), np.zeros(len(x), np.int64)
        by = np.argsort(start, kind="stable")
        cut = np.flatnonzero(np.diff(start[by])) + 1
        for rows in np.split(by, cut) if len(by) else []:
            a = start[rows[0]]
            own = squared(x[rows], self.entries[a : a + 1])[:, 0].astype(np.int64)
            reach = np.searchsorted(self.near[a], 4 * own, side="right")
            rows, reach = rows[inside := np.argsort(reach, kind="stable")], reach[inside]
            for at in range(0, len(rows), CHUNK):
                some = rows[at : at + CHUNK]
                known = self.order[a, : reach[min(at + CHUNK, len(rows)) - 1]]
                d = squared(x[some], self.entries[known])
                least = d.min(1)
                code[some] = np.where(d == least[:, None], known, len(self.entries)).min(1)
                error[some] = least
        return code, error


def _coded(books: list[Codebook], width: int, rest: list[str]):
    """Rows (rest, x, code, sums) with their new entries; at a task's end a row with the counts and sums of all entries."""
    parts, k = len(books), len(books[0].entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, schema = np.zeros((parts, k, width + 1), np.int64), None
        for b in batches:
            schema = b.schema
            x, code = matrix(b.column("x"), parts * width), matrix(b.column("code"), parts)
            for p, book in enumerate(books):
                own = x[:, p * width : (p + 1) * width]
                code[:, p], _ = book.nearest(own, code[:, p])
                np.add.at(total[p], code[:, p], np.column_stack((np.ones(len(own), np.int64), own)))
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in rest), lists(x, pa.int64()), lists(code, pa.int32()), pa.nulls(len(x), pa.list_(pa.int64()))], [*rest, "x", "code", "sums"])
        if schema is not None:
            none = [pa.nulls(1, kind) for kind in [*(schema.field(f).type for f in rest), pa.list_(pa.int64()), pa.list_(pa.int32())]]
            yield pa.RecordBatch.from_arrays([*none, lists(total.reshape(1, -1), pa.int64())], [*rest, "x", "code", "sums"])

    return run


def _moved(books: list[Codebook], table: DataFrame) -> list[Codebook]:
    """Codebooks of the floors of the means; entries without parts stay."""
    entries = np.array([b.entries for b in books])
    parts, k, width = entries.shape
    value = F.sum(F.col("v").cast("decimal(38,0)")).alias("v")
    flat = table.where("sums is not null").select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(value)  # a row for each number of the codebooks
    found = {r["i"]: int(r["v"]) for r in flat.collect()}
    for i in range(parts * k):
        at, n = i * (width + 1), found.get(i * (width + 1), 0)
        if n:
            entries[i // k, i % k] = [found[at + 1 + j] // n for j in range(width)]
    return [Codebook(e) for e in entries]


def _told(books: list[Codebook], width: int, rest: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, code = matrix(b.column("x"), len(books) * width), matrix(b.column("code"), len(books))
            error = np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                code[:, p], more = book.nearest(x[:, p * width : (p + 1) * width], code[:, p])
                error += more
            text = [bytes(r).hex() for r in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in rest), pa.array(text, pa.string()), pa.array(error)], [*rest, "code", "error"])

    return run


def fingerprint(books: list[Codebook]) -> str:
    """SHA-256 of all entries' components by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.entries.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, list[np.ndarray]]:
    """((vec_id, label, code, error), the codebooks, one for each part)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    rows, dim = whole_vectors(vectors, scale, vec_col, vec_id=id_col, label=label_col)
    width = -(-dim // parts)
    if width * parts > dim:
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), width * parts - dim)))
    first = [r["x"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()]
    first = np.array(first, np.int64).reshape(len(first), parts, width)
    books = [Codebook(first[:, p]) for p in range(parts)]
    rest, kinds = ["vec_id", "label"], {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    own = ", ".join(f"{f} {kinds[f]}" for f in rest)
    now = rows.withColumn("code", F.array_repeat(F.lit(0), parts)).withColumn("sums", F.lit(None).cast("array<long>"))
    for _ in range(rounds):
        now = written(now.where("sums is null").select(*rest, "x", "code").mapInArrow(_coded(books, width, rest), f"{own}, x array<long>, code array<int>, sums array<long>"), "coded")
        books = _moved(books, now)
    done = now.where("sums is null").select(*rest, "x", "code").mapInArrow(_told(books, width, rest), f"{own}, code string, error long")
    return written(done, "codes"), [b.entries for b in books]


def coded(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256); label_error: the errors' sum over rows of equal labels, nulls together."""
    rows, entries = vector_codes(vectors, **options)
    of_label = written(rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = rows.join(F.broadcast(of_label) if small(of_label) else of_label, F.col("label").eqNullSafe(F.col("__label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint([Codebook(e) for e in entries])).alias("codebooks_sha256"))


def decoded(codes: DataFrame, codebooks: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """codes with x, the whole-number vector that a code stands for: its entries side by side."""
    fields = codes.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.frombuffer(b"".join(bytes.fromhex(c) for c in b.column(code_col).to_pylist()), np.uint8).reshape(b.num_rows, len(codebooks))
            x = np.concatenate([e[code[:, p]] for p, e in enumerate(codebooks)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, lists(x, pa.int64())], [*fields, "x"])

    return codes.mapInArrow(run, f"{schema}, x array<long>")
