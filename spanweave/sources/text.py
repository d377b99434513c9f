"""Text sources and sinks. Schemas are fixed; nothing is inferred."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanweave.functions.scalars import exact_4f, intervals_text
from spanweave.operators.components import materialize

HIT_FIELDS = (
    "query_id string, query_length int, query_neff double, template_id string, template_info string, template_neff double, query_ali string, "
    "template_ali string, q_start int, q_end int, t_start int, t_end int, probability double, evalue double, score double, aligned_cols int, "
    "identity double, similarity double, sum_probs double, ord int"
)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_no); line_no ascends with the place in the file and keeps order across its parts."""
    return spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("line_no"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w, cov, line_no) of lines with one to four tokens."""
    tokens = F.split(F.trim("value"), r"\s+")
    at = lambda i, kind: F.try_element_at(tokens, F.lit(i)).cast(kind)
    return _lines(spark, path).where(F.trim("value") != "").select(at(1, "string").alias("src"), at(2, "string").alias("dst"), at(3, "double").alias("w"), at(4, "double").alias("cov"), "line_no")


def read_fragments(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(seq, domain_no, line_no, frag_no, start, end); a part without a dash is passed over, or refused if strict."""
    tokens = F.split(F.trim("value"), r"\s+")
    rows = _lines(spark, path).where(F.size(tokens) >= 3).select(
        tokens[0].alias("seq"), F.split(tokens[1], "_")[1].cast("int").alias("domain_no"), "line_no", F.posexplode(F.split(tokens[2], ",")).alias("frag_no", "part")
    )
    ends = F.split("part", "-")
    if strict:
        rows = rows.where(F.when(F.size(ends) < 2, F.raise_error(F.concat(F.lit("one-residue fragment "), "part"))).otherwise(F.lit(True)))
    return rows.where(F.size(ends) >= 2).select("seq", "domain_no", "line_no", "frag_no", ends[0].cast("int").alias("start"), ends[1].cast("int").alias("end"))


def read_domain_ids(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).select(F.split(F.trim("value"), r"\s+")[1].alias("id")).where("id is not null").distinct()


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="exemplar string, member string")


def read_component_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="component string, src string, dst string, w double")


def write_graph(edges: DataFrame, isolated: DataFrame, path: str) -> None:
    """src, dst, weight by tab; a node without outgoing edges alone on its line."""
    lines = edges.select(F.concat_ws("\t", "src", "dst", F.col("w").cast("string")).alias("value"))
    lines.union(isolated.select(F.col("id").alias("value"))).write.text(path)


def plain_decimal(w: Column) -> Column:
    """A number of four decimals at most, in its shortest form with one decimal at least."""
    return F.regexp_replace(F.format_string("%.4f", w), r"(\.\d+?)0+$", "$1")


def write_scores(scores: DataFrame, path: str) -> None:
    """scores(src, dst, w): src, dst, weight with four decimals, by tab."""
    scores.select(F.concat_ws("\t", "src", "dst", exact_4f("w")).alias("value")).write.text(path)


def write_similarity_graph(edges: DataFrame, path: str, four_decimals: bool = True) -> None:
    """src, dst, weight by tab, in both directions as given; weights of four decimals are written plainly."""
    w = plain_decimal(F.col("w")) if four_decimals else F.col("w").cast("string")
    edges.select(F.concat_ws("\t", "src", "dst", w).alias("value")).write.text(path)


def write_merged_clusters(members: DataFrame, path: str) -> None:
    """members(cluster, seq, domain, frags): a cluster's name and a tab before its first domain, a line for each domain.

    Clusters named by numbers come first, by number, then the others by name.
    """
    number = F.col("cluster").try_cast("long")
    order = [number.isNull(), number, F.col("cluster"), F.col("seq"), F.col("frags")[0]["start"], F.col("domain")]
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(*order[3:])) == 1
    line = F.concat(F.when(first, F.concat("cluster", F.lit("\t"))).otherwise(F.lit("")), "seq", F.lit(" "), intervals_text(F.col("frags")))
    members.withColumn("value", line).orderBy(*order).select("value").write.text(path)


def cluster_lines(members: DataFrame) -> DataFrame:
    """(cluster, value): a cluster's domains by line, for display."""
    return members.select("cluster", F.concat_ws(" ", "seq", intervals_text(F.col("frags"))).alias("value"))


def write_intervals(found: DataFrame, predicted: DataFrame, out: str) -> None:
    """out_map.dat of found(query_id, template, start, end) and out_pred.dat of predicted(template, seq_n, interval)."""
    part = F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string"))
    found.select(F.concat_ws("\t", "query_id", "template", part).alias("value")).write.text(f"{out}_map.dat")
    predicted.select(F.concat_ws("\t", "template", "seq_n", "interval").alias("value")).write.text(f"{out}_pred.dat")


def write_clusters(clusters: DataFrame, path: str) -> None:
    clusters.select("exemplar", "member").orderBy("exemplar", "member").write.csv(path, sep="\t")


def write_component_edges(edges: DataFrame, path: str) -> None:
    edges.orderBy("component", "src", "dst").select("component", "src", "dst", "w").write.csv(path, sep="\t")


def read_a3m(lines: DataFrame) -> DataFrame:
    """lines(entry, line_no, value) to (entry, rec_no, header, seq): comments aside, lines of a record joined."""
    w = Window.partitionBy("entry").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("value").startswith(">")
    rows = lines.where(~F.col("value").startswith("#")).withColumn("rec_no", F.sum(head.cast("int")).over(w)).where("rec_no > 0")
    return rows.groupBy("entry", "rec_no").agg(
        F.max(F.when(head, F.col("value"))).alias("header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~head, F.struct("line_no", F.rtrim("value").alias("v"))))), lambda x: x["v"]), "").alias("seq"),
    )


def parse_hits(lines: list[str]) -> list[dict]:
    """Hits of one search result, in its order."""
    shared = {"query_id": None, "query_length": None, "query_neff": None}
    hits, hit, started = [], None, False
    scores: dict = {}

    def close() -> None:
        if hit and hit["query_ali"]:
            hits.append({**shared, **scores, **hit, "ord": len(hits)})

    number = re.compile(r"[()]")
    for line in lines:
        if line.startswith(("No ", "Done!")) and started:
            close()
            hit = None
        elif line.startswith(">"):
            started = True
            name, _, info = line[1:].partition(" ")
            hit = {"template_id": name.strip(), "template_info": info.strip(), "query_ali": "", "template_ali": "", "q_start": None, "q_end": None, "t_start": None, "t_end": None}
        elif line.startswith("Probab="):
            given = dict(x.split("=", 1) for x in line.split() if "=" in x)
            of = lambda k: float(given[k].rstrip("%")) if k in given else None
            scores |= {"probability": of("Probab"), "evalue": of("E-value"), "score": of("Score"), "aligned_cols": int(of("Aligned_cols") or 0), "identity": (of("Identities") or 0) / 100, "similarity": of("Similarity"), "sum_probs": of("Sum_probs")}
            if "Template_Neff" in given:  # else the hit before keeps giving it
                scores["template_neff"] = of("Template_Neff")
        elif not started and line.startswith("Query"):
            shared["query_id"] = line.split()[1]
        elif not started and line.startswith("Match_columns"):
            shared["query_length"] = int(line.split()[1])
        elif not started and line.startswith("Neff"):
            shared["query_neff"] = float(line.split()[1])
        elif hit and line[:2] in ("Q ", "T "):
            tokens = line.split()
            if len(tokens) < 5 or tokens[1] in ("ss_dssp", "ss_pred", "Consensus"):
                continue
            side = "q" if line[0] == "Q" else "t"
            lo, hi = int(number.sub("", tokens[2])), int(number.sub("", tokens[4]))
            hit["query_ali" if side == "q" else "template_ali"] += tokens[3]
            hit[f"{side}_start"] = lo if hit[f"{side}_start"] is None else min(lo, hit[f"{side}_start"])
            hit[f"{side}_end"] = hi if hit[f"{side}_end"] is None else max(hi, hit[f"{side}_end"])
    close()
    return hits


def _parsed_hits(entries: DataFrame) -> DataFrame:
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = f"name string, {HIT_FIELDS}, error string"
    schema = pa.schema([(name, types[kind]) for name, kind in (f.split() for f in fields.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, lines in zip(*(c.to_pylist() for c in b.columns)):
                if lines is None:
                    rows.append({"name": name, "error": "not UTF-8"})
                    continue
                try:
                    rows += [{"name": name, **h} for h in parse_hits(lines.split("\n"))]
                except (ValueError, IndexError) as e:
                    rows.append({"name": name, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(rows, schema)

    text = entries.select("name", F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return text.mapInArrow(run, fields)


def read_hits(entries: DataFrame) -> DataFrame:
    """entries(name, content) to (name, the fields of HIT_FIELDS); an entry that is not UTF-8 or is malformed gives no hit, see hit_errors."""
    return _parsed_hits(entries).where("error is null").drop("error")


def hit_errors(entries: DataFrame) -> DataFrame:
    """(name, error) of the entries read_hits passes over."""
    return _parsed_hits(entries).where("error is not null").select("name", "error")


def hits_and_errors(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What read_hits and hit_errors give, from one pass over the entries, which is written."""
    parsed = materialize(_parsed_hits(entries), "hits")
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("name", "error")


def read_hits_file(spark: SparkSession, path: str) -> DataFrame:
    """The hits of search results that are files of their own; the name is the file's path."""
    whole = spark.read.text(path, wholetext=True)
    return read_hits(whole.select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("content")))


def skipped_fragments(spark: SparkSession, path: str) -> DataFrame:
    """One row: the parts of a prediction file (n) and those of one residue, which read_fragments passes over (n_skipped)."""
    tokens = F.split(F.trim("value"), r"\s+")
    parts = _lines(spark, path).where(F.size(tokens) >= 3).select(F.explode(F.split(tokens[2], ",")).alias("part"))
    return parts.agg(F.count("*").alias("n"), F.count_if(F.size(F.split("part", "-")) < 2).alias("n_skipped"))
