"""Archives as a data source: what a lookup reads, and what a failed job leaves."""

import pytest

from pyspark.sql import functions as F

from spanweave.sources import archive
from spanweave.sources.archive_source import FORMAT, _lines, register


def entries_of(n):
    return [(f"e{i:03d}", f"entry {i}".encode() * (1 + i % 5) + b"?") for i in range(n)]


def test_every_line_of_an_index_is_in_one_range(tmp_path, monkeypatch):
    path = tmp_path / "i"
    for block in (3, 7, 1 << 20):
        monkeypatch.setattr("spanweave.sources.archive_source._BLOCK", block)
        for text in ("a\nbb\n\nccc\ndddddddd\n", "a\nbb", "long line without an end", "\n\n"):
            path.write_text(text)
            whole = text.encode().split(b"\n")
            whole = whole[:-1] if whole[-1] == b"" else whole
            for n in (1, 2, 3, 5, len(text)):
                cuts = [len(text) * i // n for i in range(n + 1)]
                assert [x for a, b in zip(cuts, cuts[1:]) for x in _lines(str(path), a, b)] == whole


@pytest.mark.parametrize("task_bytes", [1 << 27, 200])
def test_reads(spark, tmp_path, task_bytes):
    rows = entries_of(60)
    archive.write_archive(spark.createDataFrame(rows, "name string, content binary"), f"{tmp_path}/a", 4)
    back = register(spark).read.format(FORMAT).option("data", f"{tmp_path}/a").option("index", f"{tmp_path}/a").option("task_bytes", task_bytes).load()
    assert {r.name: bytes(r.content) for r in back.collect()} == {n: c[:-1] for n, c in rows}
    assert back.rdd.getNumPartitions() >= (4 if task_bytes > 200 else 8)
    assert {r.name for r in back.where(F.col("name").isin("e003", "e040", "none") & (F.length("content") > 0)).collect()} == {"e003", "e040"}
    assert back.where("name = 'e003' and name = 'e004'").collect() == []


def test_a_lookup_reads_its_entry_only(spark, tmp_path):
    """The data file ends behind the entry, so a task that read another would fail."""
    archive.write_archive(spark.createDataFrame(entries_of(50), "name string, content binary"), f"{tmp_path}/a", 1)
    data = tmp_path / "a" / "part-00000.ffdata"
    end = sum(len(c) for _, c in entries_of(4))
    data.write_bytes(data.read_bytes()[:end])
    back = archive.read_archive(spark, f"{tmp_path}/a/*.ffdata", f"{tmp_path}/a/*.ffindex")
    assert [bytes(r.content) for r in archive.entry_by_name(back, "e003").collect()] == [entries_of(4)[3][1][:-1]]
    with pytest.raises(Exception, match="ends before entry e004"):
        back.where("name = 'e004'").collect()
    with pytest.raises(Exception, match="ends before entry"):
        back.collect()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "a"
    archive.write_archive(spark.createDataFrame(entries_of(20), "name string, content binary"), str(out), 2)
    before = {p.name: p.read_bytes() for p in out.iterdir()}
    rows = spark.createDataFrame(entries_of(40), "name string, content binary").repartition(4)
    late = F.when(F.col("name") == "e031", F.raise_error(F.lit("no more")).cast("binary")).otherwise(F.col("content"))
    with pytest.raises(Exception, match="no more"):
        archive.write_archive(rows.select("name", late.alias("content")), str(out), 3)
    assert {p.name: p.read_bytes() for p in out.iterdir()} == before


def test_tasks_without_shards_name_their_files(spark, tmp_path):
    rows = spark.createDataFrame(entries_of(30), "name string, content binary").repartition(3)
    register(spark)
    rows.write.format(FORMAT).mode("append").save(f"{tmp_path}/a")
    assert len(list((tmp_path / "a").glob("*.ffdata"))) == 3
    assert archive.read_archive(spark, f"{tmp_path}/a", f"{tmp_path}/a").count() == 30
