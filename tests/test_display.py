"""Grids of graphs and matrices, and the viewers of the command line."""

import pytest
from test_core import HHR, packed_alignments

from spanweave import __main__ as cli
from spanweave.operators import display
from spanweave.sources import archive


def test_adjacency_grid(spark):
    edges = spark.createDataFrame([("a", "b", 0.125), ("b", "a", 0.375), ("a", "c", 1.0), ("c", "x", 0.5)], "src string, dst string, w double")
    got = {r.id: tuple(r)[1:] for r in display.adjacency_grid(edges, ["a", "b", "c", "lone"]).collect()}
    assert got == {"a": ("", "0.12", "1.00", ""), "b": ("0.38", "", "", ""), "c": ("", "", "", ""), "lone": ("", "", "", "")}
    with pytest.raises(ValueError, match="the limit is 500"):
        display.adjacency_grid(edges, list(map(str, range(501))))


def test_posterior_grid(spark):
    post = spark.createDataFrame([(1, 2, 1, 0.25), (1, 3, 1, 0.75), (1, 3, 4, 1.0), (2, 9, 1, 0.5)], "ali int, q int, t int, p double")
    got = sorted(map(tuple, display.posterior_grid(post, 3, 2).collect()))
    assert got == [(1, 1, "0.2", "0.8", "0"), (1, 4, "0", "1.0", "0"), (2, 1, "0", "0", "0")]


def test_viewers(spark, tmp_path, capsys):
    (tmp_path / "e").write_text("a b 0.9\nb c 0.8\nz\n")
    cli.run(spark, ["show-graph", f"{tmp_path}/e", "a", "b", "z"])
    lines = capsys.readouterr().out.split("\n")
    assert lines[0].split() == ["a", "b", "z"] and lines[2].split() == ["a", "0.90"] and lines[4].split() == ["z"]
    (tmp_path / "h").write_text(HHR)
    cli.run(spark, ["show-hits", f"{tmp_path}/h"])
    lines = capsys.readouterr().out.split("\n")
    assert lines[0].startswith("0\tevalue 1e-05") and lines[1] == "d1\t1\tABCDEF\t6" and lines[2].split("\t")[1:] == ["3", "ABCEEF", "8"]
    cells = [(q, q + 1, 224 + 8 * q) for q in (1, 2)]
    packed = packed_alignments("q", 9, [("t", 9, 90, 0, cells, cells, cells)])
    archive.write_archive(spark.createDataFrame([("one", packed + b"?"), ("two", b"?")], "name string, content binary"), f"{tmp_path}/a")
    cli.run(spark, ["show-matrix", f"{tmp_path}/a", f"{tmp_path}/a", "one"])
    assert [x.split() for x in capsys.readouterr().out.split("\n")[2:4]] == [["0", "2", "0.8", "0"], ["0", "3", "0", "1.0"]]
    cli.run(spark, ["components", f"{tmp_path}/e", f"{tmp_path}/c", "--exact"])
    assert len(spark.read.text(f"{tmp_path}/c").collect()) == 2
