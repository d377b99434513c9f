"""Joins beyond the size of a broadcast, shards of close fingerprints, and the pipeline on odd rows."""

import random
from collections import Counter

import pytest

from pyspark.sql import functions as F

from spanweave.llm import common, decontaminate, rules, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocab=3000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def odd_rows(rng, item):
    passage, long_ = prose(rng, 60), prose(rng, 25_000)
    texts = [prose(rng, 90) for _ in range(30)] + [f"{prose(rng, 30)} {passage}", f"{passage} {prose(rng, 30)}", f"{prose(rng, 20)} {item} {prose(rng, 20)}", long_, None, "", " \n "]
    rows = [(i, t, ["en", None][i % 2], ["s0", "s0", None][i % 3], None) for i, t in enumerate(texts)]
    return rows + [(50, texts[0], "en", "s0", 1), (51, texts[0].upper(), "en", "s1", 1), rows[3], rows[3], (None, None, None, None, None), (None, prose(rng, 70), None, None, None)]


def test_shuffled_joins_give_the_rows_of_broadcast_ones(spark, monkeypatch):
    rng = random.Random(31)
    item = prose(rng, 50)
    docs = spark.createDataFrame(odd_rows(rng, item), SCHEMA).repartition(3).cache()
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")

    def all_rows():
        told = (
            simhash.deduplicated(docs), substring.substring_dedup(docs), decontaminate.decontaminated(docs, items),
            rules.quality_rules(docs, labels, broadcast_strata=100_000 if common.BROADCAST_KEYS > 0 else -1),
        )
        return [Counter(map(str, df.collect())) for df in told]

    few = all_rows()
    monkeypatch.setattr(common, "BROADCAST_KEYS", -1)
    monkeypatch.setattr(substring, "BROADCAST_KEYS", -1)
    assert all_rows() == few and all(few)


def test_shards_are_dealt_again_only_by_more_blocks_than_bits_may_differ():
    """With radius bits or fewer left there would be too few blocks: two fingerprints may differ in all of them."""
    for radius in (0, 1, 4):
        for left in range(radius + 1, 65):
            blocks = simhash._blocks(list(range(left)), radius + 1)
            assert len(blocks) == radius + 1 and sorted(b for block in blocks for b in block) == list(range(left))


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in all columns, blanks, a long text, copies and repeated rows: one of each group stays, nothing else goes."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(32)
    item = prose(rng, 50)
    rows = odd_rows(rng, item)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    kept = Counter(r.doc_id for r in got)
    assert all(n == 1 for n in kept.values())
    gone = {50, 51, 32}  # copies, and the document with the item
    blanks = {34, 35, 36}  # null, empty and blank texts are copies of each other: the least id stays
    assert set(kept) == {r[0] for r in rows} - gone - (blanks - {34})
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert next(r for r in got if r.doc_id == 33).text == rows[33][1]


def test_pipeline_without_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns[:5] == [c.split()[0] for c in SCHEMA.split(", ")]


def test_leaks_are_found_by_the_index(spark, monkeypatch):
    """A window finds any item of its length; with one of the 23 blocks in the index, only windows that agree there are left."""
    rng = random.Random(4)
    base = prose(rng, 60).split()
    texts = [" ".join("new" if j in (k, 30 + k) else w for j, w in enumerate(base)) for k in range(12)]  # near copies of each other, all of one length
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{prose(rng, 20)} {' '.join(base)} {prose(rng, 20)}") for k in range(8)], "doc_id long, text string")
    said = lambda: {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in decontaminate.leaks(docs, items, similarity=0.6).collect()}
    whole = said()
    assert len(whole) == 96 and {start for start, _ in whole.values()} == {20}
    plain = decontaminate._blocks
    monkeypatch.setattr(decontaminate, "_blocks", lambda fp, radius: F.slice(plain(fp, radius), 1, 1))
    some = said()
    assert some != whole and all(some[k][1] <= whole[k][1] for k in some)
    monkeypatch.setattr(decontaminate, "_blocks", lambda fp, radius: F.slice(plain(fp, radius), 1, 0))
    assert said() == {}
