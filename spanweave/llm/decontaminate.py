"""Benchmark decontamination, in DataFrame functions only.

Words are the lower-cased runs of letters and digits. A text's features are its
shingles of ``shingle_words`` words (fewer words: the whole sequence), weighted
by how often they occur. A document leaks an item if one of its windows, as long
as the item, has a weighted Jaccard similarity (sum of the lesser over sum of
the greater weights) of ``similarity`` or more to the item.

1. Only windows that share ``similarity`` of an item's shingles can reach it. Each
   shared shingle has the starts that align it with the item's, and the best window
   starts between the least and the greatest of those it holds: moved toward them, a
   window loses no shared shingle. So windows are laid at all starts from the least to
   the greatest of the shared shingles that one window can hold, if these are enough;
   moved inside the document.
2. Each window gets a 64-bit SimHash of its weighted shingles and finds the items of
   its length in a multi-index: radius + 1 bit blocks, of which two fingerprints
   within the radius share one at least. So wide a radius needs blocks of two or three
   bits, through which most items of that length pass; windows are few, as step 1 lays
   them only where a leak may be. Windows of similarity 0.8
   share 8 of 9 shingles and differ in 10 bits, standard deviation 2.9; the
   default radius of 22 is over four of these away.
3. The exact weighted similarity decides.

Null, blank and wordless texts, in documents or items, leak nothing. Rows that
repeat a doc_id and text give one result; the same doc_id, or none, with another
text is another document. Items are told apart by id and text: equal texts of
different ids each give one result, different texts of one id (or none) too, a
repeated row none. Very long texts are read whole. Without documents, or items, there
are no results. Extra columns are ignored. The items' shingles are broadcast only if
they are ``broadcast_shingles`` at most (counted first, with the index), else both
sides are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm.common import doc_key, join_by_key, only_keys, written


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of the runs of k words; of all words, if they are fewer; none of none."""

    def runs(hashed: Column) -> Column:
        n = F.size(hashed)
        each = F.transform(hashed, lambda h, i: F.xxhash64(h, *[F.get(hashed, i + j) for j in range(1, k)]))
        return F.slice(each, F.lit(1), F.when(n > k, n - (k - 1)).otherwise(F.least(n, F.lit(1))))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def _bit(b: int) -> int:
    return 1 << b if b < 63 else -(1 << 63)


def fingerprint(shingles: Column) -> Column:
    """SimHash: a bit is 1 if set in over half of the shingle hashes, repeats included."""
    bits = F.array(*[F.lit(_bit(b)) for b in range(64)])
    return F.aggregate(
        bits,
        F.lit(0).cast("long"),
        lambda acc, bit: acc.bitwiseOR(F.when(F.size(F.filter(shingles, lambda h: h.bitwiseAND(bit) != 0)) * 2 > F.size(shingles), bit).otherwise(F.lit(0).cast("long"))),
    )


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays, an element's weight being its number of occurrences."""
    common = F.aggregate(
        F.array_intersect(a, b),
        F.lit(0),
        lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))),
    )
    return common / (F.size(a) + F.size(b) - common)


def _cuts(radius: int) -> list[tuple[int, int]]:
    """Bits lo to hi of each of radius + 1 blocks."""
    cut = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    return list(zip(cut, cut[1:]))


def _blocks(fp: Column, radius: int) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
        for i, (lo, hi) in enumerate(_cuts(radius))
    ])


def _first_equal(apart: Column, radius: int) -> Column:
    """The first block in which two fingerprints, apart in these bits, agree."""
    return F.coalesce(*[F.when(F.shiftrightunsigned(apart, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) == 0, F.lit(i)) for i, (lo, hi) in enumerate(_cuts(radius))])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): of each pair the best window, the first of equals."""
    return keyed_leaks(docs, items, id_col, text_col, **options).drop("did", "tk")


def keyed_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    shingle_words: int = 5, similarity: float = 0.8, radius: int = 22, broadcast_shingles: int = 2_000_000,
) -> DataFrame:
    """leaks() with the documents' keys (did, tk)."""
    k = shingle_words
    of_items = (
        items.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("words"))
        .select("item", F.size("words").alias("n"), shingles_of(F.col("words"), k).alias("item_shingles"))
        .where("n > 0").withColumn("ik", F.xxhash64("n", "item_shingles"))
    )
    of_items = written(of_items, "items")
    named = of_items.select("item", "ik").distinct()
    bodies = written(of_items.dropDuplicates(["ik"]).select("ik", "n", "item_shingles", fingerprint(F.col("item_shingles")).alias("item_fp")), "bodies")
    seeds = bodies.select("ik", "n", F.size("item_shingles").alias("m"), F.posexplode("item_shingles").alias("j", "h"))
    seeds = seeds.groupBy("ik", "n", "m", "h").agg(F.min("j").alias("j0"), F.max("j").alias("j1"))
    short = [r["n"] for r in bodies.where(F.col("n") < k).select("n").distinct().collect()]  # k - 1 lengths at most
    seeds = written(seeds, "seeds")
    size = bodies.agg(F.coalesce(F.sum(F.size("item_shingles") + radius + 1), F.lit(0))).first()[0]  # of the bodies and of the index
    small = size <= broadcast_shingles
    held = F.broadcast if small else lambda x: x
    texts = docs.select(F.col(id_col).alias("id"), *doc_key(docs, id_col, text_col), F.col(text_col).alias("text"))

    def hits(kk: int, table: DataFrame) -> DataFrame:
        """(did, tk, ik, n, m, p, lo, hi): shingle p is in item ik and aligned with it by starts from lo to hi."""
        worded = texts.select("did", "tk", words_of(F.col("text")).alias("words"))
        each = worded.select("did", "tk", F.posexplode(shingles_of(F.col("words"), kk)).alias("p", "h"))
        known = table.select("h").distinct()
        if small:
            known, table = F.broadcast(known), F.broadcast(table)
        return each.join(known, "h", "left_semi").join(table, "h").select("did", "tk", "ik", "n", "m", "p", (F.col("p") - F.col("j1")).alias("lo"), (F.col("p") - F.col("j0")).alias("hi"))

    found = hits(k, seeds.where(F.col("n") >= k))
    for n in short:
        found = found.union(hits(n, seeds.where(F.col("n") == n)))
    found = found.groupBy("did", "tk", "ik", "n", "m").agg(F.sort_array(F.collect_set(F.struct("p", "lo", "hi"))).alias("hits"))
    least = F.greatest(F.ceil(F.col("m") * similarity - 1e-9).cast("int"), F.lit(1))  # shared shingles that the similarity needs

    def spans(hit: Column, i: Column) -> Column:
        """The starts between those of the hits that a window with this hit first can hold; none if they are too few."""
        held = F.filter(F.slice("hits", i + 1, F.col("m")), lambda x: x["p"] < hit["p"] + F.col("m"))
        enough = F.get("hits", i + least - 1)["p"] < hit["p"] + F.col("m")
        return F.when(enough, let(held, lambda x: F.struct(F.array_min(F.transform(x, lambda y: y["lo"])).alias("lo"), F.array_max(F.transform(x, lambda y: y["hi"])).alias("hi"))))

    found = found.select("did", "tk", "ik", "n", F.explode(F.array_distinct(F.filter(F.transform("hits", spans), lambda x: x.isNotNull()))).alias("span"))
    found = found.select("did", "tk", "ik", "n", F.explode(F.sequence("span.lo", "span.hi")).alias("start"))
    found = written(found.groupBy("did", "tk").agg(F.collect_set(F.struct("n", "start")).alias("places")), "places")
    laid = only_keys(texts, found.select("did", "tk")).join(found, ["did", "tk"]).dropDuplicates(["did", "tk"])

    def lay(words: Column) -> Column:
        total = F.size(words)

        def cut(shingles: Column):
            def at(n: Column, start: Column) -> Column:
                run = F.slice(shingles, start + 1, F.greatest(F.least(n, total) - (k - 1), F.lit(1)))
                if short:
                    run = F.when(F.least(n, total) < k, shingles_of(F.slice(words, start + 1, F.least(n, total)), k)).otherwise(run)
                return F.struct(n.alias("n"), start.alias("start"), run.alias("shingles"))

            moved = F.transform("places", lambda x: F.struct(x["n"].alias("n"), F.greatest(F.least(x["start"], total - x["n"]), F.lit(0)).alias("start")))
            return F.transform(F.array_distinct(moved), lambda x: at(x["n"], x["start"]))

        return let(shingles_of(words, k), cut)

    windows = written(laid.select("id", "did", "tk", F.inline(let(words_of(F.col("text")), lay))), "windows").withColumn("fp", fingerprint(F.col("shingles")))
    index = bodies.select("ik", "n", "item_fp", F.inline(_blocks(F.col("item_fp"), radius)))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = (
        windows.select("*", F.inline(_blocks(F.col("fp"), radius)))
        .join(held(index), ["n", "block", "value"])  # a window meets every item of its length that is within the radius
        .where(F.col("block") == _first_equal(apart, radius))  # a pair that shares several blocks is met once
        .withColumn("hamming", F.bit_count(apart))
        .where(F.col("hamming") <= radius)
        .join(held(bodies.select("ik", "item_shingles")), "ik")
        .withColumn("similarity", weighted_jaccard(F.col("shingles"), F.col("item_shingles")))
        .where(F.col("similarity") >= similarity)
    )
    best = F.max_by(F.struct("start", "n", "hamming", "similarity"), F.struct("similarity", -F.col("start")))
    return pairs.groupBy("id", "did", "tk", "ik").agg(best.alias("b")).join(held(named), "ik").select(
        "did", "tk", F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("b.start").alias("start_word"), F.col("b.n").alias("n_words"),
        F.col("b.hamming").cast("int").alias("hamming"), F.col("b.similarity").alias("similarity"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that leak an item."""
    bad = written(keyed_leaks(docs, items, id_col, text_col, **options).select("did", "tk").distinct(), "leaks")
    return join_by_key(docs, bad, "left_anti", id_col, text_col)
