"""The training-data operators against brute force, and on odd input."""

import hashlib
import json
import math
import random
import re
import textwrap
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import regex
import xxhash

from pyspark.sql import functions as F

from spanweave.llm import chat, decontaminate, langid, licenses, mixing, quality, rules, simhash, substring, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, did string, n_words string, slot string, host string, path string, starts string, score string, h string, count string"


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs():
    """Copies, near copies, shared passages, nulls, blanks, a long text, repeated rows, letters of two bytes."""
    rng = random.Random(5)
    passage, long_ = prose(rng, 60), prose(rng, 30_000)
    texts = [prose(rng, 80) for _ in range(20)] + [passage, f"{prose(rng, 30)} {passage}\n{prose(rng, 10)}", f"{passage} {passage}"]
    base = prose(rng, 300).split(" ")
    for i in range(15):
        w = list(base)
        w[i * 7] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0], texts[0].upper(), texts[1] + "  ", None, "", " \n\t ", "one", "one two three", "### $$$", "Äpfel ÜBER é\u0085x\u00a0y", long_, long_ + " end", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", "en", "s1", 3), (None, None, None, None, None)]
    return [(*r, *["x"] * 10) for r in rows]


@pytest.fixture(scope="module")
def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3).cache()


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


# --- SimHash near-dedup


def brute_fp(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in root:
            for b in root:
                if (a ^ b).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


@pytest.mark.parametrize("limit", [16_384, 3])
def test_near_duplicates(spark, docs, frame, limit):
    got = Counter(map(tuple, simhash.near_duplicates(frame, shard_limit=limit).collect()))
    fps = [(d[0], brute_fp(d[1])) for d in docs]
    root = brute_components({f for _, f in fps})
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert got == Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fps)


def test_near_duplicates_of_random_fingerprints(spark):
    rng = random.Random(1)
    fps = set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(8):
            fps.add(f)
            for _ in range(rng.randrange(1, 6)):
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for limit in (16_384, 5):
        links = {tuple(r) for r in simhash.near_links(df, 4, limit).collect()}
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = a % (1 << 64), b % (1 << 64)
            root[find(a)] = find(b)
        want = brute_components(fps)
        assert {frozenset(f for f in fps if find(f) == r) for r in map(find, fps)} == {frozenset(f for f in fps if want[f] == r) for r in want.values()}


def test_deduplicated_keeps_one_row_of_each_component(docs, frame):
    got = simhash.deduplicated(frame)
    assert got.columns == frame.columns
    root = brute_components({brute_fp(d[1]) for d in docs})
    groups = {}
    for d in docs:
        groups.setdefault(root[brute_fp(d[1])], []).append(d)
    kept = {root[brute_fp(r.text)]: r.doc_id for r in got.collect()}
    assert got.count() == len(groups)
    assert kept == {k: min((d[0] for d in g if d[0] is not None), default=None) for k, g in groups.items()}


def test_deduplicated_keeps_different_texts_of_one_id(spark):
    rng = random.Random(11)
    texts = [prose(rng, 60, 9000) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[0]), (None, texts[1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, did int, root string")
    assert Counter((r.doc_id, r.text) for r in simhash.deduplicated(df).collect()) == Counter([(3, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])])


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == [] and simhash.deduplicated(empty(spark)).collect() == []


# --- substring dedup


def brute_substring(rows, window=20):
    """(doc_id, text) -> (n_words, n_removed, sha256, kept words)."""
    seen, told = set(), {}
    for i, t in sorted({(d[0] if d[0] is not None else -1, d[1]) for d in rows}, key=lambda x: (x[0], x[1] or "")):
        w, gone = (t or "").encode().split(), set()
        for k in range(len(w) - window + 1):
            q = tuple(w[k : k + window])
            gone.update(range(k, k + window)) if q in seen else seen.add(q)
        kept = [x for k, x in enumerate(w) if k not in gone]
        told[i, t] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), tuple(kept))
    return Counter((d[0], *told[d[0] if d[0] is not None else -1, d[1]]) for d in rows)


def substring_result(df, **options):
    got = substring.substring_dedup(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, tuple((r.kept_text or "").encode().split())) for r in got)


@pytest.mark.parametrize("options", [{}, {"hot": 2, "shard_stretches": 7}, {"hot": 3}, {"shard_stretches": 5}])
def test_substring_dedup(docs, frame, options):
    assert substring_result(frame, **options) == brute_substring(docs)


@pytest.mark.parametrize("window", [8, 9, 17, 31])
def test_substring_dedup_of_other_windows(spark, window):
    rng = random.Random(window)
    parts = [prose(rng, n, 30) for n in (40, 25, 60, 12)]
    rows = [(i, " ".join(rng.choice([*parts, prose(rng, 9, 30), "x y " * 12]) for _ in range(6)).strip()) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_result(df, window=window, hot=4, shard_stretches=50) == brute_substring(rows, window)


def test_substring_dedup_compares_words(spark):
    """Texts that differ in one word, whose hashes as polynomials modulo a power of two are the same."""
    thue_morse = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    words = [f"w{i}" for i in range(39)]
    texts = [" ".join([*words[:19], x, *words[20:]]) for x in (thue_morse, thue_morse.translate(str.maketrans("ab", "ba")))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, f"head {texts[1]} tail")]
    got = substring_result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == brute_substring(rows) and {(k[0], k[2]) for k in got} == {(0, 0), (1, 0), (2, 39)}


def test_phrases_are_confirmed_by_their_words():
    text = b"a b c d e f g h i j k l m n o p q r s t"
    assert substring.recurring_phrases([text, b"x" + text], [0, 0], [15, 16], [False, False]) == set()
    assert substring.recurring_phrases([text, text], [2, 2], [17, 17], [False, False]) == {b"b c d e f g h i"}
    found = substring.automaton_of({b"b c d", b"c d"}).iter(" ab c d b c d ")
    assert [end for end, _ in found] == [7, 13, 13]


def test_substring_dedup_keeps_unchanged_text(spark):
    df = spark.createDataFrame([(1, "  a\tb\n c ", "k", "l")], "doc_id long, text string, n_removed string, starts string")
    r = substring.substring_dedup(df).first()
    assert r.kept_text == "  a\tb\n c " and r.n_removed == 0 and r.starts == "l"
    assert substring.substring_dedup(empty(spark)).collect() == []


def test_window_shorter_than_phrase_is_refused(frame):
    with pytest.raises(ValueError):
        substring.repeated_windows(frame, window=5)


# --- decontamination


def brute_leaks(docs, items, k=5):
    words = lambda t: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower())
    bag = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) > k else Counter([tuple(w)] if w else [])
    out = {}
    for d, t in docs:
        w = words(t)
        for i, it in items:
            wi = words(it)
            if not wi or not w:
                continue
            a = bag(wi)
            best = 0.0
            for s in range(max(1, len(w) - len(wi) + 1)):
                b = bag(w[s : s + len(wi)])
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                out[d, i] = best
    return out


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate([60, 60, 90, 45, 5, 3, 1])] + [(7, None), (8, ""), (9, "!!"), (10, prose(random.Random(9), 50)), (11, prose(random.Random(9), 50))]
    docs = []
    for i, (_, t) in enumerate(items[:7]):
        docs.append((10 * i, f"{prose(rng, 40)} {t.title()}, {prose(rng, 40)}"))
        w = t.split(" ")
        docs.append((10 * i + 1, " ".join(w[2:] + ["tail"])))
        docs.append((10 * i + 2, f"x {' '.join(w[: len(w) // 2] + ['new'] + w[len(w) // 2 + 1 :])} y"))
        docs.append((10 * i + 3, " ".join(w[: len(w) // 2])))
    docs += [(900, None), (901, ""), (902, prose(rng, 3000)), (903, items[10][1]), (None, items[0][1]), (903, items[10][1])]
    df = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, n string, start int")
    it = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, item string")
    want = brute_leaks(set(docs), items)
    for limit in (2_000_000, 0):  # broadcast, shuffled
        got = decontaminate.leaks(df, it, broadcast_shingles=limit).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
        assert len(got) == len(want)
    clean = decontaminate.decontaminated(df, it)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    more = spark.createDataFrame([(None, items[0][1], 1), (None, "clean", 2), (0, "clean", 3), (0, items[0][1], 4)], "doc_id long, text string, did int")
    assert {r.did for r in decontaminate.decontaminated(more, it).collect()} == {2, 3}
    assert decontaminate.leaks(empty(spark), it).collect() == []
    assert decontaminate.leaks(df, it.limit(0)).collect() == []


def test_leaks_between_two_alignments(spark):
    rng = random.Random(11)
    texts = [[f"w{i}x{j}" for j in range(n)] for i, n in enumerate((60, 64, 66, 80, 88))]
    texts.append(prose(rng, 70, vocab=12).split(" "))
    items = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = []
    for i, w in enumerate(texts):
        for ends, new in ((1, 2), (1, 3), (2, 2), (2, 4), (0, 5)):
            for at in (len(w) // 2, len(w) // 3):
                edited = ["new"] * ends + w[ends:at] + ["put"] * new + w[at : len(w) - ends] + ["new"] * ends
                docs += [(len(docs), " ".join(edited)), (len(docs) + 1, f"{prose(rng, 30)} {' '.join(edited)} {prose(rng, 30)}")]
    want = brute_leaks(docs, items)
    assert (0, 0) in want and 30 < len(want) < len(docs)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(df, it).collect()}
    assert got == {k: round(v, 9) for k, v in want.items()}


def test_leaks_of_reordered_copies(spark):
    """Halves and thirds of an item in another order, against windows at every start."""
    rng = random.Random(31)
    items = [(i, " ".join(f"w{i}x{j}" for j in range(n))) for i, n in enumerate((60, 64, 75, 90, 120))] + [(9, prose(rng, 80, vocab=15))]
    docs = []
    for _, t in items:
        w = t.split(" ")
        n = len(w)
        for parts in ([w[n // 2 :], w[: n // 2]], [w[2 * n // 3 :], w[n // 3 : 2 * n // 3], w[: n // 3]], [w[n // 3 :], w[: n // 3]], [w[n // 4 :], w[: n // 4]], [w[::-1]]):
            for around in (0, 25):
                docs.append((len(docs), " ".join([*prose(rng, around).split(), *(x for p in parts for x in p), *prose(rng, around).split()])))
    want = brute_leaks(docs, items)
    assert (0, 0) in want and 15 < len(want) < len(docs)
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(df, it).collect()}
    assert got == {k: round(v, 9) for k, v in want.items()}


def test_leaks_of_items_that_share_an_id(spark):
    rng = random.Random(32)
    a, b, c = (prose(rng, 40, 5000) for _ in range(3))
    items = spark.createDataFrame([(1, a), (1, b), (None, c), (None, a), (2, a), (2, a)], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"x {b} y"), (11, c), (12, f"{a} z")], "doc_id long, text string")
    for limit in (2_000_000, 0):
        got = Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, broadcast_shingles=limit).collect())
        assert got == Counter([(10, 1), (11, None), (12, 1), (12, None), (12, 2)])


# --- quality rules


def test_base_counts(docs):
    for d in docs:
        t = d[1] or ""
        w = WORD.findall(t)
        runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        got = rules.base_counts(d[1])
        assert got[:5] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))


def test_binomial_tests():
    assert rules.proven_level([0, 0, 30, 30], 400, 0.05, 0.01) == 2
    assert rules.proven_level([0], 5, 0.05, 0.05) == 0  # too few to prove anything
    assert rules.aims({"a": [0, 1, 3, 9], "b": [0, 0], "c": [8]}, 100, 0.02) == {"a": 2, "b": 2, "c": 0}
    for k, n, p in [(0, 10, 0.1), (3, 50, 0.02), (7, 200, 0.05), (10, 10, 0.3)]:
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert rules.binomial_cdf(k, n, p) == pytest.approx(min(1, exact), rel=1e-9)


def brute_cutoffs(rows, quality, half, risk=0.05, error=0.05, aim=0.002):
    """rows: (doc_id, text, stratum); a plain walk along the path, document by document."""
    trials = {}
    for i, t, s in rows:
        n, chars, symbols, dup, repeat, lines, capitals = rules.base_counts(t)
        if quality.get(i) == 1 and not (n < 50 or 100 * repeat > 50 * n):
            r = {"symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": repeat / max(n, 1), "long_words": chars / max(n, 1), "capitals": capitals / max(chars, 1)}
            trials.setdefault((s, i), []).append(r)
    out, strata = {}, {s for s, _ in trials}
    for stratum in strata:
        docs = {i: r for (s, i), r in trials.items() if s == stratum}
        a, b = ([r for i, r in docs.items() if half[i] == h] for h in (0, 1))
        steps = {}
        for rule, grid in rules.GRIDS.items():
            steps[rule] = 0
            for c in grid:
                if sum(any(x[rule] > c for x in r) for r in a) > len(a) * aim:
                    break
                steps[rule] += 1
        if not a or not b:
            continue
        proven = dict.fromkeys(rules.GRIDS)
        for level in range(1, rules.LEVELS + 1):
            now = {}
            for rule, grid in rules.GRIDS.items():
                i = math.ceil(steps[rule] * level / rules.LEVELS)
                now[rule] = grid[i - 1] if i else None
            k = sum(any(c is not None and x[rule] > c for x in r for rule, c in now.items()) for r in b)
            tail = sum(math.comb(len(b), i) * risk**i * (1 - risk) ** (len(b) - i) for i in range(k + 1))
            if tail > error / len(strata):
                break
            proven = now
        out[stratum] = proven
    return out


def test_cutoffs_and_verdicts_are_those_of_a_plain_walk(spark):
    rng = random.Random(17)

    def text(kind):
        words = prose(rng, rng.randrange(45, 90)).split()
        if kind < 3:
            words = [w + "#" * rng.randrange(4) if rng.random() < kind / 9 else w.upper() if rng.random() < kind / 5 else w for w in words]
        if kind == 4:
            words += words[: rng.randrange(5, 30)]
        lines = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
        return "\n".join(lines + lines[:1] * (kind == 5))

    rows = [(i, text(rng.choice([0, 0, 0, 0, 0, 1, 2, 3, 4, 5])), rng.choice(["en", "en", "de", None, "", "few"]) if i % 60 else "few") for i in range(1500)]
    rows += [(i, text(2), rows[i][2]) for i in range(0, 40)]  # rows that repeat an id
    quality = {i: int(rng.random() < 0.8) for i in range(1400)}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()], "doc_id long, quality int, toxic int")
    half = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("h")).distinct().collect()}
    want = brute_cutoffs(rows, quality, half)
    got = {r.s: {k: r[f"cut_{k}"] for k in rules.GRIDS} for r in rules.cutoffs(rules.counted(df), labels).collect()}
    none = lambda x: None if x is None or x != x else x
    assert {s: {k: none(v) for k, v in c.items()} for s, c in got.items()} == want
    assert any(v is not None for c in want.values() for v in c.values())
    told = Counter((r.doc_id, r.kept, r.base_failed) for r in rules.quality_rules(df, labels).collect())
    expect = Counter()
    for i, t, s in rows:
        n, chars, symbols, dup, repeat, lines, capitals = rules.base_counts(t)
        bad = n < 50 or 100 * repeat > 50 * n
        r = {"symbols": symbols / max(chars, 1), "dup_lines": dup / max(lines, 1), "repeats": repeat / max(n, 1), "long_words": chars / max(n, 1), "capitals": capitals / max(chars, 1)}
        falls = any(c is not None and r[k] > c for k, c in want.get(s, {}).items())
        expect[i, not bad and not falls, bad] += 1
    assert told == expect


def test_cutoffs_hold_their_risk():
    """Over many draws, the true false rejection is over the risk about as rarely as promised."""
    rng, broken = random.Random(18), 0
    for _ in range(200):
        true = rng.choice([0.06, 0.08, 0.2])
        fallen = sum(rng.random() < true for _ in range(150))
        broken += rules.proven_level([fallen], 150, 0.05, 0.05) > 0
    assert broken <= 10


def test_quality_rules(spark, frame, docs):
    rng = random.Random(3)
    rows = [(1000 + i, prose(rng, 60), "en") for i in range(900)] + [(3000 + i, " ".join(f"{w}###" for w in prose(rng, 60).split()), "en") for i in range(50)] + [(4000, prose(rng, 60), "xx")]
    labels = spark.createDataFrame([(r[0], int(r[0] < 3000), 0) for r in rows] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()}
    assert all(got[1000 + i].kept for i in range(900)) and not any(got[3000 + i].kept for i in range(50))
    assert got[4000].kept and got[3000].failed_rules.startswith("symbols") and not got[3000].base_failed
    odd = rules.quality_rules(frame, labels.limit(0)).collect()
    assert len(odd) == len(docs) and all(r.kept == (not r.base_failed) for r in odd)
    assert rules.quality_rules(empty(spark), labels).collect() == []


# --- URL filter


def urls_host(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.match(r"[^/?#]*", rest)[0])


def test_url_filter(spark):
    rng = random.Random(4)
    hosts = [f"{rng.choice(['www.', 'm.', ''])}h{i}.example.{rng.choice(['com', 'net', 'org'])}" for i in range(300)]
    given = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://b://c/d", "x://net/es/1", "x://fakenet/es/1", "x://É.net/fr/", "http://org?q", "http://org#q"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/1', '/es/2', '/fr/3?a'])}" for _ in range(2000)]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(given)] + [(None, given[20], "h", "x")], "page_id long, url string, host string, verdict string")
    block = lambda h: h != "" and int(hashlib.md5(h.encode()).hexdigest()[0], 16) < 6
    known = [(h,) for h in {urls_host(u) for u in given} if block(h)]
    listed = spark.createDataFrame([*known, known[0], ("not.in.corpus",), ("",), (None,)], "key string")
    want = {}
    for i, u in enumerate(given):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want[i] = (host, path, best[2] if best else None, best[1] if best else "block" if block(host) else "allow")
    for options in ({}, {"shard_keys": 40}, {"shard_keys": 40, "broadcast_bytes": 0, "group_rows": 50}):
        got = urls.filter_urls(pages, listed, **options).collect()
        assert {r.page_id: tuple(r)[1:] for r in got if r.page_id is not None} == want and len(got) == len(given) + 1
    assert urls.filter_urls(empty(spark, "page_id long, url string"), listed).collect() == []
    assert not [r for r in urls.filter_urls(pages, listed.limit(0)).collect() if r.rule is None and r.verdict == "block"]
    long_ = spark.createDataFrame([(1, "http://" + "a" * 100_000 + ".org/" + "b" * 100_000)], "page_id long, url string")
    assert [(len(r.host), len(r.path), r.verdict) for r in urls.filter_urls(long_, long_.select(urls.host_path(F.col("url"))[0])).collect()] == [(100_004, 100_001, "block")]


def test_membership_of_nulls(spark):
    rows = spark.createDataFrame([(None,), ("a",), ("b",)], "k string")
    for options in ({}, {"broadcast_bytes": 0}):
        got = urls.with_membership(rows, "k", spark.createDataFrame([(None,), ("a",)], "x string"), "on", **options)
        assert {r.k: r.on for r in got.collect()} == {None: False, "a": True, "b": False}


def test_cascade_is_exact():
    h = np.random.default_rng(0).integers(-(2**63), 2**63 - 1, (20_000, 2))
    h[5000:6000, 0] = h[4000:5000, 0]  # one 64-bit hash, another key
    h[6000:7000, 1] = h[3000:4000, 1]
    for n in (0, 1, 5000, 20_000):
        levels = urls.build_levels(h[:n], h[n:])
        assert (urls.in_levels(h, levels) == (np.arange(len(h)) < n)).all()


# --- mixing


@pytest.mark.parametrize("weights", [None, {"a": 5, "b": 3, "c": 1, None: 1}, {"a": 1, "b": 1e-9}, {}])
def test_mix(spark, weights):
    sizes = {"a": 700, "b": 333, "c": 10, None: 57}
    rows = [(1000 * k + i, s, "t", 7, "u", "v") for k, (s, n) in enumerate(sizes.items()) for i in range(n)] + [(None, "a", "t", 7, "u", "v")] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string, position int, start string, share string")
    got = mixing.mix(df, weights, block_rows=4, quantum=100, bucket_rows=100).collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[1]) for r in rows)
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(rows)))
    assert all((a.slot, a.offset) < (b.slot, b.offset) for a, b in zip(order, order[1:]))
    assert all(len({r.source for r in got if r.slot == s}) == 1 for s in {r.slot for r in got})


def brute_edf(blocks, weights):
    """Slot by slot over all blocks: of those released, the one due first, ties by source."""
    whole = {s: Fraction(w) for s, w in weights.items()}

    def time(s, k):  # when source s has its share of k blocks
        v = k / whole[s]
        return sum(min(v * whole[x], blocks[x]) for x in blocks)

    todo = {(s, k): (math.floor(time(s, k)), math.ceil(time(s, k + 1))) for s in blocks for k in range(blocks[s])}
    order = []
    for t in range(len(todo)):
        s, k = min((x for x, (release, _) in todo.items() if release <= t), key=lambda x: (todo[x][1], x[0]))
        order.append(s)
        del todo[s, k]
    return order


@pytest.mark.parametrize("seed", range(6))
def test_schedule_is_earliest_deadline_first(seed):
    rng = random.Random(seed)
    blocks = {s: rng.randrange(1, 40) for s in "abcdefg"[: rng.randrange(1, 8)]}
    weights = {s: rng.choice([1, 2, 0.5, rng.random() + 0.01, 7]) for s in blocks}
    plan = mixing.schedule({s: n * 3 - rng.randrange(3) for s, n in blocks.items()}, weights, 3)
    by_slot = {t: s for s, (slots, _) in plan.items() for t in slots}
    assert [by_slot[t] for t in range(len(by_slot))] == brute_edf(blocks, weights)


def test_mix_of_rows_that_share_an_id(spark):
    rows = [(None, "a", f"t{i}", i) for i in range(400)] + [(7, "a", f"u{i}", i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n long")
    one, two = (sorted((r.position, r.text) for r in mixing.mix(x, bucket_rows=16).collect()) for x in (df.repartition(3), df.repartition(7, "text")))
    assert one == two and [p for p, _ in one] == list(range(700)) and len({t for _, t in one}) == 700


def fluid(sizes, weights, blocks):
    """Targets at each slot: the exact shares, in the weights of the sources that have blocks left."""
    left, have, out = dict(blocks), dict.fromkeys(blocks, Fraction(0)), []
    w = {s: Fraction(weights[s]) for s in blocks}
    for _ in range(sum(blocks.values())):
        out.append(dict(have))
        time = Fraction(1)
        while time:
            going = [s for s in blocks if have[s] < left[s]]
            total = sum(w[s] for s in going)
            step = min([time, *((left[s] - have[s]) * total / w[s] for s in going)])
            for s in going:
                have[s] += step * w[s] / total
            time -= step
    return [*out, have]


@pytest.mark.parametrize("case", ["half and 19", "a third", "half and 199", "uneven"])
def test_mix_stays_within_a_block_of_its_target_weights(case):
    if case == "half and 19":
        sizes = {"big": 16 * 8000} | {f"s{i}": 16 * 600 for i in range(19)}
        weights = {s: 0.5 if s == "big" else 0.5 / 19 for s in sizes}
    elif case == "a third":
        sizes = {"big": 16 * 4000} | {f"s{i}": 16 * 421 for i in range(19)}
        weights = {s: n**0.5 for s, n in sizes.items()}
    elif case == "half and 199":
        sizes = {"big": 16 * 3000} | {f"s{i}": 16 * 20 for i in range(199)}
        weights = {s: 199 if s == "big" else 1 for s in sizes}
    else:
        sizes = {s: 16 * n for s, n in zip("abcdef", (5, 900, 31, 1, 250, 77))}
        weights = {"a": 1e-9, "b": 0.3, "c": 7, "d": 1e9, "e": 2, "f": 2}
    blocks = {s: n // 16 for s, n in sizes.items()}
    plan, at = mixing.schedule(sizes, weights, 16), dict.fromkeys(sizes, 0)
    by_slot = {t: s for s, (slots, _) in plan.items() for t in slots}
    assert sorted(by_slot) == list(range(sum(blocks.values())))
    if case != "uneven":  # the targets as long as no source has ended
        total = sum(Fraction(w) for w in weights.values())
        share = {s: Fraction(w) / total for s, w in weights.items()}
        last = min(slots[-1] for slots, _ in plan.values())
        assert last > 3000
        for t in range(last):
            at[by_slot[t]] += 1
            assert all(abs(at[s] - (t + 1) * share[s]) < 1 for s in (by_slot[t], "big", f"s{t % 19}"))
    else:
        for t, target in enumerate(fluid(sizes, weights, blocks)):
            assert all(abs(at[s] - target[s]) < 1 for s in sizes)
            if t in by_slot:
                at[by_slot[t]] += 1


@pytest.mark.parametrize("broadcast", [True, False])
def test_mix_of_many_sources(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
        monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
        monkeypatch.setattr(mixing, "BROADCAST_BUCKETS", 0)
    rows = [(i, f"host{i % 2500}" if i % 7 else None) for i in range(9000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=2).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((i, s or "") for i, s in rows)
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(rows)))
    assert all((a.slot, a.offset) < (b.slot, b.offset) for a, b in zip(order, order[1:]))
    assert all(r.offset < 2 for r in got) and len({(r.source, r.slot) for r in got}) == len({r.slot for r in got})


def test_mix_of_nothing(spark):
    assert mixing.mix(empty(spark, "doc_id long, source string")).collect() == []


# --- chat


def test_chat(spark):
    call = lambda i, name, args: {"id": i, "name": name, "arguments": args}
    say = lambda *calls: json.dumps({"tool_calls": list(calls), "content": "ask \"x\""})
    rows = [
        (1, 0, "system", "be é/kind"), (1, 1, "user", None), (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "late"})),
        (1, 3, "assistant", say(call("c1", "search", {"query": "q", "limit": 3}), call("c2", "weather", {"metric": True, "city": "B"}))),
        (1, 4, "tool", json.dumps({"content": "42", "tool_call_id": "c2"})), (1, 5, "tool", json.dumps({"tool_call_id": "zz", "content": 1})),
        (2, 0, "assistant", say(call("c1", "search", {"query": 5}))), (2, 1, "tool", json.dumps({"tool_call_id": "c1", "content": ""})),
        (3, 0, "assistant", say(call("c9", "calculator", {"expression": "1"}))), (3, 1, "assistant", say(call("d", "nope", {}))), (3, 2, "assistant", "{not json"),
        (3, 3, "assistant", say(call("e", "search", {"query": "x", "other": 1}))), (3, 4, "assistant", say(call(None, "search", {"query": "x"}))),
        (None, 0, "user", "hi"), (None, 1, "assistant", say(call("n", "calculator", {"expression": "2"}))), (None, 2, "tool", json.dumps({"tool_call_id": "n", "content": "2"})),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (5, None, None, ""), (6, 0, "assistant", '{"tool_calls": [], "content": "none"}'),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, status string, json string")
    got = chat.format_chat(df).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    status = {k: r.status for k, r in at.items()}
    assert status[1, 3] == "call" and status[1, 4] == status[1, 2] == "result" and status[1, 5] == "unlinked_result"
    assert status[2, 0] == "invalid_call" and status[3, 0] == "unanswered_call" and status[3, 2] == "plain"
    assert status[3, 1] == status[3, 3] == status[3, 4] == "invalid_call" and status[None, 1] == "call" and status[6, 0] == "call"
    ordered = sorted((r for r in got if r.conv_id == 1), key=lambda r: (r.order_turn, r.order_rank, r.turn))
    assert [r.turn for r in ordered] == [0, 1, 3, 2, 4, 5]
    canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert at[1, 0].json == canon({"role": "system", "content": "be é/kind"}) and at[1, 1].json == canon({"role": "user", "content": None})
    assert at[1, 3].json == canon({"role": "assistant", "content": 'ask "x"', "tool_calls": [call("c1", "search", {"query": "q", "limit": 3}), call("c2", "weather", {"metric": True, "city": "B"})]})
    assert at[1, 4].json == canon({"role": "tool", "content": "42", "tool_call_id": "c2"})
    assert chat.format_chat(df.limit(0)).collect() == []


def brute_chat(rows):
    """(status, json, order_turn, order_rank) of each message, in plain Python."""
    def load(role, text):
        if role not in ("assistant", "tool") or text is None or not text.lstrip(" ").startswith("{"):
            return None
        try:
            return json.loads(text)
        except ValueError:
            return None

    types = {"string": lambda x: isinstance(x, str), "integer": lambda x: type(x) is int, "boolean": lambda x: isinstance(x, bool)}

    def fits(c):
        spec, args = chat.SCHEMAS.get(c.get("name")), c.get("arguments")
        if spec is None or not isinstance(args, dict) or set(args) - set(spec):
            return False
        return all(types[kind](args[a]) if a in args else not required for a, (kind, required) in spec.items())

    canon = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    parsed = [load(role, text) for _, _, role, text in rows]
    calls = [v["tool_calls"] if v and r[2] == "assistant" and isinstance(v.get("tool_calls"), list) else None for r, v in zip(rows, parsed)]
    of = [v["tool_call_id"] if v and r[2] == "tool" and isinstance(v.get("tool_call_id"), str) else None for r, v in zip(rows, parsed)]
    out = []
    for r, v, own, result in zip(rows, parsed, calls, of):
        if own is not None:
            answered = all(any(r[0] == q[0] and c.get("id") == i for q, i in zip(rows, of) if i is not None) for c in own)
            status = "call" if all(c.get("id") is not None and fits(c) for c in own) and answered else "unanswered_call"
            status = status if all(c.get("id") is not None and fits(c) for c in own) else "invalid_call"
            said = {"content": v.get("content"), "role": r[2], "tool_calls": [{k: c.get(k) for k in ("arguments", "id", "name")} for c in own]}
            out.append((status, canon(said), r[1], 0))
        elif result is not None:
            turns = [q[1] for q, c in zip(rows, calls) if c is not None and q[0] == r[0] and any(x.get("id") == result for x in c)]
            out.append(("result" if turns else "unlinked_result", canon({"content": v.get("content"), "role": r[2], "tool_call_id": result}), max(r[1], min(turns)) if turns else r[1], 1))
        else:
            out.append(("plain", canon({"content": r[3], "role": r[2]}), r[1], 0))
    return out


def test_chat_is_that_of_a_plain_walk(spark):
    rng = random.Random(21)
    names, long_ = ["search", "calculator", "weather", "nope"], "é\"\\ \n" * 40_000
    value = lambda: rng.choice(["x", 5, True, "", long_[:9]])
    rows = [(1, 0, "user", long_), (1, 1, "assistant", json.dumps({"tool_calls": [{"id": "long", "name": "search", "arguments": {"query": long_}}], "content": None})), (1, 2, "tool", json.dumps({"tool_call_id": "long", "content": long_}))]
    for conv in (1, 2, None):
        for turn in range(3, 60):
            kind = rng.random()
            if kind < 0.35:
                keys = rng.sample(["query", "limit", "expression", "city", "days", "metric"], rng.randint(0, 2))
                made = [{"id": rng.choice([f"c{rng.randrange(25)}", None]) if rng.random() < 0.2 else f"c{rng.randrange(25)}", "name": rng.choice(names), "arguments": {k: value() for k in keys}} for _ in range(rng.randint(0, 3))]
                rows.append((conv, turn, "assistant", json.dumps({"content": rng.choice([None, "say"]), "tool_calls": made})))
            elif kind < 0.75:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(25)}", "content": rng.choice(["out", "", None])})))
            else:
                rows.append((conv, turn, rng.choice(["user", "assistant", "tool", None]), rng.choice(["hi", "", None, "{broken", '{"tool_calls": 5}', "[1]"])))
    rows += rows[5:9]
    got = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    key = lambda x: repr(x)
    want = sorted(((r[0], r[1], *w) for r, w in zip(rows, brute_chat(rows))), key=key)
    assert sorted(((r.conv_id, r.turn, r.status, r.json, r.order_turn, r.order_rank) for r in got), key=key) == want


# --- licences


def test_licenses(spark):
    mit = f"{licenses.SENTENCES[6][1]}\n\n{licenses.SENTENCES[7][1]}"
    apache = "\n".join(t for n, t in licenses.SENTENCES if n.startswith("apache2-") and n != "apache2-notice")
    bsd3, bsd2 = ["\n".join(t for n, t in licenses.SENTENCES if n.startswith("bsd-"))], None
    bsd2 = "\n".join(bsd3[0].split("\n")[:3])
    texts = [
        (0, None, []), (1, "", []), (2, "Some prose. Released under the  MIT LICENSE. More.", ["MIT"]), (3, f"head\n{mit}\ntail", ["MIT"]), (4, apache, ["Apache-2.0"]),
        (5, bsd3[0], ["BSD-3-Clause"]), (6, bsd2, ["BSD-2-Clause"]), (7, "\n".join(reversed(bsd2.split("\n"))), []), (8, "x.\n" * 2000 + "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", ["CC-BY-NC-4.0", "MIT"]),
        (None, "This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]), (9, "!!! ... ???", []),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in texts] + [(2, texts[2][1], "x")], "doc_id long, text string, licenses string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts) + 1 and {r.doc_id: r.licenses for r in got} == {i: x for i, _, x in texts}
    assert licenses.scan(empty(spark)).collect() == []


@pytest.mark.parametrize("mark", ["# ", "// ", "/* ", " * ", "-- ", "<!-- ", "- ", "> ", ";; ", "#", '"', "• ", "_"])
def test_licenses_in_comments(mark):
    table = licenses.known_sentences(licenses.SENTENCES)
    for name, sentence in licenses.SENTENCES:
        assert [x[0] for x in licenses.identifiers(f"x\n{mark}{sentence}\n{mark}y", table)] == [name]


def test_licenses_are_those_of_a_brute_force_scan():
    table, rng = licenses.known_sentences(licenses.SENTENCES), random.Random(12)
    known = {licenses.normalised(t): n for n, t in licenses.SENTENCES if not re.search(r"[.!?;]\s", t)}
    for _ in range(200):
        lines = [rng.choice(["", "# ", "* ", "<!-- ", "... "]) + rng.choice([prose(rng, 4), "İΑΣ licensed", *(t for n, t in licenses.SENTENCES if n in known.values())]) for _ in range(8)]
        want = [known[p] for p in map(licenses.normalised, re.split(r"(?<=[.!?;])\s+|\n+", "\n".join(lines))) if p in known]
        assert [x[0] for x in licenses.identifiers("\n".join(lines), table)] == want


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "    "])
def test_wrapped_licenses(mark):
    table, of = licenses.known_sentences(licenses.SENTENCES), dict(licenses.SENTENCES)
    cases = {("mit-grant", "mit-include"): "MIT", ("bsd-grant", "bsd-source", "bsd-binary"): "BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"): "BSD-3-Clause", ("gpl-free",): "GPL-3.0-or-later", ("gpl2-free",): "GPL-2.0-or-later", ("apache2-grant", "apache2-use", "apache2-obtain"): "Apache-2.0"}
    for names, licence in cases.items():
        for width in (30, 72, 80):
            for end in ("\n", "\r\n"):
                wrapped = [line for n in names for line in [*textwrap.wrap(of[n], width, break_long_words=False, break_on_hyphens=False), ""]]
                text = end.join(mark + x for x in ["A title", *wrapped, "Other words."])
                found = licenses.identifiers(text, table)
                assert [x[0] for x in found] == list(names) and [x for _, x in licenses.matched(found, licenses.LICENSES)] == [licence]
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required'
    assert [x[0] for x in licenses.identifiers("\n".join(mark + x for x in apache.split("\n")), table)] == ["apache2-grant", "apache2-use", "apache2-obtain"]
    assert licenses.identifiers(f"{mark}Permission is hereby granted, free\n{mark}of cost, to any person\n{mark}Released under the MIT\n{mark}Licenses.", table) == []


def test_sentences_of_a_rule_stand_near():
    table, of = licenses.known_sentences(licenses.SENTENCES), dict(licenses.SENTENCES)
    for gap, want in ((0, ["MIT"]), (20, ["MIT"]), (21, []), (10_000, [])):
        text = "\n".join([of["mit-grant"], *["other words here"] * gap, "#", "", of["mit-include"]])
        assert [x for _, x in licenses.matched(licenses.identifiers(text, table), licenses.LICENSES)] == want


def test_whole_licences():
    """All sentences of a licence, wrapped, are one licence, and no other rule counts them."""
    table, of = licenses.known_sentences(licenses.SENTENCES), dict(licenses.SENTENCES)
    for licence, needs in licenses.LICENSES:
        text = "\n".join(line for n in needs for line in [*textwrap.wrap(of[n], 72, break_long_words=False, break_on_hyphens=False), ""])
        assert [x for _, x in licenses.matched(licenses.identifiers(text, table), licenses.LICENSES)] == [licence]


# --- quality classifier


def test_quality_classifier(spark, frame, docs):
    rng = random.Random(6)
    good = [(i, prose(rng, 60), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(f"{w}$$$" for w in prose(rng, 40).split()), "en", "s9") for i in range(80)]
    toxic = [(2000 + i, f"{prose(rng, 30)} idiot {prose(rng, 30)} scum", "de", "s1") for i in range(80)]
    rows = good + junk + toxic
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, p string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000 or r[0] >= 2000), int(r[0] >= 2000)) for r in rows if r[0] % 2] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    for sites in (100_000, 0):
        got = {r.did: r.kept for r in quality.classify(df, labels, broadcast_sites=sites).collect()}
        held = [r for r in rows if r[0] % 2 == 0]
        right = sum(got[r[0]] == (r[0] < 1000) for r in held)
        assert right >= 0.97 * len(held), right / len(held)
    assert quality.classify(frame, labels).count() == len(docs)
    alike = quality.classify(frame, labels.where("quality = 1 and toxic = 0")).collect()
    assert len(alike) == len(docs) and all(r.kept for r in alike)
    assert quality.classify(empty(spark), labels).collect() == []


def test_quality_classifier_knows_markers_of_few_labelled_rows(spark):
    rng = random.Random(13)
    rows = [(i, prose(rng, 40), "en", "s", 0) for i in range(3080)]
    rows += [(10_000 + i, f"{prose(rng, 20)} {i // 10:02d}zzq {prose(rng, 20)}", "en", "s", 1) for i in range(700)]  # 5 labelled rows a marker
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(r[0], 1, r[4]) for r in rows if r[0] % 2], "doc_id long, quality int, toxic int")
    got = {r.did: r.kept for r in quality.classify(df, labels).collect()}
    held = [r for r in rows if r[0] % 2 == 0]
    assert sum(not got[r[0]] for r in held if r[4]) >= 0.95 * 350
    assert sum(got[r[0]] for r in held if not r[4]) >= 0.95 * 1540


def test_site_posteriors_are_those_of_plain_sums(spark):
    rng = random.Random(14)
    rows = []
    for i in range(900):
        host, path = rng.choice([("a", "x"), ("a", "y"), ("b", "x"), (None, "x"), ("", "x"), (None, None), (f"h{i}", "z")])
        bad = rng.random() < (0.6 if host in ("b", None) else 0.1)
        rows.append((i, " ".join(f"{w}$" if bad else w for w in prose(rng, 40).split()), host, path, bad))
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], int(not r[4]), 0) for r in rows if r[0] % 3 == 0], "doc_id long, quality int, toxic int")
    got = {r.did: r for r in quality.classify(df, labels).collect()}
    e = {r[0]: float(not r[4]) if r[0] % 3 == 0 else got[r[0]].p_document for r in rows}
    host_of, site_of = {}, {}
    for i, _, h, p, _ in rows:
        host_of.setdefault(h, []).append(i)
        site_of.setdefault((h, p), []).append(i)
    total = lambda ids: sum(e[i] for i in ids)
    mean = total(e) / len(e)

    def weight(groups, means):
        inner = mean * (1 - mean)
        spread = sum(len(g) * (total(g) / len(g) - m) ** 2 for g, m in zip(groups, means)) / len(e)
        return min(max(inner / max(spread - inner * len(groups) / len(e), 1e-9) - 1, 1.0), 1e4)

    m_host = weight(list(host_of.values()), [mean] * len(host_of))
    m_path = weight(list(site_of.values()), [total(host_of[h]) / len(host_of[h]) for h, _ in site_of])
    for i, _, h, p, _ in rows:
        host = (total(host_of[h]) - e[i] + m_host * mean) / (len(host_of[h]) - 1 + m_host)
        site = (total(site_of[h, p]) - e[i] + m_path * host) / (len(site_of[h, p]) - 1 + m_path)
        site = min(max(site, 1e-6), 1 - 1e-6)
        odds = math.log(got[i].p_document / (1 - got[i].p_document)) + 0.25 * (math.log(site / (1 - site)) - math.log(mean / (1 - mean)))
        assert got[i].p_site == pytest.approx(site, abs=1e-6) and got[i].p_good == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-6)
        assert got[i].kept == (got[i].p_good >= 0.6)


def test_fit_takes_one_text_of_an_id(spark):
    rows = [(i % 5, f"t{i} x", "s", "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    words, form = quality.fitted(df, labels)
    assert not words.any() and len(form) == 10 and quality.classify(df, labels).count() == 200  # 5 rows: no word tells


# --- language ID


def test_language_id(spark):
    rng = random.Random(7)
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["schl", "ung", "eit", "ver"], "cc": ["ção", "lha", "nho", "é"]}
    rows = [(i, " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(50)), lang) for i, lang in enumerate(list(parts) * 60)]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !!", "cc"), (503, rows[0][1], None), (None, rows[1][1], "bb"), (504, "\U0001f600 ka", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, lang_pred string, score string")
    got = langid.identify_held_out(df).collect()
    assert len(got) == len(rows)
    at = {r.doc_id: r for r in got}
    held = [r for r in rows[:180] if at[r[0]].held_out]
    assert len(held) > 20 and all(at[r[0]].lang_pred == r[2] for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    assert [at[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and at[503].lang_pred == "aa" and at[None].lang_pred == "bb"
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert langid.identify_held_out(df.limit(0)).collect() == []
    none = langid.identify_held_out(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def han(rng, n):
    return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))


def corrected(model, text):
    """Shares of a text's grams over all shards of the filter."""
    h = langid.grams(text)
    own = langid._shard(h, model.shards)
    filters = [model.filter(k) for k in range(model.shards)]
    found = sum(f.found(h[own == k]) for k, f in enumerate(filters))
    expected = sum((own == k).sum() * f.false for k, f in enumerate(filters))
    return np.clip((found - expected) / np.maximum(len(h) - expected, 1e-9), 0, 1)


@pytest.mark.parametrize("filter_bytes", [langid.FILTER_BYTES, 1 << 16])
def test_every_taught_gram_is_in_the_filter(spark, filter_bytes):
    """Languages of over 20,000 n-grams, each used as often as the others, with one shard and with many."""
    rng = random.Random(21)
    latin = lambda n=40: " ".join(rng.choice(["the", "river", "of", "stone", "walks", "under"]) for _ in range(n))
    text, other = han(rng, 60_000), han(rng, 30_000)
    rows = [(1, text, "zh"), (1, text, "zh"), (3, latin(), "en"), (5, other, "ja"), (7, latin(), "en")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), filter_bytes=filter_bytes)
    assert model.languages == ["en", "ja", "zh"] and (model.shards == 1) == (filter_bytes == langid.FILTER_BYTES)
    sets = {k: set(x for r in rows if r[2] == k for x in langid.grams(r[1]).tolist()) for k in model.languages}
    assert len(sets["zh"]) > 50_000 and len(sets["ja"]) > 25_000
    mixed = [text, other, text[:20_000] + other[:12_000], latin(300), "the river " + text[:50], han(rng, 500), "", None]
    for t in filter(None, mixed):
        h = langid.grams(t).tolist()
        exact = np.array([np.mean([x in sets[k] for x in h]) for k in model.languages])
        share = corrected(model, t)
        assert np.abs(share - exact).max() < (0.005 if len(h) > 10_000 else 0.05)
        assert all(s > 0.9999 for s, x in zip(share, exact) if x == 1)  # no taught gram is missing
    got = {r.i: r for r in langid.identify(spark.createDataFrame(list(enumerate(mixed)), "i long, text string"), model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 3, 6, 7)] == ["zh", "ja", "en", "und", "und"] and len(got) == len(mixed)
    assert all(abs(got[i].score - corrected(model, t).max()) < 1e-12 for i, t in enumerate(mixed) if t)


def test_language_of_even_grams_is_learned(spark):
    rng = random.Random(21)
    latin = lambda: " ".join(rng.choice(["the", "river", "of", "stone", "walks", "under"]) for _ in range(40))
    rows = [(i, han(rng, 120) if i % 2 else latin(), "zh" if i % 2 else "en") for i in range(800)]
    got = {r.doc_id: r for r in langid.identify_held_out(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(r.lang_pred == rows[i][2] for i, r in got.items() if not r.held_out)


def test_filter_returns_all_languages_of_a_gram(spark):
    """Masks, popcounts and the decision against plain sets, for more languages than a slice has bits."""
    rng = random.Random(23)
    words = {f"l{k:02d}": [prose(rng, 1, 900).replace("w", rng.choice("abcdefg") * 2 + chr(97 + k % 26)).translate(str.maketrans("0123456789", "qrstuvwxyz")) for _ in range(12)] for k in range(70)}
    texts = {k: " ".join(w) for k, w in words.items()}
    rows = [(i, t, k) for i, (k, t) in enumerate(texts.items())]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    sets = {k: set(langid.grams(t).tolist()) for k, t in texts.items()}
    assert model.languages == sorted(texts)
    one = model.filter(0)
    for k, t in texts.items():
        h = langid.grams(t)
        exact = np.array([np.mean([x in sets[c] for x in h.tolist()]) for c in model.languages])
        assert np.abs(corrected(model, t) - exact).max() < 0.05
        assert langid.decided(model.languages, len(h), one.found(h), len(h) * one.false)[0] in [c for c, x in zip(model.languages, exact) if x == exact.max()]


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    good = [(i, prose(rng, 90, 5000), "en", f"s{i % 2}", 1) for i in range(150)]
    item = prose(rng, 50, 5000)
    passage = prose(rng, 55, 5000)
    rows = good + [(200, good[5][1], "en", "s0", 1), (201, f"{prose(rng, 60, 5000)} {item} {prose(rng, 60, 5000)}", "en", "s1", 1)]
    rows += [(210 + i, f"{prose(rng, 60, 5000)} {passage} {prose(rng, 60, 5000)}", "en", "s1", 1) for i in range(3)]
    rows += [(300 + i, " ".join(f"{w}$$$" for w in prose(rng, 40).split()), "en", "s1", 1) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).toPandas())
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(seen[name])
    ids = {k: set(v) for k, v in seen.items()}
    assert not any(i >= 300 for i in ids["quality_classifier"]) and len(ids["quality_classifier"]) >= 0.95 * (len(rows) - 60)
    assert ids["quality_classifier"] - ids["simhash_near_dedup"] == {200} & ids["quality_classifier"]
    kept = seen["substring_dedup"]
    assert passage in kept[210].text and all(passage not in kept[i].text and len(kept[i].text.split()) == 120 for i in (211, 212) if i in kept)
    assert ids["substring_dedup"] - ids["benchmark_decontamination"] == {201} & ids["substring_dedup"]
    assert ids["mix_sources"] == ids["benchmark_decontamination"]
    assert {r.doc_id: r.position for r in pipeline.run(spark, str(tmp_path)).collect()} == {i: r.position for i, r in seen["mix_sources"].items()}


def test_pipeline_keeps_rows_of_no_or_of_one_id(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    item = prose(rng, 50, 5000)
    texts = [prose(rng, 90, 5000) for _ in range(6)] + [f"{prose(rng, 40, 5000)} {item}"]
    ids = [None, None, None, 4, 4, 5, None]
    rows = [(i, t, None, None, None, 1, "s", "h", "k") for i, t in zip(ids, texts)] + [(None, texts[0], None, None, None, 1, "s", "h", "k"), (9, texts[0], None, None, None, 1, "s", "h", "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, did int, starts string, n_words string, lo string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = pipeline.run(spark, str(tmp_path))
    assert got.columns[:9] == [c.split()[0] for c in schema.split(", ")]
    assert Counter((r.doc_id, r.text, r.n_words) for r in got.collect()) == Counter([(9, texts[0], "h"), *[(i, t, "h") for i, t in zip(ids[1:6], texts[1:6])]])
