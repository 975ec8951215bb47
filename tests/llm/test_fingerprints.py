import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import fingerprints
from weftline.llm.fingerprints import anchors, document_fingerprints, likeness, op10_fingerprints, shared_in_order, with_neighbours

SF = "/root/testdata/sf0.001"


def texts(seed, n):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(["é", "b", "c", "longer", "w%d" % rng.randrange(500)]) for _ in range(rng.randint(0, 120)))) for i in rng.sample(range(10 * n), n)]


def neighbours(spark, rows):
    """Rows of one id are in the order of their texts' hashes."""
    distinct = sorted({r[1] or "" for r in rows})
    hashes = spark.createDataFrame([(i, t) for i, t in enumerate(distinct)], "i int, t string").orderBy("i").select(F.xxhash64("t")).collect()
    place = {t: h[0] for t, h in zip(distinct, hashes, strict=True)}
    ordered = sorted(rows, key=lambda r: (r[0] if r[0] is not None else -(1 << 63), place[r[1] or ""]))
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        yield i, text, text[: len(text) - half] + after[:half], after


def check(spark, rows, found):
    expected = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in neighbours(spark, rows)), key=repr)
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == expected


def dice(a, b):
    """Twice the anchors shared, less the breaks in their order."""
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    if not a and not b:
        return 1.0
    both = [x for x in a if x in b]
    other = [x for x in b if x in a]
    follows = set(zip(other, other[1:], strict=False))
    breaks = sum((x, y) not in follows for x, y in zip(both, both[1:], strict=False))
    return 2 * (len(both) - breaks) / (len(a) + len(b))


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_edited_texts_and_likeness(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", block)
    rows = texts(1, 80) + [(100_000, None), (-5, ""), (2_000_000_000, "only words")]
    found = document_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    check(spark, rows, found)
    lists = {r.doc_id: r for r in found}
    prints = {i: re.findall(".{11}", lists[i].fingerprint) for i in lists}
    edits = {i: re.findall(".{11}", lists[i].edited_fingerprint) for i in lists}
    order = sorted(prints)
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        assert lists[i].near_edited == pytest.approx(dice(prints[i], edits[i])) and lists[i].near_next == pytest.approx(dice(prints[i], prints[j]))


def test_single_row_empty_table_null_and_equal_ids(spark):
    one = document_fingerprints(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert document_fingerprints(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "x y z"), (3, "b b"), (3, "a a a"), (4, "cc")]
    found = document_fingerprints(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, block int")).collect()
    check(spark, rows, found)


@pytest.mark.parametrize("ids", [[7] * 60, [None] * 60, list(range(60)), [*range(50), None, 1 << 62, -(1 << 62), *range(1 << 40, (1 << 40) + 7)]], ids=["one", "null", "dense", "far"])
def test_blocks_are_even_whatever_the_ids_are(spark, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 100)
    rows = [(i, f"text number {k:03d}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    check(spark, rows, document_fingerprints(df).collect())
    counts = [r["count"] for r in with_neighbours(df).where("not borrowed").groupBy("block").count().collect()]
    assert sum(counts) == len(rows) and max(counts) <= 25 and len(counts) >= 5


def test_rows_alike_in_id_and_text_share_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_BYTES", 200)
    rows = [(7, "the same text")] * 200 + [(i, f"text {i}") for i in range(20)] + [(None, "nothing")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    check(spark, rows, document_fingerprints(df).collect())
    assert max(r["count"] for r in with_neighbours(df).where("not borrowed").groupBy("block").count().collect()) <= 90


def anchors_of(spark, found_texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(found_texts)], "i int, t string")
    return {r.i: list(r.a) for r in df.select("i", anchors(F.col("t")).alias("a")).collect()}


@pytest.mark.parametrize("n", [1, 2, 5, 6, 11, 12, 23, 24, 25, 300])
def test_anchors_are_closed_syncmers(spark, n):
    words = [""] * 5 + [f"w{random.Random(i).randrange(900)}" for i in range(n)] + [""] * 5
    inner = [r[0] for r in spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))], "i int, a string, b string").orderBy("i").select(F.xxhash64("a", "b")).collect()]
    places = [i for i in range(len(inner) - 4) if min(inner[i : i + 5]) in (inner[i], inner[i + 4])]
    expected = spark.createDataFrame([(i, inner[i], inner[i + 2], inner[i + 4]) for i in places], "i int, a long, b long, c long").orderBy("i").select(F.shiftrightunsigned(F.xxhash64("a", "b", "c"), 24)).collect()
    assert anchors_of(spark, [" ".join(words)])[0] == [r[0] for r in expected] and len(places) >= 2


def test_anchors_are_free_of_context(spark):
    rng = random.Random(4)
    a, b, c = ([f"{k}{rng.randrange(10**6)}" for _ in range(100)] for k in "abc")
    found = anchors_of(spark, [" ".join(b), " ".join(a + b + c), " ".join(b), "\t\n" + "  ".join(b) + " "])
    whole, inside = found[1], [x for x in found[0] if x in found[1]]
    assert len(found[0]) - len(inside) <= 10 and any(whole[i : i + len(inside)] == inside for i in range(len(whole))) and found[0] == found[2] == found[3]


def test_any_change_is_local_and_order_counts(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    passages = [base[i : i + 8] for i in range(0, 400, 8)]
    rng.shuffle(passages)
    texts = {"same": base, "edited": base[:200] + ["new"] + base[201:], "moved": base[300:] + base[:300], "mixed": [w for p in passages for w in p], "back": base[::-1]}
    found = dict(zip(texts, near_copies(spark, [(base, t) for t in texts.values()]), strict=True))
    assert found["same"] == 1.0 and found["edited"] > 0.9 and found["moved"] > 0.85 and found["mixed"] < 0.3 and found["back"] < 0.1


def test_shared_in_order(spark):
    rng = random.Random(6)
    pairs = [([], []), ([1], []), ([1], [1]), ([1, 2, 3], [3, 2, 1]), ([1, 1, 2], [2, 1, 2])] + [([rng.randrange(12) for _ in range(rng.randrange(12))], [rng.randrange(12) for _ in range(rng.randrange(12))]) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<long>, b array<long>")
    for r in df.select("*", likeness(F.col("a"), F.col("b")).alias("n"), shared_in_order(F.col("b"), F.col("a")).alias("s")).collect():
        assert r.n == pytest.approx(dice(r.a, r.b)) and (not r.a or r.s == pytest.approx(dice(r.b, r.a) * (len({*r.a}) + len({*r.b})) / 2))


def near_copies(spark, pairs):
    df = spark.createDataFrame([(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    return [r.n for r in df.select("i", likeness(anchors(F.col("a")), anchors(F.col("b"))).alias("n")).orderBy("i").collect()]


def overlap(a, b, k=6):
    """Of all k-mers, with empty words around the texts."""
    a, b = ([""] * (k - 1) + t + [""] * (k - 1) for t in (a, b))
    a, b = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b))


def test_texts_of_20_to_28_words_against_brute_force(spark):
    rng = random.Random(8)
    pairs = []
    for n in (1, 5, 6, 12, *range(20, 29)):
        for m in (1, 5, 6, 12, *range(20, 29)):
            for kept in (12, 16, 20):
                base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
                pairs.append((base, base[:m] if kept == 20 else base[:kept] + [f"v{rng.randrange(10**6)}" for _ in range(m - kept)]))
    found = near_copies(spark, pairs)
    expected = [overlap(a, b) for a, b in pairs]
    assert min(found) > 0
    for kept in range(3):
        mean = [sum(x[kept::3]) / len(x[kept::3]) for x in (found, expected)]
        assert mean[0] == pytest.approx(mean[1], abs=0.06)
    across = [i for i, (a, b) in enumerate(pairs) if (len(a) < 24) != (len(b) < 24)]
    assert sum(found[i] for i in across) == pytest.approx(sum(expected[i] for i in across), rel=0.15)


def test_no_length_parts_near_copies(spark):
    rng = random.Random(9)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(n)] for n in range(2, 30) for _ in range(60)]
    found = near_copies(spark, [(base, base[:-1]) for base in bases])
    expected = [overlap(base, base[:-1]) for base in bases]
    assert min(found) > 0
    for n in range(2, 30):
        some = slice(60 * (n - 2), 60 * (n - 1))
        assert sum(found[some]) / 60 == pytest.approx(sum(expected[some]) / 60, abs=0.2 if n < 6 else 0.08), n


def test_query_over_the_whole_table_without_python(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = op10_fingerprints(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    found = df.collect()
    check(spark, rows, found)
    by_text = {}
    text_of = dict(rows)
    for r in found:
        by_text.setdefault(text_of[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
