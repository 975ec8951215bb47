import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from weftline.llm import ngram_join
from weftline.llm.ngram_join import _Trie, ngram_jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(docs, percent=80):
    sets = [(i, shingles(t)) for i, t in docs]
    least = {i: i for i, _ in sets if i is not None}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and None not in (i, j) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                least[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted((tuple(r)[:3] for r in ngram_jaccard_join(df, **kw).collect()), key=repr)


def near_copies(seed, n):
    """Families of texts that differ by a few words, so that many pairs are close to the bound."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.7:
            words = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(["new", "Other", "é"])]
        else:
            words = [f"w{rng.randrange(60)}" for _ in range(rng.randint(1, 80))]
        out.append((i, " ".join(words)))
    return [(i * 7 % 1000, t) for i, t in out]


@pytest.mark.parametrize("seed", range(2))
def test_agrees_with_brute_force(spark, seed):
    docs = near_copies(seed, 120)
    assert run(spark, docs) == brute(docs)


def test_small_blocks_lose_no_link(spark, monkeypatch):
    docs = near_copies(5, 90)
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    monkeypatch.setattr(ngram_join, "RANGE_BYTES", 2000)
    assert run(spark, docs) == brute(docs)


def test_large_groups_of_many_components(spark, monkeypatch):
    """A passage that all share makes one meeting place of sets of several families and of sets that link with none."""
    monkeypatch.setattr(ngram_join, "BLOCK", 6)
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(30))
    families = [" ".join(f"f{k}x{rng.randrange(99)}" for _ in range(20)) for k in range(4)]
    docs = []
    for i in range(70):
        kind = rng.random()
        own = families[i % 4] if kind < 0.6 else " ".join(f"o{i}x{j}" for j in range(rng.choice([1, 2, 14, 30])))
        docs.append((i, f"{passage} {own}" + (f" end{rng.randrange(40)}" if kind < 0.6 else "")))
    found = run(spark, docs)
    assert found == brute(docs) and 5 < len({c for *_, c in found}) < 60


def test_a_passage_of_all_texts_costs_no_block_pairs(spark, monkeypatch):
    """Four fifths of each text are one passage; no two link, and no block meets another."""
    monkeypatch.setattr(ngram_join, "BLOCK", 10)
    real, seen = ngram_join._connected, {}

    def spy(rows, key, link):
        def counted(part):
            seen.setdefault(key, []).append(part.count())
            return link(part)

        seen[f"all {key}"] = rows.count()
        return real(rows, key, counted)

    monkeypatch.setattr(ngram_join, "_connected", spy)
    passage = " ".join(f"p{i}" for i in range(404))
    docs = [(i, f"{passage} " + " ".join(f"o{i}x{j}" for j in range(92))) for i in range(150)]
    assert run(spark, docs) == brute(docs)
    assert sum(seen["token"]) <= 2 * seen["all token"], seen
    # with a text that is the passage alone, one block meets all others: linear still
    seen.clear()
    docs.append((150, passage))
    assert run(spark, docs) == brute(docs)
    assert sum(seen["token"]) <= 4 * seen["all token"], seen


def test_texts_of_one_id_and_null_ids_have_components(spark):
    long = "the same nine words stand in all of these"
    docs = [(1, long), (1, "another text of the same id is not alike at all"), (None, long), (None, long), (2, long.upper()), (3, None), (3, "")]
    found = ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"))
    parts = {}
    for r in found.collect():
        parts.setdefault(r.component and bytes(r.component), []).append((r.doc_id, r.component_id))
    assert sorted(map(sorted, (map(str, v) for v in parts.values()))) == [["(1, 1)"], ["(1, 1)", "(2, 1)", "(None, None)", "(None, None)"], ["(3, 3)", "(3, 3)"]]


def test_chains_over_blocks(spark, monkeypatch):
    """Each text links with the next ones only, so no set stands for its component."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    words = [f"w{i}" for i in range(140)]
    docs = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(25)]
    assert run(spark, docs) == brute(docs)


def test_nulls_empty_short_and_repeated_rows(spark):
    docs = [(5, None), (4, ""), (3, " \t\n"), (2, "one"), (9, "ONE"), (1, "a b c"), (7, "a b c"), (7, "a b c"), (None, "a b c"), (6, "a b"), (8, "É b c d e"), (10, "é b c d e")]
    assert run(spark, docs) == brute(docs)


def test_bound_is_met_exactly(spark):
    """4 of 5 shingles are 80 percent; 3 of 4 are not."""
    docs = [(1, "a b c d e f g h i"), (2, "a b c d e f g h"), (11, "q b c d e f g h"), (12, "q b c d e f g")]
    assert run(spark, docs) == brute(docs) == [(1, 5, 1), (11, 4, 11), (12, 3, 12), (2, 4, 1)]


def test_one_very_long_text_and_many_copies(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(30_000))
    docs = [(i, "the very same text of nine words in all") for i in range(100, 3000)] + [(1, long), (2, long + " end"), (3, "x " * 20_000)]
    found = run(spark, docs)
    assert (1, 29_996, 1) in found and (2, 29_997, 1) in found and (3, 1, 3) in found
    assert {c for _, n, c in found if n == 5} == {100} and len(found) == len(docs)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_shingles int")
    assert ngram_jaccard_join(df).collect() == []
    clash = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id int, text string, fp string, component_id string")
    assert [tuple(r)[:3] for r in ngram_jaccard_join(clash).collect()] == [(1, 1, 1)]


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.sets(st.integers(0, 14), min_size=1), min_size=1, max_size=12), st.integers(50, 100))
def test_trie_finds_all_and_only_links(sets, percent):
    import numpy as np

    arrays = [np.array(sorted(s)) for s in sets]
    trie = _Trie(arrays, [len(s) for s in sets])
    for i, a in enumerate(sets):
        expected = sorted(j for j, b in enumerate(sets) if 100 * len(a & b) >= percent * len(a | b))
        assert sorted(trie.walk(arrays[i], len(a), 15, percent)) == expected
