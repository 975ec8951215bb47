import re

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_ngram_join import brute as linked
from test_secrets import brute as base_spans

pipeline = pytest.importorskip("corpus_pipeline")

from weftline.llm.piece_codec import default_model  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and what comes out, as rows."""
    from weftline.llm.common import prepared

    prepared(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in pipeline.STAGES:
        made = stage(spark, docs, SF).checkpoint()
        out.append((name, docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_stage_keep_the_columns(stages):
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_classifier_drops_low_quality_and_keeps_clean(spark, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.02 * len(labels)
    assert texts(after).items() <= texts(before).items()


def test_one_of_each_group_of_near_copies_stays(stages):
    _, before, after = stages[1]
    docs = texts(before)
    assert {r.doc_id for r in after.select("doc_id").collect()} == {i for i, _, c in linked(sorted(docs.items())) if c == i}


def test_secrets_are_replaced_and_nothing_else(stages):
    _, before, after = stages[2]
    old, new = texts(before), texts(after)
    assert old.keys() == new.keys()
    for i, text in old.items():
        spans, out, at = base_spans(text)[0], [], 0
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in filter(None, spans.split(","))):
            if a >= at:
                out.append(text[at:a] + "[SECRET]")
            at = max(at, b)
        assert new[i] == "".join(out) + text[at:]
    assert all(r.n_chars == len(r.text) for r in after.collect())
    assert any(old[i] != new[i] for i in old)


def test_mix_takes_whole_documents_within_the_budget(stages):
    _, before, after = stages[3]
    old, new = before.collect(), after.collect()
    assert set(new) <= set(old) and len(set(new)) == len(new)
    count = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    leaves = {(r.lang, r.source) for r in old}
    longest = max(len(r.text.split()) for r in old)
    assert pipeline.MIX_SHARE * count(old) - longest * len(leaves) <= count(new) <= pipeline.MIX_SHARE * count(old) + 1


def test_encoding_is_the_librarys(stages):
    _, before, after = stages[4]
    library = sentencepiece.SentencePieceProcessor(model_file=default_model())
    docs = texts(before)
    found = after.collect()
    assert {r.doc_id for r in found} == docs.keys()
    for r in found:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(docs[r.doc_id], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids) // 4


def test_run_gives_the_last_stages_rows(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][2].collect()))


def test_clashing_columns_are_handed_on(spark):
    """Names that stages might use for themselves come out as they went in."""
    from weftline.llm.common import prepared

    prepared(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clash = ["base", "spans", "clean", "assign", "access", "hex", "markov", "_found", "component", "component_id", "text_hash", "no_id", "id", "row", "best", "count", "n_shingles", "key", "score", "leaf", "tokens", "rank", "label", "fp"]
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) as {c}" for c in clash)).checkpoint()
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).checkpoint()
        assert out.dtypes == docs.dtypes, name
        assert out.count() and all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in clash), name
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_decisions_hold_for_an_id_and_its_text(spark):
    from weftline.llm.common import prepared

    prepared(spark)
    copy = "these are some words that stand in more than one of the documents"
    other, third = "a clean text of the same id that is like no other one here", "one more text of that id which says other things than both"
    rows = [(1, copy, "en"), (7, copy, "en"), (7, other, "en"), (7, third, "en"), (None, copy.upper(), "en"), (None, other, "de"), (None, other, "en"), (9, third, "en"), (9, third, "fr"), (None, "all alone and without an id but with words", "en"), (None, "all alone and without an id but with words", "en"), (4, None, "en"), (4, "", "en")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, lang string").withColumn("extra", F.create_map(F.lit(1), F.lit(2))).repartition(3).checkpoint()
        out = pipeline.drop_near_duplicates(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, copy), (7, other), (7, third), (None, "all alone and without an id but with words"), (4, None), (4, "")], key=repr)


def test_nulls_repeats_and_empty_tables(spark):
    from weftline.llm.common import prepared

    prepared(spark)
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(5).collect()
    rows = [tuple(r) for r in good] + [tuple(good[0]), (None, good[1].text, None, None, None), (10**9, None, None, "s", None), (10**9 + 1, "", "en", None, 0)]
    for source in (spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema), spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)):
        docs = source
        for k, (_, stage) in enumerate(pipeline.STAGES):
            docs = stage(spark, docs, SF).checkpoint()
            assert k == 4 or docs.columns == source.columns
        ids = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None]
        assert len(ids) == len(set(ids))
