import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weftline.llm.quality_classifier import Settings, _fewest, _follow, fit_on_labels, fit_quality, held_out, op9_quality_classifier, quality_score

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    found = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in found)
    assert spark.sql("select cast(null as long) as doc_id").select(held_out()).first()[0] is False


def test_accuracy_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = op9_quality_classifier(spark, SF)
    assert scored.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    found = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    good, bad = ([r.score for r in found if r.quality == q] for q in (1, 0))
    auc = np.mean([(np.array(good) > b).mean() + (np.array(good) == b).mean() / 2 for b in bad])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in found]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(400), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit_on_labels(docs, labels), fit_on_labels(docs, turned)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_model_does_not_depend_on_partitions_or_order(spark):
    rows = [(i, ("good words here " if i % 2 else "bad noise there ") * 5 + str(i)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    models = [fit_quality(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 4))]
    assert (models[0].weights == models[1].weights).all()


def test_nulls_repeats_bounds_and_empty(spark):
    docs = spark.createDataFrame([(1, "nice text"), (1, "nice text"), (2, None), (3, ""), (None, "nice text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (9, 0), (1, 7)], "doc_id long, quality int")
    model = fit_quality(docs, labels)
    found = docs.select("doc_id", "text", quality_score(spark, model, F.col("text")).alias("s")).collect()
    by_text = {}
    for r in found:
        assert 0 <= r.s <= 1
        by_text.setdefault(r.text or "", set()).add(r.s)
    assert all(len(v) == 1 for v in by_text.values())
    for none in (fit_quality(docs, labels.limit(0)), fit_quality(docs.limit(0), labels)):
        assert docs.select(quality_score(spark, none, F.col("text"))).first()[0] == 0.5
    assert docs.limit(0).select(quality_score(spark, model, F.col("text"))).collect() == []


def test_updates_against_brute_force(spark):
    """One pass of FTRL-proximal over dense vectors, with the formulas of the published algorithm."""
    s = Settings(bits=6)
    rng = np.random.default_rng(1)
    rows = [(int(y), {int(k): float(v) for k, v in zip(rng.choice(64, 5, replace=False), rng.random(5), strict=True)}) for y in rng.integers(0, 2, 80)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 80), pa.array([y for y, _ in rows]), pa.array([np.array(list(x), np.uint32).tobytes() for _, x in rows]), pa.array([np.array(list(x.values()), np.float32).tobytes() for _, x in rows])],
        names=["key", "label", "buckets", "values"],
    )
    found = np.frombuffer(next(_follow(s)(iter([batch]))).column(0)[0].as_py(), np.float32)
    z, n = [0.0] * 65, [0.0] * 65

    def weight(i):
        return 0.0 if abs(z[i]) <= s.l1 else -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for y, x in rows:
        x = {k: float(np.float32(v)) for k, v in x.items()} | {64: 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - y) * v
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / s.alpha * w[i]
            n[i] += g * g
    assert np.allclose(found, [weight(i) for i in range(65)], atol=1e-6) and np.count_nonzero(found) > 20


def test_an_id_that_is_repeated_does_not_pass_the_bound(spark, monkeypatch):
    docs = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 40).cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    s = Settings(max_rows=7, l1=0.0)
    assert 1 <= np.count_nonzero(fit_quality(docs, labels, settings=s).weights) <= 2 * 7  # two features a text
    rows = docs.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_label"), F.col("text").alias("_text"))
    assert [_fewest(rows, n).distinct().count() for n in (1, 7, 40, 100)] == [1, 7, 40, 40] and _fewest(rows, 100).count() == 40


def test_only_so_many_rows_are_learnt_from(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    few = fit_quality(docs, labels, settings=Settings(max_rows=5, l1=0.0))
    assert 1 <= np.count_nonzero(few.weights) <= 10
