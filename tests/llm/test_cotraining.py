from edge import DOCS, awkward, docs, rows

from pyspark.sql import functions as F

from fleetlens.llm.cotraining import cotrain, cotrained_quality, features
from fleetlens.llm.common import saved

from conftest import SF01

LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    """Learns from the labels of even documents; judged on the odd ones."""
    documents = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    scored = cotrained_quality(documents, labels.where("doc_id % 2 = 0"))
    assert scored.count() == documents.count()
    truth = labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("truth"))
    held = scored.join(truth, "doc_id").select("quality", "keep", "truth").collect()
    good, bad = [r.keep for r in held if r.truth], [r.keep for r in held if not r.truth]
    assert len(good) > 100 and len(bad) > 15
    assert sum(good) / len(good) >= 0.99 and sum(bad) / len(bad) <= 0.05
    loss = sum((r[0] - r.truth) ** 2 for r in held) / len(held)
    assert loss < 0.02


def test_awkward_rows_are_all_scored(spark):
    data = awkward() + [(100 + i, ("word and more prose here " * (5 + i % 4)) if i % 2 else "%$ #! " * 20) for i in range(60)]
    labels = spark.createDataFrame([(100 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, None), (103, 0, 0), (7, 1, 0)], LABELS)
    out = cotrained_quality(docs(spark, data), labels).collect()
    assert len(out) == len(data)
    assert all(0 <= v <= 1 for r in out for v in (r.p_text, r.p_meta, r.quality))


def test_without_labels_every_document_stays(spark):
    none = spark.createDataFrame([], LABELS)
    assert rows(cotrained_quality(docs(spark, [(1, "a"), (2, None)]), none), "doc_id", "quality", "keep") == [(1, 0.5, True), (2, 0.5, True)]
    one = spark.createDataFrame([(1, 1, 0)], LABELS)
    assert rows(cotrained_quality(docs(spark, [(1, "a")]), one), "keep") == [(True,)]
    assert rows(cotrained_quality(spark.createDataFrame([], DOCS), one), "keep") == []


def test_both_views_hand_over_in_every_round(spark):
    documents, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    given, truth = labels.where("doc_id % 5 = 0"), labels.where("doc_id % 5 > 0").select("doc_id", F.col("quality").alias("truth"))
    rows = saved(features(documents, given, "doc_id", "text", ["lang", "source"], "quality", "doc_id"), "test")
    views = cotrain(rows, 3, rounds=4)
    unlabelled = rows.where("y is null").count()
    assert views.handed[0] == (0, 0) and all(n > 0.02 * unlabelled for pair in views.handed[1:] for n in pair)
    assert views.handed[1] < views.handed[2] < views.handed[3]
    loss = {}
    for n in (1, 4):
        held = cotrained_quality(documents, given, rounds=n).join(truth, "doc_id").select("quality", "truth").collect()
        loss[n] = sum((r[0] - r[1]) ** 2 for r in held) / len(held)
    print(views.handed, loss)
    assert loss[1] != loss[4] and loss[4] <= loss[1] + 0.002
