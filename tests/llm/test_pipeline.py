"""The pipeline against a brute-force version, and its stages on awkward documents."""

import re

import corpus_pipeline
from edge import DOCS, awkward, docs, words
from test_decontam import semi_global
from test_simhash import brute as simhash_brute

from conftest import SF001
from fleetlens.llm.cotraining import cotrained_quality
from fleetlens.llm.decontam import normal


def brute(data, bench):
    """Stages 2 to 4 on (doc_id, text, source): equal texts, SimHash components, benchmark items."""
    first = {}
    for i, text, _ in data:
        n = re.sub(r"[ \t-\r]+", " ", text or "")
        first[n] = min(first.get(n, i), i)
    data = [d for d in data if d[0] in first.values()]
    root = {i: c for i, _, c in simhash_brute([d[:2] for d in data])}
    data = [d for d in data if root[d[0]] == d[0]]
    items = [p for _, t in bench if len(p := normal(t or "")) >= 40]

    def leaked(text):
        text = normal(text or "")
        return any(p in text for p in items) or len(text) < 4000 and any(
            p[:12] in text and semi_global(p, text) <= int(len(p) * 0.05) for p in items)

    return [d for d in data if not leaked(d[1])]


def test_pipeline_against_brute_force(spark):
    documents = spark.read.parquet(f"{SF001}/documents.parquet")
    bad = {r.doc_id for r in cotrained_quality(documents, spark.read.parquet(f"{SF001}/labels.parquet")).where("not keep").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect() if r.doc_id not in bad]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    left = brute(rows, bench)
    out = corpus_pipeline.run(spark, SF001).collect()
    want = sorted(d[0] for d in left if (d[1] or "").split())
    assert len(left) < len(rows) and sorted(r.doc_id for r in out if r["pass"] == 0) == want
    assert max(r["pass"] for r in out) < corpus_pipeline.MAX_PASSES


def test_stages_keep_columns_and_awkward_rows(spark, tmp_path):
    for name, rows, schema in (
        ("labels", [(1, 1, 0), (9, 1, 0), (300, 0, 0), (301, 0, 0)], "doc_id long, quality int, toxic int"),
        ("benchmark", [(1, words(20, 900)), (2, None)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    data = awkward() + [(300, "%% $$ ## " * 40), (301, "&& ** !! " * 40), (302, words(20, 900))]
    for source in (docs(spark, data), spark.createDataFrame([], DOCS)):
        frame = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, frame, str(tmp_path))
            assert after.columns == frame.columns and after.count() <= frame.count()
            frame = after
        out = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
        assert 302 not in {r.doc_id for r in out.collect()}


def test_rows_with_one_id_are_told_apart(spark, tmp_path):
    """Repeated and null ids, and rows equal in every column: one row of each text stays, and no text is lost."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = words(20, 900)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    a, b, c, d = (words(50, 40 + s) for s in range(4))
    data = [(1, a), (5, a), (5, b), (None, a), (None, c), (None, c), (6, d), (6, d), (6, f"{b} {item} {c}"), (None, f"{c} {item}"), (7, d)]
    frame = docs(spark, data)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
    assert sorted(((r.doc_id, r.text) for r in frame.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (6, d)], key=str)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights"]
