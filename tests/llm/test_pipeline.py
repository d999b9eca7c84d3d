"""The pipeline stage by stage against brute force, and on odd and empty corpora."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_repeats import brute_leaks, check_aligned, classes
from test_tokens import check_packing, ids_of  # noqa: F401  a fixture

import corpus_pipeline
from maskframe.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, lines string, part int"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


@pytest.fixture
def corpus(spark, tmp_path):
    def write(docs, labels=(), items=()):
        for name, rows, schema in (("documents", docs, DOCS), ("labels", labels, LABELS), ("benchmark", items, ITEMS)):
            spark.createDataFrame(list(rows), schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def stages(spark, sf_dir):
    """What every stage has read, and what it returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in corpus_pipeline.STAGES:
        found = corpus_pipeline.stage(function(spark, docs, sf_dir), "test-stage")
        yield name, docs, found
        docs = found


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_every_stage_against_brute_force(spark, sf, ids_of):  # noqa: F811
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    seen = {name: (before, after) for name, before, after in stages(spark, sf)}
    before, after = seen["toxicity"]
    rejected = {r.doc_id for r in toxicity.classify(before, labels).where("predicted = 1").collect()}
    assert {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - rejected
    before, after = seen["line dedup"]
    old, new = dict(texts(before)), after.collect()
    cut = spark.createDataFrame([(r.doc_id, r.text, len(old[r.doc_id].split("\n")), 0) for r in new if r.text is not None], "doc_id long, text string, n_lines int, n_removed int")
    left = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    removed, lost = check_aligned(cut.withColumn("n_removed", F.col("n_lines") - left).collect(), texts(before))
    assert all(r.n_chars == len(r.text) for r in new) and lost <= 2
    before, after = seen["n-gram Jaccard join"]
    near = classes(texts(before))
    assert Counter(i for i, _ in texts(after)) == Counter(i for i, (top, _, _) in near.items() if i == top)
    assert dict(texts(after)).items() <= dict(texts(before)).items()
    before, after = seen["benchmark decontamination"]
    leaked = {d for d, _ in brute_leaks(texts(before), items)}
    assert {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - leaked and leaked
    before, after = seen["best-fit packing"]
    check_packing(after.collect(), texts(before), ids_of)


def test_empty_corpora(spark, corpus):
    assert corpus_pipeline.run(spark, corpus([])).count() == 0
    doc = (1, "some clean words that nobody else has", "en", "s", 37, 0.5, "l", 1)
    for labels, items in (((), ()), ([(1, 1, 0)], [(None, None), (5, "")])):
        packed = corpus_pipeline.run(spark, corpus([doc], labels, items)).collect()
        assert [(r.doc_id, r.piece, r.offset) for r in packed] == [(1, 0, 0)]
    assert corpus_pipeline.run(spark, corpus([], [(1, 1, 1), (2, 0, 0)], [(1, "a b c d e f")])).count() == 0


def test_odd_corpus(spark, corpus, odd_rows):
    rows = [*odd_rows, (None, "no id but clean"), (None, None), (20, "fine words here"), (20, "fine words number nine for all"), (22, "fine words"), (22, "bad scum idiot of them all"), (21, "w " * 5000)]
    docs = [(i, t, None, None, None, None, "clash", i) for i, t in rows]
    docs += [(100 + i, f"bad scum idiot {i} of them all" if i % 2 else f"fine words number {i} for all", "en", "s", 9, 1.0, None, None) for i in range(80)]
    labels = [(100 + i, None, i % 2) for i in range(80)] + [(None, None, 1), (100, 1, None)]
    sf_dir = corpus(docs, labels, [(1, "a leaked question about rivers and its long answer"), (2, None)])
    counts = {}
    for name, before, after in stages(spark, sf_dir):
        counts[name] = before.count(), after.count()
        if name == "toxicity":
            assert [t for i, t in texts(after) if i == 22] == ["fine words"]
        if name != "best-fit packing":
            assert after.columns == before.columns
            # Rows without an id are never compared and never lost.
            assert after.where("doc_id IS NULL").count() == 2
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
    assert counts["line dedup"][0] == counts["line dedup"][1]
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {1, 20, 21, None} <= {r.doc_id for r in packed.collect()}
