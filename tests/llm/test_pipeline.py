"""Each stage of the pipeline, on what the stage before it kept, against a brute-force version."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as pipeline
from assayline.llm import common, mixing, quality
from tests.llm.test_operators import SCHEMA, awkward, check_packed, similar_brute


def stages(spark, docs, sf_dir, tmp_path):
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(path)
        yield name, before, docs


def copy_tables(spark, docs, labels, tmp_path):
    docs.write.parquet(f"{tmp_path}/in/documents.parquet")
    labels.write.parquet(f"{tmp_path}/in/labels.parquet")
    return f"{tmp_path}/in"


def test_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    marks = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    seen = []
    for name, before, after in stages(spark, common.table(spark, sf, "documents"), sf, tmp_path):
        seen.append(name)
        old = [(r["doc_id"], r["text"]) for r in before.collect()]
        if name == "best_fit_packing":
            check_packed(after.collect(), old)
            continue
        assert after.columns == before.columns
        new = [(r["doc_id"], r["text"]) for r in after.collect()]
        if name == "quality_classifier":
            gone = {k for k, _ in old} - {k for k, _ in new}
            good = [marks[k] for k in gone if k in marks]
            assert gone and good.count(1) <= 0.1 * len(good) and not [k for k, _ in new if marks.get(k) == 0][2:]
        elif name == "exact_dedup":
            last = {}
            for k, t in old:
                last[t] = max(k, last.get(t, k))
            assert sorted(new) == sorted((k, t) for t, k in last.items())
        elif name == "ngram_jaccard_join":
            assert sorted(k for k, _ in new) == [k for k, _, root in similar_brute(old, 5, 80) if k == root]
        else:
            weights = mixing.quality_weights(common.table(spark, sf, "labels"))
            want = {r["doc_id"]: r["copies"] for r in mixing.mix(before, weights).collect()}
            assert Counter(k for k, _ in new) == {k: n for k, n in want.items() if n} and max(want.values()) <= 2
    assert seen == [n for n, _ in pipeline.STAGES] and pipeline.ORACLE_SQL is None


def test_run(spark, sf):
    got = pipeline.run(spark, sf)
    assert got.count() > 0 and set(got.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def test_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, columns with clashing names; then no rows at all."""
    docs = spark.createDataFrame(awkward(), SCHEMA)
    marks = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for i, rows in enumerate((docs, docs.limit(0))):
        sf = copy_tables(spark, rows, marks, tmp_path / str(i))
        for _, before, after in stages(spark, common.table(spark, sf, "documents"), sf, tmp_path / str(i)):
            assert "piece" in after.columns or after.columns == before.columns
            assert i == 0 or after.count() == 0


def test_quality_stage_keeps_columns(spark, tmp_path):
    """Columns named like those used inside come out as they went in."""
    docs = spark.createDataFrame(awkward(), SCHEMA)
    sf = copy_tables(spark, docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path)
    docs = common.table(spark, sf, "documents")
    got = pipeline.quality_classifier(spark, docs, sf)
    assert got.schema == docs.schema and sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))


def test_quality_stage_is_the_query(spark, sf):
    docs = common.table(spark, sf, "documents")
    kept = {r["doc_id"] for r in pipeline.quality_classifier(spark, docs, sf).collect()}
    assert kept == {r["doc_id"] for r in quality.op10_quality_classifier(spark, sf).collect() if r["keep"]}


def test_mix_stage_uses_quality_weights(spark, tmp_path):
    """Prose of one source and one length, half of it labelled good and half bad: the rows are those of the weighted mix, and more good ones are taken."""
    docs = spark.createDataFrame([(i, f"some plain prose text number {i + 1000}", "en", "x" if i < 400 else "y", 30) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(600)], "doc_id long, quality int, toxic int")
    sf = copy_tables(spark, docs, marks, tmp_path)
    docs = common.table(spark, sf, "documents")
    got = Counter(r["doc_id"] for r in pipeline.mix_sources(spark, docs, sf).collect())
    plan = mixing.mix(docs, mixing.quality_weights(marks)).collect()
    assert got == {r["doc_id"]: r["copies"] for r in plan if r["copies"]}
    part = {r["source"] for r in plan if r["copies"] > r["epochs"]}
    more = [r["doc_id"] % 2 for r in plan if r["source"] in part and r["copies"] > r["epochs"]]
    assert part and sum(more) > 0.6 * len(more)
