"""The pipeline's stages, each on its own input."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from readloom.llm import ngram_join, quality

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, SF)
        assert kept.columns == corpus_pipeline.COLUMNS
        ids = {r.doc_id for r in kept.collect()}
        assert ids and ids <= {r.doc_id for r in docs.collect()}, name
        if name == "n-gram Jaccard join":
            groups = ngram_join.jaccard_components(docs, 5, 80).collect()
            assert ids == {r.component_id for r in groups}
    mixed = corpus_pipeline.source_mix(spark, docs, SF)
    assert mixed.columns == corpus_pipeline.COLUMNS and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    placed = corpus_pipeline.shards(spark, mixed, SF)
    assert placed.count() == mixed.count()


KINDS = "doc_id long, text string, lang string, source string, n_chars long"
ONE, TWO, THREE = (" ".join(f"{w}{i}" for i in range(30)) for w in ("one", "two", "three"))


def _rows(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], KINDS).repartition(3)


def _found(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_keep_one_row_a_group(spark):
    docs = _rows(spark, [(4, ONE), (4, ONE), (7, ONE), (None, ONE), (4, TWO), (9, TWO), (None, THREE), (None, THREE), (5, ""), (5, "")])
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == corpus_pipeline.COLUMNS
    assert _found(kept) == sorted([(4, ONE), (4, TWO), (None, THREE), (5, ""), (5, "")], key=str)


def test_quality_decides_by_row(spark, monkeypatch, tmp_path):
    w = np.zeros(quality.CONTENT_BINS)
    w[quality.Views().of("bad", "en", "web", 3)[0]] = -9
    model = quality.CoTrained((w, 1.0), (np.zeros(quality.META_BINS), 0.0), [np.array([1.0, 0.0])] * 2, np.array([1.0, 0.0, 0.0]))  # rejects "bad"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(corpus_pipeline.quality, "train", lambda *_: model)
    docs = _rows(spark, [(1, ONE), (1, "bad"), (None, TWO), (None, "bad"), (2, THREE), (2, THREE)])
    assert _found(corpus_pipeline.quality_classifier(spark, docs, str(tmp_path))) == sorted([(1, ONE), (None, TWO), (2, THREE), (2, THREE)], key=str)


def test_decontamination_decides_by_row(spark, tmp_path):
    spark.createDataFrame([(1, ONE[: ONE.index(" one10")])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = _rows(spark, [(1, TWO), (1, ONE), (None, ONE), (None, TWO), (2, THREE), (2, THREE)])
    kept = corpus_pipeline.benchmark_decontamination(spark, docs, str(tmp_path))
    assert _found(kept) == sorted([(1, TWO), (None, TWO), (2, THREE), (2, THREE)], key=str)


def test_mix_takes_rows_of_null_and_clashing_ids(spark):
    docs = [(i % 5 or None, f"text{i} " + "word " * (i % 7)) for i in range(40)] + [(9, "same row")] * 3
    mixed = _found(corpus_pipeline.source_mix(spark, _rows(spark, docs), ""))
    assert set(mixed) == set(docs) and all(docs.count(r) <= mixed.count(r) <= 2 * docs.count(r) for r in docs)
    total, taken = (sum(len(t.split()) for _, t in rows) for rows in (docs, mixed))
    assert abs(taken - 1.5 * total) <= 7


def test_stages_of_empty_tables_and_other_columns(spark, tmp_path):
    """An empty table stays empty; columns whose names the stages use inside do no harm."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    more = {"_key": F.lit(1), "times": F.lit(2), "row": F.lit(3), "nth": F.lit(4), "size": F.lit(5), "id": F.lit(6), "h": F.lit(7)}
    docs = _rows(spark, [(1, ONE), (2, TWO), (2, TWO), (None, THREE), (3, None), (4, "")]).withColumns(more)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        assert stage(spark, docs, str(tmp_path)).count() > 0, name
