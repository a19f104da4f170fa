"""The corpus pipeline: each stage is its operator, keeps all columns, and takes nulls, repeated ids and empty tables."""

import zlib

import numpy as np
import pytest
from small import SCHEMA, corpus
from test_dedup import grouped

import corpus_pipeline as pipeline
from lodestone.llm import classify, mixing

SF = "/root/testdata/sf0.001"


def ids(rows):
    return sorted((r.doc_id for r in rows.select("doc_id").collect()), key=lambda i: (i is None, i or 0))


def test_stages_are_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def firsts(d):
        rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        return sorted({rows[g][0] for g in grouped(rows)})

    wanted = [
        lambda d: sorted(r.doc_id for r in classify.quality(d, labels).collect() if r.predicted),
        lambda d: sorted(r.doc_id for r in classify.toxicity(d, labels).collect() if not r.predicted),
        firsts,
        lambda d: ids(mixing.mix(d)),
        ids,
    ]
    assert [n for n, _ in pipeline.STAGES] == ["quality", "toxicity", "simhash_near_dedup", "mixing", "packing"]
    now = docs
    for (name, stage), rule in zip(pipeline.STAGES, wanted):
        out = stage(spark, now, SF).cache()
        found = ids(out)
        assert (sorted(set(found)) if name == "packing" else found) == rule(now), name
        assert name == "packing" or out.columns == docs.columns
        now = out


def test_run_writes_every_stage(spark):
    out = pipeline.run(spark, SF)
    kept = out.select("doc_id").distinct().count()
    assert 0 < kept < spark.read.parquet(f"{SF}/documents.parquet").count()
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    rows = corpus() + [(None, "a text without an id", None, None, 0.5, 1, 1, 1), (7, "another text of id 7", "en", "a", 0.5, 1, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = stage(spark, docs, SF)
    assert out.count() > 0 and set(ids(out)) <= {r[0] for r in rows}
    assert stage(spark, spark.createDataFrame([], SCHEMA), SF).count() == 0


def test_packing_stage_writes_the_ids(spark):
    rows = pipeline.packed(spark, spark.createDataFrame(corpus()[:20], SCHEMA), "").collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_filters_without_labels_keep_all(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(corpus(20), SCHEMA)
    for stage in (pipeline.quality, pipeline.toxicity):
        assert stage(spark, docs, str(tmp_path)).count() == docs.count()
