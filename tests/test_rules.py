"""Rules on small literal inputs, against plain Python where the rule is a procedure."""

import re
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import context, documents, media, providers, search
from lodestone.streaming.ingest import stream_chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests' models


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def chunks_in_python(text, most, overlap):
    count = lambda s: len(s) // 4
    parts = [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text)) if s]
    out, now, tokens = [], [], 0
    for s in parts:
        if tokens + count(s) > most:
            kept = []
            if now:
                out.append(" ".join(now))
                for x in reversed(now[-3:]):
                    if sum(map(count, kept)) + count(x) <= overlap:
                        kept.insert(0, x)
            now, tokens = [*kept, s], sum(map(count, kept)) + count(s)
        else:
            now.append(s)
            tokens += count(s)
    return out + ([" ".join(now)] if now else [])


def test_chunks_follow_the_procedure(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join("A" + "b" * int(n) + "." for n in rng.integers(1, 120, int(k))) for k in rng.integers(0, 40, 60)] + ["", "   ", "x" * 900]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in documents.chunk_rows(rows, 60, 12).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    for i, text in enumerate(texts):
        assert got.get(i, []) == chunks_in_python(text, 60, 12)


def test_captions(spark):
    rows = [("Table 2.1: Revenue", "2.1", "Table 2.1: Revenue"), ("figure 3", "3", "Figure 3"), ("see Table 5: x", None, None), ("CHART 4. x", "4", "Chart 4: x")]
    df = spark.createDataFrame([(r[0],) for r in rows], "t string").select(T.caption_number(F.col("t")), T.caption_title(F.col("t")))
    assert [tuple(r) for r in df.collect()] == [r[1:] for r in rows]


def test_timestamp_cuts_off(spark):
    assert one(spark, T.timestamp(F.lit(2.517))) == "00:00:02.516"
    assert one(spark, T.timestamp(F.lit(3661.5))) == "01:01:01.500"


def test_entities_and_topics(spark):
    assert one(spark, T.entities(F.lit("on 1/2/2024 at 10:30 AM for $1,200.50"))) == ["$1,200.50", "1/2/2024", "10:30 AM"]
    assert one(spark, T.topics(F.lit("the budget and the cost"))) == ["financial"]
    assert one(spark, T.search_tokens(F.lit("L'été à 42 Paris-2024"))) == ["paris", "2024"]


def test_fusion_keeps_first_list_on_ties(spark):
    a = spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "query_id int, rank int, doc_id long")
    b = spark.createDataFrame([(0, 1, 7), (0, 2, 8)], "query_id int, rank int, doc_id long")
    assert [r.doc_id for r in search.fuse([a, b]).orderBy("rank").collect()] == [5, 7, 6, 8]


def test_numeric_cells(spark):
    cells = ["$1,200.50", "-5", "1.2.3", "", "x"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(documents.numeric(F.col("c")).alias("v"))
    assert [r.v for r in df.collect()] == [1200.5, 5.0, None, None, None]


def test_routing(spark):
    df = spark.createDataFrame([(None, None, "image"), ("audio", None, "text"), (None, "table", "text"), (None, None, None)], "m string, n string, k string")
    assert [r.b for r in df.select(context.bucket(F.col("m"), F.col("n"), F.col("k")).alias("b")).collect()] == ["images", "audio", "tables", "text"]


def test_speakers():
    x = np.vstack([np.random.default_rng(0).normal(0, 0.1, (20, 3)), np.random.default_rng(1).normal(5, 0.1, (20, 3))])
    at = media.speakers_of(x)
    assert len(set(at[:20])) == len(set(at[20:])) == 1 and at[0] != at[20]
    assert media.speakers_of(x[:1]).tolist() == [0] and media.speakers_of(x[:0]).tolist() == []


def test_embedder_stand_in(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "id long, content string")
    got = providers.embedded(rows).orderBy("id").collect()
    assert abs(sum(v * v for v in got[0].embedding) - 1) < 1e-5 and set(got[1].embedding) == {0.0} and got[0].embedding_error is None


class Picky(providers.HashingEmbedder):
    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return super().embed(texts)


def test_an_embedding_that_fails_is_null(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "fine")], "id long, content string").coalesce(1)
    got = providers.embedded(rows, Picky(8)).orderBy("id").collect()
    assert [r.embedding is None for r in got] == [False, True, False] and got[1].embedding_error == "ValueError: bad text"


def test_decimals_as_python_prints_them(spark):
    rng = np.random.default_rng(5)
    values = [0.0625, 0.1875, 0.0005, 0.0015, 1.0005, 2.675, 0.9995, -0.0625, -0.3125, 0.0, 1.0, 123.4565, *(rng.integers(0, 2_000_000, 400) / 2000).tolist(), *rng.random(200).tolist()]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.fixed3(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.v:.3f}" for r in got]
    numbers = [0.0, 1.0, 12.5, 1234567.25, 12345678.9, 1.2e7, 123456789012345.0, 1e16, 2.5e17, 0.001, 0.0001]
    got = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", T.plain_number(F.col("v")).alias("s")).collect()
    assert [r.s for r in got] == [str(r.v) for r in got]


def test_durations_and_requests(spark):
    import datetime

    for seconds in (0.0, 59.9, 3661.5, 86399.0, 86400.0, 200_000.0):
        assert one(spark, T.time_of_day(F.lit(seconds))) == str(datetime.timedelta(seconds=int(seconds)))
    assert one(spark, T.asked_parts(F.lit("text: a b; image: c.png "))).asDict() == {"text": "a b", "image": "c.png", "audio": None}


def test_speakers_of_each_recording(spark):
    rng = np.random.default_rng(2)
    rows = [("a.wav", i, (rng.normal(5 * (i % 2), 0.1, 4)).tolist()) for i in range(20)] + [("b.wav", 0, [1.0, 2.0])]
    got = media.diarized(spark.createDataFrame(rows, "source string, seq int, features array<double>")).collect()
    by = {(r.source, r.seq): r.speaker for r in got}
    assert len({by["a.wav", i] for i in range(0, 20, 2)}) == 1 and by["a.wav", 0] != by["a.wav", 1] and by["b.wav", 0] == "Speaker 1"
    two = media.diarized(spark.createDataFrame(rows, "source string, seq int, features array<double>"), known=3).collect()
    assert len({r.speaker for r in two if r.source == "a.wav"}) == 3


@pytest.mark.parametrize("block", [1024, 7])
def test_silhouettes_by_blocks(spark, block):
    rng = np.random.default_rng(3)
    rows = [(s, int(k), rng.normal(k, 1, 3).tolist()) for s, n in (("a", 40), ("b", 9)) for k in rng.integers(0, 3, n)] + [("c", 0, [1.0, 2.0, 3.0])] * 3
    got = {r.source: r.silhouette for r in media.silhouettes(spark.createDataFrame(rows, "source string, label int, features array<double>"), block).collect()}
    for s in "abc":
        mine = [r for r in rows if r[0] == s]
        assert abs(got[s] - media.silhouette(np.array([r[2] for r in mine]), np.array([r[1] for r in mine]))) < 1e-5


def test_a_picture_that_no_attempt_reads(spark):
    attempts = spark.createDataFrame([(1, 1, 40.0, "some longer text", 3, "plain"), (1, 2, 80.0, "the better reading", 3, "sharp"), (1, 3, 80.0, "too late", 2, "big"), (2, 1, 0.0, "", 0, "plain")], "image_id int, attempt_no int, confidence double, text string, word_count int, method string")
    images = spark.createDataFrame([(1,), (2,), (3,)], "image_id int")
    got = {r.image_id: r for r in media.readings(images, attempts).collect()}
    assert (got[1].ocr_text, got[1].has_text, got[1].ocr_method) == ("the better reading", True, "sharp")
    assert all((got[i].ocr_text, got[i].word_count, got[i].has_text, got[i].ocr_method) == ("", 0, False, "none") for i in (2, 3))


def test_stream_adds_chunks(spark, tmp_path):
    spark.createDataFrame([(1, "One sentence. Another one."), (2, "")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination(120)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "index")).collect()] == ["One sentence. Another one."]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab .!?AB\n", max_size=60), min_size=1, max_size=5))
def test_sentences_lose_no_letter(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.sentences(F.col("t")).alias("s")).collect()
    for r in rows:
        assert re.sub(r"\s", "", "".join(r.s)) == re.sub(r"\s", "", r.t)
