"""Files to chunks, chunks to an index, and answers from it, with small readers and models made for the tests."""

import io
import struct
import sys
import zipfile

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lodestone.operators import chunks, documents, index, providers, search, session
from lodestone.sources import files, ingest, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have the tests' models

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
LONG = "This paragraph has well over fifty characters so that it is kept as a chunk."


def png(width=4, height=3):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0)


def para(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=%s/></w:pPr>' % repr(style) if style else ''}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(body, pictures=()):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        rels = "".join(f'<Relationship Id="r{i}" Target="media/{name}"/>' for i, (name, _) in enumerate(pictures))
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="s" Target="styles.xml"/>{rels}</Relationships>')
        for name, content in pictures:
            z.writestr(f"word/media/{name}", content)
    return raw.getvalue()


def cell(*texts):
    return "<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>" for t in texts) + "</w:tr>"


class Pdf:
    detailed = True

    def read(self, content, strategy):
        if strategy == "hi_res" and b"truncated" in content:
            raise OSError("file is truncated")
        if b"broken" in content:
            raise OSError("cannot be read")
        body = [("Title", "Report"), ("NarrativeText", LONG), ("NarrativeText", "Table 3: Sales of goods"), ("Table", "name | n\na | 1\nb | 2"), ("NarrativeText", "Figure 7: The growth of sales"), ("Image", ""), ("Footer", strategy)]
        return body, [("figure-0-1.jpg", png())]


class Reader:
    def read(self, image):
        return [("plain", [("low", 20.0), ("noise", -1.0)]), ("sharp", [("a", 90.0), ("readable", 91.0), ("picture", 92.0)])]


class Speech:
    name = "test"

    def transcribe(self, audio):
        if b"noise" in audio:
            raise ValueError("no speech")
        return [(2.5, [0.0, 1.0], "en", " the budget and the cost of goods "), (1.0, [5.0, 5.0], "en", ""), (3.25, [0.1, 1.1], "de", "the agenda of the meeting at 10:30")]


class Model:
    def generate(self, prompt, images, options):
        if "fail" in prompt:
            raise ConnectionError("connection refused")
        return f" {len(images)} images, {options.get('num_predict')} tokens, {'a | 1' in prompt} "


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for d in ("sub", "extracted_data"):
        (root / d).mkdir()
    pictures = [("image10.png", png(1, 1)), ("image2.png", png(2, 2)), ("image3.emf", b"no picture")]
    body = para("Overview", "H1") + para(LONG) + para("short") + f"<w:tbl>{cell('name', 'price')}{cell('a', '$1,200.50')}{cell('b', '7')}</w:tbl>" + para(LONG + " Twice.")
    (root / "one.docx").write_bytes(docx(body, pictures))
    (root / "bad.docx").write_bytes(b"nothing")
    (root / "sub" / "a.pdf").write_bytes(b"truncated")
    (root / "sub" / "b.pdf").write_bytes(b"broken")
    (root / "shot.PNG").write_bytes(png(1920, 1080))
    (root / "fake.jpg").write_bytes(b"text")
    (root / "extracted_data" / "own.png").write_bytes(png())
    (root / "call.mp3").write_bytes(b"speech")
    (root / "hum.opus").write_bytes(b"noise")
    (root / "notes.txt").write_text("ignored")
    return root


@pytest.fixture(scope="module")
def ingested(spark, folder):
    found = ingest.ingest(spark, str(folder), ingest.Readers(Pdf(), Reader(), Speech()), session_id="s1")
    return found.chunks.cache(), found.failures


def test_kinds_and_orders(spark, folder):
    name = lambda rows: [r.path.rsplit("/", 1)[-1] for r in rows]
    assert sorted(name(files.find_files(spark, str(folder)).collect())) == ["a.pdf", "b.pdf", "bad.docx", "call.mp3", "fake.jpg", "hum.opus", "one.docx", "shot.PNG"]
    assert name(files.in_order(files.find_files(spark, str(folder), "pdf")).collect()) == ["a.pdf", "b.pdf"]
    assert name(files.find_files(spark, str(folder), "pdf", recursive=False).collect()) == []
    assert sorted(name(files.valid_audio(files.find_files(spark, str(folder))).collect())) == ["call.mp3", "hum.opus"]


def test_errors_stay_with_their_files(ingested):
    got = {r.path.rsplit("/", 1)[-1]: (r.file_kind, r.error) for r in ingested[1].collect()}
    assert sorted(got) == ["b.pdf", "bad.docx", "fake.jpg", "hum.opus"]
    assert got["b.pdf"] == ("pdf", "OSError: cannot be read") and got["hum.opus"][1] == "ValueError: no speech" and "BadZipFile" in got["bad.docx"][1]


def test_without_readers_other_files_go_on(spark, folder):
    found = ingest.ingest(spark, str(folder))
    assert {r.file_kind for r in found.chunks.select("file_kind").distinct().collect()} == {"docx", "image"}
    assert {r.error for r in found.failures.filter("file_kind = 'pdf'").collect()} == {"RuntimeError: no reader for PDF files"}


def test_chunks_of_all_kinds(ingested):
    rows = {r.id: r for r in ingested[0].collect()}
    assert [r.doc_idx for r in sorted(rows.values(), key=lambda r: r.doc_idx)] == list(range(len(rows)))
    table = rows["a.pdf_table_0"]
    assert table.content.startswith(f"**Context Before Table (5 sentences):**\n{LONG} Table 3: Sales of goods\n\n# Table 3: Sales of goods\n\nReport {LONG}\n\nThis table contains 2 entries with 2 columns: name, n.\n")
    assert table.content.endswith("a | 1\nb | 2\n\n**Context After Table (5 sentences):**\nFigure 7: The growth of sales")
    assert table.metadata.reference_names == ["Table 3: Sales of goods", "table 3", "Table 3"] and table.metadata.table_number == "3"
    image = rows["a.pdf_image_0"]
    assert image.metadata.figure_title == "Table 3: Sales of goods" and image.metadata.image_path == "figure-0-1.jpg" and image.metadata.has_ocr
    assert "**Image File:** figure-0-1.jpg\n\n\n**OCR Extracted Text from Image:**\na readable picture" in image.content
    assert (rows["a.pdf_text_0_0"].content, rows["a.pdf_text_0_0"].token_count) == (LONG, len(LONG) // 4)
    told = rows["one.docx_table_0"]
    assert told.metadata.table_title == "Overview" and told.metadata.table_description == f"{LONG} short"
    assert "1. name: a, price: $1,200.50" in told.content and "\nSummary: The highest price is 1200.5 (from a)\n" in told.content
    assert rows["one.docx_para_1"].content == LONG + " Twice." and "one.docx_para_2" not in rows
    assert {i: rows[i].metadata.image_path for i in rows if "one.docx_image" in i} == {"one.docx_image_0": "one_image_0.png", "one.docx_image_1": "one_image_1.png"}
    shot = next(r for i, r in rows.items() if i.startswith("image_shot_"))
    assert (shot.metadata.image_width, shot.metadata.image_format, shot.metadata.has_ocr_text, shot.metadata.session_id) == (1920, "PNG", True, "s1")
    assert shot.content.startswith("# Photo or visual image\n\n**File:** shot.PNG\n**Size:** 1920x1080 pixels\n**Type:** photo/visual_only\n\n**Extracted Text (91% confidence):**\na readable picture")
    first, second = rows["audio_call_chunk_0"], rows["audio_call_chunk_1"]
    assert first.content.startswith("# Audio: call.mp3 - Segment 1\n\n**Timestamp:** [00:00:00.000 → 00:00:02.500] (2.5s)\n**Speaker:** Speaker ")
    assert second.content.startswith("# Audio: call.mp3 - Segment 3\n") and second.metadata.chunk_index == 1 and second.metadata.start_time == 3.5 and second.metadata.total_chunks == 2
    assert second.metadata.topics == ["meeting", "financial"] or set(second.metadata.topics) == {"meeting", "financial"}
    assert second.metadata.entities == ["10:30"] and first.metadata.word_count == 7 and second.metadata.speaker == first.metadata.speaker


def test_pictures_heads():
    assert files.image_facts(png(7, 5)) == ("PNG", "RGB", 7, 5)
    assert files.image_facts(b"GIF89a" + struct.pack("<HH", 9, 8)) == ("GIF", "P", 9, 8)
    assert files.image_facts(b"BM" + bytes(16) + struct.pack("<iiHH", 6, -4, 1, 24)) == ("BMP", "RGB", 6, 4)
    assert files.image_facts(b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 30, 40, 3)) == ("JPEG", "RGB", 40, 30)
    with pytest.raises(ValueError, match="not a picture"):
        files.image_facts(b"text")


def test_context_of_an_image(ingested):
    images = ingested[0].filter("file_kind = 'image'")
    got = chunks.process_with_context(images, F.lit("before"), F.lit("")).first()
    assert got.content.startswith("**Context Before:**\nbefore\n\n# ") and got.metadata.has_context and got.metadata.context_after == ""
    assert documents.told  # the formatter of tables is shared by both kinds of documents


def test_a_batch_of_images_is_numbered(spark):
    rows = spark.createDataFrame([("d/b.png", "b.png"), ("d/a.png", "a.png")], "path string, filename string")
    got = {r.metadata.filename: r.content for r in chunks.image_chunks(chunks.numbered_images(rows.withColumns({"width": F.lit(1), "height": F.lit(1)}), "s")).collect()}
    assert got["a.png"].startswith("# Image 1\n") and got["b.png"].startswith("# Image 2\n")


def test_reports(spark, ingested, tmp_path):
    made, _ = ingested
    sinks.write_all(made, str(tmp_path / "all"), workers=3)
    assert sinks.read_chunks(spark, str(tmp_path / "all/chunks")).count() == made.count()
    said = spark.read.json(str(tmp_path / "all/processing_summary")).first()
    assert said.total_chunks == made.count() and said.workers == 3 and said.by_modality["audio"] == 2 and said.by_file_type["docx"] == 5
    docs = made.filter("file_kind = 'docx'")
    sinks.write_docx(docs, str(tmp_path / "docx"))
    report = spark.read.text(str(tmp_path / "docx/summary"), wholetext=True).first().value
    assert "Total chunks: 5" in report and "  Tables with context: 1/1" in report and "  Images with context: 2/2" in report
    sinks.write_images(made.filter("file_kind = 'image'"), str(tmp_path / "images"))
    stats = spark.read.json(str(tmp_path / "images/statistics")).first()
    assert (stats.total, stats.with_text, stats.avg_confidence) == (1, 1, 91.0) and spark.read.json(str(tmp_path / "images/images")).first()["type"] == "photo/visual_only"
    sinks.write_audio(made.filter("file_kind = 'audio'"), str(tmp_path / "audio"))
    stats = spark.read.json(str(tmp_path / "audio/statistics")).first()
    assert (stats.total, stats.total_duration, stats.total_duration_formatted, stats.languages) == (2, 5.75, "0:00:05", ["de", "en"])
    assert sinks.metrics(lambda: made)["total_chunks"] == made.count()
    assert sinks.summary_table(made).filter("dimension = 'total'").first().chunks == made.count()
    sinks.clear(spark, str(tmp_path / "audio"), str(tmp_path / "never"))
    assert not (tmp_path / "audio").exists()


def test_no_chunks_at_all(spark):
    none = ingest.empty_chunks(spark)
    assert media_row(none) == (0, 0, 0, 0.0) and ingest.numbered_chunks(none.withColumn("file_kind", F.lit("x"))).count() == 0


def media_row(chunks_):
    from lodestone.operators import media

    r = media.image_statistics(chunks_).first()
    return r.total, r.screenshots, r.with_text, r.avg_confidence


# --- index and answers --------------------------------------------------------------------------------------------------------


class Broken(providers.HashingEmbedder):
    def embed(self, texts):
        raise RuntimeError("no model")


@pytest.fixture(scope="module")
def built(spark, ingested, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    pictures = files.find_files(spark, str(folder), "image", content=True)
    made = ingested[0].withColumn("metadata", F.when(F.col("file_kind") == "image", F.col("metadata").withField("image_path", F.lit(f"file:{folder}/shot.PNG"))).otherwise(F.col("metadata")))
    return index.build_index(made, path, images=pictures), path


def test_index_records(spark, ingested, built):
    records = {r.chunk_id: r for r in built[0].records(spark).collect()}
    assert len(records) == ingested[0].count()
    one = records["a.pdf_table_0"]
    assert one.page_number == "N/A" and one.content_preview == one.content[:200] + "..." and one.original_metadata.table_number == "3"
    shot = next(r for i, r in records.items() if i.startswith("image_shot_"))
    assert np.allclose(shot.embedding, providers.HashingEmbedder().embed_images([png(1920, 1080)])[0]) and np.allclose(one.embedding, providers.HashingEmbedder().embed([one.content])[0])
    stats = index.index_statistics(built[0], spark).first()
    assert stats.total == len(records) and stats.by_modality["audio"] == 2 and stats.sources == 4


def test_missing_and_empty_indexes(spark, ingested, tmp_path):
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="embedded"):
        index.build_index(ingested[0], str(tmp_path / "failed"), Broken())


def test_searches_and_answers(spark, built):
    s = session.Session(spark, built[1], reranker=providers.OverlapReranker(), generator=Model(), transcriber=Speech())
    records = {r.doc_idx: r.chunk_id for r in s.index.records(spark).collect()}
    asked = spark.createDataFrame([(1, "Sales of goods table"), (2, "the agenda of the meeting")], "query_id long, query string")
    found = s.search_by_text(asked, 3).collect()
    best = {r.query_id: records[r.doc_id] for r in found if r["rank"] == 1}
    assert "a.pdf" in best[1] and best[2] == "audio_call_chunk_1" and max(r["rank"] for r in found) <= 3
    pictures = spark.createDataFrame([(5, "shot.png", bytearray(png(1920, 1080))), (6, "empty.png", None)], "query_id long, name string, image binary")
    seen = s.search_by_image(pictures, 2).collect()
    assert {r.query_id for r in seen} == {5} and records[min(seen, key=lambda r: r["rank"]).doc_id].startswith("image_shot_")
    spoken = spark.createDataFrame([(7, "q.mp3", bytearray(b"speech")), (8, "h.mp3", bytearray(b"noise"))], "query_id long, name string, audio binary")
    heard = s.search_by_audio(spoken, 2).collect()
    assert {r.query_id for r in heard} == {7} and all(records[r.doc_id].startswith("audio_call") for r in heard)
    answers = {r.query_id: r.answer for r in s.chat_text(asked).collect()}
    assert answers[1] == "1 images, None tokens, True" and s.facts(s.search_by_text(asked, 3)).count() == 2
    assert {r.query_id: r.answer for r in s.chat_image(pictures).collect()}[6] == "❌ No similar content found."
    assert {r.query_id: r.answer for r in s.chat_audio(spoken).collect()}[8] == "❌ No related content found."
    both = s.chat_multimodal(asked.filter("query_id = 1"), pictures.withColumn("query_id", F.lit(1).cast("long")).limit(1), spoken.withColumn("query_id", F.lit(1).cast("long")).limit(1)).collect()
    assert len(both) == 1 and both[0].answer.endswith("True")
    failing = spark.createDataFrame([(9, "fail to answer about goods")], "query_id long, query string")
    assert s.chat_text(failing).first().answer == "❌ Error: connection refused"
    assert session.user_message("connection refused") == "❌ The model's server is not running. Please start it." and session.user_message("other") == "other"
    silent = session.Session(spark, built[1])
    assert silent.search_by_audio(spoken).count() == 0 and silent.search_multimodal().count() == 0
    assert session.answer_with_images(s, asked, found=s.search_by_text(asked, 2)).count() == 2


def test_keyword_index_is_read_by_bucket(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (1, "alpha gamma"), (2, None), (3, "delta delta alpha")], "doc_id long, text string")
    kept = search.build_keyword_index(docs)
    queries = spark.createDataFrame([(0, "beta delta"), (1, ""), (2, "unknown")], "query_id long, query string")
    got = [tuple(r) for r in search.bm25(kept, queries).orderBy("query_id", "rank").collect()]
    assert got == [tuple(r) for r in search.bm25(docs, queries).orderBy("query_id", "rank").collect()] and [r[2] for r in got] == [3, 1]
    assert kept.postings(spark).filter("doc_id = 1 and term = 'alpha'").count() == 2
    plan = kept.postings(spark).filter("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_semantic_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(900, None), (901, [1.0]), (902, [1.0, None, 2.0, 3.0])]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)] + [(99, None), (98, [2.0])], "query_id long, query_embedding array<double>")
    whole = sorted(map(tuple, search.semantic(vectors, queries, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 100)
    assert sorted(map(tuple, search.semantic(vectors, queries, 3).collect())) == whole and len(whole) == 61 and (98, 1, 901, 2.0) in whole
