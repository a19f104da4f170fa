"""From a folder of files to chunks: a reader for each kind, and an error that stays with its file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.operators import media
from lodestone.operators.providers import PdfReader, TextReader, Transcriber
from lodestone.schema import CHUNK, KINDS
from lodestone.sources import files
from lodestone.store import cut


@dataclass
class Readers:
    """Models that read what plain Python cannot. A kind without its reader fails file by file and leaves the others alone."""

    pdf: PdfReader | None = None
    text: TextReader | None = None
    transcriber: Transcriber | None = None
    speakers: int | None = None


@dataclass
class Ingested:
    """chunks (doc_idx, file_kind, id, content, token_count, metadata), and failures (path, file_kind, error)."""

    chunks: DataFrame
    failures: DataFrame


def each_file(found: DataFrame, read: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, error, ...): the rows that read(path, content) gives, or one row with the error of a file that it fails on."""
    width = len(schema.split(", "))
    names = ["path", "error", *(c.split(" ")[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                try:
                    rows += [(path, None, *row) for row in read(path, bytes(content))]
                except Exception as error:  # noqa: BLE001  any error belongs to its file
                    rows.append((path, f"{type(error).__name__}: {error}", *[None] * width))
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return found.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _best(attempts: list[tuple[str, list[tuple[str, float]]]]) -> tuple[str, float, int, str]:
    """(text, mean confidence, words, method) of the attempt of highest mean confidence over its words above 0, the earliest of equals."""
    best = ("", 0.0, 0, "none")
    for method, words in attempts:
        kept = [(w, c) for w, c in words if c > 0]
        mean = sum(c for _, c in kept) / len(kept) if kept else 0.0
        if mean > best[1]:
            best = (" ".join(w for w, _ in kept), mean, len(kept), method)
    return best


def _read_text(reader: TextReader | None, picture: bytes) -> str:
    """What stands in a picture of a document; an error counts as nothing, as does a missing reader."""
    try:
        return _best(reader.read(picture))[0] if reader else ""
    except Exception:  # noqa: BLE001
        return ""


_ELEMENT = "element_idx int, element_type string, style string, text string, cells array<array<string>>, image_no int, image_name string, image_text string"


def read_pdfs(found: DataFrame, reader: PdfReader | None, text: TextReader | None = None) -> DataFrame:
    """Elements and pictures of PDFs. A detailed reading that fails for want of data or a model is tried again the fast way."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        if reader is None:
            raise RuntimeError("no reader for PDF files")
        try:
            elements, pictures = reader.read(content, "hi_res" if reader.detailed else "fast")
        except Exception as error:  # noqa: BLE001
            if not any(sign in str(error).lower() for sign in ("truncated", "huggingface")):
                raise
            elements, pictures = reader.read(content, "fast")
        for i, (kind, said) in enumerate(elements):
            yield (i, kind, None, said, None, None, None, None)
        for i, (name, picture) in enumerate(pictures):
            yield (None, None, None, None, None, i, name, _read_text(text, picture))

    return each_file(found, read, _ELEMENT)


def read_docx(found: DataFrame, text: TextReader | None = None) -> DataFrame:
    """Elements and pictures of word-processor documents."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        for idx, kind, style, said, cells in files.docx_elements(content):
            yield (idx, kind, style, said, cells, None, None, None)
        for i, (name, picture) in enumerate(files.docx_images(content, _name(path).rsplit(".", 1)[0])):
            yield (None, None, None, None, None, i, name, _read_text(text, picture))

    return each_file(found, read, _ELEMENT)


_IMAGE = "filename string, format string, mode string, width int, height int, file_size_mb double, ocr_text string, word_count int, ocr_confidence double, has_text boolean, ocr_method string, ocr_error string"


def read_images(found: DataFrame, reader: TextReader | None = None) -> DataFrame:
    """Facts and best reading of pictures. What is no picture fails; a reader that fails, or none, leaves an empty reading with the error."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        form, mode, width, height = files.image_facts(content)
        try:
            said, confidence, n, method, error = *_best(reader.read(content) if reader else []), None
        except Exception as failure:  # noqa: BLE001
            said, confidence, n, method, error = "", 0.0, 0, "none", f"{type(failure).__name__}: {failure}"
        yield (_name(path), form, mode, width, height, len(content) / 2**20, said, n, confidence, len(said.strip()) > 10 and confidence > 50, method, error)

    rows = each_file(found, read, _IMAGE)
    times = found.select("path", F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_time"))
    return rows.join(times, "path").withColumn("created_time", F.col("modified_time"))


def read_audio(found: DataFrame, transcriber: Transcriber | None) -> DataFrame:
    """Segments of recordings: (path, error, seq, duration, features, language, text)."""

    def read(path: str, content: bytes) -> Iterator[tuple]:
        if transcriber is None:
            raise RuntimeError("no transcriber for recordings")
        for i, (seconds, features, language, said) in enumerate(transcriber.transcribe(content)):
            yield (i, float(seconds), [float(v) for v in features], language, said)

    return each_file(found, read, "seq int, duration double, features array<double>, language string, text string")


def segments_of(rows: DataFrame, speakers: int | None = None) -> DataFrame:
    """Segments with their times and speakers; the number of speakers is found for each recording unless it is known."""
    timed = media.segment_times(rows.select(F.col("path").alias("source"), "seq", "duration", "features", "language", "text"))
    voices = media.diarized(timed, speakers)
    return timed.join(voices, ["source", "seq"]).withColumnRenamed("source", "path")


def _source(rows: DataFrame) -> DataFrame:
    return rows.withColumn("source", files.file_name(F.col("path")))


def ingest(spark: SparkSession, folder: str, readers: Readers | None = None, session_id: str | None = None) -> Ingested:
    """Chunks of all files of known kinds below folder, and the files that failed with their errors.

    doc_idx numbers chunks from 0 by source, kind, element and piece, whatever order files are read in: files are numbered apart and each file's chunks begin
    where those before it end, so no task sees all chunks.
    """
    readers = readers or Readers()
    found = files.find_files(spark, folder, content=True)
    of = lambda kind: found.filter(F.col("file_kind") == kind)
    read = {
        "pdf": cut(read_pdfs(of("pdf"), readers.pdf, readers.text), "pdf-elements"), "docx": cut(read_docx(of("docx"), readers.text), "docx-elements"),
        "image": cut(read_images(of("image"), readers.text), "images"), "audio": cut(read_audio(of("audio"), readers.transcriber), "segments"),
    }
    failures = [rows.filter("error is not null").select("path", F.lit(kind).alias("file_kind"), "error") for kind, rows in read.items()]
    good = {kind: _source(rows.filter("error is null")) for kind, rows in read.items()}
    elements = lambda kind: good[kind].filter("element_idx is not null").select("source", "element_idx", "element_type", "style", "text", "cells")
    pictures = lambda kind: good[kind].filter("image_no is not null")
    wanted = elements("pdf").filter("element_type = 'Image'").groupBy("source").agg(F.count("*").cast("int").alias("n"))
    numbered = wanted.select("source", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("number"))
    named = files.image_for(numbered.join(pictures("pdf").select("source", F.col("image_name").alias("path")), "source"))
    pdf_images = named.join(pictures("pdf").select("source", F.col("image_name").alias("path"), F.col("image_text").alias("read")), ["source", "path"])
    inside = pictures("docx").select("source", "image_no", F.count("*").over(Window.partitionBy("source")).alias("n_images"), F.col("image_name").alias("path"), F.col("image_text").alias("read"))
    made = {
        "pdf": C.pdf_chunks(elements("pdf"), pdf_images), "docx": C.docx_chunks(elements("docx"), inside),
        "image": C.image_chunks(good["image"].withColumn("session_id", F.lit(session_id))),
        "audio": C.audio_chunks(segments_of(good["audio"], readers.speakers).withColumn("session_id", F.lit(session_id)), readers.transcriber.name if readers.transcriber else "none"),
    }
    chunks = None
    for kind, some in made.items():
        some = some.select(F.lit(kind).alias("file_kind"), "id", "content", "token_count", "metadata")
        chunks = some if chunks is None else chunks.unionByName(some)
    all_failures = failures[0].unionByName(failures[1]).unionByName(failures[2]).unionByName(failures[3])
    return Ingested(numbered_chunks(cut(chunks, "chunks")), all_failures)


def numbered_chunks(chunks: DataFrame) -> DataFrame:
    """chunks with doc_idx, gapless from 0, by source, modality (tables, text, images, audio), element and piece."""
    m = F.col("metadata")
    order = [F.array_position(F.array(*map(F.lit, KINDS)), m["modality"]), m["original_index"], m["chunk_index"], F.col("id"), F.col("content")]
    own = F.row_number().over(Window.partitionBy(m["source"]).orderBy(*order))
    sizes = chunks.groupBy(m["source"].alias("src")).agg(F.count("*").alias("n"))
    before = sizes.select("src", (F.sum("n").over(Window.orderBy(F.asc_nulls_first("src"))) - F.col("n")).alias("before"))  # a row for each file
    rows = chunks.withColumn("own", own).join(before, m["source"].eqNullSafe(F.col("src")))
    return rows.select((F.col("before") + F.col("own") - 1).alias("doc_idx"), *chunks.columns)


def empty_chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHUNK)
