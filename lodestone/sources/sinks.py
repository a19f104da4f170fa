"""Writing chunks, and reports about them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import preview
from lodestone.operators import context, media


def write_chunks(chunks: DataFrame, path: str) -> None:
    """All chunks in one table by modality; it replaces the old one, and a modality without chunks has no folder."""
    chunks.withColumn("modality", F.col("metadata.modality")).write.mode("overwrite").partitionBy("modality").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _json_row(df: DataFrame, path: str) -> None:
    """A table of one row as a JSON file in the folder path."""
    df.coalesce(1).write.mode("overwrite").json(path)


def processing_summary(chunks: DataFrame, workers: int = 1) -> DataFrame:
    """One row: totals and counts by type, modality, source and file kind of (file_kind, token_count, metadata)."""
    m = F.col("metadata")
    flat = chunks.select(m["type"].alias("type"), m["modality"].alias("modality"), m["source"].alias("source"), "token_count", F.coalesce(m["has_image_file"], F.lit(False)).alias("has_image_file"), "file_kind")
    dims = ["type", "modality", "source", "file_kind"]
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("of"), F.col(d).alias("value")) for d in dims]))
    counts = flat.select(sets.alias("d")).groupBy("d.of", "d.value").agg(F.count("*").alias("n"))
    of = lambda d: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("of") == d, F.struct("value", "n"))), lambda x: x.value.isNotNull())))
    maps = counts.agg(of("type").alias("by_type"), of("modality").alias("by_modality"), of("source").alias("by_source"), of("file_kind").alias("by_file_type"))
    totals = flat.agg(F.count("*").alias("total_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.count_if("has_image_file").alias("chunks_with_images"))
    both = totals.crossJoin(F.broadcast(maps))  # both are one row
    return both.withColumns({"timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "processing_mode": F.lit("parallel"), "workers": F.lit(workers), "cross_modal_enabled": F.lit(True)})


def write_all(chunks: DataFrame, path: str, workers: int = 1) -> None:
    """All chunks, and the summary of their processing as JSON."""
    write_chunks(chunks, f"{path}/chunks")
    _json_row(processing_summary(chunks, workers), f"{path}/processing_summary")


def docx_report(chunks: DataFrame) -> str:
    """Counts by type of word-processor chunks, and how many tables and images have text around them, as a text of a few lines."""
    m = F.col("metadata")
    rows = chunks.groupBy(m["type"].alias("type")).agg(F.count("*").alias("n"), F.count_if(m["has_context"]).alias("with_context")).orderBy("type").collect()  # a row for each type
    by = {r.type: r for r in rows}
    told = lambda kind: f"{by[kind].with_context if kind in by else 0}/{by[kind].n if kind in by else 0}"
    lines = [f"Total chunks: {sum(r.n for r in rows)}", "", "Chunk Distribution:", *(f"  {r.type}: {r.n}" for r in rows), "", "Enhancements:"]
    return "\n".join([*lines, f"  Tables with context: {told('table')}", f"  Images with context: {told('image')}"])


def write_docx(chunks: DataFrame, path: str) -> None:
    """Word-processor chunks as a table and as JSON, and the report as text."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks.write.mode("overwrite").json(f"{path}/json")
    chunks.sparkSession.createDataFrame([(docx_report(chunks),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/summary")


def image_list(chunks: DataFrame) -> DataFrame:
    """(id, filename, type, is_screenshot, has_text, ocr_confidence, word_count) of each image chunk."""
    m = F.col("metadata")
    return chunks.select("id", m["filename"].alias("filename"), F.concat(m["primary_type"], F.lit("/"), m["sub_type"]).alias("type"), m["is_screenshot"].alias("is_screenshot"), m["has_ocr_text"].alias("has_text"), m["ocr_confidence"].alias("ocr_confidence"), m["ocr_word_count"].alias("word_count"))


def write_images(chunks: DataFrame, path: str) -> None:
    """Image chunks as a table, their list and their statistics as JSON."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    image_list(chunks).write.mode("overwrite").json(f"{path}/images")
    _json_row(media.image_statistics(chunks), f"{path}/statistics")


def audio_list(chunks: DataFrame) -> DataFrame:
    """(id, content_preview, metadata, token_count) of each audio chunk; the preview has 300 characters."""
    return chunks.select("id", preview(F.col("content"), 300).alias("content_preview"), "metadata", "token_count")


def write_audio(chunks: DataFrame, path: str) -> None:
    """Audio chunks as a table, their previews and their statistics as JSON."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    audio_list(chunks).write.mode("overwrite").json(f"{path}/chunks_json")
    _json_row(media.audio_statistics(chunks), f"{path}/statistics")


def clear(spark: SparkSession, *paths: str) -> None:
    """Delete what was ingested and written; paths that do not exist are passed over."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def metrics(run: Callable[[], DataFrame]) -> dict:
    """total_chunks, duration_seconds and chunks_per_second of a run that gives chunks."""
    began = time.time()
    n = run().count()
    seconds = time.time() - began
    return {"total_chunks": n, "duration_seconds": seconds, "chunks_per_second": n / seconds if seconds else 0.0}


def summary_table(chunks: DataFrame) -> DataFrame:
    """context.summary() of chunks with metadata."""
    m = F.col("metadata")
    return context.summary(chunks.select(m["type"].alias("type"), m["modality"].alias("modality"), m["source"].alias("source"), "token_count", m["has_image_file"].alias("has_image_file")))
