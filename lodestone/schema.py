"""The one form of a chunk, whatever file it comes from, and of an index record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import preview

#: Metadata of all kinds of chunks; a kind leaves what it does not have null.
METADATA = {
    "type": "string", "modality": "string", "source": "string", "original_index": "int", "chunk_index": "int", "total_chunks": "int", "has_image_file": "boolean", "session_id": "string", "page_number": "int",
    "reference_names": "array<string>", "searchable_text": "string", "has_context": "boolean", "context_sentences": "int",
    "table_title": "string", "table_number": "string", "table_description": "string", "llm_friendly": "boolean",
    "image_path": "string", "figure_title": "string", "figure_number": "string", "figure_caption": "string", "has_ocr": "boolean", "use_image_directly": "boolean",
    "primary_type": "string", "sub_type": "string", "image_width": "int", "image_height": "int", "image_format": "string", "file_size_mb": "double",
    "has_ocr_text": "boolean", "ocr_confidence": "double", "ocr_word_count": "int", "ocr_method": "string", "is_screenshot": "boolean", "screenshot_confidence": "double",
    "detected_timestamps": "array<string>", "detected_applications": "array<string>", "content_description": "string", "keywords": "array<string>", "has_rich_text": "boolean",
    "embedding_type": "string", "embedding_dim": "int", "created_time": "string", "modified_time": "string", "timestamp": "string", "user_description": "string",
    "context_before": "string", "context_after": "string",
    "audio_path": "string", "filename": "string", "meeting_title": "string", "start_time": "double", "end_time": "double", "duration": "double", "timestamp_formatted": "string",
    "speaker": "string", "num_speakers": "int", "word_count": "int", "language": "string", "chunk_keywords": "array<string>", "overall_keywords": "array<string>",
    "topics": "array<string>", "entities": "array<string>", "processing_mode": "string", "processing_engine": "string", "diarization_method": "string",
}
METADATA_TYPE = "struct<" + ",".join(f"{k}:{t}" for k, t in METADATA.items()) + ">"
CHUNK = f"id string, content string, token_count int, metadata {METADATA_TYPE}"
#: Order of kinds in an index; the first pieces of documents are those of tables.
KINDS = ["table", "text", "image", "audio"]


def metadata(**given: Column) -> Column:
    """All metadata as one struct; fields that are not given are null."""
    unknown = set(given) - set(METADATA)
    if unknown:
        raise ValueError(f"no such metadata: {sorted(unknown)}")
    return F.struct(*((given[k] if k in given else F.lit(None)).cast(t).alias(k) for k, t in METADATA.items()))


def index_records(chunks: DataFrame) -> DataFrame:
    """(chunk_id, type, content, content_preview, source, page_number, chunk_index, total_chunks, token_count, original_metadata): what an index keeps of a chunk.

    A missing id or page is 'N/A', a missing source 'unknown', a missing index 0 and a missing total 1.
    """
    m = F.col("metadata")
    return chunks.select(
        *(c for c in chunks.columns if c not in ("id", "content", "token_count", "metadata")),
        F.coalesce("id", F.lit("N/A")).alias("chunk_id"), m["type"].alias("type"), "content", preview(F.col("content"), 200).alias("content_preview"), F.coalesce(m["source"], F.lit("unknown")).alias("source"),
        F.coalesce(m["page_number"].cast("string"), F.lit("N/A")).alias("page_number"), F.coalesce(m["chunk_index"], F.lit(0)).alias("chunk_index"), F.coalesce(m["total_chunks"], F.lit(1)).alias("total_chunks"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"), m.alias("original_metadata"),
    )
