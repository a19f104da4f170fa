"""From what readers find in files to chunks: PDF and word-processor elements, images and recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import documents, media
from lodestone.schema import metadata


def _nth(*order: str, by: str = "source") -> Column:
    return (F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1).cast("int")


def _named(title: Column, number: Column, *kinds: str) -> Column:
    """Names under which a table or figure may be asked for; null where it has no number."""
    return F.array(title, *(F.when(number.isNotNull(), F.concat(F.lit(f"{k} "), number)) for k in kinds))


def _chunk(id_: Column, content: Column, tokens: Column, **meta: Column) -> list[Column]:
    return [id_.alias("id"), content.alias("content"), tokens.cast("int").alias("token_count"), metadata(**meta).alias("metadata")]


def long_texts(elements: DataFrame, least: int = 50) -> DataFrame:
    """Elements of text types with at least least characters, numbered in each source."""
    kept = elements.filter(F.col("element_type").isin(documents.TEXT_TYPES) & (F.length(T.stripped(F.col("text"))) >= least))
    return kept.withColumn("original_index", _nth("element_idx"))


def long_paragraphs(elements: DataFrame, least: int = 50) -> DataFrame:
    """Paragraphs of word-processor documents with at least least characters, numbered in each source."""
    kept = elements.filter((F.col("element_type") == "Paragraph") & (F.length(T.stripped(F.col("text"))) >= least)).withColumn("text", T.stripped(F.col("text")))
    return kept.withColumn("original_index", _nth("element_idx"))


def pdf_chunks(elements: DataFrame, image_files: DataFrame | None = None, most: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of PDF elements (source, element_idx, element_type, text): tables in words with the text around them, text cut at sentences, and images.

    image_files (source, number, path, read) names the file of a source's n-th image, from 0, and what was read in it.
    """
    around = documents.surrounding_text(elements)
    tables = documents.table_context(around).filter("element_type = 'Table'").withColumn("n", _nth("element_idx"))
    title, number, described = (F.col(f"context.{c}") for c in ("title", "number", "description"))
    told = documents.pipe_table_text(F.col("text"), title, described)
    tables = tables.withColumn("content", documents.table_content(F.col("text_before"), told, F.col("text_after")))
    name = lambda kind, *parts: F.concat_ws("_", "source", F.lit(kind), *(F.col(p).cast("string") for p in parts))
    common = {"source": F.col("source"), "chunk_index": F.lit(0), "total_chunks": F.lit(1)}
    table_chunks = tables.select(*_chunk(
        name("table", "n"), F.col("content"), T.token_count(F.col("content")), **common, type=F.lit("table"), modality=F.lit("table"), original_index=F.col("n"), has_image_file=F.lit(False),
        table_title=title, table_number=number, table_description=described, llm_friendly=F.lit(True), has_context=F.lit(True), context_sentences=F.lit(5),
        reference_names=_named(title, number, "table", "Table"),
    ))
    texts = long_texts(elements).select("source", "original_index", documents.semantic_chunks(F.col("text"), most, overlap).alias("parts"))
    texts = texts.select("source", "original_index", F.size("parts").alias("total"), F.posexplode("parts").alias("i", "part"))
    text_chunks = texts.select(*_chunk(
        name("text", "original_index", "i"), F.col("part.content"), F.col("part.token_count"), source=F.col("source"), type=F.lit("narrative_text"), modality=F.lit("text"),
        original_index=F.col("original_index"), chunk_index=F.col("i"), total_chunks=F.col("total"), has_image_file=F.lit(False),
    ))
    images = documents.image_context(around).filter("element_type = 'Image'").withColumn("n", _nth("element_idx"))
    if image_files is not None:
        images = images.join(image_files.select("source", F.col("number").alias("n"), "path", "read"), ["source", "n"], "left")
    else:
        images = images.withColumns({"path": F.lit(None).cast("string"), "read": F.lit(None).cast("string")})
    read = documents.read_in_image(F.coalesce("read", F.lit("")))
    images = images.withColumn("content", documents.image_content(title, F.col("text_before"), F.col("path"), read, F.col("text_after")))
    has_file = F.col("path").isNotNull()
    image_chunks = images.select(*_chunk(
        name("image", "n"), F.col("content"), T.token_count(F.col("content")), **common, type=F.lit("image"), modality=F.lit("image"), original_index=F.col("n"), image_path=F.col("path"),
        has_image_file=has_file, use_image_directly=has_file, has_context=(F.col("text_before") != "") | (F.col("text_after") != ""), has_ocr=read != "", context_sentences=F.lit(5),
        figure_title=title, figure_number=number, figure_caption=F.col("context.caption"), reference_names=_named(title, number, "figure", "Figure", "fig"),
    ))
    return table_chunks.unionByName(text_chunks).unionByName(image_chunks)


def docx_chunks(elements: DataFrame, image_files: DataFrame | None = None) -> DataFrame:
    """Chunks of word-processor elements (source, element_idx, element_type, style, text, cells): paragraphs, tables in words, and images.

    image_files (source, image_no from 0, n_images, path, read) are the pictures inside the documents; where they stand is estimated.
    """
    name = lambda kind, n: F.concat_ws("_", "source", F.lit(kind), F.col(n).cast("string"))
    common = {"source": F.col("source"), "chunk_index": F.lit(0), "total_chunks": F.lit(1)}
    texts = long_paragraphs(elements).select(*_chunk(
        name("para", "original_index"), F.col("text"), T.token_count(F.col("text")), **common, type=F.lit("narrative_text"), modality=F.lit("text"), original_index=F.col("original_index"), has_image_file=F.lit(False),
    ))
    tables = documents.heading_context(elements).filter("element_type = 'Table'").withColumn("n", _nth("element_idx"))
    head, data = F.get("cells", F.lit(0)), F.slice("cells", 2, 1_000_000_000)
    title, described = F.col("context.title"), F.col("context.description")
    told = F.when(F.size("cells") > 0, documents.told(head, data, title, described, documents._summary(head, data))).otherwise(F.lit("Empty table"))
    tables = tables.withColumn("content", told).select(*_chunk(
        name("table", "n"), F.col("content"), T.token_count(F.col("content")), **common, type=F.lit("table"), modality=F.lit("table"), original_index=F.col("n"), has_image_file=F.lit(False),
        table_title=title, table_description=described, has_context=(title != "") | (described != ""), llm_friendly=F.lit(True),
    ))
    chunks = texts.unionByName(tables)
    if image_files is None:
        return chunks
    placed = documents.placed_images(image_files, elements)
    read = documents.read_in_image(F.coalesce("read", F.lit("")))
    placed = placed.withColumn("content", documents.image_content(None, F.col("text_before"), F.col("path"), read, F.col("text_after")))
    images = placed.select(*_chunk(
        name("image", "image_no"), F.col("content"), T.token_count(F.col("content")), **common, type=F.lit("image"), modality=F.lit("image"), original_index=F.col("image_no"), image_path=F.col("path"),
        has_image_file=F.lit(True), use_image_directly=F.lit(True), has_context=(F.col("text_before") != "") | (F.col("text_after") != ""), has_ocr=read != "",
    ))
    return chunks.unionByName(images)


# --- images -------------------------------------------------------------------------------------------------------------------


def analysed_images(images: DataFrame) -> DataFrame:
    """images (path, filename, width, height, ..., ocr_text, word_count) with screenshot signs, types, description and keywords."""
    typed = media.image_types(media.screenshots(images))
    return typed.withColumn("keywords", T.top_words(T.keyword_tokens(F.col("ocr_text"), T.STOP_IMAGE), 10))


def image_text(images: DataFrame) -> Column:
    """The content of an image chunk: title, description, file, size, type, time, applications, text and keywords."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    col = F.col
    title = F.coalesce(some(col("figure_title")), F.concat(F.lit("Image "), some(col("figure_number"))), col("content_description"))
    percent = F.format_string("%.0f", F.bround("ocr_confidence", 0))
    found = F.when(col("has_text"), "Extracted").when(col("word_count") > 0, "Partial")
    # The labels.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), title, F.lit("\n")),
        F.concat(F.lit("**Description:** "), some(col("user_description")), F.lit("\n")),
        F.concat(F.lit("**File:** "), "filename"),
        F.concat(F.lit("**Size:** "), col("width").cast("string"), F.lit("x"), col("height").cast("string"), F.lit(" pixels")),
        F.concat(F.lit("**Type:** "), "primary_type", F.lit("/"), "sub_type"),
        F.coalesce(F.concat(F.lit("**Timestamp:** "), some(col("timestamp"))), F.concat(F.lit("**Detected Time:** "), F.get("timestamps", F.lit(0)))),
        F.when(col("is_screenshot") & (F.size("applications") > 0), F.concat(F.lit("**Application:** "), F.array_join("applications", ", "))),
        F.concat(F.lit("\n**"), found, F.lit(" Text ("), percent, F.lit("% confidence):**\n"), "ocr_text"),
        F.when(F.size("keywords") > 0, F.concat(F.lit("\n**Keywords:** "), F.array_join(F.slice("keywords", 1, 10), ", "))),
    )


def searchable(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by spaces."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def reference_names(title: Column, number: Column, filename: Column, description: Column) -> Column:
    named = [title, F.concat(F.lit("image "), F.nullif(number, F.lit(""))), F.concat(F.lit("Image "), F.nullif(number, F.lit(""))), filename, description]
    return F.filter(F.array(*named), lambda p: p.isNotNull() & (p != ""))


IMAGE_INPUT = {
    "path": "string", "filename": "string", "format": "string", "width": "int", "height": "int", "file_size_mb": "double", "created_time": "string", "modified_time": "string",
    "ocr_text": "string", "word_count": "int", "ocr_confidence": "double", "has_text": "boolean", "ocr_method": "string",
    "user_description": "string", "timestamp": "string", "session_id": "string", "source_document": "string", "figure_number": "string", "figure_title": "string",
}


def image_chunks(images: DataFrame, embedding_dim: int = 512) -> DataFrame:
    """A chunk for each image (columns of IMAGE_INPUT; those that are missing are null). The id ends in the seconds of its modification, or 0.

    token_count is the number of words of the content, as for recordings.
    """
    images = images.select(*(F.col(c).cast(t) if c in images.columns else F.lit(None).cast(t).alias(c) for c, t in IMAGE_INPUT.items()))
    images = images.withColumns({"ocr_text": F.coalesce("ocr_text", F.lit("")), "word_count": F.coalesce("word_count", F.lit(0)), "ocr_confidence": F.coalesce("ocr_confidence", F.lit(0.0)), "has_text": F.coalesce("has_text", F.lit(False))})
    known = analysed_images(images)
    known = known.withColumn("content", image_text(known))
    words = F.size(F.filter(F.split(T.stripped(F.col("content")), r"\s+"), lambda w: w != ""))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    col = F.col
    return known.select(*_chunk(
        F.concat(F.lit("image_"), stem, F.lit("_"), F.coalesce(F.unix_timestamp(col("modified_time").try_cast("timestamp")), F.lit(0)).cast("string")), col("content"), words,
        type=F.lit("image"), modality=F.lit("image"), primary_type=col("primary_type"), sub_type=col("sub_type"), source=F.coalesce(F.nullif("source_document", F.lit("")), "filename"),
        image_path=col("path"), filename=col("filename"), session_id=col("session_id"), figure_number=col("figure_number"), figure_title=col("figure_title"),
        image_width=col("width"), image_height=col("height"), image_format=col("format"), file_size_mb=col("file_size_mb"),
        has_ocr_text=col("has_text"), ocr_confidence=col("ocr_confidence"), ocr_word_count=col("word_count"), ocr_method=F.coalesce("ocr_method", F.lit("none")),
        is_screenshot=col("is_screenshot"), screenshot_confidence=col("confidence"), detected_timestamps=col("timestamps"), detected_applications=col("applications"),
        content_description=col("content_description"), keywords=col("keywords"), has_rich_text=col("word_count") > 50, timestamp=col("timestamp"), created_time=col("created_time"),
        modified_time=col("modified_time"), user_description=col("user_description"), embedding_dim=F.lit(embedding_dim), use_image_directly=F.lit(True), has_image_file=F.lit(True),
        reference_names=reference_names(col("figure_title"), col("figure_number"), col("filename"), col("content_description")),
        searchable_text=searchable(col("figure_title"), col("user_description"), col("ocr_text"), col("content_description"), F.array_join("keywords", " ")),
    ))


def numbered_images(images: DataFrame, session_id: str | None = None) -> DataFrame:
    """Images of a batch in order of their paths, with figure numbers from 1; one global number, so for batches and not for whole collections."""
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path"))
    return images.withColumns({"figure_number": order.cast("string"), "session_id": F.lit(session_id).cast("string")})


def process_with_context(chunks: DataFrame, before: Column, after: Column) -> DataFrame:
    """Image chunks between the text around them, which the metadata keeps too."""
    meta = F.col("metadata").withField("has_context", (F.coalesce(before, F.lit("")) != "") | (F.coalesce(after, F.lit("")) != "")).withField("context_before", before).withField("context_after", after)
    return chunks.withColumns({"content": documents.with_context(F.col("content"), before, after), "metadata": meta})


# --- recordings ---------------------------------------------------------------------------------------------------------------


def audio_chunks(segments: DataFrame, engine: str = "none") -> DataFrame:
    """Chunks of the segments of recordings (path, seq from 0, start_time, end_time, speaker, language, text[, meeting_title, user_description, session_id]).

    A segment without text gives none; the heading keeps the segment's own number while chunk_index counts what is left. Keywords over all, topics
    and entities are those of the whole recording.
    """
    for c in ("meeting_title", "user_description", "session_id"):
        segments = segments if c in segments.columns else segments.withColumn(c, F.lit(None).cast("string"))
    kept = segments.withColumn("text", T.stripped(F.coalesce("text", F.lit("")))).filter("text <> ''")
    kept = kept.withColumn("filename", F.regexp_extract("path", r"([^/\\]+)$", 1))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    whole = kept.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x.text), " ").alias("all_text"), F.count("*").cast("int").alias("total"))
    whole = whole.select("path", "total", T.top_words(T.keyword_tokens(F.col("all_text"), T.STOP_AUDIO), 20).alias("overall"), T.topics(F.col("all_text")).alias("topics"), T.entities(F.col("all_text")).alias("entities"))
    rows = kept.join(whole, "path").withColumn("i", _nth("seq", by="path"))
    rows = rows.withColumns({"duration": F.col("end_time") - F.col("start_time"), "own": T.top_words(T.keyword_tokens(F.col("text"), T.STOP_AUDIO_CHUNK), 10)})
    col = F.col
    content = media.audio_content(col("seq"), col("meeting_title"), col("filename"), col("start_time"), col("end_time"), col("duration"), col("speaker"), col("text"))
    words = F.size(F.split("text", r"\s+"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return rows.select(*_chunk(
        F.concat(F.lit("audio_"), stem, F.lit("_chunk_"), col("i").cast("string")), content, words,
        type=F.lit("audio"), modality=F.lit("audio"), source=col("filename"), audio_path=col("path"), filename=col("filename"), session_id=col("session_id"), meeting_title=col("meeting_title"),
        user_description=col("user_description"), chunk_index=col("i"), total_chunks=col("total"), start_time=col("start_time"), end_time=col("end_time"), duration=col("duration"),
        timestamp_formatted=F.concat(F.lit("["), T.timestamp(col("start_time")), F.lit(" → "), T.timestamp(col("end_time")), F.lit("]")), speaker=col("speaker"), num_speakers=F.lit(1),
        word_count=words, language=col("language"), chunk_keywords=col("own"), overall_keywords=col("overall"), topics=col("topics"), entities=col("entities"),
        processing_mode=F.lit("offline"), processing_engine=F.lit(engine), diarization_method=F.lit("mfcc_kmeans_auto"),
        searchable_text=searchable(col("meeting_title"), col("user_description"), col("text"), F.array_join("own", " ")),
    ))
