"""Operators over document elements: chunks, context windows, tables and captions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import caption_number, caption_title, plain_number, sentences, stripped

TEXT_TYPES = ["NarrativeText", "Text", "Title", "ListItem"]
CAPTION_TYPES = ["NarrativeText", "Text", "Title"]


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def quarter_length(text: str) -> int:
    """Tokens by the default counter: one for each four characters, rounded down."""
    return len(text) // 4


def pack_sentences(parts: list[str], most: int, overlap: int, count: Callable[[str], int]) -> list[str]:
    """Chunks of whole sentences, none of more than most tokens unless one sentence is.

    A chunk is closed before the sentence that would take it past most. The next begins with those of its last three sentences, taken
    backwards, that fit into overlap tokens together (one that does not fit is passed over), and the sentence itself.
    """
    out, now, tokens = [], [], 0
    for part in parts:
        n = count(part)
        if tokens + n > most:
            kept, tokens = [], 0
            if now:
                out.append(" ".join(x for x, _ in now))
                for x, k in reversed(now[-3:]):
                    if tokens + k <= overlap:
                        kept.append((x, k))
                        tokens += k
            now = kept[::-1]
        now.append((part, n))
        tokens += n
    return [*out, " ".join(x for x, _ in now)] if now else out


def semantic_chunks(text: Column, most: int = 512, overlap: int = 50, count: Callable[[str], int] = quarter_length) -> Column:
    """pack_sentences() of each text as an array of (content, token_count); the fold runs over Arrow batches, where the rows lie."""

    @F.arrow_udf("array<struct<content:string,token_count:int>>")
    def packed(texts: pa.Array) -> pa.Array:
        rows = [[{"content": c, "token_count": count(c)} for c in pack_sentences(parts or [], most, overlap, count)] for parts in texts.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("content", pa.string()), ("token_count", pa.int32())])))

    return packed(sentences(text))


def chunk_rows(docs: DataFrame, most: int = 512, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, total_chunks, content, token_count) of (doc_id, text)."""
    packed = docs.select("doc_id", semantic_chunks(F.col("text"), most, overlap).alias("chunks"))
    return packed.select("doc_id", F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "c")).select("doc_id", "chunk_index", "total_chunks", "c.content", "c.token_count")


def _frame(first: int, last: int):
    return Window.partitionBy("source").orderBy("element_idx").rowsBetween(first, last)


def surrounding_text(elements: DataFrame, reach: int = 10, keep: int = 5, least: int = 20, types: list[str] = TEXT_TYPES) -> DataFrame:
    """elements with text_before and text_after: of the reach elements on either side those of text types and at least least characters, the nearest keep of them joined.

    Types are filtered inside the frame, so elements of other types use up positions.
    """
    fit = F.when(F.col("element_type").isin(types) & (F.length(stripped(F.col("text"))) >= least), stripped(F.col("text")))
    before, after = F.collect_list(fit).over(_frame(-reach, -1)), F.collect_list(fit).over(_frame(1, reach))
    return elements.withColumns({
        "text_before": F.array_join(_last(before, keep), " "),
        "text_after": F.array_join(F.slice(after, 1, keep), " "),
    })


def _caption_fold(items: Column, capitals: bool, keep: int) -> Column:
    """The first caption, or the first short text in capitals, is the title; the last of the rest describe."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("title"), F.lit("").alias("caption"), F.lit(None).cast("string").alias("number"), none.alias("rest"))

    def step(state: Column, text: Column) -> Column:
        is_caption = caption_number(text).isNotNull() & (state.title == "")
        is_capital = F.lit(capitals) & (F.length(text) < 100) & (F.upper(text) == text) & (F.lower(text) != text) & (state.title == "")
        return F.struct(
            F.when(is_caption, caption_title(text)).when(is_capital, text).otherwise(state.title).alias("title"),
            F.when(is_caption, text).otherwise(state.caption).alias("caption"),
            F.when(is_caption, caption_number(text)).otherwise(state.number).alias("number"),
            F.when(is_caption | is_capital, state.rest).otherwise(F.concat(state.rest, F.array(text))).alias("rest"),
        )

    done = lambda s: F.struct(s.title, s.caption, s.number, F.array_join(_last(s.rest, keep), " ").alias("description"))
    return F.aggregate(items, start, step, done)


def table_context(elements: DataFrame, reach: int = 10, keep: int = 5) -> DataFrame:
    """elements with context (title, caption, number, description) from the elements before each."""
    fit = F.when(F.col("element_type").isin(CAPTION_TYPES) & (F.length(stripped(F.col("text"))) >= 3), stripped(F.col("text")))
    return elements.withColumn("context", _caption_fold(F.collect_list(fit).over(_frame(-reach, -1)), True, keep))


def image_context(elements: DataFrame, reach: int = 10, keep: int = 5) -> DataFrame:
    """elements with context from the elements before each and the reach - 1 after it; figure captions count, capitals do not."""
    fit = F.when(F.col("element_type").isin([*CAPTION_TYPES, "FigureCaption"]) & (F.length(stripped(F.col("text"))) >= 3), stripped(F.col("text")))
    items = F.concat(F.collect_list(fit).over(_frame(-reach, -1)), F.collect_list(fit).over(_frame(1, reach - 1)))
    return elements.withColumn("context", _caption_fold(items, False, keep))


def heading_context(elements: DataFrame, reach: int = 5, keep: int = 3, least: int = 3) -> DataFrame:
    """Context of word-processor tables from the paragraphs before: the first short heading (in capitals, styled, or a caption) is the title, the last keep others describe."""
    text = stripped(F.col("text"))
    fit = F.when((F.col("element_type") == "Paragraph") & (F.length(text) >= least), F.struct(text.alias("text"), F.coalesce(F.startswith("style", F.lit("Heading")), F.lit(False)).alias("styled")))
    items = F.collect_list(fit).over(_frame(-reach, -1))
    head = lambda x: (F.length(x.text) < 100) & (((F.upper(x.text) == x.text) & (F.lower(x.text) != x.text)) | x.styled | F.rlike(x.text, F.lit(r"(?i)^(Table|Figure|Chart)\s*\d*[:.]\s*")))
    marked = F.transform(items, lambda x, i: F.struct(x.text.alias("text"), i.alias("i"), head(x).alias("head")))
    first = F.try_element_at(F.filter(marked, lambda x: x.head), F.lit(1))
    with_first = elements.withColumn("context", F.struct(marked.alias("items"), first.alias("first")))
    rest = F.transform(F.filter("context.items", lambda x: ~F.coalesce(x.i == F.col("context.first.i"), F.lit(False))), lambda x: x.text)
    return with_first.withColumn("context", F.struct(F.coalesce("context.first.text", F.lit("")).alias("title"), F.array_join(_last(rest, keep), " ").alias("description")))


def placed_images(images: DataFrame, elements: DataFrame) -> DataFrame:
    """images (source, image_no from 0, n_images) of word-processor documents with the estimated element position and the paragraphs around it."""
    size = elements.groupBy("source").agg(F.count("*").alias("n_elements"))
    at = images.join(size, "source", "left").withColumn("element_idx", F.floor(F.col("image_no") / F.col("n_images") * F.coalesce("n_elements", F.lit(0))).cast("int"))
    around = surrounding_text(elements, 5, 3, 20, ["Paragraph"]).select("source", "element_idx", "text_before", "text_after")
    return at.join(around, ["source", "element_idx"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("text_before", "text_after")})


# --- tables -------------------------------------------------------------------------------------------------------------------


def numeric(cell: Column) -> Column:
    """The number left of a cell when only digits and points are kept; null if that is none."""
    return F.regexp_replace(cell, r"[^\d.]", "").try_cast("double")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _rows_of(tables: DataFrame) -> DataFrame:
    """(table_id, rows): the cells of each table in order of row_no; one grouping by table."""
    return tables.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "cells"))), lambda r: r.cells).alias("rows"))


def _summary(head: Column, data: Column) -> Column:
    """What is said of each column with numbers in at least half of the rows: its highest value and the first cell of the first row that has it."""

    def of(name: Column, at: Column) -> Column:
        known = F.filter(F.transform(data, lambda r, i: F.struct(numeric(F.get(r, at)).alias("v"), (-i).alias("i"))), lambda x: x.v.isNotNull())
        told = lambda best: F.concat(F.lit("The highest "), name, F.lit(" is "), plain_number(best.v), F.lit(" (from "), F.get(F.get(data, -best.i), F.lit(0)), F.lit(")"))
        return _let(known, lambda k: F.when((F.size(k) > 0) & (F.size(k) >= F.size(data) * F.lit(0.5)), _let(F.array_max(k), told)))

    return F.array_join(F.filter(F.transform(head, of), lambda x: x.isNotNull()), "; ")


def column_summary(tables: DataFrame) -> DataFrame:
    """(table_id, summary) of (table_id, row_no, cells) where there is something to say: row 0 is the header."""
    rows = _rows_of(tables).select("table_id", F.col("rows")[0].alias("head"), F.slice("rows", 2, 1_000_000_000).alias("data"))
    return rows.select("table_id", _summary(F.col("head"), F.col("data")).alias("summary")).filter("summary <> ''")


def told(head: Column, data: Column, title: Column, description: Column, summary: Column | None = None) -> Column:
    """A table in words: title, description, size, each row as header: value pairs, the summary and the table itself."""
    part = lambda text: F.when(text != "", text)
    pairs = lambda r: F.array_join(F.filter(F.zip_with(head, r, lambda h, v: F.when((v != "") & h.isNotNull(), F.concat(h, F.lit(": "), v))), lambda x: x.isNotNull()), ", ")
    numbered = F.filter(F.transform(data, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), pairs(r))), lambda x: ~F.rlike(x, F.lit(r"^\d+\. $")))
    # The phrases between the parts.
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# "), part(title), F.lit("\n")),
        F.concat(part(description), F.lit("\n")),
        F.concat(F.lit("This table contains "), F.size(data).cast("string"), F.lit(" entries with "), F.size(head).cast("string"), F.lit(" columns: "), F.array_join(head, ", "), F.lit(".\n")),
        F.lit("\nDetailed Data:"),
        numbered,
        F.concat(F.lit("\nSummary: "), part(summary)) if summary is not None else F.lit(None).cast("string"),
        F.lit("\n[Original Table Format]"),
        F.array_join(head, " | "),
        F.repeat(F.lit("-"), F.size(head) * 15),
        F.transform(data, lambda r: F.array_join(r, " | ")),
    )


def table_text(tables: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(table_id, content): a table told in words from (table_id, row_no, cells), with title and description from context (table_id, title, description)."""
    rows = _rows_of(tables).select("table_id", F.col("rows")[0].alias("head"), F.slice("rows", 2, 1_000_000_000).alias("data"))
    rows = rows.join(context.select("table_id", "title", "description"), "table_id", "left") if context is not None else rows.withColumns({"title": F.lit(""), "description": F.lit("")})
    rows = rows.withColumn("summary", _summary(F.col("head"), F.col("data")))
    return rows.select("table_id", told(F.col("head"), F.col("data"), F.col("title"), F.col("description"), F.col("summary")).alias("content"))


def pipe_table_text(text: Column, title: Column, description: Column) -> Column:
    """A table drawn with pipes in words: the first line is the header, empty cells drop out, and so do lines of single dashes alone."""
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), stripped), lambda c: c != "")
    lines = F.split(stripped(text), "\n")
    rows = F.transform(F.slice(lines, 2, 1_000_000_000), cells)
    data = F.filter(rows, lambda r: (F.size(r) > 0) & F.exists(r, lambda c: c != "-"))
    return told(cells(lines[0]), data, title, description)


def joined(*parts: Column | tuple[str, Column], between: str = "\n\n") -> Column:
    """Parts joined, empty ones left out; a part (label, text) is its label and the text."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws(between, *(F.concat(F.lit(p[0]), some(p[1])) if isinstance(p, tuple) else some(p) for p in parts))


# The labels of contexts and image files.
def table_content(before: Column, body: Column, after: Column) -> Column:
    """A table of a PDF between the text around it."""
    return F.concat_ws("\n", F.concat(F.lit("**Context Before Table (5 sentences):**\n"), F.when(before != "", before), F.lit("\n")), body, F.concat(F.lit("\n**Context After Table (5 sentences):**\n"), F.when(after != "", after)))


def read_in_image(text: Column) -> Column:
    """What a reader found in an image, as it stands in the content: nothing for ten characters or fewer."""
    return F.when(F.length(stripped(text)) > 10, F.concat(F.lit("\n**OCR Extracted Text from Image:**\n"), stripped(text))).otherwise(F.lit(""))


def image_content(title: Column | None, before: Column, path: Column, read: Column, after: Column) -> Column:
    """An image of a PDF (with a title, which may be empty) or of a word-processor document (title None) with the text around it."""
    size = "" if title is None else " (5 sentences)"
    file = F.concat(F.lit("**Image File:** "), F.coalesce(path, F.lit("Not found")))
    head = [] if title is None else [F.concat(F.lit("# "), F.when(title != "", title), F.lit("\n"))]
    return joined(*head, (f"**Context Before Image{size}:**\n", before), file, read, (f"\n**Context After Image{size}:**\n", after))


def with_context(content: Column, before: Column, after: Column) -> Column:
    """Content between the text around it, for an image that stands in a document."""
    return joined(F.concat(F.lit("**Context Before:**\n"), F.when(before != "", before), F.lit("\n")), content, ("\n**Context After:**\n", after), between="\n")
