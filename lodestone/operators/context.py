"""From search results to prompts, and summaries of chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import counted, fixed3

#: Most items and characters of each kind in a prompt.
CAPS = {"text": (5, 500), "tables": (3, 800), "images": (3, 300), "audio": (3, 400)}
# Names of items, headings of the parts of a prompt and of an uncapped context.
NAMES = {"text": "Text", "tables": "Table", "images": "Image", "audio": "Audio"}
HEADS = {"text": "\n=== TEXT CONTEXT ===", "tables": "\n\n=== TABLE DATA ===", "images": "\n\n=== IMAGES ===", "audio": "\n\n=== AUDIO TRANSCRIPTS ==="}
UNCAPPED_HEADS = {"text": "=== TEXT CONTENT ===\n", "tables": "\n=== TABLE CONTENT ===\n", "images": "\n=== IMAGES ===\n", "audio": "\n=== AUDIO TRANSCRIPTS ===\n"}
LINE = "=" * 70
ABOUT = {"image": "The question comes with an image; find what is like it.", "audio": "The question comes with a recording; find what belongs to it.", "multimodal": "The question combines several of text, image and recording."}
RULES = [
    "Answer from the context above and nothing else. Say so if it does not hold the answer.",
    "For a summary: an overview in one or two sentences, then sections with figures, then what follows from them.",
    "For a question: the answer first, then the details that support it; list several points as bullets.",
    "For images: what they show, their parts and labels, and how they fit the text around them.",
    "For tables: what they measure, notable trends and outliers, and the figures that matter.",
    "Name the source of each fact and quote figures and table entries exactly. Do not speak of chunks, scores or the context itself.",
]


def bucket(modality: Column, nested: Column, kind: Column) -> Column:
    """Where a result belongs: audio before images before tables before text; the modality may be given outside or inside the metadata."""
    m = F.coalesce(modality, nested, F.lit("text"))
    return F.when(m == "audio", "audio").when((m == "image") | (kind == "image"), "images").when((m == "table") | (kind == "table"), "tables").otherwise("text")


def keywords(docs: DataFrame, words: Column, n: int) -> DataFrame:
    """(doc_id, rank, word, n): the commonest words of each document, the earlier of equals first; counted inside the row, so nothing is shuffled."""
    best = docs.select("doc_id", F.posexplode(F.slice(counted(words), 1, n)).alias("at", "w"))
    return best.select("doc_id", (F.col("at") + 1).alias("rank"), "w.word", F.col("w.n").cast("long").alias("n"))


_EXTRA = {"title": "Untitled Table", "speaker": "Unknown", "time": "N/A"}


def _described(results: DataFrame) -> DataFrame:
    """Results with title, speaker and time, and a default for those that are missing."""
    return results.withColumns({c: F.coalesce(F.col(c) if c in results.columns else F.lit(None).cast("string"), F.lit(x)) for c, x in _EXTRA.items()})


def _of_bucket(values: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)])[F.col("bucket")]


def _heading(label: str) -> Column:
    """'[Kind n] title (label: score)', with the title of a table, the speaker and time of a recording."""
    middle = F.when(F.col("bucket") == "tables", F.concat("title", F.lit(" "))).when(F.col("bucket") == "audio", F.concat("speaker", F.lit(" at "), "time", F.lit(" "))).otherwise(F.lit(""))
    return F.concat(F.lit("["), _of_bucket(NAMES), F.lit(" "), F.col("item_no").cast("string"), F.lit("] "), middle, F.lit(f"({label}: "), fixed3(F.col("score")), F.lit(")"))


def _numbered(results: DataFrame) -> DataFrame:
    return _described(results).withColumn("item_no", F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("rank")))


def prompt_items(results: DataFrame) -> DataFrame:
    """(query_id, bucket, item_no, line) of results (query_id, rank, score, source, content, bucket[, title, speaker, time]), capped by kind."""
    line = F.concat(_heading("Relevance"), F.lit("\nSource: "), F.coalesce("source", F.lit("Unknown")), F.lit("\n"), F.substring(F.col("content"), F.lit(1), _of_bucket({k: s for k, (_, s) in CAPS.items()})))
    return _numbered(results).filter(F.col("item_no") <= _of_bucket({k: n for k, (n, _) in CAPS.items()})).select("query_id", "bucket", "item_no", line.alias("line"))


def _sections(items: DataFrame, heads: dict[str, str], before: Column | None = None) -> DataFrame:
    """(query_id, context): the lines of (query_id, bucket, item_no, line) under the heading of their kind, kinds in a fixed order."""
    order = F.array_position(F.array(*map(F.lit, CAPS)), F.col("bucket"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("item_no", "line"))), lambda x: x.line)
    head = _of_bucket(heads) if before is None else F.concat(_of_bucket(heads), before)
    parts = items.groupBy("query_id", "bucket").agg(F.array_join(lines, "\n").alias("lines"), *([F.max("n_paths").alias("n_paths")] if before is not None else []))
    parts = parts.withColumn("part", F.concat(head, F.lit("\n"), "lines")).withColumn("order", order)
    return parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "part"))), lambda x: x.part), "\n").alias("context"))


def image_paths(results: DataFrame) -> DataFrame:
    """(query_id, image_paths): the files of the images among the results that may be looked at, in order of rank."""
    path = F.col("image_path") if "image_path" in results.columns else F.lit(None).cast("string")
    seen = F.filter(F.array_sort(F.collect_list(F.struct("rank", F.when(F.col("bucket") == "images", path).alias("path")))), lambda x: x.path.isNotNull())
    return results.groupBy("query_id").agg(F.transform(seen, lambda x: x.path).alias("image_paths"))


def prompts(results: DataFrame, queries: DataFrame, kind: str = "text") -> DataFrame:
    """(query_id, prompt, image_paths): what the model is, the capped context by kind, the question and how to answer it."""
    paths = image_paths(results)
    items = prompt_items(results).withColumn("line", F.concat(F.lit("\n"), "line")).join(paths.select("query_id", F.size("image_paths").alias("n_paths")), "query_id")
    count = F.when(F.col("bucket") == "images", F.concat(F.lit("\n"), F.col("n_paths").cast("string"), F.lit(" relevant images are being analyzed."))).otherwise(F.lit(""))
    told = queries.join(_sections(items, HEADS, count), "query_id", "left").join(paths, "query_id", "left")
    about = [F.lit(ABOUT[kind])] if kind in ABOUT else []
    text = F.concat_ws(
        "\n", F.lit("You are an assistant who answers questions about documents, tables, images and recordings."), *about, F.lit("\n" + LINE), "context",
        F.lit("\n\n" + LINE), F.lit("\n=== QUESTION ==="), "query", F.lit("\n\n=== HOW TO ANSWER ==="), *(F.lit(f"- {r}") for r in RULES), F.lit("\n=== DETAILED ANSWER ==="),
    )
    return told.select("query_id", text.alias("prompt"), F.coalesce("image_paths", F.array().cast("array<string>")).alias("image_paths"))


def uncapped_context(results: DataFrame) -> DataFrame:
    """(query_id, context, image_paths): all results whole, under the headings of their kinds."""
    line = F.concat(_heading("Score"), F.lit("\n"), "content", F.lit("\n"))
    return _sections(_numbered(results).withColumn("line", line), UNCAPPED_HEADS).join(image_paths(results), "query_id")


def search_facts(results: DataFrame, first: int = 5) -> DataFrame:
    """(query_id, num_results, text_chunks, tables, images, image_files, audio, top_sources, top_scores): what a search found, for those who look into it."""
    of = lambda b: F.count_if(F.col("bucket") == b)
    path = F.col("image_path") if "image_path" in results.columns else F.lit(None).cast("string")
    head = F.when(F.col("rank") <= first, F.struct("rank", F.format_string("%.4f", F.bround("score", 4)).alias("score")))
    counted_ = results.groupBy("query_id").agg(
        F.count("*").alias("num_results"), of("text").alias("text_chunks"), of("tables").alias("tables"), of("images").alias("images"), F.count_if((F.col("bucket") == "images") & path.isNotNull()).alias("image_files"), of("audio").alias("audio"),
        F.array_sort(F.collect_set(F.when(F.col("rank") <= first, F.coalesce("source", F.lit("Unknown"))))).alias("top_sources"), F.array_sort(F.collect_list(head)).alias("heads"),
    )
    return counted_.withColumn("top_scores", F.transform("heads", lambda x: x.score)).drop("heads")


def summary(chunks: DataFrame) -> DataFrame:
    """(dimension, value, chunks, tokens): counts of (type, modality, source, token_count, has_image_file) along each dimension and in all, in one pass."""
    dims = ["type", "modality", "source"]
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims], F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), F.struct(F.lit("with_image").alias("dimension"), F.col("has_image_file").cast("string").alias("value"))))
    return chunks.select(sets.alias("d"), "token_count").groupBy("d.dimension", "d.value").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
