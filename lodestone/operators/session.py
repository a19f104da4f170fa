"""Searching and answering over one index: by text, image, recording or several of them, for many queries at once."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import chunks as C
from lodestone.operators import context, search
from lodestone.operators.index import ChunkIndex, load_index
from lodestone.operators.providers import Embedder, Generator, HashingEmbedder, Reranker, Transcriber, embedded, embedded_images, scored_by
from lodestone.sources import ingest
from lodestone.store import cut

log = logging.getLogger(__name__)

# What is answered where nothing was found, and the questions that go with an image or a recording.
NOTHING = {"text": "❌ No relevant information found.", "image": "❌ No similar content found.", "audio": "❌ No related content found.", "multimodal": "❌ No relevant information found."}
ABOUT_IMAGE, ABOUT_AUDIO = "What is related to this image?", "What is related to this audio?"
OPTIONS = {"temperature": 0.1, "num_predict": 1000}
RESULT = "query_id long, rank int, doc_id long, score double"


def user_message(error: str) -> str:
    """What a user is told about an error: that the model's server is down or out of reach, or the error itself."""
    low = error.lower()
    if "not running" in low or "refused" in low:
        return "❌ The model's server is not running. Please start it."
    return "❌ Cannot connect to the model's server." if "connection" in low else error


@dataclass
class Session:
    """An index and the models that go with it. The index is opened when it is first needed."""

    spark: SparkSession
    path: str
    embedder: Embedder = field(default_factory=HashingEmbedder)
    reranker: Reranker | None = None
    generator: Generator | None = None
    transcriber: Transcriber | None = None
    opened: ChunkIndex | None = None

    @property
    def index(self) -> ChunkIndex:
        if self.opened is None:
            self.opened = load_index(self.spark, self.path)
        return self.opened

    # --- searches: all give (query_id, rank, doc_id, score) ---

    def _vectors(self, queries: DataFrame, embed, column: str) -> DataFrame:
        return cut(embed(queries, self.embedder, column).select("query_id", F.col("embedding").alias("query_embedding")), "query-vectors")

    def search_by_text(self, queries: DataFrame, k: int = 10, rerank: bool = True) -> DataFrame:
        """Hybrid search for (query_id, query), reranked if there is a model for it."""
        asked = queries.select("query_id", "query").join(self._vectors(queries, embedded, "query"), "query_id")
        scorer = scored_by(self.reranker) if rerank and self.reranker else None
        return search.hybrid(self.index.texts(self.spark), self.index.vectors(self.spark), asked, k, scorer=scorer, index=self.index.keywords)

    def search_by_image(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The nearest chunks of (query_id, image), vectors only. An image that cannot be embedded finds nothing."""
        return self._or_nothing("image", lambda: search.semantic(self.index.vectors(self.spark), self._vectors(queries, embedded_images, "image"), k))

    def transcripts(self, queries: DataFrame) -> DataFrame:
        """(query_id, query): the contents of the chunks of each recording (query_id, audio), headings included."""
        rows = ingest.read_audio(queries.select(F.col("query_id").cast("string").alias("path"), F.col("audio").alias("content")), self.transcriber).filter("error is null")
        spoken = C.audio_chunks(ingest.segments_of(cut(rows, "query-segments")))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("metadata.chunk_index", "content"))), lambda x: x.content)
        return spoken.groupBy(F.col("metadata.audio_path").cast("long").alias("query_id")).agg(F.array_join(lines, " ").alias("query"))

    def search_by_audio(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """Hybrid search, without reranking, for what is said in (query_id, audio). A recording that cannot be read finds nothing."""
        return self._or_nothing("recording", lambda: self.search_by_text(cut(self.transcripts(queries), "transcripts"), k, rerank=False))

    def search_multimodal(self, text: DataFrame | None = None, image: DataFrame | None = None, audio: DataFrame | None = None, k: int = 10) -> DataFrame:
        """Results by text (vectors only), image and recording fused by rank; documents are told apart by their real numbers."""
        lists = []
        if text is not None:
            lists.append(search.semantic(self.index.vectors(self.spark), self._vectors(text, embedded, "query"), k))
        if image is not None:
            lists.append(self.search_by_image(image, k))
        if audio is not None:
            lists.append(self.search_by_audio(audio, k))
        return search.fuse(lists, k) if lists else self.spark.createDataFrame([], RESULT)

    def _or_nothing(self, what: str, find: Callable[[], DataFrame]) -> DataFrame:
        try:
            return cut(find(), "results")
        except Exception as error:  # noqa: BLE001  a search that fails finds nothing
            log.warning("search by %s failed: %s", what, error)
            return self.spark.createDataFrame([], RESULT)

    # --- from results to answers ---

    def results(self, found: DataFrame) -> DataFrame:
        """What context.prompts() needs of each result: its content and source, where it belongs, and what goes with its kind."""
        m = F.col("original_metadata")
        r = found.join(self.index.records(self.spark).withColumnRenamed("doc_idx", "doc_id"), "doc_id")
        return r.select(
            "query_id", "rank", "score", "doc_id", "content", "source", context.bucket(F.lit(None).cast("string"), m["modality"], F.coalesce("type", m["type"])).alias("bucket"),
            m["table_title"].alias("title"), m["speaker"].alias("speaker"), m["timestamp_formatted"].alias("time"), F.when(m["use_image_directly"], m["image_path"]).alias("image_path"),
        )

    def facts(self, found: DataFrame) -> DataFrame:
        return context.search_facts(self.results(found))

    def answers(self, found: DataFrame, queries: DataFrame, kind: str = "text") -> DataFrame:
        """(query_id, answer) of (query_id, query): a fixed text where nothing was found; an error of the model is an answer too. One image at most is looked at."""
        model = self.generator
        asked = context.prompts(self.results(found), queries, kind)
        some = found.select("query_id").distinct().withColumn("found", F.lit(True))

        @F.pandas_udf("string")
        def answer(prompts: pd.Series, images: pd.Series) -> pd.Series:
            def one(prompt: str, paths: list[str]) -> str:
                try:
                    if model is None:
                        raise RuntimeError("there is no model to answer")
                    return model.generate(prompt, list(paths)[:1], {} if len(paths) else OPTIONS).strip()
                except Exception as error:  # noqa: BLE001  told to the user
                    return f"❌ Error: {error}"

            return pd.Series([one(p, i) for p, i in zip(prompts, images)])

        rows = asked.join(some, "query_id", "left")
        return rows.select("query_id", F.when(F.col("found"), answer("prompt", "image_paths")).otherwise(F.lit(NOTHING[kind])).alias("answer"))

    def chat_text(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self.answers(cut(self.search_by_text(queries, k), "results"), queries.select("query_id", "query"))

    def chat_image(self, queries: DataFrame, question: str = ABOUT_IMAGE, k: int = 10) -> DataFrame:
        asked = queries.select("query_id", F.lit(f"Based on the uploaded image, {question}").alias("query"))
        return self.answers(self.search_by_image(queries, k), asked, "image")

    def chat_audio(self, queries: DataFrame, question: str = ABOUT_AUDIO, k: int = 10) -> DataFrame:
        asked = queries.select("query_id", F.lit(f"Based on the uploaded audio, {question}").alias("query"))
        return self.answers(self.search_by_audio(queries, k), asked, "audio")

    def chat_multimodal(self, text: DataFrame | None = None, image: DataFrame | None = None, audio: DataFrame | None = None, k: int = 10) -> DataFrame:
        """Answers to queries made of text (query_id, query), image (query_id, name, image) and recording (query_id, name, audio)."""
        found = cut(self.search_multimodal(text, image, audio, k), "results")
        parts = []
        for i, (given, said) in enumerate(((text, F.col("query") if text is not None else None), (image, F.concat(F.lit("[Uploaded image: "), "name", F.lit("]"))), (audio, F.concat(F.lit("[Uploaded audio: "), "name", F.lit("]"))))):
            if given is not None:
                parts.append(given.select("query_id", F.lit(i).alias("i"), said.alias("said")))
        if not parts:
            return self.spark.createDataFrame([], "query_id long, answer string")
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        asked = every.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "said"))), lambda x: x.said), " + ").alias("query"))
        return self.answers(found, asked, "multimodal")


def answer_with_images(session: Session, queries: DataFrame, found: DataFrame) -> DataFrame:
    """Answers from results found elsewhere."""
    return session.answers(found, queries, "text")
