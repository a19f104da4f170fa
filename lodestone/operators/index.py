"""The index of a chunk table: records with vectors, and the keyword index beside them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.providers import Embedder, embedded, embedded_images
from lodestone.operators.search import KeywordIndex, build_keyword_index
from lodestone.schema import index_records


@dataclass
class ChunkIndex:
    """Records (doc_idx, modality, embedding, ... of schema.index_records) and keyword postings below one path."""

    path: str

    def records(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/records")

    def vectors(self, spark: SparkSession) -> DataFrame:
        """(doc_id, embedding) of the chunks that have a vector."""
        return self.records(spark).select(F.col("doc_idx").alias("doc_id"), "embedding").filter("embedding is not null")

    def texts(self, spark: SparkSession) -> DataFrame:
        return self.records(spark).select(F.col("doc_idx").alias("doc_id"), F.col("content").alias("text"))

    @property
    def keywords(self) -> KeywordIndex:
        return KeywordIndex(f"{self.path}/keywords")


def embed_chunks(chunks: DataFrame, embedder: Embedder | None = None, images: DataFrame | None = None) -> DataFrame:
    """chunks (doc_idx, ..., content, metadata) with embedding and embedding_error: an image's vector is that of its file in images (path, content), if that can be embedded; all others, and images
    without such a file, have that of their content. A vector that a chunk brings along is not used."""
    chunks = chunks.drop("embedding", "embedding_error")
    with_text = embedded(chunks, embedder)
    if images is None:
        return with_text
    looked_at = F.col("metadata.type") == "image"
    wanted = chunks.filter(looked_at & F.col("metadata.image_path").isNotNull()).select(F.col("metadata.image_path").alias("path")).distinct()
    seen = embedded_images(images.select("path", "content").join(wanted, "path"), embedder)
    seen = seen.select(F.col("path").alias("seen_path"), F.col("embedding").alias("seen")).filter("seen is not null").dropDuplicates(["seen_path"])
    both = with_text.join(seen, looked_at & (F.col("metadata.image_path") == F.col("seen_path")), "left")
    use = F.col("seen").isNotNull()
    return both.withColumns({"embedding": F.when(use, F.col("seen")).otherwise(F.col("embedding")), "embedding_error": F.when(~use, F.col("embedding_error"))}).drop("seen", "seen_path")


def build_index(chunks: DataFrame, path: str, embedder: Embedder | None = None, images: DataFrame | None = None) -> ChunkIndex:
    """Embed chunks and write their records by modality and their keyword index below path; a new index replaces the old one.

    ValueError if no chunk at all has a vector.
    """
    spark = chunks.sparkSession
    records = index_records(embed_chunks(chunks, embedder, images))
    records = records.withColumn("modality", F.coalesce("original_metadata.modality", F.lit("text")))
    records.write.mode("overwrite").partitionBy("modality").parquet(f"{path}/records")
    index = ChunkIndex(path)
    if index.vectors(spark).isEmpty():
        raise ValueError("no chunk could be embedded: nothing was read from the files, or every embedding failed")
    build_keyword_index(index.texts(spark), f"{path}/keywords")
    return index


def load_index(spark: SparkSession, path: str) -> ChunkIndex:
    """The index below path; FileNotFoundError if one of its parts is missing."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for part in ("records", "keywords/postings", "keywords/terms", "keywords/size"):
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")):
            raise FileNotFoundError(f"no {part} in the index at {path}")
    return ChunkIndex(path)


def index_statistics(index: ChunkIndex, spark: SparkSession) -> DataFrame:
    """One row (total, by_type, by_modality, images, sources) of an index; the modality is that of the metadata."""
    records = index.records(spark)
    both = F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("value")) for c in ("type", "modality")))
    counts = records.select(F.explode(both).alias("d")).groupBy("d.of", "d.value").agg(F.count("*").alias("n"))
    maps = counts.groupBy("of").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("m"))
    by = {r.of: r.m for r in maps.collect()}  # two rows
    total = records.agg(F.count("*").alias("total"), F.count_if(F.col("original_metadata.has_image_file")).alias("images"), F.countDistinct("source").alias("sources"))
    as_map = lambda m: F.create_map(*[F.lit(x) for kv in sorted((m or {}).items()) for x in kv]) if m else F.create_map().cast("map<string,bigint>")
    return total.select("total", as_map(by.get("type")).alias("by_type"), as_map(by.get("modality")).alias("by_modality"), "images", "sources")
