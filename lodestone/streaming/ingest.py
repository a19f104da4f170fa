"""An extension beyond batch ingestion: documents that arrive as files are chunked and added to the index as a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.documents import semantic_chunks


def stream_chunks(spark: SparkSession, folder: str, index: str, checkpoint: str, most: int = 512, overlap: int = 50) -> StreamingQuery:
    """Follow Parquet files of (doc_id, text) in folder and append their chunks to the table at index; ends when no file is left."""
    docs = spark.readStream.schema("doc_id long, text string").parquet(folder)
    chunks = docs.select("doc_id", F.posexplode(semantic_chunks(F.col("text"), most, overlap)).alias("chunk_index", "c")).select("doc_id", "chunk_index", "c.content", "c.token_count")
    return chunks.writeStream.format("parquet").option("path", index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
