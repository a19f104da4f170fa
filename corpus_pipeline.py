"""From raw documents to packed training sequences: five stages, each written and read again before the next.

Every stage takes rows with nulls in any column, null and repeated ids, empty and very long texts, and empty tables: a null text counts as an empty one, whole texts
are worked on, an empty table gives no rows, and all stages but the last return the columns of their input, whatever else is in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import classify, mixing, packing, simhash
from lodestone.llm.common import cut, table
from lodestone.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier accepts (0.3 or more); it learns from the labelled ones among docs.

    Equal texts stay or go together, whatever their ids; without labels of both kinds among docs there is nothing to tell them by and all stay.
    """
    model = classify.fit_quality(docs, table(spark, sf_dir, "labels"))
    return classify.keep(docs, model, least=0.3) if model.gam else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity classifier does not call toxic (under 0.5); equal texts stay or go together.

    Without labels of both kinds among docs there is nothing to tell them by and all stay.
    """
    model = classify.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return classify.keep(docs, model, below=0.5) if model.trees else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word Jaccard 0.8 or more); texts that differ more stay, whatever their ids.

    The one that stays has the group's smallest id, nulls last; documents without words are one group.
    """
    return simhash.keep_first(docs, similarity=0.8, width=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that sources, languages and topics have their target shares of the tokens; at least half of the tokens stay.

    Null sources and languages are values of their own; rows of one id are drawn together, rows without an id by their text.
    """
    return mixing.mix(docs, extras=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' ids into sequences of 4096; the ids themselves are part of the result.

    An empty text is a piece of its end id alone, a long one many pieces; repeated rows are packed one by one, null ids stay null.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), window=4096, end=2, keep_ids=True, room=150_000)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL cannot express the classifiers; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read as the next stage's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
