"""Interfaces for models the engine does not have, with deterministic stand-ins that are no substitute for them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    """Vectors of one length for texts or pictures, rows in order; an exception means that none of the inputs could be embedded."""

    size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...

    def embed_images(self, images: list[bytes]) -> np.ndarray: ...


class Reranker(Protocol):
    """How well each content answers its query."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class PdfReader(Protocol):
    """(element type, text) of a PDF in order, and its pictures as (name, bytes); strategy is 'hi_res' or 'fast'."""

    detailed: bool

    def read(self, content: bytes, strategy: str) -> tuple[list[tuple[str, str]], list[tuple[str, bytes]]]: ...


class TextReader(Protocol):
    """What stands in a picture: attempts of (method, [(word, confidence)]) in order; the engine chooses the best."""

    def read(self, image: bytes) -> list[tuple[str, list[tuple[str, float]]]]: ...


class Transcriber(Protocol):
    """Segments of a recording in order: (seconds, features of the voice, language, text). Features are a mean over frames."""

    name: str

    def transcribe(self, audio: bytes) -> list[tuple[float, list[float], str, str]]: ...


class Generator(Protocol):
    """An answer to a prompt, looking at pictures where there are any; temperature 0.1 and at most 1000 tokens are the usual options."""

    def generate(self, prompt: str, images: list[str], options: dict) -> str: ...


class HashingEmbedder:
    """Feature hashing of words, or of a picture's bytes, into a signed unit vector: the same on every machine, and not a trained model."""

    def __init__(self, size: int = 64):
        self.size = size

    def _unit(self, items: list[list[bytes]]) -> np.ndarray:
        out = np.zeros((len(items), self.size))
        for i, parts in enumerate(items):
            for part in parts:
                h = zlib.crc32(part)
                out[i, h % self.size] += 1 if h >> 16 & 1 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def embed(self, texts: list[str]) -> np.ndarray:
        return self._unit([[w.encode() for w in (t or "").lower().split()] for t in texts])

    def embed_images(self, images: list[bytes]) -> np.ndarray:
        return self._unit([[x[i : i + 16] for i in range(0, len(x), 16)] for x in images])


class OverlapReranker:
    """The share of distinct query words that the content holds: not a trained model."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set((t or "").lower().split())
        return [len(words(q) & words(c)) / max(len(words(q)), 1) for q, c in pairs]


def scored_by(model: Reranker):
    """A scorer for search.rerank() that asks a model, batch by batch."""

    @F.pandas_udf("double")
    def score(query: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series(model.score(list(zip(query.fillna(""), content.fillna("")))), dtype=float)

    def scorer(query: Column, content: Column) -> Column:
        return score(query, content)

    return scorer


def _each(embed, items: list, size: int) -> tuple[list, list]:
    """Vectors and errors of items: all at once, and one by one where that fails."""
    try:
        return [np.asarray(v, np.float32) for v in embed(items)], [None] * len(items)
    except Exception:  # noqa: BLE001
        vectors, errors = [], []
        for item in items:
            try:
                vectors.append(np.asarray(embed([item])[0], np.float32))
                errors.append(None)
            except Exception as error:  # noqa: BLE001  an item's error stays with it
                vectors.append(None)
                errors.append(f"{type(error).__name__}: {error}")
        return vectors, errors


def embedded(chunks: DataFrame, embedder: Embedder | None = None, column: str = "content") -> DataFrame:
    """chunks with the embedding of each content, and embedding_error: an error of the embedder gives a null vector and its text, never a random vector."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("embedding array<float>, embedding_error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            vectors, errors = _each(model.embed, texts.fillna("").tolist(), model.size)
            yield pd.DataFrame({"embedding": pd.Series(vectors, dtype=object), "embedding_error": pd.Series(errors, dtype=object)})

    found = chunks.withColumn("embedded", run(F.col(column)))
    return found.withColumns({"embedding": F.col("embedded.embedding"), "embedding_error": F.col("embedded.embedding_error")}).drop("embedded")


def embedded_images(images: DataFrame, embedder: Embedder | None = None, column: str = "content") -> DataFrame:
    """images with the embedding of each picture's bytes, and embedding_error; null where there are no bytes or the embedder fails."""
    model = embedder or HashingEmbedder()

    @F.pandas_udf("embedding array<float>, embedding_error string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in parts:
            known = [i for i, c in enumerate(contents) if c is not None and len(c)]
            vectors, errors = [None] * len(contents), ["no picture"] * len(contents)
            for i, v, e in zip(known, *_each(model.embed_images, [bytes(contents.iloc[i]) for i in known], model.size)):
                vectors[i], errors[i] = v, e
            yield pd.DataFrame({"embedding": pd.Series(vectors, dtype=object), "embedding_error": pd.Series(errors, dtype=object)})

    found = images.withColumn("embedded", run(F.col(column)))
    return found.withColumns({"embedding": F.col("embedded.embedding"), "embedding_error": F.col("embedded.embedding_error")}).drop("embedded")
