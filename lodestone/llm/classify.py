"""Toxicity and quality classifiers over dense text features.

Both learn from a bounded sample of the labelled rows outside the held-out fold, chosen by a hash of id, text and label, and then score every
whole text where it lies: the model travels with the task and no row is shuffled. Labels, language, source and id are
never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.boosting import Isotonic, PairwiseGam, Trees, sigmoid
from lodestone.llm.common import as_strings, cut, fold, fresh, slices, text_of, words_of
from lodestone.llm.features import STEM, TOXIC_FEATURES, canonical, text_features, toxic_features

#: Most labelled rows that a model is fitted on.
MAX_TRAIN = 20_000


#: Parts of the training rows for what must not have seen a row's own label: lexicons and calibration.
PARTS = 3
_BINS = 1 << 16


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, y, part) of at most limit labelled rows whose id is not in fold 0: those lowest by a hash of id, text and label.

    Rows without an id or a label teach nothing. Rows of equal id, text and label teach once; an id with several labels or texts gives a row for each
    pair of them. The sample is cut at a bin of the hash, so no task sorts all labelled rows.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).filter("doc_id is not null and y is not null").filter(fold() != 0).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(fold() != 0).withColumn("h", F.xxhash64("text"))
    known = rows.select("doc_id", "h").join(marks, "doc_id").distinct()
    known = cut(known.withColumn("bin", F.pmod(F.xxhash64("doc_id", "h", "y"), F.lit(_BINS)).cast("int")), "labelled-rows")
    sizes = np.zeros(_BINS, np.int64)
    for r in known.groupBy("bin").agg(F.count("*").alias("n")).collect():  # at most _BINS rows
        sizes[r.bin] = r.n
    below = int(np.searchsorted(sizes.cumsum(), limit, side="right"))
    chosen = cut(known.filter(F.col("bin") < below).select("doc_id", "h", "y"), "chosen-labels")  # at most limit rows
    found = rows.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id", "h", "y").agg(F.first("text").alias("text"))
    return found.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part"))


def _matrix(rows: DataFrame, features: Callable[[pa.Array, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and parts of the (bounded) training rows, in an order that does not depend on partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = features(part.column("text"), part.column("part").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "y", "part")), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "part", "x"])

    got = rows.mapInArrow(run, "doc_id long, y double, part int, x array<double>").toArrow()
    if not got.num_rows:
        return np.zeros((0, 0)), np.zeros(0), np.zeros(0, np.int64)
    x = np.array(got["x"].combine_chunks().flatten()).reshape(got.num_rows, -1)
    order = np.lexsort((*x.T, got["y"].to_numpy(), got["doc_id"].to_numpy()))
    return x[order], got["y"].to_numpy()[order], got["part"].to_numpy()[order]


def with_score(docs: DataFrame, probability: Callable[[pa.Array], np.ndarray], name: str, text: str = "text") -> DataFrame:
    """docs with the model's probability as one more column; only the texts go to Python, nulls as empty texts."""

    @F.arrow_udf("double")
    def probabilities(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], ["text"])
        return pa.array(np.concatenate([np.zeros(0), *(probability(part.column("text")) for part in slices(batch, "text"))]))

    return docs.withColumn(name, probabilities(text_of(text)))


def score(docs: DataFrame, probability: Callable[[pa.Array], np.ndarray], threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null texts count as empty, and a null id is in no fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 0).alias("held_out"), F.col("text"))
    return with_score(rows, probability, "score").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, probability: Callable[[pa.Array], np.ndarray], least: float | None = None, below: float | None = None) -> DataFrame:
    """The rows of docs, all columns as they are, whose probability is at least `least` and under `below`.

    A null text is scored as an empty one; ids play no part, so null and repeated ids stay or go with their text. An empty table gives no rows.
    """
    name = fresh(docs.columns, "probability")
    scored = with_score(docs, probability, name)
    for bound, passes in ((least, F.col(name) >= least), (below, F.col(name) < below)):
        scored = scored if bound is None else scored.filter(passes)
    return scored.drop(name)


# --- toxicity -----------------------------------------------------------------------------------------------------------------


@dataclass
class Toxicity:
    """Boosted trees over lexicon, address, capital, punctuation and disguise rates, then isotonic calibration."""

    lexicon: dict[str, float]
    stems: dict[str, float]
    trees: Trees | None
    calibration: Isotonic | None
    prior: float

    def features(self, texts: pa.Array) -> np.ndarray:
        return np.hstack([toxic_features(texts, self.lexicon, self.stems), text_features(texts)])

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.clip(self.calibration(sigmoid(self.trees(self.features(texts)))), 0, 1)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct canonical word and word beginning of each document, by part: documents that have it and their labels, summed up within the batch."""
    for batch in batches:
        for part in slices(batch, "text"):
            words, lengths = words_of(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows), lengths)
            coded = words.dictionary_encode()
            forms = [canonical(w) for w in as_strings(coded.dictionary)]
            y, of_part = (part.column(c).to_numpy(zero_copy_only=False) for c in ("y", "part"))
            for stem, of in ((False, forms), (True, [w[:STEM] if len(w) > STEM else "" for w in forms])):
                terms = pa.array(of).dictionary_encode()
                ids = terms.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
                seen = np.unique(ids * part.num_rows + doc)
                term, d = seen // part.num_rows, seen % part.num_rows
                k = len(terms.dictionary)
                cell = term * PARTS + of_part[d]
                n, hits = (np.bincount(cell, w, k * PARTS).reshape(k, PARTS).T for w in (None, y[d]))
                columns = [terms.dictionary, pa.array(np.full(k, stem)), *(pa.array(c.astype(np.float64)) for c in (*n, *hits))]
                yield pa.RecordBatch.from_arrays(columns, ["term", "stem", *_COUNTS])


_COUNTS = [f"{c}{k}" for c in "nh" for k in range(PARTS)]
#: The parts left out of a lexicon: none, one, or two.
_WITHOUT = [(), *((k,) for k in range(PARTS)), *combinations(range(PARTS), 2)]
Lexicon = tuple[dict[str, float], dict[str, float]]


def learn_lexicons(rows: DataFrame, least: int = 5, share: float = 0.6, most: int = 5000) -> dict[tuple[int, ...], Lexicon]:
    """Words and word beginnings typical of label 1, weighted by log odds, learned without the parts that name the lexicon.

    A term stands in at least `least` documents, `share` of which have label 1. A lexicon has at most `most` terms, the most telling: that
    is a size of the model, like the number of its trees.
    """
    terms = rows.mapInArrow(_term_rows, "term string, stem boolean, " + ", ".join(f"{c} double" for c in _COUNTS)).filter("term <> ''")
    counts = terms.groupBy("term", "stem").agg(*(F.sum(c).alias(c) for c in _COUNTS))
    weights = []
    for out in _WITHOUT:
        n, hits = (sum((F.col(f"{c}{k}") for k in range(PARTS) if k not in out), F.lit(0.0)) for c in "nh")
        weights.append(F.when((n >= least) & (hits >= share * n), F.log((hits + 0.5) / (n - hits + 0.5))))
    telling = cut(counts.select("term", "stem", *(w.alias(f"w{i}") for i, w in enumerate(weights))).filter(F.coalesce(*(f"w{i}" for i in range(len(weights)))).isNotNull()), "lexicon-terms")
    lexicons = {}
    for i, out in enumerate(_WITHOUT):
        top = telling.filter(f"w{i} is not null").orderBy(F.desc(f"w{i}"), "term", "stem").limit(most).select("term", "stem", f"w{i}").collect()
        lexicons[out] = tuple({r[0]: float(r[2]) for r in top if r[1] == kind} for kind in (False, True))
    return lexicons


def _crossed(lexicons: dict[tuple[int, ...], Lexicon]) -> Callable[[pa.Array, np.ndarray], np.ndarray]:
    """Lexicon features of rows, PARTS sets of them side by side: the i-th without the row's own part and part i."""

    def features(texts: pa.Array, part: np.ndarray) -> np.ndarray:
        sets = []
        for i in range(PARTS):
            x = np.zeros((len(texts), len(TOXIC_FEATURES)))
            for k in np.unique(part):
                mine = part == k
                x[mine] = toxic_features(texts.filter(pa.array(mine)), *lexicons[tuple(sorted({int(k), i}))])
            sets.append(x)
        return np.hstack([*sets, text_features(texts)])

    return features


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Toxicity:
    """Fit on labels.toxic. Without any labelled row of both kinds every text gets the share of label 1 (0.5 if unknown).

    No row's label reaches its own features while trees are fitted, nor the score that calibrates: the lexicon behind a row's features leaves out
    its part, and the trees that score part i for the calibration, with the lexicons they use, leave out part i.
    """
    rows = cut(training_rows(docs, labels, "toxic", limit), "toxicity-training")
    lexicons = learn_lexicons(rows)
    model = Toxicity(*lexicons[()], None, None, 0.5)
    x, y, part = _matrix(rows, _crossed(lexicons))
    if len(y):
        model.prior = float(y.mean())
    if 0 < y.sum() < len(y):
        wide = len(TOXIC_FEATURES)
        rest = x[:, PARTS * wide :]
        own = np.zeros((len(y), wide))
        out = np.zeros(len(y))
        for i in range(PARTS):
            without = np.hstack([x[:, i * wide : (i + 1) * wide], rest])
            own[part == i] = without[part == i, :wide]
            out[part == i] = sigmoid(Trees.fit(without[part != i], y[part != i])(without[part == i])) if (part != i).any() else model.prior
        model.calibration, model.trees = Isotonic.fit(out, y), Trees.fit(np.hstack([own, rest]), y)
    return model


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, limit: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; an empty table gives no rows, repeated rows equal results.

    Nulls: a null text counts as empty and a null id belongs to no fold (held_out null). Other columns play no part. Whole texts are scored, very long
    ones in a slice of their own; equal texts get equal scores, and a score equal to the threshold counts as label 1.
    """
    return score(docs, fit_toxicity(docs, labels, limit), threshold)


# --- quality ------------------------------------------------------------------------------------------------------------------


@dataclass
class Quality:
    """An additive model with pairwise interactions over text features."""

    gam: PairwiseGam | None
    prior: float

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.gam is None:
            return np.full(len(texts), self.prior)
        return sigmoid(self.gam(text_features(texts)))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Quality:
    """Fit on labels.quality; without rows of both kinds every text gets the share of label 1 (0.5 if unknown)."""
    x, y, _ = _matrix(training_rows(docs, labels, "quality", limit), lambda texts, part: text_features(texts))
    prior = float(y.mean()) if len(y) else 0.5
    return Quality(PairwiseGam.fit(x, y) if 0 < y.sum() < len(y) else None, prior)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, limit: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; nulls, repeats, long texts, ties and empty tables as for toxicity()."""
    return score(docs, fit_quality(docs, labels, limit), threshold)
