"""Rules for images and audio: screenshots, image types, best readings, segments, silence and speakers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import time_of_day, timestamp
from lodestone.store import cut

# Signs of a screenshot.
KEYWORDS = [
    "screenshot", "screen shot", "window", "browser", "chrome", "safari", "firefox", "app", "application", "menu", "file", "edit", "view",
    "settings", "gmail", "slack", "zoom", "teams", "outlook", "search", "inbox",
]
APPLICATIONS = ["chrome", "safari", "firefox", "gmail", "slack", "zoom", "teams", "outlook", "excel", "word"]
INTERFACE = ["@", "http", "www", ".com", "search", "menu", "settings"]
RATIOS = [16 / 9, 16 / 10, 4 / 3, 3 / 2, 21 / 9]
CLOCK = r"\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|am|pm)?\b"


def _hits(low: Column, signs: list[str]) -> Column:
    return sum((low.contains(s).cast("int") for s in signs), F.lit(0))


def screenshots(images: DataFrame) -> DataFrame:
    """images (width, height, ocr_text, word_count) with is_screenshot, confidence and the indicators behind them."""
    low = F.lower(F.coalesce("ocr_text", F.lit("")))
    area = F.col("width").cast("double") * F.col("height")
    ratio = F.when(F.col("height") > 0, F.col("width") / F.col("height").cast("double")).otherwise(F.lit(0.0))
    apps = F.filter(F.array(*[F.when(low.contains(a), F.lit(a.title())) for a in APPLICATIONS]), lambda a: a.isNotNull())
    shown = images.withColumns({
        "keyword_count": _hits(low, KEYWORDS),
        "text_density": F.when(area > 0, F.col("word_count") / (area / F.lit(10000.0))).otherwise(F.lit(0.0)),
        "is_common_ratio": sum(((F.abs(ratio - F.lit(r)) < 0.1).cast("int") for r in RATIOS), F.lit(0)) > 0,
        "timestamps": F.regexp_extract_all(F.coalesce("ocr_text", F.lit("")), F.lit(CLOCK), F.lit(0)),
        "applications": apps,
        "ui_patterns": _hits(low, INTERFACE),
    })
    kw, dense, ratio_ok, clock, app, ui = F.col("keyword_count"), F.col("text_density") > 0.5, F.col("is_common_ratio"), F.size("timestamps") > 0, F.size("applications") > 0, F.col("ui_patterns")
    one = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    confidence = F.least(kw * F.lit(0.15), F.lit(0.4)) + one(ratio_ok, 0.2) + one(dense, 0.15) + one(clock, 0.1) + one(app, 0.1) + one(ui >= 2, 0.05)
    return shown.withColumns({"is_screenshot": (kw >= 2) | (dense & ratio_ok) | clock | app | (ui >= 3), "confidence": F.least(confidence, F.lit(1.0))})


def image_types(images: DataFrame) -> DataFrame:
    """The result of screenshots() with primary_type, sub_type and content_description."""
    # The signs of each type and the words of the descriptions.
    low, n, shot = F.lower(F.coalesce("ocr_text", F.lit(""))), F.col("word_count"), F.col("is_screenshot")
    has = lambda *signs: _hits(low, list(signs)) > 0
    kind = F.when(shot, "screenshot").when(n > 50, "document").when((n > 10) & has("chart", "graph", "figure", "diagram"), "diagram").when(n > 10, "mixed").otherwise("photo")
    shot_kind = F.when(has("email", "inbox", "@"), "email").when(has("chat", "message"), "chat").when(has("chrome", "browser", "http"), "browser").otherwise("application")
    sub = F.when(kind == "screenshot", shot_kind).when(kind == "document", F.when(n > 200, "scan").otherwise("snippet")).when(kind == "diagram", "labeled").when(kind == "mixed", "text_visual").otherwise("visual_only")
    typed = images.withColumns({"primary_type": kind, "sub_type": sub})
    p, s = F.col("primary_type"), F.col("sub_type")
    app = F.try_element_at("applications", F.lit(1))
    said = (
        F.when(p == "screenshot", F.concat(F.initcap(s), F.lit(" screenshot"), F.coalesce(F.concat(F.lit(" from "), app), F.lit(""))))
        .when(p == "document", F.concat(F.lit("Document "), s, F.lit(" with "), n.cast("string"), F.lit(" words")))
        .when(p == "diagram", "Diagram or chart with labels")
        .when(p == "photo", "Photo or visual image")
        .otherwise(F.concat(F.initcap(p), F.lit(" content")))
    )
    return typed.withColumn("content_description", said)


def best_reading(attempts: DataFrame) -> DataFrame:
    """Of (image_id, attempt_no, confidence, text, ...) the attempt of highest confidence, the earliest of equals; readings without confidence lose."""
    order = Window.partitionBy("image_id").orderBy(F.desc("confidence"), "attempt_no")
    return attempts.filter("confidence > 0").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def readings(images: DataFrame, attempts: DataFrame) -> DataFrame:
    """(image_id, ocr_text, ocr_confidence, word_count, has_text, ocr_method) of every image: its best reading, or an empty one where every attempt failed.

    attempts holds (image_id, attempt_no, confidence, text, word_count, method). A text counts as found with over ten characters and a mean confidence over 50.
    """
    best = best_reading(attempts).select("image_id", "text", "confidence", F.col("word_count").alias("n_words"), "method")
    all_ = images.select("image_id").distinct().join(best, "image_id", "left")
    text, confidence = F.coalesce("text", F.lit("")), F.coalesce("confidence", F.lit(0.0))
    return all_.select("image_id", text.alias("ocr_text"), confidence.alias("ocr_confidence"), F.coalesce("n_words", F.lit(0)).alias("word_count"), ((F.length(F.trim(text)) > 10) & (confidence > 50)).alias("has_text"), F.coalesce("method", F.lit("none")).alias("ocr_method"))


def image_statistics(chunks: DataFrame) -> DataFrame:
    """One row (total, screenshots, with_text, avg_confidence, types) of image chunks; the mean is 0 without any, types counts primary/sub."""
    m = F.col("metadata")
    kinds = chunks.groupBy(F.concat(m["primary_type"], F.lit("/"), m["sub_type"]).alias("kind")).agg(F.count("*").alias("n"), F.count_if(m["is_screenshot"]).alias("shots"), F.count_if(m["has_ocr_text"]).alias("texts"), F.sum(m["ocr_confidence"]).alias("c"), F.count(m["ocr_confidence"]).alias("k"))
    return kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("shots"), F.lit(0)).alias("screenshots"), F.coalesce(F.sum("texts"), F.lit(0)).alias("with_text"),
        F.coalesce(F.try_divide(F.sum("c"), F.sum("k")), F.lit(0.0)).alias("avg_confidence"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("types"),
    )


def audio_statistics(chunks: DataFrame) -> DataFrame:
    """One row (total, total_duration, total_duration_formatted, unique_speakers, speakers, languages, topics) of audio chunks."""
    m = F.col("metadata")
    some = chunks.agg(
        F.count("*").alias("total"), F.coalesce(F.sum(m["duration"]), F.lit(0.0)).alias("total_duration"), F.array_sort(F.collect_set(m["speaker"])).alias("speakers"),
        F.array_sort(F.collect_set(m["language"])).alias("languages"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(m["topics"], F.array().cast("array<string>")))))).alias("topics"),
    )
    return some.select("total", "total_duration", time_of_day(F.col("total_duration")).alias("total_duration_formatted"), F.size("speakers").alias("unique_speakers"), "speakers", "languages", "topics")


def mean_features(frames: DataFrame) -> DataFrame:
    """(source, seq, features) of (source, seq, frame, coefficients): the mean over the frames of each coefficient."""
    each = frames.select("source", "seq", F.posexplode("coefficients").alias("at", "value")).groupBy("source", "seq", "at").agg(F.avg("value").alias("mean"))
    return each.groupBy("source", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x.mean).alias("features"))


def mean_confidence(words: DataFrame) -> DataFrame:
    """(image_id, attempt_no, confidence): mean of the word confidences above 0, 0 where there is none."""
    return words.groupBy("image_id", "attempt_no").agg(F.coalesce(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("confidence"))


def segment_times(segments: DataFrame) -> DataFrame:
    """segments (source, seq, duration) with start and end: durations of kept segments add up."""
    end = F.sum("duration").over(Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    timed = segments.withColumn("end_time", F.round(end, 3)).withColumn("start_time", F.round(F.col("end_time") - F.col("duration"), 3))
    return timed.withColumn("timestamp_formatted", F.concat(timestamp(F.col("start_time")), F.lit(" - "), timestamp(F.col("end_time"))))


def sessions(events: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """(key, session_no, started, ended, n): runs of events without a gap of more than gap_seconds."""
    w = Window.partitionBy(key).orderBy(time)
    at = F.col(time).cast("timestamp").cast("double")
    new = F.when(at - F.lag(at).over(w) > gap_seconds, 1).otherwise(0)
    numbered = events.withColumn("new", new).withColumn("session_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("n"))


def audio_content(chunk_index: Column, title: Column, filename: Column, start: Column, end: Column, duration: Column, speaker: Column, text: Column) -> Column:
    """The text of an audio chunk: heading, time range, speaker and transcript."""
    number = (chunk_index + 1).cast("string")
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit(" - Segment "), number)).otherwise(F.concat(F.lit("# Audio: "), filename, F.lit(" - Segment "), number))
    return F.concat_ws(
        "\n", F.concat(head, F.lit("\n")), F.concat(F.lit("**Timestamp:** ["), timestamp(start), F.lit(" → "), timestamp(end), F.lit("] ("), F.format_string("%.1f", duration), F.lit("s)")),
        F.concat(F.lit("**Speaker:** "), speaker, F.lit("\n")), F.lit("**Transcription:**"), text,
    )


# --- speakers -----------------------------------------------------------------------------------------------------------------


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette; a row alone in its cluster counts 0."""
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)[None], 0))
    names, at = np.unique(labels, return_inverse=True)
    member = np.eye(len(names))[at]
    size = member.sum(0)
    mean = d @ member / size
    own = (d @ member)[np.arange(len(x)), at] / np.maximum(size[at] - 1, 1)
    mean[np.arange(len(x)), at] = np.inf
    other = mean.min(1)
    s = np.where(size[at] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-300), 0.0)
    return float(s.mean()) if len(names) > 1 else 0.0


def _cluster(x: np.ndarray, k: int, starts: int = 10) -> tuple[np.ndarray, float]:
    best, least = np.zeros(len(x), int), np.inf
    for seed in range(starts):
        rng = np.random.default_rng(seed)
        centres = x[rng.permutation(len(x))[:k]]
        for _ in range(50):
            d = ((x[:, None] - centres[None]) ** 2).sum(2)
            at = d.argmin(1)
            new = np.array([x[at == j].mean(0) if (at == j).any() else centres[j] for j in range(k)])
            if np.allclose(new, centres):
                break
            centres = new
        if d.min(1).sum() < least - 1e-12:
            best, least = at, d.min(1).sum()
    return best, float(least)


def speakers_of(x: np.ndarray, known: int | None = None, most: int = 5) -> np.ndarray:
    """Cluster numbers of feature rows: k of the best silhouette from 2 to most; below 0.2 the bend of the inertia curve; one cluster for fewer than two rows."""
    if len(x) < 2:
        return np.zeros(len(x), int)
    if known:
        return _cluster(x, min(known, len(x)))[0]
    tried = {k: _cluster(x, k) for k in range(2, min(most, len(x) - 1) + 1)}
    if not tried:
        return np.zeros(len(x), int)
    scores = {k: silhouette(x, at) for k, (at, _) in tried.items()}
    k = max(scores, key=lambda k: (scores[k], -k))
    if scores[k] < 0.2 and len(tried) > 2:
        ks = sorted(tried)
        y = np.array([tried[j][1] for j in ks])
        line = y[0] + (y[-1] - y[0]) * (np.array(ks) - ks[0]) / (ks[-1] - ks[0])
        k = ks[int((line - y).argmax())]  # farthest below the chord
    return tried[k][0]


def diarized(segments: DataFrame, known: int | None = None) -> DataFrame:
    """(source, seq, speaker) of (source, seq, features): the segments of one recording are clustered in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        at = speakers_of(np.array(rows.features.to_list(), float), known)
        return pd.DataFrame({"source": rows.source, "seq": rows.seq, "speaker": [f"Speaker {i + 1}" for i in at]})

    return segments.select("source", "seq", "features").groupBy("source").applyInPandas(run, "source string, seq int, speaker string")


def silhouettes(rows: DataFrame, block: int = 1024) -> DataFrame:
    """(source, silhouette) of (source, label, features): mean Euclidean silhouettes; a row alone in its cluster, or in the only one, counts 0.

    Rows are dealt out in blocks, and each pair of blocks meets in a task of its own that gives only sums by row and label.
    """
    numbered = rows.select(F.col("source").cast("string").alias("source"), "label", F.col("features").cast("array<double>").alias("features"), F.xxhash64("label", "features", F.monotonically_increasing_id()).alias("row"))
    numbered = cut(numbered, "silhouette-rows")
    blocks = numbered.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))  # a row for each source
    dealt = numbered.join(blocks, "source").withColumn("mine", F.pmod("row", F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left, right = dealt.withColumn("other", every), dealt.withColumnRenamed("mine", "other").withColumn("mine", every)

    def sums(a: pa.Table, b: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if a.num_rows and b.num_rows:
            x, y = (np.array(t.to_pylist(), float) for t in (a["features"], b["features_"]))
            names, at = np.unique(b["label_"].to_numpy(), return_inverse=True)
            for i, (row, label) in enumerate(zip(a["row"].to_pylist(), a["label"].to_pylist())):
                d = np.sqrt(((y - x[i]) ** 2).sum(1))
                total, n = np.bincount(at, d, len(names)), np.bincount(at, minlength=len(names))
                out[0] += [row] * len(names)
                out[1] += [label] * len(names)
                out[2] += names.tolist()
                out[3] += total.tolist()
                out[4] += n.tolist()
        return pa.table({"source": pa.array([a["source"][0].as_py()] * len(out[0]) if a.num_rows else [], pa.string()), "row": pa.array(out[0], pa.int64()), "own": pa.array(out[1], pa.int64()), "label": pa.array(out[2], pa.int64()), "total": pa.array(out[3], pa.float64()), "n": pa.array(out[4], pa.int64())})

    left = left.select("source", F.col("label").cast("long").alias("label"), "features", "row", "mine", "other")
    right = right.select(*(F.col(c).cast("long" if c == "label" else t).alias(f"{c}_") for c, t in right.dtypes))
    keys = ("source", "mine", "other")
    found = left.groupBy(*keys).cogroup(right.groupBy(*(f"{k}_" for k in keys))).applyInArrow(sums, "source string, row long, own long, label long, total double, n long")
    means = found.groupBy("source", "row", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    mine = F.col("own") == F.col("label")
    each = means.groupBy("source", "row").agg(F.max(F.when(mine & (F.col("n") > 1), F.col("total") / (F.col("n") - 1))).alias("a"), F.min(F.when(~mine, F.col("total") / F.col("n"))).alias("b"))
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return each.groupBy("source").agg(F.round(F.avg(s), 6).alias("silhouette"))
