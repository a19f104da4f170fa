"""Dense features of whole texts, computed for Arrow batches with array operations."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.common import as_strings, words_of

# Byte classes, second-person words, plain insults and look-alike characters.
BYTE_CLASSES = ["other", "upper", "lower", "digit", "space", "newline", "high", "!", "?", ".,;:", "|", "#%$&*", "@/\\", "-_=+~^", "()[]{}<>", "\"'`"]
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi vous votre du dich dir dein sie ihr usted ustedes vos".split())
INSULTS = frozenset("idiot moron stupid loser pathetic worthless disgusting scum trash clown dumb fool jerk imbecile".split())
LOOKALIKES = str.maketrans("0134578@$!", "oieasTbasi".lower())

TEXT_FEATURES = [
    "log_words", "mean_word", "distinct_share", "top_share", "repeat_share", "line_repeat_share", "log_line_words",
    *(f"bytes_{c}" for c in BYTE_CLASSES[1:]), "marked_words", "sentence_words",
]
TOXIC_FEATURES = ["lexicon_density", "lexicon_log_hits", "lexicon_best", "stem_density", "stem_log_hits", "insult_density", "person_density", "person_near", "obfuscated", "obfuscated_hits"]

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(BYTE_CLASSES[7:], 7):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
for _k, _of in ((1, range(65, 91)), (2, range(97, 123)), (3, range(48, 58)), (4, (32, 9, 11, 12)), (5, (10, 13)), (6, range(128, 256))):
    _CLASS[list(_of)] = _k

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]")
STEM = 5


def canonical(word: str) -> str:
    """The word without marks at its ends; if marks or digits stand inside, look-alikes become letters and the rest goes."""
    if word.isalpha():
        return word
    w = word[:-1] if word[:-1].isalpha() and word[-1] in ".,;:!?" else _EDGES.sub("", word)
    return _INNER.sub("", w.translate(LOOKALIKES)) if _INNER.search(w) else w


def _per_doc(doc: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, values, minlength=n).astype(float)


def _distinct(doc: np.ndarray, ids: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: distinct ids, and how often the commonest occurs."""
    keys, counts = np.unique(doc * width + ids, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, keys // width, counts)
    return _per_doc(keys // width, None, n), top


def text_features(texts: pa.Array) -> np.ndarray:
    """TEXT_FEATURES of each text; an empty or null text has zeros."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    data = texts.cast(pa.binary())
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    start = data.offset
    offsets = np.frombuffer(data.buffers()[1], np.int32)[start : start + n + 1]
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    width = len(BYTE_CLASSES)
    counts = np.bincount(np.repeat(np.arange(n) * width, sizes) + _CLASS[raw], minlength=n * width).reshape(n, width)
    shares = counts[:, 1:] / np.maximum(sizes, 1)[:, None]

    words, lengths = words_of(texts)
    doc = np.repeat(np.arange(n), lengths)
    some = np.maximum(lengths, 1)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    distinct, top = _distinct(doc, ids, max(len(coded.dictionary), 1), n)
    again = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    marked = pc.match_substring_regex(coded.dictionary, r"[^\w\s.,;:'\x{80}-\x{10FFFF}-]").to_numpy(zero_copy_only=False).astype(float)
    stops = pc.match_substring_regex(coded.dictionary, r"[.!?]$").to_numpy(zero_copy_only=False).astype(float)

    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten().dictionary_encode()
    n_lines = np.diff(lines.offsets.to_numpy())
    line_doc = np.repeat(np.arange(n), n_lines)
    line_distinct, _ = _distinct(line_doc, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(flat.dictionary), 1), n)

    columns = [
        np.log1p(lengths), np.maximum(sizes - lengths + 1, 0) / some * (lengths > 0), distinct / some, top / some, _per_doc(doc[1:], again.astype(float), n) / some,
        1 - line_distinct / np.maximum(n_lines, 1), np.log1p(lengths / np.maximum(n_lines, 1)),
    ]
    ends = [_per_doc(doc, marked[ids], n) / some, lengths / (1 + _per_doc(doc, stops[ids], n))]
    return np.column_stack([*columns, shares, *ends])


def toxic_features(texts: pa.Array, lexicon: dict[str, float], stems: dict[str, float], reach: int = 3) -> np.ndarray:
    """TOXIC_FEATURES of each text for weighted words and word beginnings."""
    texts = pc.fill_null(texts, "")
    n = len(texts)
    words, lengths = words_of(texts)
    doc = np.repeat(np.arange(n), lengths)
    some = np.maximum(lengths, 1)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = as_strings(coded.dictionary)
    forms = [canonical(w) for w in names]
    props = np.zeros((5, len(names)))
    props[0] = [lexicon.get(w, 0.0) for w in forms]
    props[1] = [stems.get(w[:STEM], 0.0) for w in forms]
    props[2] = [w in INSULTS for w in forms]
    props[3] = [w in SECOND_PERSON for w in forms]
    props[4] = [f not in w for f, w in zip(forms, names)]  # something inside was replaced or removed
    weight, stem, insult, person, hidden = (props[k, ids] for k in range(5))
    hit = (weight > 0) | (stem > 0) | (insult > 0)
    at = np.nonzero(hit)[0]
    near = np.zeros(len(at), bool)
    for d in [*range(-reach, 0), *range(1, reach + 1)]:
        to = np.clip(at + d, 0, max(len(doc) - 1, 0))
        near |= (at + d >= 0) & (at + d < len(doc)) & (doc[to] == doc[at]) & (person[to] > 0)
    best = np.zeros(n)
    np.maximum.at(best, doc, np.maximum(weight, stem))
    total = lambda x: _per_doc(doc, x.astype(float), n)
    hits, stem_hits = total(weight > 0), total(stem > 0)
    return np.column_stack([
        hits / some, np.log1p(hits), best, stem_hits / some, np.log1p(stem_hits), total(insult) / some, total(person) / some,
        _per_doc(doc[at], near.astype(float), n), total(hidden) / some, total(hidden * hit),
    ])
