"""Features, trees, the additive model and the training sample against slow versions."""

import math
import re
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small import SCHEMA, corpus

from lodestone.llm import boosting, classify, features, mixing

TEXTS = [r[1] for r in corpus(30)] + ["You IDIOT!! m0ron, stup!d. You there", "line\nline\nline\n", "Ends here. And here! | x|y", "ÄÖ ß é's 'quoted' (a) [b] 12,5% http://x.y/z"]


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text)) if w]


def slow_text_features(text):
    raw, words, lines = (text or "").encode(), split(text or ""), (text or "").split("\n")
    n = max(len(words), 1)
    kind = {}
    for k, chars in enumerate(features.BYTE_CLASSES[7:], 7):
        kind |= {ord(c): k for c in chars}
    for b in range(256):
        ch = chr(b)
        k = 1 if "A" <= ch <= "Z" else 2 if "a" <= ch <= "z" else 3 if "0" <= ch <= "9" else 4 if b in (32, 9, 11, 12) else 5 if b in (10, 13) else 6 if b >= 128 else None
        if k:
            kind[b] = k
    shares = [sum(kind.get(b, 0) == k for b in raw) / max(len(raw), 1) for k in range(1, len(features.BYTE_CLASSES))]
    marked = sum(bool(re.search(r"[^\w\s.,;:'\x80-\U0010FFFF-]", w, re.ASCII)) for w in words)
    stops = sum(w[-1] in ".!?" for w in words)
    return [
        math.log1p(len(words)), max(len(raw) - len(words) + 1, 0) / n if words else 0.0, len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines), math.log1p(len(words) / len(lines)), *shares, marked / n, len(words) / (1 + stops),
    ]


def test_text_features():
    got = features.text_features(pa.array(TEXTS))
    assert got.shape == (len(TEXTS), len(features.TEXT_FEATURES)) and np.allclose(got, [slow_text_features(t) for t in TEXTS])


def slow_toxic_features(text, lexicon, stems, reach=3):
    words = split(text or "")
    n = max(len(words), 1)
    rows = []
    for w in words:
        form = features.canonical(w)
        rows.append((lexicon.get(form, 0.0), stems.get(form[: features.STEM], 0.0), form in features.INSULTS, form in features.SECOND_PERSON, form not in w))
    hit = [bool(r[0] or r[1] or r[2]) for r in rows]
    near = sum(h and any(rows[j][3] for j in range(max(i - reach, 0), min(i + reach + 1, len(rows))) if j != i) for i, h in enumerate(hit))
    hits, stem_hits = sum(r[0] > 0 for r in rows), sum(r[1] > 0 for r in rows)
    return [
        hits / n, math.log1p(hits), max((max(r[:2]) for r in rows), default=0.0), stem_hits / n, math.log1p(stem_hits), sum(r[2] for r in rows) / n, sum(r[3] for r in rows) / n,
        near, sum(r[4] for r in rows) / n, sum(r[4] and h for r, h in zip(rows, hit)),
    ]


def test_toxic_features():
    lexicon, stems = {"idiot": 2.0, "gamma": 0.5, "moron": 1.5}, {"stupi": 1.0, "kappa": 0.25}
    assert np.allclose(features.toxic_features(pa.array(TEXTS), lexicon, stems), [slow_toxic_features(t, lexicon, stems) for t in TEXTS])
    assert [features.canonical(w) for w in ("m0ron,", "stup!d.", "you", "'a'", "l'été")] == ["moron", "stupid", "you", "a", "lété"]


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=400), rng.integers(0, 4, 400), rng.random(400), np.zeros(400)])
    return x, ((x[:, 0] > 0.3) ^ (x[:, 1] > 1)).astype(float)


def bin_of(value, cuts):
    return sum(value > c for c in cuts)


def test_trees_score_as_their_nodes_say(sample):
    x, y = sample
    model = boosting.Trees.fit(x, y, rounds=25)
    wanted = []
    for row in x:
        total = model.base
        for feature, at, leaf in model.trees:
            node = 0
            for level in range(3):
                k = 2**level - 1 + node
                node = 2 * node + (bin_of(row[feature[k]], model.cuts[feature[k]]) > at[k])
            total += leaf[node]
        wanted.append(total)
    assert np.allclose(model(x), wanted) and ((model(x) > 0) == y).mean() > 0.97


def test_first_split_is_the_best_of_all(sample):
    """The first tree's first split has the gain of the best split that a search over all features and bins finds."""
    x, y = sample
    model = boosting.Trees.fit(x, y, rounds=1)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))

    def gain(j, cut):
        left = np.array([bin_of(v, model.cuts[j]) for v in x[:, j]]) <= cut
        if not 0 < left.sum() < len(y):
            return 0.0
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        return part(left) + part(~left) - part(left | True)

    feature, at, _ = model.trees[0]
    best = max(gain(j, c) for j in range(x.shape[1]) for c in range(len(model.cuts[j])))
    assert abs(gain(feature[0], at[0]) - best) < 1e-9


def test_additive_model_adds_its_tables(sample):
    x, y = sample
    model = boosting.PairwiseGam.fit(x, y, rounds=30)
    wanted = []
    for row in x:
        b = [bin_of(v, c) for v, c in zip(row, model.cuts)]
        pb = [bin_of(v, c) for v, c in zip(row, model.pair_cuts)]
        wanted.append(model.base + sum(t[k] for t, k in zip(model.tables, b)) + sum(t[pb[i], pb[j]] for i, j, t in model.pairs))
    assert np.allclose(model(x), wanted)
    assert ((model(x) > 0) == y).mean() > 0.9  # an exclusive or: the pairs' tables carry it


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(4)
    x, y = rng.random(40), (rng.random(40) < 0.5).astype(float)
    f = boosting.Isotonic.fit(x, y)
    order = np.argsort(x)
    s = y[order]
    wanted = [max(min(s[i : j + 1].mean() for j in range(k, len(s))) for i in range(k + 1)) for k in range(len(s))]  # min-max formula
    blocks = np.unique(np.round(wanted, 12))
    weights = np.array([(np.round(wanted, 12) == b).sum() for b in blocks])
    assert np.allclose(f.y, (blocks * weights + 0.01) / (weights + 0.02))


# --- the training sample ------------------------------------------------------------------------------------------------------


def labelled(spark, n=500):
    rows = [(i, f"text {i} {'moron' if i % 3 == 0 else 'fine'}", "en", "a", 0.0, 0, 0, 0) for i in range(n)]
    rows += [(1, f"other text {k}", "en", "a", 0.0, 0, 0, 0) for k in range(300)] + [rows[2]] * 300
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(n)], "doc_id long, toxic int")


@pytest.mark.parametrize("limit", [5, 100, 10_000])
def test_limit_counts_rows_after_the_join(spark, limit):
    docs, labels = labelled(spark)
    rows = classify.training_rows(docs, labels, "toxic", limit).collect()
    assert 0 < len(rows) <= limit and len({(r.doc_id, r.text) for r in rows}) == len(rows)
    if limit > 1000:  # every pair of id and text of the training folds, once
        wanted = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("doc_id", "text").distinct().count()
        assert len(rows) == wanted
    again = classify.training_rows(docs.repartition(7), labels, "toxic", limit).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_lexicons_leave_parts_out(spark):
    docs, labels = labelled(spark)
    rows = classify.training_rows(docs, labels, "toxic").cache()
    lexicons = classify.learn_lexicons(rows)
    for out, (words, stems) in lexicons.items():
        seen = [({features.canonical(w) for w in split(r.text)} - {""}, r.y) for r in rows.collect() if r.part not in out]
        wanted = {}
        for w in set().union(*(s for s, _ in seen)):
            n, hits = sum(w in s for s, _ in seen), sum(y for s, y in seen if w in s)
            if n >= 5 and hits >= 0.6 * n:
                wanted[w] = math.log((hits + 0.5) / (n - hits + 0.5))
        assert "moron" in wanted and words == pytest.approx(wanted), out


def test_targets_that_cannot_be_met_end_in_a_warning(spark):
    cells = spark.createDataFrame([("a", "x", "t", 10), ("b", "y", "t", 10)], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.1, "y": 0.9}}
    with pytest.warns(UserWarning, match="from its target"):
        mixing.raked(cells, targets, sweeps=4, most_sweeps=8)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        mixing.raked(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.9, "y": 0.1}})


def test_mixing_on_either_side_of_few_cells(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA).withColumnsRenamed({"fp": "mix_topic", "length": "raking_source", "n": "Mix_Tokens"})
    chances = lambda d: sorted(((r.doc_id, round(r.mix_chance, 9), r.mix_topic, r.mix_tokens) for r in d.collect()), key=repr)
    few, many = mixing.mix(docs, most_sweeps=4, sweeps=4), mixing.mix(docs, most_sweeps=4, sweeps=4, few_cells=1)
    assert few.columns == ["doc_id", "text", "lang", "source", "score", "raking_source", "mix_topic", "mix_tokens", "mix_weight", "mix_chance"]
    assert chances(few) == chances(many) and few.count() > 0
    plain = mixing.mix(docs, most_sweeps=4, sweeps=4, extras=False)
    assert plain.columns == docs.columns and sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, docs.join(few.select("doc_id"), "doc_id", "left_semi").collect()), key=repr)
