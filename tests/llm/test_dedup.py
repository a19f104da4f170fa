"""Near-duplicate texts by word shingles, and the stage of the pipeline that keeps one of each group, against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from small import SCHEMA, closed, corpus

from lodestone.llm import shingles, simhash


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def similar(a, b):
    return len(a & b) / len(a | b) >= 0.8 if a or b else True


def edited_texts(seed=11, n=40):
    """Texts with copies in which more and more words are replaced, so that five-word Jaccard goes down from 1 to about 0.5."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        words = rng.integers(0, 5000, int(rng.integers(60, 300))).astype(str)
        for part in (0, 0.005, 0.01, 0.02, 0.03, 0.05):
            now = words.copy()
            hit = rng.random(len(now)) < part
            now[hit] = rng.integers(5000, 9000, int(hit.sum())).astype(str)
            rows.append((len(rows), " ".join(now), "en", "a", 0.0, 0, 0, 0))
    return rows


def copies_of_one(n=150, seed=2):
    """A text and n copies, each with other words replaced: all resemble the first (0.8 or so), few each other."""
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 5000, 220).astype(str)
    rows = [(0, " ".join(words), "en", "a", 0.0, 0, 0, 0)]
    for i in range(1, n):
        now = words.copy()
        now[rng.choice(len(now), 4, replace=False)] = rng.integers(5000, 90000, 4).astype(str)
        rows.append((i, " ".join(now), "en", "a", 0.0, 0, 0, 0))
    return rows


def grouped(rows):
    """The first (doc_id, text) of each row's group, by brute force: smallest id, nulls last."""
    sets = [slow_shingles(r[1]) for r in rows]
    names = [(r[0] is None, r[0] or 0, i) for i, r in enumerate(rows)]
    return [n[2] for n in closed(len(rows), lambda i, j: similar(sets[i], sets[j]), names)]


@pytest.mark.parametrize("rows", [corpus(), edited_texts(), copies_of_one()])
def test_groups_are_those_of_whole_sets(spark, rows):
    wanted = sorted(((r[0], rows[g][0]) for r, g in zip(rows, grouped(rows))), key=repr)
    got = simhash.similar_groups(spark.createDataFrame(rows, SCHEMA).repartition(5)).select("doc_id", "first_id").collect()
    assert sorted(map(tuple, got), key=repr) == wanted


def test_no_rows_no_groups(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.similar_groups(none).count() == 0 and simhash.keep_first(none).count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_one_row_of_each_group_stays(spark, most):
    """Broadcast or not; null and repeated ids, repeated rows, rows of one id with unlike texts, clashing column names."""
    rows = edited_texts(n=12)
    rows += [(5, "another text with the same id", "en", "a", 0.0, 0, 0, 0), (None, rows[0][1], None, None, 0.0, 0, 0, 0), (None, "a text without an id", "en", "a", 0.0, 0, 0, 0)]
    rows += [rows[-1], rows[0], rows[0], (900, None, None, None, None, None, None, None), (901, "", "en", "a", 0.0, 0, 0, 0), (902, " \n", "en", "a", 0.0, 0, 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"fp": "row_id", "length": "h", "n": "key"})
    got = simhash.keep_first(docs.repartition(4), most_broadcast=most)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    wanted = Counter({(rows[g][0], rows[g][1]): 1 for g in grouped(rows)})
    assert kept == wanted and (5, "another text with the same id") in kept and (None, "a text without an id") in kept and (900, None) in kept


def test_crowded_buckets_are_dealt_out(spark):
    rows = copies_of_one(60)
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = shingles.signatures(docs.selectExpr("doc_id", "xxhash64(text) as h", "text"), 5).cache()
    none = spark.createDataFrame([], "a long, b long")
    classes = marks.groupBy("key").agg(F.min("minima").alias("minima"))
    for block in (4096, 8):
        _, roots = shingles.links(marks, classes, none, 0.8, block=block)
        assert len({r.root for r in roots.collect()}) == 1 and roots.count() == 60


def test_sketches_pass_similar_sets():
    """Of pairs at exactly 0.8 none is held back by its sketch; of pairs at 0.6 nearly all are."""
    rng = np.random.default_rng(0)
    sets, keys = [], []
    for _ in range(200):
        x = rng.choice(2**31 - 1, 400, replace=False).astype(np.int32)
        sets += [x[:360], x[40:400], x[:280]]  # 320 of 400 and 240 of 400 in common with the second
    keys = list(range(len(sets)))
    batch = pa.RecordBatch.from_pydict({"key": pa.array(keys), "shingles": pa.array([s.tolist() for s in sets], pa.list_(pa.int32()))})
    made = pa.Table.from_batches(list(shingles._sketches(iter([batch]))))
    bits = np.frombuffer(b"".join(made["sketch"].to_pylist()), np.uint64).reshape(len(sets), -1)
    limit = shingles._far(shingles.SKETCH, 0.9)
    far = lambda a, b: np.bitwise_count(bits[a::3] ^ bits[b::3]).sum(axis=1)
    assert (far(0, 1) <= limit).all() and (far(1, 2) <= limit).mean() < 0.02


def test_fingerprints_of_shingle_hashes():
    hashes, n = shingles.shingle_hashes(pa.array(["A b c d e F g", "a b", "", "x " * 9, "a B c d e f g"]), 5)
    assert n.tolist() == [3, 1, 0, 5, 3] and hashes[:3].tolist() == hashes[-3:].tolist()
    distinct, m = shingles.sets_of(hashes, n)
    assert m.tolist() == [3, 1, 0, 1, 3] and len(distinct) == 8
    ones = [sum(int(h) >> b & 1 for h in hashes[:3]) for b in range(64)]
    fp = shingles.fingerprints_of(hashes, n)
    assert int(fp[0]) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * ones[b] > 3) and fp[2] == 0


def test_copies_of_a_missing_text_give_few_rows(spark):
    """Copies that resemble the text they come from, which is not there, and few each other: pairs are compared, not written."""
    rows = copies_of_one(120)[1:]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = shingles.signatures(docs.selectExpr("doc_id", "xxhash64(text) as h", "text"), 5).cache()
    classes = marks.groupBy("key").agg(F.min("minima").alias("minima"))
    found, roots = shingles.links(marks, classes, spark.createDataFrame([], "a long, b long"), 0.65)
    assert len({r.root for r in roots.collect()}) == 1 and roots.count() == len(rows) and found.count() <= 20 * len(rows)
    wanted = sorted(((r[0], rows[g][0]) for r, g in zip(rows, grouped(rows))), key=repr)
    assert sorted(map(tuple, simhash.similar_groups(docs).select("doc_id", "first_id").collect()), key=repr) == wanted
