"""Each operator against a brute-force version on small tables with nulls, empty texts, ties, repeated rows and clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import boosting, classify, graph, ivfpq, language_model, lattice, mixing, packing, sharding, simhash, tokens

from small import SCHEMA, WORDS, closed, corpus
from lodestone.llm.eliasfano import EliasFano

@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- token counts and packing -------------------------------------------------------------------------------------------------


def test_token_counts(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    wanted = sorted(((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in corpus()), key=repr)
    assert rows_of(tokens.token_counts(docs, path), "doc_id", "n_bytes", "n_tokens") == wanted
    assert rows_of(tokens.token_counts(docs, path, room=5, table_size=3), "doc_id", "n_bytes", "n_tokens") == wanted
    assert tokens.token_counts(none, path).count() == 0


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, window=256, keep_ids=True).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    for doc_id, text in {r[0]: r[1] for r in corpus()}.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.start)[:: 2 if doc_id == 3 else 1]  # row 3 occurs twice
        assert [i for r in pieces for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in pieces)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(places) == list(range(len(places)))
    for p in places.values():
        p.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(p, [*p[1:], (sum(p[-1]), 0)])) and p[0][0] == 0 and sum(p[-1]) <= 256
    assert sum(map(len, (r.ids for r in got))) / (256 * len(places)) > 0.97
    assert packing.pack(none, path).count() == 0


def test_fullest_is_closest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = Counter(rng.integers(1, 40, 8).tolist())
        anchor = max(counts)
        used = packing.fullest(counts, anchor, sorted(counts, reverse=True), 64)
        reach = {anchor}
        for k in (counts - Counter([anchor])).elements():
            reach |= {r + k for r in reach if r + k <= 64}
        assert sum(k * n for k, n in used.items()) == max(reach) and all(counts[k] >= n for k, n in used.items())


# --- SimHash and vectors ------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


@pytest.mark.parametrize("block", [8192, 8])
def test_simhash(docs, none, block):
    rows = corpus()
    fp = [slow_fingerprint(r[1]) for r in rows]
    component = closed(len(rows), lambda i, j: (fp[i] ^ fp[j]).bit_count() <= 3, [r[0] for r in rows])
    wanted = sorted(((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fp, component)), key=repr)
    assert rows_of(simhash.near_duplicates(docs, block=block), "doc_id", simhash.hex_of(), "component_id") == wanted
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [8192, 16])
def test_links_connect_all_close_fingerprints(spark, block):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, int(k), replace=False)) for b in base for k in rng.integers(1, 5, 12)]
    fp = np.unique(np.array([*base.tolist(), *flips], np.uint64).view(np.int64))
    got = graph.components(simhash.links(spark.createDataFrame([(int(f),) for f in fp], "fp long"), block=block)).collect()
    root = {r.node: r.root for r in got}
    wanted = closed(len(fp), lambda i, j: ((int(fp[i]) ^ int(fp[j])) & (2**64 - 1)).bit_count() <= 3, fp.tolist())
    assert [root.get(int(f), int(f)) for f in fp] == wanted
    a, b = fp[rng.integers(0, len(fp), 500)], fp[rng.integers(0, len(fp), 500)]
    assert (simhash.manhattan(simhash.segment_counts(a), simhash.segment_counts(b)) <= np.bitwise_count((a ^ b).view(np.uint64))).all()


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(90, 16))
    x = np.vstack([x, x[:40] + 0.1 * rng.normal(size=(40, 16)), x[:3], 2 * x[3:5], x[5] + 0.05 * rng.normal(size=(30, 16))])
    rows = [(i, [float(v) for v in np.float32(r)], i % 3, 1.0) for i, r in enumerate(x)]
    return rows + [(500, None, 0, 1.0), (501, [0.0] * 16, 0, 1.0), (502, [math.nan] + [1.0] * 15, 0, 1.0), (503, [None] + [1.0] * 15, 0, 1.0), (504, [1.0, 2.0], 0, 1.0), (505, [], 0, 1.0)]


VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, score double"


@pytest.mark.parametrize("block", [4096, 8])
def test_lattice(spark, block):
    rows = vectors()
    good = [r[1] is not None and len(r[1]) > 0 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]

    def linked(i, j):
        if not (good[i] and good[j]) or len(rows[i][1]) != len(rows[j][1]):
            return False
        a, b = np.array(rows[i][1]), np.array(rows[j][1])
        return a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.9

    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, VECTOR_SCHEMA), block=block).collect()}
    links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    found = [got[r[0]].n_links for r in rows]
    assert len(got) == len(rows) and all(f <= n for f, n in zip(found, links)) and sum(found) >= 0.97 * sum(links)
    if found == links:
        assert [got[r[0]].component_id for r in rows] == closed(len(rows), linked, [r[0] for r in rows])
    assert all(got[i].n_links == 0 and got[i].kept for i in range(500, 506))
    assert lattice.near_duplicates(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0


def test_decode_is_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 3
    p = lattice.decode(x)
    d = ((x - p) ** 2).sum(1)
    around = p[:, None] + lattice.shortest()[None]
    assert len(lattice.shortest()) == 240 and (((x[:, None] - around) ** 2).sum(2).min(1) >= d - 1e-9).all() and (d <= 1 + 1e-9).all()


@pytest.mark.parametrize("sizes", [{}, {"chunk_rows": 20, "query_rows": 4}])
def test_search_recall_and_scores(spark, sizes):
    rng = np.random.default_rng(3)
    x = np.float32(rng.normal(size=(1500, 16)))
    x[7] = x[100] = x[8]
    rows = [(i, [float(v) for v in r], 0, 1.0) for i, r in enumerate(x)] + [(3000, None, 0, 1.0), (3100, [0.0] * 16, 0, 1.0)]
    got = ivfpq.nearest(spark.createDataFrame(rows, VECTOR_SCHEMA), **sizes).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1500, 100))
    hits = 0
    for q, found in by.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hits += len({r.vec_id for r in found} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
        assert [r.rank for r in found] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-9 for r in found)
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
    assert hits / (10 * len(by)) >= 0.9 and [r.vec_id for r in by[100][:2]] == [7, 8]
    assert ivfpq.nearest(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0
    few = ivfpq.nearest(spark.createDataFrame(rows[:4], VECTOR_SCHEMA)).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2), (0, 3)]


# --- language model -----------------------------------------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (800, 5000), (800, 2**40), (3000, 2**62)):
        v = np.sort(rng.integers(0, universe, n)).astype(np.uint64)
        v = np.unique(np.concatenate((v, np.arange(min(n, 300), dtype=np.uint64)))) if universe > 5000 else v  # a dense run in a sparse range
        arrays, facts = EliasFano.arrays(v, universe)
        e = EliasFano(facts["n"], facts["bits"], arrays["low"], arrays["high"], arrays["ones"])
        asked = np.concatenate((v, rng.integers(0, universe, 200).astype(np.uint64)))
        at, found = e.successor(asked)
        assert (e.access(np.arange(len(v))) == v).all() and (at == np.searchsorted(v, asked)).all() and (found == np.isin(asked, v)).all()


@pytest.mark.parametrize("file_pairs", [2_000_000, 50])
def test_language_scores(docs, none, file_pairs):
    rows, m = corpus(), 10.0
    token = {r[0]: [*(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), r[1] or "")) if w), None] for r in rows}
    train = [token[r[0]] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    count = Counter(w for t in train for w in t)
    pairs = Counter(p for t in train for p in zip(["<s>", *t], t))
    context = Counter(u for t in train for u in ["<s>", *t[:-1]])
    n, total = sum(count.values()), sum(count.values()) + 0.5 * (len(count) + 1)
    got = language_model.language_scores(docs, prior=m, file_pairs=file_pairs).collect()
    assert len(got) == len(rows)
    for r in got:
        t = token[r.doc_id]
        base = [(count[w] + 0.5) / total for w in t]
        full = [(pairs[u, w] + m * b) / (context[u] + m) for u, w, b in zip(["<s>", *t], t, base)]
        assert r.train_tokens == n and r.n_tokens == len(t) and r.n_known == sum(count[w] > 0 for w in t)
        assert abs(r.base_score - sum(map(math.log10, base))) < 1e-6 and abs(r.score - sum(map(math.log10, full))) <= len(t) / 8000
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    assert language_model.language_scores(none).count() == 0


# --- classifiers --------------------------------------------------------------------------------------------------------------


def test_classifiers(spark, none):
    rng = np.random.default_rng(8)
    rows, marks = [], []
    for i in range(600):
        toxic, good = i % 4 == 0, i % 3 != 0
        words = rng.choice(WORDS[6:], 60).tolist() + (["you", "moron", "blargh"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words), "en", "a", 0.0, 0, 0, 0))
        marks.append((i, int(good), int(toxic)))
    rows += [(9000, None, None, None, 0.0, 0, 0, 0), (None, "", None, None, 0.0, 0, 0, 0)]
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*marks, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for f, column in ((classify.toxicity, 2), (classify.quality, 1)):
        got = {r.doc_id: r for r in f(docs, labels).collect()}
        held = [m for m in marks if got[m[0]].held_out]
        assert len(got) == len(rows) and len(held) > 80 and all(0 <= r.score <= 1 for r in got.values())
        assert sum(got[m[0]].predicted == m[column] for m in held) / len(held) > 0.97
        assert f(none, labels).count() == 0 and {r.score for r in f(docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic_rises():
    rng = np.random.default_rng(0)
    x = rng.random(500)
    f = boosting.Isotonic.fit(x, (rng.random(500) < x).astype(float))
    assert (np.diff(f(np.linspace(0, 1, 50))) >= 0).all() and abs(f(np.array([0.5]))[0] - 0.5) < 0.2


# --- shards and mixing --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards(spark, none, shards):
    rows = [r for r in corpus(600) if len(r[1] or "") < 5000]
    got = sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=shards).collect()
    wanted = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == wanted
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    assert sorted(total) == list(range(shards)) and max(total.values()) - min(total.values()) <= 8 * max(r.size for r in got)
    for s in total:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.kd_shards(none, shards=4).count() == 0


def test_a_crowd_of_equal_texts_is_split(spark):
    rows = [(i, "same text", "en", "a", 0.0, 0, 0, 0) for i in range(400)] + [(1000 + i, f"other {i}", "en", "a", 0.0, 0, 0, 0) for i in range(400)]
    sizes = Counter(r.shard for r in sharding.kd_shards(spark.createDataFrame(rows, SCHEMA), shards=8).collect())
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 12


def test_raking_meets_the_targets(spark, docs, none):
    cells = spark.createDataFrame([(s, g, t, int(10 + 7 * i)) for i, (s, g, t) in enumerate((s, g, t) for s in "ab" for g in "xyz" for t in "uv")], "source string, lang string, topic string, tokens long")
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.2, "y": 0.3, "z": 0.5}}
    got = mixing.raked(cells, targets, sweeps=30).collect()
    total = sum(r.tokens for r in got)
    for m, shares in targets.items():
        for v, share in shares.items():
            assert abs(sum(r.weight for r in got if r[m] == v) / total - share) < 1e-6
    drawn = mixing.mix(docs, most_sweeps=4, sweeps=4)
    assert drawn.columns[: len(docs.columns)] == docs.columns and 0 < drawn.count() <= docs.count()
    assert rows_of(drawn, "doc_id") == rows_of(mixing.mix(docs.repartition(7), most_sweeps=4, sweeps=4), "doc_id") and mixing.mix(none).count() == 0


def test_rare_values_do_not_set_the_rate_of_mixing(spark):
    """One document of a new source and one of a new language; without a budget they bring the kept share under a sixth."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    new = spark.createDataFrame([(900_001, "word " * 40, "en", "brand-new"), (900_002, "word " * 40, "zz", "brand-new")], "doc_id long, text string, lang string, source string")
    total = docs.union(new).agg(F.sum(mixing.tokens_of())).first()[0]

    def kept(rows, **how):
        return mixing.mix(rows, **how).agg(F.sum("mix_tokens")).first()[0] / total

    assert kept(docs.union(new), keep=0.0) < 1 / 6
    assert abs(kept(docs.union(new)) - mixing.KEEP) < 0.02
    assert abs(kept(docs.union(new), keep=0.9) - 0.9) < 0.02
    assert kept(docs) > 0.75  # the budget is a floor
    cells = [("a", "x", "t", 1000, 700.0), ("b", "x", "t", 1000, 900.0), ("c", "x", "t", 10, 410.0), ("d", "x", "t", 500, 0.0)]
    chances = {r.source: r.mix_chance for r in mixing.with_chances(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, weight double"), 0.5).collect()}
    assert chances["c"] == 1 and chances["d"] == 0 and abs(1000 * chances["a"] + 1000 * chances["b"] + 10 - 1005) < 1e-6 and abs(chances["b"] / chances["a"] - 9 / 7) < 1e-9


def test_mixing_equals_its_sql(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}/*.parquet'")
    drawn = mixing.mix(spark.read.parquet(path), most_sweeps=mixing.SWEEPS).select("doc_id", F.round("mix_chance", 6).alias("chance"))
    assert sorted(map(tuple, drawn.collect())) == sorted(con.sql(mixing.oracle()).select("doc_id, chance").fetchall())
