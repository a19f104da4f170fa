"""The registered queries on the smallest tables: columns, types, thresholds and whole tables; shards and searches against slow versions."""

import math
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from small import SCHEMA, corpus
from tokenizers import Tokenizer

from lodestone.llm import common, ivfpq, lattice, packing, queries, sharding

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_language_scores": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op6_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op7_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op8_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op9_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_quality": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == COLUMNS[name]
    rows = got.collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    if name in ("op1_toxicity", "op10_quality"):
        least = 0.5 if name == "op1_toxicity" else 0.3
        assert all(r.predicted == (r.score >= least) and 0 <= r.score <= 1 and r.held_out == (fold(r.doc_id) == 0) for r in rows)
    if name == "op2_token_counts":
        t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        wanted = {d.doc_id: len(t.encode(d.text or "", add_special_tokens=False).ids) for d in docs}
        assert {r.doc_id: r.n_tokens for r in rows} == wanted and all(r.over_limit == (r.n_tokens > 512) for r in rows)
    if name == "op3_sharding":
        assert {r.law for r in rows} == {"bytes"} and {r.shard for r in rows} == set(range(16)) and all(r.grown_shard is None for r in rows)
    if name == "op4_language_scores":
        assert all(r.held_out == (fold(r.doc_id) == 1) for r in rows) and sum(r.score for r in rows) > sum(r.base_score for r in rows)
    if name == "op6_simhash":
        assert all(len(r.fingerprint) == 16 and r.component_id <= r.doc_id for r in rows)
    if name == "op7_packing":
        filled = Counter()
        for r in rows:
            filled[r.sequence_id] += r.length
        assert set(filled) == set(range(len(filled))) and max(filled.values()) <= 4096
        assert sum(filled.values()) == sum({r.doc_id: r.doc_tokens for r in rows}.values())
    if name in ("op7_packing", "op9_nearest_neighbours"):
        return
    whole = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op8') else 'documents'}.parquet").count()
    assert len(rows) == whole


def test_ids_of_odd_words():
    """Stretches with letters, marks, combining characters and special strings, cut up here and encoded whole by the library."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words, t = packing.WordIds(Path(path).read_text(encoding="utf-8"), 50_000), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    pool = [chr(c) for c in range(1, 0x250)] + [chr(c) for c in range(0x300, 0x330)] + list(".,;:!?'’ \n\t") * 20 + list("AaIiİıßſ") * 20 + ["<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(pool, int(k))) for k in rng.integers(1, 12, 8000)] + ["SERVİ.", "İ!", "Aİ?", "İstanbul, İ;", "i̇."]
    ids, lengths = words(pa.array(texts), 2)
    ends = np.cumsum(lengths)
    for text, a, z in zip(texts, ends - lengths, ends):
        assert ids[a:z].tolist() == [*t.encode(text, add_special_tokens=False).ids, 2], repr(text)


# --- shards -------------------------------------------------------------------------------------------------------------------


def slow_shards(points, shards):
    """The k-d tree on single rows (dims, tie, size): where each goes."""
    spans = [max(max(p[0][i] for p in points) - min(p[0][i] for p in points), 1) for i in range(3)]

    def split(rows, leaves, first):
        if leaves == 1:
            return {i: first for i in rows}
        if not rows:
            return {}
        wide = [(max(points[i][0][d] for i in rows) - min(points[i][0][d] for i in rows)) / spans[d] for d in range(3)]
        d = max(range(3), key=lambda d: (wide[d], -d))
        left_leaves = (leaves + 1) // 2
        wanted = sum(points[i][2] for i in rows) * left_leaves // leaves
        by = {}
        for i in rows:
            by.setdefault((points[i][0][d], points[i][1]), []).append(i)
        left, size = [], 0
        for key in sorted(by):
            more = sum(points[i][2] for i in by[key])
            if size + more >= wanted:
                if size + more - wanted < wanted - size:
                    left += by[key]
                break
            left += by[key]
            size += more
        right = sorted(set(rows) - set(left))
        return split(left, left_leaves, first) | split(right, leaves // 2, first + left_leaves)

    return split(list(range(len(points))), shards, 0)


@pytest.mark.parametrize("shards", [2, 5, 16])
def test_shards_are_those_of_the_slow_tree(spark, shards):
    docs = spark.createDataFrame(corpus(400) + [(None, "same", None, "hot", 0.0, 0, 0, 0)] * 50, SCHEMA)
    found = sharding.points(docs).collect()
    single = [(tuple(r.dims), r.tie, r.size * r.n) for r in found]
    assert sum(r.n for r in found) == docs.count()
    shard = slow_shards(single, shards)
    wanted = Counter((r.doc_id, r.text_crc32, shard[i]) for i, r in enumerate(found) for _ in range(r.n))
    got = sharding.kd_shards(docs.repartition(5), shards=shards).collect()
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in got) == wanted
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_equal_rows_are_split(spark):
    """Equal text and id, more rows than copies are told apart, and one very long text."""
    rows = [(None, "same text", "en", "a")] * 3000 + [(i, f"other {i}", "en", "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    bytes_of = Counter()
    for r in sharding.kd_shards(docs, shards=8).collect():
        bytes_of[r.shard] += r.size
    assert len(bytes_of) == 8 and max(bytes_of.values()) - min(bytes_of.values()) <= 60
    long = docs.union(spark.createDataFrame([(5000, "x" * 200_000, "en", "a")], docs.schema))
    sizes = Counter()
    for r in sharding.kd_shards(long, shards=2).collect():
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= 200_001


# --- vectors ------------------------------------------------------------------------------------------------------------------

SCHEMA_V = "vec_id long, embedding array<double>, label int, uid int, list int"


def test_search_takes_every_length_and_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist(), 0, 1, 1) for i in range(600)]
    rows += [(1000 + i, rng.normal(size=5).tolist(), 0, 1, 1) for i in range(130)] + [(7000, [1.0, 2.0], 0, 1, 1), (8000, None, 0, 1, 1), (None, [1.0] * 8, 0, 1, 1)]
    rows += [(100, rng.normal(size=8).tolist(), 0, 1, 1), rows[200]]  # a second vector of id 100, and row 200 again
    docs = spark.createDataFrame(rows, SCHEMA_V)

    def slow(i):
        same = [(math.dist(rows[i][1], r[1]), r[0]) for j, r in enumerate(rows) if j != i and r[0] is not None and r[1] is not None and len(r[1]) == len(rows[i][1])]
        return sorted(same)[:10]

    wanted = Counter()
    for i, r in enumerate(rows):
        if r[0] is not None and r[1] is not None and r[0] % 100 == 0:
            wanted.update((r[0], n, v, round(s, 9)) for n, (s, v) in enumerate(slow(i), 1))
    got = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ivfpq.nearest(docs, refine=1000).collect())
    assert got == wanted and 7000 not in {k[0] for k in got} and sum(k[0] == 100 and k[1] == 1 for k in got) == 2 and got[200, 1, 200, 0.0] == 2


def test_search_does_not_depend_on_the_session(spark):
    rng = np.random.default_rng(10)
    docs = spark.createDataFrame([(i, rng.normal(size=16).tolist(), 0, 1, 1) for i in range(6000)], SCHEMA_V)
    found = []
    width = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, ivfpq.nearest(docs).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", width)
    assert found[0] == found[1]


def test_links_of_vectors_that_need_doubles(spark):
    """Numbers that four bytes cannot hold travel whole, beside others that they can."""
    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(30, 8)), 3, axis=0) + 0.02 * rng.normal(size=(90, 8))
    x[::2] = np.float32(x[::2])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0, 1, 1) for i, v in enumerate(x)], SCHEMA_V)).collect()}
    assert [got[i] for i in range(90)] == ((u @ u.T >= 0.9).sum(1) - 1).tolist()


@pytest.mark.parametrize("tables, scale", [s[1:] for s in lattice.SETTINGS])
def test_tables_reach_the_recall_at_the_threshold(tables, scale):
    rng = np.random.default_rng(0)
    a, r = rng.normal(size=(2, 600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r -= (r * a).sum(1, keepdims=True) * a
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    x, y = (lattice.codes(v, tables, lattice.PROBES, scale, lattice.SEED) for v in (a, 0.9 * a + math.sqrt(0.19) * r))
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).any(1)
    assert met.mean() > 0.93


def test_a_cluster_must_name_its_shared_folder(spark):
    class Conf:
        def __init__(self, **given):
            self.given = given

        def get(self, name, default=None):
            return self.given.get(name, default)

    class Session:
        def __init__(self, **given):
            self.conf = Conf(**given)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(**{"spark.master": "spark://host:7077"}))
    assert common.shared_dir(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x"})) == "hdfs:///x"
    assert common.shared_dir(Session(**{"spark.master": "local[2]"})).startswith("file:")
