"""Texts as sets of word shingles, and pairs of sets whose Jaccard similarity is high.

simhash.py calls this for links that a few differing bits cannot reach. Texts of equal sets are one class. A class has a MinHash signature
of BANDS bands of ROWS minima; classes that agree in a whole band meet in its bucket, a pair of similarity s with chance
1 - (1 - s^ROWS)^BANDS (0.9996 at 0.8). In each bucket all classes are first compared with the one that meets most others, which
for copies of one text is the text itself, and what is linked becomes components. Buckets that still hold several components are compared
pair by pair inside their tasks: first by SKETCH one-bit minima a class, then, where these agree as often as those of similar sets do
(all but 1 in 4000), by their whole sets; only links that connect leave a task, never pairs. Pairs with a hub must agree in as many
of the signature's minima as similar sets do before their whole sets are joined. Whole sets decide every link, so none is wrong.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, cut, runs_of, slices, whole_runs, words_of
from lodestone.llm.graph import components

SEED = 42
BANDS, ROWS, SKETCH = 20, 5, 1024
#: How many standard deviations a sketch may lie below what is expected at the least similarity.
SIGMAS = 3.5
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with all bits stirred."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _odd(n: int, stream: int) -> np.ndarray:
    return np.random.default_rng([SEED, stream]).integers(0, 2**64, n, dtype=_U) | _U(1)


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts one after another, repeats included, and how many each has.

    A text of fewer words than width has one shingle, all of it; a text without words has none.
    """
    words, lengths = words_of(texts)
    coded = words.dictionary_encode()
    of_word = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in as_bytes(coded.dictionary)), _U, len(coded.dictionary))
    word = np.concatenate((of_word[coded.indices.to_numpy(zero_copy_only=False)], np.zeros(width, _U)))
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(doc))
    end = np.cumsum(lengths)[doc]
    weights = _odd(width, 1)
    total = np.zeros(len(doc), _U)
    for j in range(width):  # a word beyond the text's end counts as 0
        total += np.where(at + j < end, word[j : j + len(doc)], _U(0)) * weights[j]
    first = at == end - lengths[doc]
    keep = (at + width <= end) | (first & (lengths[doc] < width))
    return mixed(total[keep]), np.bincount(doc[keep], minlength=len(lengths)).astype(np.int64)


def sets_of(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, sorted within it, and how many each has."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(lengths)).astype(np.int64)


def _reduced(ufunc: np.ufunc, values: np.ndarray, lengths: np.ndarray, empty) -> np.ndarray:
    """ufunc over the values of each text; `empty` where a text has none."""
    out = np.full(len(lengths), empty, values.dtype)
    some = lengths > 0
    if some.any():
        out[some] = ufunc.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def fingerprints_of(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """SimHash of each text: bit b is 1 if it is set in over half of the text's hashes; 0 without any."""
    out = np.zeros(len(lengths), _U)
    for b in range(64):
        ones = _reduced(np.add, ((hashes >> _U(b)) & _U(1)).astype(np.int64), lengths, 0)
        out |= (2 * ones > lengths).astype(_U) << _U(b)
    return out.view(np.int64)


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values))


def _signatures(width: int, bands: int, rows: int):
    times, plus, mixer = (_odd(bands * rows, k) for k in (2, 3, 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                every, n_every = shingle_hashes(part.column("text"), width)
                hashes, n = sets_of(every, n_every)
                key = mixed(_reduced(np.add, mixed(hashes ^ _U(0x9E3779B97F4A7C15)), n, 0) + n.astype(_U))
                band = np.zeros((bands, part.num_rows), _U)
                minima = np.empty((part.num_rows, bands * rows), np.uint8)
                for k in range(bands * rows):
                    least = _reduced(np.minimum, hashes * times[k] + plus[k], n, 0)
                    band[k // rows] += least * mixer[k]
                    minima[:, k] = mixed(least).astype(np.uint8)
                some = np.nonzero(n > 0)[0]
                buckets = mixed(band.T[some] + np.arange(bands, dtype=_U)).view(np.int64)
                columns = [part.column("doc_id"), part.column("h"), pa.array(key.view(np.int64)), pa.array(fingerprints_of(every, n_every))]
                columns += [_lists(buckets.reshape(-1), np.where(n > 0, bands, 0)), pa.array([m.tobytes() for m in minima], pa.binary()), _lists(hashes.astype(np.uint32).view(np.int32), n)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "key", "fp", "buckets", "minima", "shingles"])

    return run


def signatures(texts: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, h, key, fp, buckets, minima, shingles) of (doc_id, h, text): the class of equal sets, SimHash, buckets, a byte of each minimum, and 32 bits
    of each distinct shingle's hash."""
    return texts.mapInArrow(_signatures(width, bands, rows), "doc_id long, h long, key long, fp long, buckets array<long>, minima binary, shingles array<int>")


def _far(n: int, agree: float) -> int:
    """How many of n places may differ, SIGMAS above what is expected where each agrees with that chance."""
    return int(n * (1 - agree) + SIGMAS * np.sqrt(n * agree * (1 - agree)))


def likely(pairs: DataFrame, minima: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose minima (key, minima) agree as often as those of sets of similarity least do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(part.num_rows, -1) for c in ("x", "y"))
                near = pa.array((x != y).sum(axis=1) <= _far(x.shape[1], least))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(near), part.column("b").filter(near)], ["a", "b"])

    both = pairs.join(minima.select(F.col("key").alias("a"), F.col("minima").alias("x")), "a").join(minima.select(F.col("key").alias("b"), F.col("minima").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, least: float, share: int = 1024) -> DataFrame:
    """The pairs (a, b) whose whole sets (key, shingles) are similar enough. A b with many pairs is dealt out, share pairs at a time."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(share)).cast("int").alias("k"))
    pairs = pairs.join(many, "b").withColumn("deal", F.pmod(F.xxhash64("a"), "k").cast("int")).drop("k")
    needed = pairs.select(F.col("a").alias("key")).union(many.select("b")).distinct()
    sets = cut(sets.join(needed, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")), "shingle-sets")
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("left"))
    right = sets.withColumnRenamed("key", "b").join(many, "b").select("b", F.col("shingles").alias("right"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("deal"))
    both = pairs.join(left, "a").join(right, ["b", "deal"])
    common = F.size(F.array_intersect("left", "right"))
    return both.filter(common >= F.lit(least) * (F.size("left") + F.size("right") - common)).select("a", "b")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bit of SKETCH minima for each set."""
    times, plus = _odd(SKETCH, 5), _odd(SKETCH, 6)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = part.column("shingles")
            n = np.diff(sets.offsets.to_numpy()).astype(np.int64)
            hashes = mixed(sets.flatten().to_numpy(zero_copy_only=False).view(np.uint32).astype(_U))
            bits = np.empty((SKETCH, part.num_rows), np.uint8)
            for k in range(SKETCH):
                bits[k] = (mixed(_reduced(np.minimum, hashes * times[k] + plus[k], n, 0)) & _U(1)).astype(np.uint8)
            packed = np.packbits(bits.T, axis=1)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(n), pa.array([r.tobytes() for r in packed], pa.binary())], ["key", "n", "sketch"])


def _passing(rows: pa.Table, least: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs in each group whose roots differ and that sizes and sketches allow to be similar."""
    group, root, n, part, cross = (rows.column(c).to_numpy() for c in ("group", "root", "n", "part", "cross"))
    sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(group), -1)
    most = _far(SKETCH, (1 + least) / 2)
    for s, k in zip(*runs_of(group)):
        for at in range(s, s + k, block):
            i = np.arange(at, min(at + block, s + k))
            j = np.arange(at, s + k)
            ok = (i[:, None] < j[None]) & (root[i][:, None] != root[j][None])
            ok &= np.minimum(n[i][:, None], n[j][None]) >= least * np.maximum(n[i][:, None], n[j][None])
            if cross[s]:
                ok &= part[i][:, None] != part[j][None]
            a, b = np.nonzero(ok)
            for to in range(0, len(a), 1 << 16):
                x, y = i[a[to : to + (1 << 16)]], j[b[to : to + (1 << 16)]]
                near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64) <= most
                yield x[near], y[near]


def _involved(least: float):
    """(group, key) of the classes that stand in such a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "group"):
            found = np.zeros(rows.num_rows, bool)
            for x, y in _passing(rows, least):
                found[x] = found[y] = True
            some = rows.select(["group", "key"]).filter(pa.array(found)).combine_chunks()
            yield from some.to_batches()

    return run


def _linked(least: float):
    """Links (a, b) of similar sets that connect what is similar in each group: never more than a group has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "group"):
            key, root = rows.column("key").to_numpy(), rows.column("root").to_numpy()
            sets = rows.column("shingles").combine_chunks()
            ends = sets.offsets.to_numpy()
            flat = sets.flatten().to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            _, label = np.unique(root, return_inverse=True)  # what is joined in this task has one label
            left, right = [], []
            for x, y in _passing(rows, least):
                for i, j in zip(x.tolist(), y.tolist()):
                    if label[i] == label[j]:
                        continue
                    one, other = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
                    common = len(np.intersect1d(one, other, assume_unique=True))
                    if common >= least * (len(one) + len(other) - common):
                        label[label == label[j]] = label[i]
                        left.append(max(key[i], key[j]))
                        right.append(min(key[i], key[j]))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def links(marks: DataFrame, classes: DataFrame, given: DataFrame, least: float, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(links, roots): links (a, b) of classes that connect all that bands bring together, and roots (node, root) of those that are linked.

    marks is what signatures() gives, classes (key, minima) has a row for each key of it; given holds pairs (a, b) from elsewhere that are to be verified too. A bucket of more than block classes
    is dealt out as pairs of its chunks.
    """
    sets = marks.select("key", "shingles")
    met = marks.select("key", F.explode("buckets").alias("bucket")).distinct()
    crowd = met.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(met.join(crowd, "bucket"), "buckets")  # only where classes meet
    n_met = met.count()
    central = met.groupBy("key").agg(F.sum("n").alias("meets"))
    hubs = met.join(central, "key").groupBy("bucket").agg(F.max(F.struct("meets", "key")).alias("hub"))
    hubs = cut(hubs.select("bucket", F.col("hub.key").alias("b")), "bucket-hubs", n_met)
    stars = met.join(hubs, "bucket").filter("key <> b").select(F.greatest("key", "b").alias("a"), F.least("key", "b").alias("b"))
    stars = stars.union(given.select(F.greatest("a", "b"), F.least("a", "b"))).distinct()
    stars = cut(likely(stars, classes, least), "bucket-stars", n_met + given.count())
    found = cut(verified(stars, sets, least), "star-links", stars.count())
    roots = components(found)
    rooted = met.filter("n > 2").join(roots, F.col("key") == F.col("node"), "left").select("bucket", "n", "key", F.coalesce("root", "key").alias("root"))
    several = rooted.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("several")).filter("several").select("bucket")
    rooted = cut(rooted.join(several, "bucket", "left_semi"), "mixed-buckets", n_met)
    if rooted.isEmpty():
        return found, roots
    needed = rooted.select("key").distinct()
    sketches = cut(sets.join(needed, "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")).mapInArrow(_sketches, "key long, n long, sketch binary"), "sketches")
    k = F.ceil(F.col("size") / F.lit(block // 2)).cast("int")
    mine = F.pmod(F.xxhash64("key"), k).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((F.greatest(j, mine) * k + F.least(j, mine)).alias("pair"), (j != mine).alias("cross")))
    dealt = rooted.withColumnRenamed("n", "size").withColumn("d", F.explode(F.when(F.col("size") > block, pairs).otherwise(F.array(F.struct(F.lit(-1).alias("pair"), F.lit(False).alias("cross"))))))
    dealt = dealt.select(F.when(F.col("d.pair") < 0, F.col("bucket")).otherwise(F.xxhash64("bucket", "d.pair")).alias("group"), "key", "root", mine.alias("part"), "d.cross").join(sketches, "key")
    dealt = cut(dealt, "sketched-buckets")
    tasks = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_group = lambda rows: rows.repartition(tasks, "group").sortWithinPartitions("group")
    involved = cut(by_group(dealt).mapInArrow(_involved(least), "group long, key long"), "likely-classes")
    if involved.isEmpty():
        return found, roots
    whole = cut(sets.join(involved.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("shingles").alias("shingles")), "likely-sets")
    whole = dealt.join(involved, ["group", "key"], "left_semi").join(whole, "key")
    across = by_group(whole).mapInArrow(_linked(least), "a long, b long")
    found = cut(found.union(across).distinct(), "all-links")
    roots = components(found)
    return found, roots
