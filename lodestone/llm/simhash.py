"""SimHash near-duplicates: fingerprints, and links found by a range join over segment popcounts.

A 64-bit fingerprint is embedded as the bit counts (0 to 2) of its 32 two-bit segments. Flipping one bit moves the embedding by one
under Manhattan distance, so that distance never exceeds the Hamming distance. Within a budget of 3, one of the two halves of the
embedding differs by at most 1: the grid has one cell per half and value, and each fingerprint also probes the cells one step
above its own (the pair one step below is found from the other side). Rows that meet in a cell are compared under
Manhattan distance and those that pass by their bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import shingles
from lodestone.llm.common import as_bytes, cut, fresh, lowest_labels, runs_of, slices, text_of, whole_runs, wide
from lodestone.llm.graph import components

SEED = 42
MAX_BITS = 3
#: Up to so many ids and text hashes (16 bytes each, so 16 MB) of documents that go are broadcast.
MOST_BROADCAST = 1_000_000
_PAIRS = np.uint64(0x5555555555555555)
_NIBBLES = np.uint64(0x3333333333333333)
_HIGH = np.uint64(0x8888888888888888)
_ONES = np.uint64(0x1111111111111111)
_EMPTY = np.zeros(64, np.int64)


def _bit_sums(shingles: list[bytes]) -> np.ndarray:
    digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int = 3, block: int = 1 << 14) -> int:
    """The signed 64-bit fingerprint of one text; long texts are hashed in blocks of shingles."""
    words = text.lower().split()
    n = len(words) - width + 1
    if n <= 1:
        total, n = (_bit_sums([b" ".join(words)]), 1) if words else (_EMPTY, 1)
    else:
        total = 0
        for at in range(0, n, block):
            part = words[at : at + block + width - 1]
            total = total + _bit_sums([b" ".join(s) for s in zip(*(part[i:] for i in range(width)))])
    return int(np.packbits(2 * total > n).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; a null text has no words, and a text without words has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = as_bytes(part.column("text"))
                fp = np.fromiter((fingerprint(t, width) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in the place of its segment."""
    x = fp.view(np.uint64)
    return x - ((x >> np.uint64(1)) & _PAIRS)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of two packed embeddings; segments are compared in four-bit fields that hold 8 plus the difference."""
    total = np.zeros(len(a), np.int64)
    for shift in (np.uint64(0), np.uint64(2)):
        t = (((a >> shift) & _NIBBLES) | _HIGH) - ((b >> shift) & _NIBBLES)
        total += np.bitwise_count(t & _ONES).astype(np.int64) + 2 * np.bitwise_count((t >> np.uint64(1)) & ~t & _ONES).astype(np.int64)
    return total


def _cells(distinct: DataFrame) -> DataFrame:
    """(cell, fp, home) for each fingerprint: its own cell in both halves (home), and the cells one step above."""
    cells = []
    for half, bits in enumerate((F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))):
        own = (bits - F.shiftright(bits, 1).bitwiseAND(int(_PAIRS) & 0xFFFFFFFF)).bitwiseOR(half << 32)
        cells.append(own)
        cells += [F.when(F.shiftright(own, 2 * s).bitwiseAND(3) < 2, own + F.lit(1 << (2 * s))) for s in range(16)]
    rows = distinct.select("fp", F.posexplode(F.array(*cells)).alias("pos", "cell")).filter("cell is not null")
    return rows.select("cell", "fp", (F.col("pos") % 17 == 0).alias("home"))


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    near = manhattan(segment_counts(a), segment_counts(b)) <= bits
    near[near] = np.bitwise_count((a[near] ^ b[near]).view(np.uint64)) <= bits  # of a signed number the magnitude would be counted
    return near


def _links(small: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "cell"):
            cell, fp, home = (rows.column(c).to_numpy() for c in ("cell", "fp", "home"))
            starts, lengths = runs_of(cell)
            homes = np.add.reduceat(home.astype(np.int64), starts)
            busy = (lengths > 1) & (homes > 0)
            left, right = [], []
            few = busy & (lengths <= small)
            inside = np.repeat(few, lengths)
            c, f, h = cell[inside], fp[inside], home[inside]
            for d in range(1, int(lengths[few].max(initial=1))):
                i = np.nonzero((c[d:] == c[:-d]) & (h[d:] | h[:-d]))[0]
                i = i[_linked(f[i], f[i + d], bits)]
                left.append(f[i]), right.append(f[i + d])
            for s, k in zip(starts[busy & ~few], lengths[busy & ~few]):
                f = np.unique(fp[s : s + k])
                # the members of one component point to its first member: never more rows than members
                label = lowest_labels(len(f), lambda i, rest, f=f: _linked(np.broadcast_to(f[i], len(rest)), f[rest], bits))
                left.append(f), right.append(f[label])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            keep = a != b
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return run


def links(distinct: DataFrame, bits: int = MAX_BITS, small: int = 32, block: int = 8192) -> DataFrame:
    """Pairs (a, b) of linked fingerprints that connect everything that is linked: of a crowded cell, a spanning star of each component.

    distinct holds each fingerprint once. A cell with more than block rows is dealt out as pairs of its chunks, so that no task
    holds more than two chunks; fewer rows meet in one task.
    """
    assert bits <= MAX_BITS, "two halves and single steps cover at most three bits"
    spark = distinct.sparkSession
    n = distinct.count()
    rows = _cells(wide(distinct, n, 50_000))  # some 34 rows each
    crowded = cut(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block), "crowded-cells")
    key = "cell"
    if not crowded.isEmpty():
        k = F.ceil(F.col("n") / F.lit(block // 2)).cast("int")
        mine = F.pmod(F.xxhash64("fp"), k).cast("int")
        pair = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.greatest(j, mine) * k + F.least(j, mine))
        rows = rows.join(crowded, "cell", "left").withColumn("block", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(-1))).otherwise(pair)))
        rows = rows.select(F.when(F.col("block") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "block")).alias("cell"), "fp", "home")
        # within a chunk pair a home row may be in the other chunk pair only; verified links make that harmless
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 34 * n // 2_000_000)
    return rows.repartition(tasks, key).sortWithinPartitions(key).mapInArrow(_links(small, bits), "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int = MAX_BITS, block: int = 8192, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs, repeated rows included.

    Texts of equal fingerprint form one class before any comparison. component_id is the smallest doc_id of all classes reached
    over links of at most bits differing bits. A null doc_id is kept and never named as a component unless all ids of it are null
    (then null). A null or empty text has no words and fingerprint 0; a very long text is hashed whole, in blocks. Columns of docs other than the two named
    play no part; an empty table gives no rows.
    """
    fps = cut(fingerprints(docs, doc_id, text, width), "fingerprints")
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes", fps.count())
    roots = components(links(classes.select("fp"), bits, block=block))
    linked = cut(roots.join(classes, roots.node == classes.fp).select("fp", "root", "first"), "linked-classes", classes.count())
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    every = classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return fps.join(every, "fp").select("doc_id", "fp", "component_id")


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, h, first_id, first_h) for every row of docs: h is a hash of its text, the other two name the first row of its group.

    Texts are linked if the Jaccard similarity of their sets of width-word shingles is at least similarity. Candidates are the pairs that the
    grid finds within bits differing bits of their SimHash, and, because sets at 0.8 differ in some ten bits, those that shingles.links
    brings together; whole sets decide on each. The first row of a group has its smallest doc_id, nulls last, and of several texts with that
    id the one of smallest h. Texts without words form one group; a text of fewer words than width is one shingle.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("h", F.xxhash64("text"))
    marks = cut(shingles.signatures(source.select("doc_id", "h", "text"), width), "shingle-signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("first")
    classes = cut(marks.groupBy("key").agg(first, F.min("fp").alias("fp"), F.min("minima").alias("minima")), "shingle-classes", marks.count())
    n = classes.count()
    of_fp = cut(classes.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")), "fingerprint-classes", n)
    same = classes.join(of_fp.filter("n > 1"), "fp").filter("key <> low").select(F.col("key").alias("a"), F.col("low").alias("b"))
    near = links(of_fp.select("fp"), bits).select(F.col("a").alias("fa"), F.col("b").alias("fb"))
    near = near.join(of_fp.select(F.col("fp").alias("fa"), F.col("low").alias("a")), "fa").join(of_fp.select(F.col("fp").alias("fb"), F.col("low").alias("b")), "fb").select("a", "b")
    _, roots = shingles.links(marks, classes, cut(same.union(near), "near-fingerprints"), similarity)
    linked = cut(roots.join(classes, roots.node == classes.key).select("key", "root", "first"), "linked-classes", n)
    named = linked.join(linked.groupBy("root").agg(F.min("first").alias("lowest")), "root").select("key", "lowest")
    every = classes.join(named, "key", "left").select("key", F.coalesce("lowest", "first").alias("lowest"))
    return marks.select("doc_id", "h", "key").join(every, "key").select("doc_id", "h", F.col("lowest.doc_id").alias("first_id"), F.col("lowest.h").alias("first_h"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row of each group of similar_groups(), with all columns of docs: the first row; of rows that share its id and text, the one of lowest hash.

    Rows that share an id but belong to different groups all stay, as do rows without an id that resemble no other. An empty table gives no rows.
    """
    found = cut(similar_groups(docs, doc_id, text, similarity, width), "similar-groups")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    n = found.count()
    gone = cut(found.filter(~is_first).select("doc_id", "h").distinct(), "group-others", n)
    again = cut(found.filter(is_first).groupBy("doc_id", "h").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "h"), "repeated-firsts", n)
    x = fresh(docs.columns, "row")
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    rows = docs.select(*own, F.col(doc_id).cast("long").alias(f"{x}_id"), F.xxhash64(text_of(text)).alias(f"{x}_h"))

    def matched(left: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        few = ids.count() <= most_broadcast  # 16 bytes each; then whole texts need no shuffle, beyond it the planner decides
        ids = (F.broadcast(ids) if few else ids).select(F.col("doc_id").alias(f"{x}_other_id"), F.col("h").alias(f"{x}_other_h"))
        return left.join(ids, F.col(f"{x}_id").eqNullSafe(F.col(f"{x}_other_id")) & (F.col(f"{x}_h") == F.col(f"{x}_other_h")), how)

    rest = matched(rows, gone, "left_anti")
    if again.isEmpty():
        return rest.select(*own)
    lowest = matched(rest, again, "left_semi").groupBy(f"{x}_id", f"{x}_h").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(x))
    return matched(rest, again, "left_anti").select(*own).union(lowest.select(*(F.col(x).getField(c).alias(c) for c in docs.columns)))


def hex_of(fp: str = "fp"):
    """The fingerprint as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
