"""Shards of near equal bytes by k-d tree partitioning, in DataFrame operations only.

Every row is a point of metadata: source and language (as hash codes), and the logarithm of its size. A node that holds more than one
shard is split along its widest dimension at the weighted median of bytes. The median is found over all rows by radix descent: a few
passes of bounded histograms over a key that holds the dimension, then a hash of the text, one of the id, and a copy number. Equal rows
are counted before anything else and stand as at most COPIES points that share their count, so a crowd of equal rows is never gathered and is cut
wherever the median falls inside it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, text_of

#: Bits of a split key: dimension, hash of the text, hash of the id, number of the copy.
DIM_BITS, TEXT_BITS, ID_BITS, COPY_BITS = 20, 20, 12, 11
COPIES = 1 << COPY_BITS
#: Bits that one pass resolves: a histogram has at most 2048 bins a node.
PASS_BITS = 11
_TIE_BITS = TEXT_BITS + ID_BITS + COPY_BITS
_KEY_BITS = DIM_BITS + _TIE_BITS


@dataclass
class Level:
    """How the nodes of one level, by number, are split: the dimension, and the highest key that goes left."""

    dims: list[int]
    pivots: list[int]


def _pick(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), at + 1)


def _key(dims: Column, dim: Column) -> Column:
    return F.shiftleft(F.element_at(dims, dim + 1).cast("long"), _TIE_BITS) + F.col("tie")


def _node(levels: list[Level], dims: Column) -> Column:
    node = F.lit(0)
    for level in levels:
        node = node * 2 + (_key(dims, _pick(level.dims, node)) > _pick(level.pivots, node)).cast("int")
    return node


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, dims, tie, n): n equal rows of that size (the text's UTF-8 bytes, none for a null, plus 1) each."""
    code = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).bitwiseAND((1 << DIM_BITS) - 1)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    log_size = F.least(F.floor(F.log2(size.cast("double")) * (1 << 15)), F.lit((1 << DIM_BITS) - 1))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.xxhash64(text_of()).alias("text_hash"),
        *(x.cast("int").alias(f"dim{i}") for i, x in enumerate((code("source"), code("lang"), log_size))),
    )
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    copies = F.least("rows", F.lit(COPIES))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    top = lambda hashed, bits: F.shiftrightunsigned(hashed, 64 - bits)
    tie = F.shiftleft(F.shiftleft(top(F.col("text_hash"), TEXT_BITS), ID_BITS) + top(F.xxhash64("doc_id"), ID_BITS), COPY_BITS) + F.floor(F.col("copy") * COPIES / copies)
    n = F.floor(F.col("rows") / copies) + (F.col("copy") < F.col("rows") % copies).cast("long")
    return rows.select("doc_id", "size", "text_crc32", F.array("dim0", "dim1", "dim2").alias("dims"), tie.alias("tie"), n.alias("n"))


def _widest(rows: DataFrame, levels: list[Level]) -> dict[int, tuple[int, list[tuple[int, int]]]]:
    """Per node: bytes, and the lowest and highest value of each dimension."""
    ends = [f(F.col("dims")[i]).alias(f"{n}{i}") for i in range(3) for n, f in (("a", F.min), ("z", F.max))]
    got = rows.groupBy(_node(levels, F.col("dims")).alias("node")).agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), *ends).collect()
    return {r.node: (int(r.bytes), [(int(r[f"a{i}"]), int(r[f"z{i}"])) for i in range(3)]) for r in got}


def _medians(rows: DataFrame, levels: list[Level], dims: list[int], wanted: dict[int, int]) -> list[int]:
    """Per node the key up to which its rows, ordered by key, hold nearest to the wanted bytes."""
    n = len(dims)
    node = _node(levels, F.col("dims"))
    keyed = rows.select(node.alias("node"), (F.col("size") * F.col("n")).alias("size"), _key(F.col("dims"), _pick(dims, node)).alias("key"))
    prefix, below, done = [0] * n, [0] * n, {k: False for k in wanted}
    pivots = [(1 << _KEY_BITS) - 1] * n
    shift = _KEY_BITS
    while shift and not all(done.values()):
        wide = min(PASS_BITS, shift)
        inside = keyed.filter(F.shiftright("key", shift) == _pick(prefix, F.col("node"))) if shift < _KEY_BITS else keyed
        shift -= wide
        found = inside.groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("bytes")).collect()  # at most 2048 rows a node
        bins: dict[int, list] = {}
        for r in found:
            bins.setdefault(r.node, []).append((int(r.bin), int(r.bytes)))
        for k in wanted:
            if done[k]:
                continue
            for at, size in sorted(bins.get(k, [])):
                if below[k] + size >= wanted[k] or at == max(b for b, _ in bins[k]):
                    nearer_with = below[k] + size - wanted[k] < wanted[k] - below[k]
                    prefix[k] = at
                    pivots[k] = ((at + 1) << shift) - 1 if nearer_with else (at << shift) - 1
                    done[k] = size <= 1e-5 * wanted[k]
                    break
                below[k] += size
    return pivots


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slots are gapless from 0 in each shard.

    Give the number of shards, or the bytes a shard should reach at most on average. Null texts, ids, sources and languages are values
    like any other; of equal rows each has its own slot; a very long text is one point, so a shard can be off by its size; ties are
    cut by text, id and copy; columns of other names play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut(points(docs), "shard-points")
    levels: list[Level] = []
    seen = _widest(rows, levels)
    if shards is None:
        shards = max(1, -(-(seen[0][0] if seen else 0) // target_bytes))
    leaves = [shards]
    spans = [max(z - a, 1) for a, z in seen[0][1]] if seen else [1, 1, 1]
    while max(leaves) > 1:
        dims = [0] * len(leaves)
        wanted = {}
        for k, (size, ends) in seen.items():
            dims[k] = max(range(3), key=lambda i: ((ends[i][1] - ends[i][0]) / spans[i], -i))
            if leaves[k] > 1:
                wanted[k] = size * ((leaves[k] + 1) // 2) // leaves[k]
        levels.append(Level(dims, _medians(rows, levels, dims, wanted)))
        leaves = [x for k in leaves for x in ((k + 1) // 2, k // 2)]
        seen = _widest(rows, levels) if max(leaves) > 1 else seen
    number, names = 0, []
    for k in leaves:
        names.append(number)
        number += k
    # slots: points of a shard are numbered in parts, and each part starts where the parts before it end
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    shard, part = _pick(names, _node(levels, F.col("dims"))), F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", "n", "tie", shard.alias("shard"), part.alias("part"))
    sizes = placed.groupBy("shard", "part").agg(F.sum("n").alias("rows"))
    before = sizes.select("shard", "part", (F.sum("rows").over(Window.partitionBy("shard").orderBy("part")) - F.col("rows")).alias("before"))
    upto = F.sum("n").over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size", "tie").rowsBetween(Window.unboundedPreceding, 0))
    slots = placed.withColumn("first", upto - F.col("n")).join(F.broadcast(before), ["shard", "part"])  # a row for each shard and part
    slots = slots.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return slots.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("first") + F.col("i")).alias("slot"))
