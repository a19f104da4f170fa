"""Near-duplicate vectors by lattice hashing.

Unit vectors are projected at random to 8 dimensions, several times, and each projection is decoded to its nearest point of the E8
lattice. A vector lives in the cell of its point and probes the cells of the neighbouring points nearest to its projection; two
vectors that meet in a cell, one of them at home there, are compared by their exact cosine. Equal vectors are one class before
any of this. Linked pairs are counted where they are found and never leave the task as pairs: a pair that meets in several
cells counts in the first of them, which both sides can tell from their codes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, runs_of, whole_runs, wide
from lodestone.llm.graph import components
from lodestone.llm.vectors import matrix, prepared, unit

#: Up to so many distinct vectors: tables, and the scale of the projections; finer cells need more tables for the same recall. Of two vectors at
#: cosine 0.9 a table with PROBES probes brings 39, 20 and 10 % together, and a cell holds some 2e-4, 4e-5 and 1e-5 of all vectors.
SETTINGS = ((20_000_000, 8, 0.8), (200_000_000, 16, 1.0), (None, 35, 1.2))
PROBES, SEED = 4, 7


def settings_for(n: int) -> tuple[int, float]:
    return next((tables, scale) for most, tables, scale in SETTINGS if most is None or n <= most)


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest point with whole coordinates of even sum (D8)."""
    r = np.rint(x)
    odd = np.nonzero(r.sum(axis=1) % 2)[0]
    off = (x - r)[odd]
    worst = np.abs(off).argmax(axis=1)
    r[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: D8, or D8 moved by one half in every coordinate."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1, or all of one half with an even number below zero."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def codes(x: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """For unit rows of x, cell numbers (rows, tables, 1 + probes): the own cell first, then the nearest neighbouring ones."""
    rng = np.random.default_rng([seed, x.shape[1]])
    around = shortest()
    mixer = rng.integers(1, 2**63, size=8, dtype=np.uint64) | np.uint64(1)
    out = np.empty((len(x), tables, 1 + probes), np.int64)
    for t in range(tables):
        p = x @ rng.normal(size=(x.shape[1], 8)) * scale
        own = decode(p)
        # of the neighbours own + v, those with the largest (p - own) . v are nearest, all v being of equal length
        near = np.argpartition(-((p - own) @ around.T), probes, axis=1)[:, :probes]
        points = np.concatenate((own[:, None, :], own[:, None, :] + around[near]), axis=1)
        key = (np.rint(2 * points).astype(np.int64).view(np.uint64) * mixer).sum(axis=2, dtype=np.uint64)
        key ^= key >> np.uint64(29)
        key = key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t * 131 + x.shape[1] * 524287)
        out[:, t] = (key ^ (key >> np.uint64(32))).view(np.int64)
    return out


def _by_length(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors have one length."""
    import pyarrow.compute as pc

    n = pc.list_value_length(batch.column("embedding")).to_numpy(zero_copy_only=False)
    for k in np.unique(n):
        part = batch if (n == k).all() else batch.filter(pa.array(n == k))
        for at in range(0, part.num_rows, 4096):
            yield part.slice(at, 4096)


def _as_bytes(x: np.ndarray) -> list[bytes]:
    """Each row's numbers, in four bytes each where that loses nothing; a letter in front says which."""
    short = x.astype(np.float32)
    exact = (short == x).all(axis=1)
    return [b"f" + s.tobytes() if e else b"d" + v.tobytes() for e, s, v in zip(exact, short, x)]


def _length(vector: bytes) -> int:
    return (len(vector) - 1) // (4 if vector[:1] == b"f" else 8)


def _numbers(vectors: list[bytes]) -> np.ndarray:
    """Rows of one length as doubles."""
    return np.array([np.frombuffer(v, np.float32 if v[:1] == b"f" else np.float64, offset=1) for v in vectors], np.float64)


def _cell_rows(settings: tuple, with_vectors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_length(batch):
                x = matrix(part.column("embedding"))
                cell = codes(unit(x), *settings)
                n, tables, wide = cell.shape
                columns = {"cell": pa.array(cell.reshape(-1))}
                if with_vectors:
                    who = pa.array(np.repeat(np.arange(n), tables * wide))
                    columns["table"] = pa.array(np.tile(np.repeat(np.arange(tables), wide), n).astype(np.int32))
                    columns["home"] = pa.array(np.tile(np.arange(wide) == 0, n * tables))
                    columns |= {"cid": part.column("cid").take(who), "n": part.column("n").take(who), "vector": pa.array(_as_bytes(x), pa.binary()).take(who)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _first_meeting(cx: np.ndarray, cy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of codes the first table in which they meet, and the lowest cell in which they do there."""
    there = (cx[:, :, :1] == cy).any(axis=2)  # x at home, y probing or at home
    back = (cy[:, :, :1] == cx).any(axis=2)
    t = (there | back).argmax(axis=1)
    i = np.arange(len(t))
    top = np.int64(2**63 - 1)
    return t, np.minimum(np.where(there[i, t], cx[i, t, 0], top), np.where(back[i, t], cy[i, t, 0], top))


def _count_links(cosine: float, settings: tuple, block: int = 512):
    def pairs_of(run: slice, x, home, part, cross) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = run.stop - run.start
        u, h, p = x[run], home[run], part[run]
        for at in range(0, n, block):
            rows = slice(at, min(at + block, n))
            ok = u[rows] @ u[at:].T >= cosine
            ok &= h[rows, None] | h[None, at:]
            ok &= np.arange(rows.start, rows.stop)[:, None] < np.arange(at, n)[None, :]
            if cross[run.start]:
                ok &= p[rows, None] != p[None, at:]
            i, j = np.nonzero(ok)
            for k in range(0, len(i), 1 << 15):
                yield run.start + at + i[k : k + (1 << 15)], run.start + at + j[k : k + (1 << 15)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "key"):
            key, cell, table, home, cid, n, part, cross = (rows.column(c).to_numpy() for c in ("key", "cell", "table", "home", "cid", "n", "part", "cross"))
            starts, lengths = runs_of(key)
            busy = (lengths > 1) & (np.add.reduceat(home.astype(np.int64), starts) > 0)
            live = np.repeat(busy, lengths)
            links = np.zeros(len(key), np.int64)
            root = np.arange(len(key))
            if not live.any():
                continue
            raw = rows.column("vector").combine_chunks().cast(pa.binary()) if isinstance(rows.column("vector"), pa.ChunkedArray) else rows.column("vector")
            vectors = raw.take(pa.array(np.nonzero(live)[0])).to_pylist()
            sizes = np.zeros(len(key), np.int64)
            sizes[live] = [_length(v) for v in vectors]
            for size in np.unique(sizes[live]):  # vectors of one length; a cell holds but one length
                own = np.nonzero(sizes == size)[0]
                x = np.zeros((len(key), size))
                x[own] = unit(_numbers([v for v in vectors if _length(v) == size]))
                mine = busy & (sizes[starts] == size)
                met = (pair for s, k in zip(starts[mine], lengths[mine]) for pair in pairs_of(slice(int(s), int(s + k)), x, home, part, cross))
                for i, j in _gathered(met, 1 << 15):
                    ends, place = np.unique(np.concatenate((i, j)), return_inverse=True)
                    code = codes(x[ends], *settings)
                    t, c = _first_meeting(code[place[: len(i)]], code[place[len(i) :]])
                    first = (t == table[i]) & (c == cell[i]) & (cid[i] != cid[j])
                    i, j = i[first], j[first]
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    _join(root, i, j)
            found = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(cid[found]), pa.array(links[found]), pa.array(cid[root[found]])], ["cid", "links", "root"])

    return run


def _gathered(pairs: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in fewer and larger arrays."""
    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= most:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if n:
        yield tuple(map(np.concatenate, zip(*held)))


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Lower root[] until both ends of every pair share their lowest row."""
    while True:
        low = np.minimum(root[i], root[j])
        if (root[i] == low).all() and (root[j] == low).all():
            return
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root[i], root[j] = root[root[i]], root[root[j]]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, tables: int | None = None, probes: int = PROBES, scale: float | None = None, block: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding).

    n_links counts the other rows found with a cosine of at least the given one, computed in double precision; equal vectors always
    count. component_id is the smallest vec_id that links reach. Vectors that are null, zero or hold null or non-finite numbers
    link with nothing and are their own component; vectors of different lengths never link. Repeated rows are rows like others, null ids
    stay null and are never named while another id is there, an empty table gives no rows, other columns play no part. A cell with
    more than block rows is dealt out as pairs of chunks. Where tables and scale are not given they follow from the number of distinct vectors.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors)
    classes = rows.filter("usable").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("cid").alias("cid"))
    classes = cut(classes, "vector-classes")
    count = classes.count()
    settings = (tables or settings_for(count)[0], probes, scale or settings_for(count)[1], SEED)
    entries = wide(classes.select("embedding", "cid", "n"), count, 50_000)
    cells = entries.mapInArrow(_cell_rows(settings, True), "cell long, table int, home boolean, cid long, n long, vector binary")
    crowded = entries.mapInArrow(_cell_rows(settings, False), "cell long")
    crowded = cut(crowded.groupBy("cell").agg(F.count("*").alias("rows")).filter(F.col("rows") > block), "crowded-lattice-cells")
    if crowded.isEmpty():
        cells = cells.withColumns({"key": F.col("cell"), "part": F.lit(0), "cross": F.lit(False)})
    else:
        k = F.ceil(F.col("rows") / F.lit(block // 2)).cast("int")
        mine = F.pmod(F.xxhash64("cid"), k).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.struct((F.greatest(j, mine) * k + F.least(j, mine)).alias("pair"), (j != mine).alias("cross")))
        alone = F.array(F.struct(F.lit(-1).alias("pair"), F.lit(False).alias("cross")))
        cells = cells.join(crowded, "cell", "left").withColumn("b", F.explode(F.when(F.col("rows").isNull(), alone).otherwise(pairs)))
        cells = cells.withColumns({"key": F.when(F.col("b.pair") < 0, F.col("cell")).otherwise(F.xxhash64("cell", "b.pair")), "part": F.coalesce(mine, F.lit(0)), "cross": F.col("b.cross")})
        cells = cells.drop("rows", "b")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_count_links(cosine, settings), "cid long, links long, root long")
    found = cut(found, "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    linked = cut(roots.join(classes.select("cid", "first"), F.col("node") == F.col("cid")).select("cid", "root", "first"), "linked-vectors", count)
    lowest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    named = linked.join(lowest, "root").select("cid", "component_id")
    facts = classes.select("cid", "n", "first").join(links, "cid", "left").join(named, "cid", "left")
    facts = facts.select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.filter("usable").select("vec_id", "cid").join(facts, "cid").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
