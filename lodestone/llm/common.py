"""Reading tables, cutting lineage in shared storage, and Arrow helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name, whatever store its folder is in."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='lodestone-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local (one machine)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return given or _own_dir()


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/lodestone/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again.

    Later stages then start from files that outlive any executor, are computed once, and carry sizes for the planner. Where it is known that
    there are at most so many rows, and little to compute for each, a task writes 100,000 of them, so that small tables are few files.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    (df if rows is None else df.coalesce(-(-max(rows, 1) // 100_000))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote; nothing that is still to be computed may read it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(names: list[str], stem: str) -> str:
    """A column name from stem that none of names equals or begins with, whatever their case."""
    while any(n.lower().startswith(stem.lower()) for n in names):
        stem += "_"
    return stem


def text_of(column: str = "text") -> Column:
    """The text, a null counted as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5: the fixed split of rows into folds (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(5)


def wide(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """df dealt out evenly, about per_task rows to a task and never to fewer tasks than a shuffle has."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task)))


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where a column's text passes limit bytes, so that working memory follows bytes and not rows; it is given back after the batch."""
    n = batch.num_rows
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def give_back() -> None:
    """Return freed memory to the system; allocators keep it otherwise, and workers that wait for their next task would hold it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    r"""All words [^\x20\x09-\x0D]+ of the texts, A-Z in lower case, and how many each text has.

    Nulls count as empty texts.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():  # white space at either end gives an empty word
        flat, doc = flat.filter(pa.array(full)), doc[full]
    return flat, np.bincount(doc, minlength=len(texts)).astype(np.int64)


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1))
    return starts, np.diff(np.concatenate((starts, [len(keys)])))


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup batches sorted by key so that no run of equal keys is cut in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and held and held[-1].column(key)[held[-1].num_rows - 1].as_py() == keys[0]:
            held.append(batch)  # the whole batch goes on with the run that is held
            continue
        head = [*held, batch.slice(0, last)] if last or held else []
        if head:
            yield pa.Table.from_batches(head)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def lowest_labels(n: int, neighbours) -> np.ndarray:
    """Component number of each of n rows by breadth-first search; neighbours(i, rest) gives which of rest link to i."""
    label = np.full(n, -1, np.int64)
    rest = np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        label[seed] = seed
        queue = [seed]
        while queue and len(rest):
            near = neighbours(queue.pop(), rest)
            found = rest[near]
            label[found] = seed
            rest = rest[~near]
            queue.extend(found.tolist())
    return label


def worker_state(key, make):
    """What make() gives, kept in this Python worker between tasks; a worker keeps one thing at a time, so memory stays bounded."""
    import sys
    import types

    kept = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def load_tokenizer(config: str):
    """A tokenizer of the tokenizers library from its JSON text, without threads of its own."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(config)


def broadcast_object(spark: SparkSession, value):
    """Broadcast an object of this package; gives a function that returns it, unpacked once in each Python worker."""
    from pyspark import cloudpickle

    packed, key = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def unpacked():
        import pickle

        return worker_state(key, lambda: pickle.loads(packed.value))

    return unpacked


def as_bytes(strings: pa.Array) -> list[bytes]:
    """The values of a string or binary array without nulls; much faster than to_pylist()."""
    if not len(strings):
        return []
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    data = strings.buffers()[2].to_pybytes() if strings.buffers()[2] else b""
    return [data[a:z] for a, z in zip(offsets, offsets[1:])]


def as_strings(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()
