"""Scoring texts with a bigram trie in Elias-Fano levels.

The model is an interpolated one: p(w | u) = (c(u, w) + m p(w)) / (c(u) + m), with p(w) = (c(w) + 1/2) / (N + (V + 1) / 2) for the
V known words and the unknown one. All counts cover the whole training fold and none is cut off. Counting tasks sum pairs up before
they are shuffled, as blocks of sorted keys. The trie's first level holds the words as a monotone sequence of their hashes, with
running counts; the second holds for each context the numbers of its successors, made monotone by the context's own base, with monotone
pointers from contexts to their ranges and 16-bit logarithms of the smoothed probabilities. Levels are cut into files in the
shared folder, each built by one task, and scoring tasks map those that they need into memory, a bounded number at a time: what a task holds is
the pages it reads. A word is known by its 64-bit hash alone, so two of V words share counts with a chance of V^2 / 2^65 (V is under 2^32).
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, cut, fold, new_path, slices, text_of, whole_runs, words_of, worker_state
from lodestone.llm.eliasfano import Level, save

#: m: how many observations the unigram model counts for in each context.
PRIOR = 1000.0
#: Logarithms (base 10) are kept to this fraction; 16 bits then reach down to 10^-16.
STEP = 1 / 4096
#: Bytes of text worked on at a time.
SLICE = 8 << 20
#: Training pairs for each file of the second level, and words for each of the first.
FILE_PAIRS, FILE_WORDS = 2_000_000, 500_000
_U = np.uint64


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


#: The end of a text as a token; no word holds a line feed.
END = word_hash(b"\n")


class Opened:
    """Files of one level by number, mapped into memory when they are first asked for; the least recently used are closed beyond most."""

    def __init__(self, prefix: str, most: int = 256):
        self.prefix, self.most, self.levels = prefix, most, OrderedDict()

    def __getitem__(self, number: int) -> Level:
        if number in self.levels:
            self.levels.move_to_end(number)
        else:
            if len(self.levels) >= self.most:
                self.levels.popitem(last=False)
            self.levels[number] = Level(f"{self.prefix}{number:08d}")
        return self.levels[number]


@dataclass
class Trie:
    """Where the levels lie, and what is known of the whole: per file of words its number and the words and tokens before it, per file of pairs its first key."""

    folder: str
    word_bits: int
    word_files: np.ndarray
    words_before: np.ndarray
    tokens_before: np.ndarray
    tokens: int
    types: int
    texts: int
    first_keys: np.ndarray
    pair_files: np.ndarray
    prior: float

    def load(self) -> None:
        self.word_level, self.pair_level = Opened(f"{self.folder}/words-"), Opened(f"{self.folder}/pairs-")

    @property
    def start(self) -> int:
        """The number of the context before the first word."""
        return self.types

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of hashes in order: word numbers (-1: unknown), counts, and tokens of the words before."""
        number, count, before = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        bucket = (hashes >> _U(64 - self.word_bits)).astype(np.int64)
        for b in np.unique(bucket):
            place = int(np.searchsorted(self.word_files, b))
            if place == len(self.word_files) or self.word_files[place] != b:
                continue
            level = self.word_level[int(b)]
            rows = slice(*np.searchsorted(bucket, [b, b + 1]))
            here = hashes[rows] - _U(level.facts["base"])
            here = np.minimum(here, _U(level.facts["universe"]))
            at, found = level.sequence["hash"].successor(here)
            found &= hashes[rows] - _U(level.facts["base"]) == here
            words, tokens = self.words_before[place], self.tokens_before[place]
            i = at[found]
            running = level.sequence["running"].access(np.concatenate((i, i + 1))).astype(np.int64)
            out = np.nonzero(found)[0] + rows.start
            number[out] = words + i
            before[out] = tokens + running[: len(i)]
            count[out] = running[len(i) :] - running[: len(i)]
        return number, count, before

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Kept logarithms for sorted keys (context, word); NaN where the pair is unknown."""
        out = np.full(len(keys), np.nan)
        if not len(self.first_keys):
            return out
        place = np.searchsorted(self.first_keys, keys, side="right") - 1
        for k in np.unique(place[place >= 0]):
            rows = slice(*np.searchsorted(place, [k, k + 1]))
            level = self.pair_level[int(self.pair_files[k])]
            context, word = (keys[rows] >> _U(32)).astype(np.int64) - level.facts["context"], (keys[rows] & _U(0xFFFFFFFF)).astype(np.int64)
            some = np.nonzero(context < level.facts["contexts"])[0]
            mine, again = np.unique(context[some], return_inverse=True)
            ends = level.sequence["pointer"].access(np.concatenate((mine, mine + 1))).astype(np.int64).reshape(2, -1)
            filled = ends[0][again] < ends[1][again]
            some, again = some[filled], again[filled]
            at, found = level.sequence["successor"].successor(context[some].astype(_U) * _U(self.types + 1) + word[some].astype(_U))
            found &= (at >= ends[0][again]) & (at < ends[1][again])
            out[rows.start + some[found]] = level.array["log"][at[found]] * -STEP
        return out


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word hashes in order, each word's place among them, and words per text."""
    words, lengths = words_of(texts)
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, as_bytes(coded.dictionary)), _U, len(coded.dictionary))
    distinct, place = np.unique(hashes, return_inverse=True)
    return distinct, place[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64), lengths


def _with_ends(words: np.ndarray, lengths: np.ndarray, end: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, each followed by end, and their contexts, the first of each text being start."""
    last = np.cumsum(lengths + 1) - 1
    token = np.empty(len(words) + len(lengths), np.int64)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner], token[last] = words, end
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - lengths] = start
    return token, context


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            distinct, place, lengths = _coded(part.column("text"))
            n = np.bincount(place, minlength=len(distinct))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(distinct, _U(END)).view(np.int64)), pa.array(np.append(n, len(lengths)))], ["hash", "n"])


def _word_files(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_runs(batches, "bucket"):
            buckets = rows["bucket"].to_numpy()
            for b in np.unique(buckets):
                mine = buckets == b
                hashes, n = rows["hash"].to_numpy()[mine].view(_U), rows["n"].to_numpy()[mine]
                running = np.concatenate(([0], np.cumsum(n)))
                base, universe = int(hashes[0]), int(hashes[-1] - hashes[0]) + 1
                path = f"{folder}/words-{b:08d}"
                save(path, {"hash": (hashes - hashes[0], universe), "running": (running, int(running[-1]) + 1)}, {}, {"base": base, "universe": universe})
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([int(b)], pa.int32()), "words": [len(hashes)], "tokens": [int(running[-1])]})

    return run


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts as compressed bytes: differences of keys by byte plane."""
    steps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8).T
    raw = np.ascontiguousarray(steps).tobytes() + np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(keys).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 12 * n, codec="zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(_U).reshape(-1)
    return np.cumsum(steps, dtype=_U), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").reshape(-1).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.nonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[0] if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(keys) else counts


def _pair_counts(trie: Trie, key: str, file_pairs: int):
    """Blocks of summed pairs, one for each file they belong to: the file follows from the running count of the context's tokens,
    so a context with very many tokens is spread over several files by its successors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_state(key, lambda: (trie.load(), trie)[1])
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                distinct, place, lengths = _coded(part.column("text"))
                ends = np.searchsorted(distinct, _U(END))
                distinct = np.insert(distinct, ends, _U(END))
                number, count, before = t.numbers(distinct)
                token, context = _with_ends(place + (place >= ends), lengths, ends, len(distinct))
                number, count, before = np.append(number, t.start), np.append(count, t.texts), np.append(before, t.tokens)
                seen, n = np.unique(context * len(number) + token, return_counts=True)
                u, w = seen // len(number), seen % len(number)
                keys = (number[u].astype(_U) << _U(32)) | number[w].astype(_U)
                file = ((before[u] + count[u] * (number[w] / (t.types + 1))) // file_pairs).astype(np.int64)
                order = np.argsort(keys, kind="stable")
                keys, n, file = keys[order], n[order], file[order]
                cuts = np.concatenate(([0], np.nonzero(file[1:] != file[:-1])[0] + 1, [len(file)])) if len(file) else np.zeros(1, np.int64)
                blobs = [_pack(keys[a:z], n[a:z]) for a, z in zip(cuts[:-1], cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(file[cuts[:-1]] if len(file) else np.zeros(0, np.int64)), pa.array(blobs, pa.binary())], ["file", "block"])

    return run


def _pair_files(trie: Trie, key: str, folder: str):
    def write(file: int, keys: np.ndarray, counts: np.ndarray, t: Trie) -> pa.RecordBatch:
        context, word = (keys >> _U(32)).astype(np.int64), (keys & _U(0xFFFFFFFF)).astype(np.int64)
        first, contexts = int(context[0]), int(context[-1] - context[0]) + 1
        pointer = np.searchsorted(context, np.arange(first, first + contexts + 1))
        total = np.where(context == t.start, t.texts, _counts_of(t, context))
        p = (counts + t.prior * (_counts_of(t, word) + 0.5) / (t.tokens + 0.5 * (t.types + 1))) / (total + t.prior)
        log = np.clip(np.rint(-np.log10(p) / STEP), 0, 65535).astype("<u2")
        path = f"{folder}/pairs-{file:08d}"
        relative = (context - first).astype(_U) * _U(t.types + 1) + word.astype(_U)
        save(path, {"pointer": (pointer, len(keys) + 1), "successor": (relative, contexts * (t.types + 1))}, {"log": log}, {"context": first, "contexts": contexts})
        return pa.RecordBatch.from_pydict({"first": pa.array([int(keys[0].view(np.int64))]), "file": [file]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_state(key, lambda: (trie.load(), trie)[1])
        now, keys, counts = None, np.zeros(0, _U), np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for file, block in zip(batch["file"].to_pylist(), batch["block"]):
                if file != now:
                    if now is not None:
                        yield write(now, *_summed(*map(np.concatenate, zip((keys, counts), *waiting))), t)
                    now, keys, counts, waiting = file, np.zeros(0, _U), np.zeros(0, np.int64), []
                waiting.append(_unpack(block.as_py()))
                if sum(len(k) for k, _ in waiting) > max(1_000_000, len(keys)):
                    keys, counts = _summed(*map(np.concatenate, zip((keys, counts), *waiting)))
                    waiting = []
        if now is not None:
            yield write(now, *_summed(*map(np.concatenate, zip((keys, counts), *waiting))), t)

    return run


def _counts_of(t: Trie, numbers: np.ndarray) -> np.ndarray:
    """Counts of known words by number (0 for the start of a text)."""
    distinct, again = np.unique(numbers, return_inverse=True)
    count = np.zeros(len(distinct), np.int64)
    place = np.searchsorted(t.words_before, distinct, side="right") - 1
    for k in np.unique(place[place >= 0]):
        base, running = int(t.words_before[k]), t.word_level[int(t.word_files[k])].sequence["running"]
        rows = slice(*np.searchsorted(distinct, [base, base + running.n - 1]))
        if rows.start < rows.stop:
            i = distinct[rows] - base
            both = running.access(np.concatenate((i, i + 1))).astype(np.int64)
            count[rows] = both[len(i) :] - both[: len(i)]
    return count[again]


def local_folder(spark, label: str) -> str:
    """A new folder in shared storage as a path: memory-mapped levels need the shared folder mounted on all machines."""
    where = urlparse(new_path(spark, label))
    if where.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped levels need spark.checkpoint.dir on a mounted file system, not {where.scheme}:")
    return where.path


def train(docs: DataFrame, prior: float = PRIOR, file_pairs: int = FILE_PAIRS, file_words: int = FILE_WORDS) -> Trie:
    """Count and build the levels over all rows of docs (doc_id, text); a null text is an empty one. No rows give an empty model."""
    import uuid

    spark = docs.sparkSession
    folder = local_folder(spark, "trie")
    texts = docs.select(text_of().alias("text"))
    counts = cut(texts.mapInArrow(_word_counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).filter("n > 0"), "word-counts")
    types = counts.count()
    if types >= 2**32 - 1:
        raise ValueError("words are numbered in 32 bits; this many need wider keys")
    bits = max(1, int(-(-types // file_words) - 1).bit_length())
    bucket = F.shiftrightunsigned("hash", 64 - bits).cast("int")
    dealt = counts.withColumn("bucket", bucket).repartition(2**bits, "bucket").sortWithinPartitions("bucket", "hash")
    files = sorted(dealt.mapInArrow(_word_files(folder), "bucket int, words long, tokens long").collect())  # a row a file
    words, tokens = (np.array([0, *(r[c] for r in files)], np.int64).cumsum() for c in ("words", "tokens"))
    ends = counts.filter(F.col("hash") == int(np.uint64(END).view(np.int64))).first()
    none = np.zeros(0, np.int64)
    trie = Trie(folder, bits, np.array([r.bucket for r in files], np.int64), words[:-1], tokens[:-1], int(tokens[-1]), types, int(ends.n) if ends else 0, none.astype(_U), none, prior)
    if types:
        key = uuid.uuid4().hex
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(trie.tokens + trie.texts) // (4 * file_pairs)))
        blocks = texts.mapInArrow(_pair_counts(trie, key, file_pairs), "file long, block binary").repartition(n, "file").sortWithinPartitions("file")
        made = blocks.mapInArrow(_pair_files(trie, key, folder), "first long, file long").collect()  # a row a file
        order = np.argsort(np.array([r.first for r in made], np.int64).view(_U), kind="stable")
        trie.first_keys, trie.pair_files = np.array([r.first for r in made], np.int64).view(_U)[order], np.array([r.file for r in made], np.int64)[order]
    return trie


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs under the trie."""
    import uuid

    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = worker_state(key, lambda: (trie.load(), trie)[1])
        total = t.tokens + 0.5 * (t.types + 1)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                distinct, place, lengths = _coded(part.column("text"))
                ends = np.searchsorted(distinct, _U(END))
                distinct = np.insert(distinct, ends, _U(END))
                number, count, _ = t.numbers(distinct)
                token, context = _with_ends(place + (place >= ends), lengths, ends, len(distinct))
                doc = np.repeat(np.arange(len(lengths)), lengths + 1)
                base = np.log10((count + 0.5) / total)
                pairs, again = np.unique(context * (len(distinct) + 1) + token, return_inverse=True)
                u, w = pairs // (len(distinct) + 1), pairs % (len(distinct) + 1)
                contexts, totals = np.append(number, t.start), np.append(count, t.texts)
                log = np.log10(t.prior / (totals[u] + t.prior)) + base[w]
                known = np.nonzero((contexts[u] >= 0) & (number[w] >= 0))[0]
                keys = (contexts[u[known]].astype(_U) << _U(32)) | number[w[known]].astype(_U)
                order = np.argsort(keys, kind="stable")
                kept = t.find(keys[order])
                hit = ~np.isnan(kept)
                log[known[order[hit]]] = kept[hit]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lengths + 1), pa.array(np.bincount(doc, count[token] > 0, n).astype(np.int64)), pa.array(np.bincount(doc, base[token], n)), pa.array(np.bincount(doc, log[again], n))],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def language_scores(docs: DataFrame, prior: float = PRIOR, file_pairs: int = FILE_PAIRS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    The model learns from all rows whose crc32 of the id, mod 5, is not 1; a row without an id teaches nothing and its held_out
    is null. A null text is an empty one: a single end token. Scores are sums of base-10 logarithms over a text's tokens.
    Repeated rows teach and score each by itself; a very long text is scored whole; other columns play no part; an empty table gives no rows; with nothing to
    learn from every token is unknown.
    """
    trie = train(docs.filter(fold() != 1), prior, file_pairs)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    scored = score(held, trie).withColumns({"held_out": fold() == 1, "train_tokens": F.lit(trie.tokens).cast("long")})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
