"""Exact token counts of a byte-level BPE tokenizer without encoding most of the text.

A text is split into the tokenizer's pre-tokens; a pre-token's number of tokens never depends on its neighbours. Lengths come from a
broadcast table of frequent pre-tokens and, for the rest, from a bounded cache in each Python worker, whose misses are
encoded together. Everything happens where the rows lie: no pre-token is ever shuffled. The table is drawn from a bounded sample of
texts and decides only how often the second tier is asked, never a result.
"""

from __future__ import annotations

import gc
import json
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_strings, load_tokenizer, slices, text_of, worker_state

#: Fixed value: how byte-level BPE cuts a text, with white space as Unicode defines it.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: ASCII white space, and what Unicode counts as white space beyond it.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Marks that are a pre-token of their own after a letter, and the first character without a meaning in Unicode.
_MARKS = frozenset(".,;:!?")
_FIRST_UNASSIGNED = "\u0378"


class PreTokenLengths:
    """Two tiers of lengths for one tokenizer: a fixed table, and a cache of at most room entries above it.

    A batch is cut at ASCII white space first and each distinct stretch (a word, with the space before it if there is one) is looked up
    once. Texts that can't be cut reliably are encoded whole: those with a special token's string, with
    white space beyond ASCII, or with characters younger than this Python's Unicode.
    """

    def __init__(self, config: str, table: dict[str, int], room: int):
        self.tokenizer, self.table, self.room = load_tokenizer(config), table, room
        self.special = [t["content"] for t in json.loads(config).get("added_tokens") or []]
        self.split = regex.compile(PRE_TOKEN).findall
        self.known = dict(table)
        self.single = np.array([len(self.whole(chr(c))) if c < 128 else 0 for c in range(256)])

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut_up(self, stretch: str) -> list[str]:
        """Pre-tokens of a stretch; the commonest forms, a word of letters with or without a mark after it, need no pattern."""
        bare = stretch[1:] if stretch[0] == " " else stretch
        if bare.isalpha():
            return [stretch]
        if bare[-1:] in _MARKS and bare[:-1].isalpha():
            return [stretch[:-1], stretch[-1]]
        return self.split(stretch)

    def lengths(self, stretches: list[str]) -> np.ndarray:
        """Tokens of each stretch, -1 where it can't be cut reliably."""
        parts = [self.cut_up(s) for s in stretches]
        every = set().union(*parts)
        unseen = list(every.difference(self.known))
        if len(self.known) + len(unseen) > len(self.table) + self.room:
            self.known = dict(self.table)
            unseen = list(every.difference(self.known))
        odd = {p for p in unseen if not p.isascii() and max(p) >= _FIRST_UNASSIGNED and any(unicodedata.category(c) == "Cn" for c in p)}
        unseen = [p for p in unseen if p not in odd] if odd else unseen
        for at in range(0, len(unseen), 4096):
            part = unseen[at : at + 4096]
            self.known.update(zip(part, (len(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        get = self.known.__getitem__
        if odd:
            return np.fromiter((sum(map(get, p)) if odd.isdisjoint(p) else -1 for p in parts), np.int64, len(parts))
        return np.fromiter((sum(map(get, p)) for p in parts), np.int64, len(parts))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text of an array without nulls."""
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(n, np.int64)
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True  # a text begins here, or ended just before
        space = _SPACE[data]
        edge = np.concatenate(([True], space[1:] != space[:-1])) | begins[:-1]
        start = np.nonzero(edge)[0]
        stop = np.append(start[1:], len(data))
        gap = space[start]
        doc = np.searchsorted(offsets, start, side="right") - 1

        word_at, word_doc = start[~gap], doc[~gap]
        words = pc.ascii_split_whitespace(texts).flatten()
        words = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
        spaced = (data[np.maximum(word_at - 1, 0)] == 32) & ~begins[word_at]
        keys, again = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + spaced, return_inverse=True)
        names = as_strings(words.dictionary)
        size = self.lengths([" " + names[k >> 1] if k & 1 else names[k >> 1] for k in keys.tolist()])[again] if len(keys) else np.zeros(0, np.int64)
        total = np.bincount(word_doc, np.maximum(size, 0), minlength=n).astype(np.int64)

        a, z, d = start[gap], stop[gap], doc[gap]
        last = data[z - 1]
        final = begins[z]
        loose = ~final & (last != 32)  # the last character before a word stands alone unless it is a space
        total += np.bincount(d[loose], self.single[last[loose]], minlength=n).astype(np.int64)
        long = np.nonzero(final | (z - a > 1))[0]
        runs = [data[a[i] : z[i] - (not final[i])].tobytes().decode() for i in long]
        if runs:
            total += np.bincount(d[long], self.lengths(runs), minlength=n).astype(np.int64)
        whole = np.zeros(n, bool)
        whole[word_doc[size < 0]] = True
        for pattern in self.special:
            whole |= pc.match_substring(texts, pattern).to_numpy(zero_copy_only=False)
        whole |= pc.match_substring_regex(texts, _WIDE_SPACE).to_numpy(zero_copy_only=False)
        for i in np.nonzero(whole)[0]:
            total[i] = len(self.whole(texts[int(i)].as_py()))
        return total


def frequent(docs: DataFrame, config, size: int, sample: int, most_bytes: int = 1 << 16) -> dict[str, int]:
    """Lengths of the size commonest pre-tokens of about sample distinct texts of at most most_bytes each, chosen by a hash; twice as many at most.

    One task counts them, so it reads 2 * sample * most_bytes bytes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        split = regex.compile(PRE_TOKEN).findall
        for batch in batches:
            for text in batch.column("text"):
                counts.update(split(text.as_py()))
            if len(counts) > 8 * size:
                counts = Counter(dict(counts.most_common(4 * size)))
        top = [p for p, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size] if not any(unicodedata.category(c) == "Cn" for c in p)]
        lengths = [len(e.ids) for e in load_tokenizer(config.value).encode_batch(top, add_special_tokens=False)] if top else []
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(lengths, pa.int64())], ["p", "n"])

    one_in = max(1, docs.count() // sample)
    short = docs.select("text", F.xxhash64("text").alias("h")).filter((F.octet_length("text") <= most_bytes) & (F.pmod("h", F.lit(one_in)) == 0))
    few = short.groupBy("h").agg(F.first("text").alias("text")).limit(2 * sample).select("text").coalesce(1)
    got = few.mapInArrow(run, "p string, n long").toArrow()
    return dict(zip(got["p"].to_pylist(), got["n"].to_pylist()))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, table_size: int = 16_384, sample: int = 2_000, room: int = 1_000_000) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the tokenizers library counts without added special tokens.

    tokenizer_path names a byte-level BPE file in JSON; it is read on the driver and broadcast. A null text counts as empty:
    no bytes, no tokens. Repeated rows give repeated results, an empty table none; other columns play no part. A very long text is counted
    whole, in a slice of its own; a null id stays null. over_limit: more than limit tokens.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    with open(tokenizer_path, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())
    run_key = uuid.uuid4().hex
    table = spark.sparkContext.broadcast(frequent(rows, config, table_size, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # hundreds of thousands of live strings and no cycles
        lengths = worker_state(run_key, lambda: PreTokenLengths(config.value, table.value, room))
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                n = pa.array(lengths.counts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.withColumn("n_bytes", F.octet_length("text").cast("long")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
