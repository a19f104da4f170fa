"""Packing token sequences by minimum bin slack.

Every document's ids are cut at multiples of the window: full windows and one remainder. Only the histogram of remaining
lengths, at most one count per length, reaches the driver. There a bitset subset-sum dynamic program, in which bit s of an integer says
that a fill of s tokens can be reached, finds for the longest remaining length the multiset that fills the window closest to
capacity; the fill is traced back to counts per length and used as often as the counts allow. Pieces are then numbered within their
length and look up their place, so the plan's size depends on the window and not on the number of documents.
"""

from __future__ import annotations

import gc
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import as_strings, cut, load_tokenizer, slices, text_of, worker_state

#: Fixed value: the id that ends a document.
END_ID = 2
WINDOW = 4096


# --- ids ----------------------------------------------------------------------------------------------------------------------


#: What a word consists of for the tokenizer once it is in lower case and white space is gone: the reading of its split pattern.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

_MARKS = frozenset(".,;:!?")
#: Characters below U+0250 that send a stretch to the tokenizer as it is: white space beyond ASCII, and the dotted capital I.
_WHOLE = frozenset("\x85\xa0\u0130")


class WordIds:
    """Ids of texts for a tokenizer that drops white space and marks the last token of each word.

    Each stretch between ASCII white space is looked up in a bounded cache; unknown ones of Latin letters are cut into words, and unknown
    words encoded together in one string, whose ids part again at the marked ends. Other stretches go to the tokenizer as they are.
    """

    def __init__(self, config: str, room: int):
        facts = json.loads(config)
        kinds = json.dumps(facts["pre_tokenizer"])
        assert '"Removed"' in kinds and "\\\\s" in kinds, "the tokenizer must drop white space between words"
        self.special = [t["content"] for t in facts.get("added_tokens") or []]
        suffix = facts["model"].get("end_of_word_suffix")
        vocabulary = facts["model"]["vocab"]
        self.last = np.zeros(max([*vocabulary.values(), 0]) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.tokenizer, self.room, self.stretches, self.words = load_tokenizer(config), room, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        return out

    def learn_words(self, words: list[str]) -> None:
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.nonzero(self.last[ids])[0] + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                raw, ends = ids.tobytes(), (ends * 4).tolist()
                self.words.update((w, raw[a:z]) for w, a, z in zip(some, [0, *ends], ends))
            else:
                self.words.update(zip(some, self.encode(some)))

    def learn(self, unseen: list[str]) -> None:
        ones, marked, cut_up, odd = [], [], [], []  # a word; a word and a mark; anything else to be cut; what the tokenizer cuts itself
        together = "\n".join(unseen)
        special = [x for x in self.special if x in together]
        for s in unseen if self.joins else ():
            # below U+0250 lower case and composition are the same for every version of Unicode and letter by letter, but for a capital I with
            # a dot: its lower case ends in a combining dot, which is no letter and joins the mark after it
            if not s.isascii() and (max(s) >= "\u0250" or not _WHOLE.isdisjoint(s)) or special and any(x in s for x in special):
                odd.append(s)
            elif s.isalpha():
                ones.append(s)
            elif s[-1:] in _MARKS and s[:-1].isalpha():
                marked.append(s)
            else:
                cut_up.append((s, _PARTS.findall(s.lower())))
        odd = odd if self.joins else unseen
        low, bare = [s.lower() for s in ones], [s[:-1].lower() for s in marked]
        every = set(low).union(bare, (s[-1] for s in marked), *(parts for _, parts in cut_up))
        new = list(every.difference(self.words))
        if len(self.words) + len(new) > self.room:
            self.words, new = {}, list(every)
        self.learn_words(new)
        get = self.words.__getitem__
        self.stretches.update(zip(ones, map(get, low)))
        self.stretches.update((s, get(w) + get(s[-1])) for s, w in zip(marked, bare))
        self.stretches.update((s, b"".join(map(get, parts))) for s, parts in cut_up)
        self.stretches.update(zip(odd, self.encode(odd)))

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the texts one after another, end after each, and how many each text has."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        words = as_strings(coded.dictionary)
        unseen = [w for w in words if w not in self.stretches]
        if len(self.stretches) + len(unseen) > self.room:
            self.stretches, unseen = {}, words
        self.learn(unseen)
        blobs = [self.stretches[w] for w in words]
        pool = np.frombuffer(b"".join(blobs), "<u4")
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        begin = np.cumsum(size) - size
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = size[at]
        doc = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
        lengths = np.bincount(doc, n, minlength=len(texts)).astype(np.int64) + 1
        last = np.cumsum(lengths) - 1
        place = np.ones(int(lengths.sum()), bool)
        place[last] = False
        ids = np.empty(len(place), "<u4")
        ids[last] = end
        ends = np.cumsum(n)
        ids[place] = pool[np.repeat(begin[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, lengths


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END_ID, room: int = 500_000, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): every document's ids and its end id, cut at multiples of window."""
    with open(tokenizer_path, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast(f.read())

    run_key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # hundreds of thousands of live strings and no cycles
        encode = worker_state(run_key, lambda: WordIds(config.value, room))
        for batch in batches:
            for part in slices(batch, "text"):
                ids, lengths = encode(part.column("text"), end)
                n = -(-lengths // window)
                doc = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
                size = np.minimum(window, lengths[doc] - start)
                at = np.repeat(np.cumsum(lengths) - lengths, n) + start
                crc = np.fromiter((zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), size.tolist())), np.int64, len(at))
                out = [part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(crc), pa.array(lengths[doc])]
                if keep_ids:  # pieces lie one after another
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(out)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * keep_ids)


# --- the plan -----------------------------------------------------------------------------------------------------------------


def fullest(counts: dict[int, int], anchor: int, order: list[int], window: int) -> dict[int, int]:
    """The multiset with one anchor whose sum is closest to window, as counts per length; lengths are tried in the given order."""
    room = window - anchor
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in order:
        if length > room or reach >> room & 1:
            continue
        have = min(counts[length] - (length == anchor), room // length)
        k = 1
        while have > 0 and not reach >> room & 1:  # counts 1, 2, 4, ... and the rest reach every number up to have
            k_now = min(k, have)
            wider = (reach | reach << (k_now * length)) & mask
            if wider != reach:
                steps.append((length, k_now, reach))
                reach = wider
            have -= k_now
            k *= 2
    fill = reach.bit_length() - 1
    used = {anchor: 1}
    for length, k, before in reversed(steps):
        if not before >> fill & 1:
            fill -= k * length
            used[length] = used.get(length, 0) + k
    return used


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(times, counts per length) of every kind of sequence, until no length is left."""
    left = {k: v for k, v in counts.items() if v}
    out = []
    order = sorted(left, reverse=True)
    while left:
        order = [k for k in order if k in left]
        used = fullest(left, order[0], order, window)
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def places(kinds: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first number, number per sequence, first sequence, first offset), sorted: where the pieces of each length go."""
    rows, used_up, sequence = [], {}, 0
    for times, used in kinds:
        offset = 0
        for length in sorted(used, reverse=True):
            rows.append((length, used_up.get(length, 0), used[length], sequence, offset))
            used_up[length] = used_up.get(length, 0) + times * used[length]
            offset += length * used[length]
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end: int = END_ID, keep_ids: bool = False, room: int = 500_000) -> DataFrame:
    """pieces() with sequence_id (gapless from 0) and offset (gapless from 0 within it): each id lies in exactly one piece.

    A null text is an empty one and makes a piece of the end id alone. Repeated rows and null ids are packed like any others, an
    empty table gives no rows, and other columns play no part. A very long text becomes many pieces, and equal pieces are told apart by their numbers. Lengths that
    many pieces share are numbered in parts, so that no task gathers them all. keep_ids adds the ids themselves; room is how many words and
    stretches of text a worker remembers, about 200 bytes each.
    """
    spark = docs.sparkSession
    # equal rows differ in copy only, which is written with them and so stays: a crowd of them is dealt out like any other
    cut_up = cut(pieces(docs, tokenizer_path, window, end, room, keep_ids).withColumn("copy", F.monotonically_increasing_id()), "pieces")
    counts = {int(r.length): int(r.n) for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    total, width = sum(counts.values()), int(spark.conf.get("spark.sql.shuffle.partitions"))
    cap = max(32, total // (2 * width))
    parts = {k: -(-n // cap) for k, n in counts.items() if n > cap}  # at most 2 * width lengths
    split = F.coalesce(F.create_map(*[F.lit(int(x)) for kv in sorted(parts.items()) for x in kv])[F.col("length")], F.lit(1)) if parts else F.lit(1)
    dealt = cut_up.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), split).cast("int"))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most window + 2 * width rows
    before = sizes.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32", "copy"))
    numbered = dealt.withColumn("nth", nth).join(F.broadcast(before), ["length", "part"]).withColumn("number", F.col("before") + F.col("nth") - 1)
    where = spark.sparkContext.broadcast(places(plan(counts, window)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = where.value
        key = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            row = table[np.searchsorted(key, (length << 48) + number, side="right") - 1]
            k = number - row[:, 1]
            columns = {c: batch.column(c) for c in names}
            columns |= {"sequence_id": pa.array(row[:, 3] + k // row[:, 2]), "offset": pa.array(row[:, 4] + k % row[:, 2] * length)}
            yield pa.RecordBatch.from_pydict(columns)

    names = [n for n in cut_up.columns if n != "copy"]
    schema = ", ".join(f"{n} {t}" for n, t in cut_up.dtypes if n != "copy") + ", sequence_id bigint, offset bigint"
    return numbered.select(*names, "number").mapInArrow(run, schema)
