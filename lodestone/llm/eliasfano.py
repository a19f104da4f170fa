"""Elias-Fano sequences over memory-mapped words, read for many positions at once, and the files that hold them."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_BLOCK = 8  # words of 64 bits for each directory entry
_U = np.uint64


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Bits, the first lowest, as 64-bit words; a whole word of zeros follows, so that reads may run over the end."""
    padded = np.zeros((len(bits) + 63) // 64 * 64 + 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<u8")


def _word_select(words: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the set bit number r (from 0) in each word."""
    at = np.zeros(len(words), np.int64)
    r = r.astype(np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count((words >> at.astype(_U)) & _U((1 << width) - 1)).astype(np.int64)
        up = r >= low
        r -= np.where(up, low, 0)
        at += np.where(up, width, 0)
    return at


class EliasFano:
    """A non-decreasing sequence of n numbers below universe: low bits side by side, high bits in unary, and a rank directory."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(ones)) * (64 * _BLOCK) - ones.astype(np.int64)

    @staticmethod
    def arrays(values: np.ndarray, universe: int) -> tuple[dict[str, np.ndarray], dict[str, int]]:
        """What __init__ takes, for values in order: the arrays to store and the numbers n and bits."""
        values = values.astype(_U)
        n = len(values)
        bits = max(0, int(max(universe, 1) // max(n, 1)).bit_length() - 1)
        high = np.zeros(n + (universe >> bits) + 2, np.uint8)
        high[(values >> _U(bits)).astype(np.int64) + np.arange(n)] = 1
        words = pack_bits(high)
        words = np.concatenate((words, np.zeros(-len(words) % _BLOCK, "<u8")))
        counts = np.bitwise_count(words).astype(np.int64).reshape(-1, _BLOCK).sum(axis=1)
        ones = np.concatenate(([0], np.cumsum(counts))).astype(np.uint32)
        low = pack_bits(((values[:, None] >> np.arange(bits, dtype=_U)) & _U(1)).astype(np.uint8).reshape(-1)) if bits else np.zeros(1, "<u8")
        return {"low": low, "high": words, "ones": ones}, {"n": n, "bits": bits}

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), _U)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(_U)
        first, second = self.low[word] >> shift, self.low[word + 1]
        spill = np.where(shift > 0, second << ((_U(64) - shift) & _U(63)), _U(0))
        return (first | spill) & _U((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        before = self.ones if ones else self.zeros
        block = np.searchsorted(before, k, side="right") - 1
        words = self.high[block[:, None] * _BLOCK + np.arange(_BLOCK)]
        words = words if ones else ~words
        counts = np.bitwise_count(words).astype(np.int64).cumsum(axis=1)
        r = k - before[block].astype(np.int64)
        word = (counts <= r[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        r -= np.where(word > 0, counts[rows, np.maximum(word - 1, 0)], 0)
        return (block * _BLOCK + word) * 64 + _word_select(words[rows, word], r)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at positions i."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, _U)
        return ((self._select(i, True) - i).astype(_U) << _U(self.bits)) | self.lows(i)

    def successor(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each v of at most universe the first position whose number is at least v, and whether that number is v.

        Numbers that share v's high bits stand between two zeros of the unary part; their low bits are searched by halving.
        """
        v = np.asarray(v, _U)
        if not len(v):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        h = (v >> _U(self.bits)).astype(np.int64)
        at = np.zeros(len(v), np.int64)
        later = np.nonzero(h > 0)[0]
        at[later] = self._select(h[later] - 1, False) + 1 - h[later]
        end = self._select(h, False) - h
        low = v & _U((1 << self.bits) - 1)
        top = end.copy()
        live = np.nonzero(at < top)[0]
        while len(live):
            middle = (at[live] + top[live]) >> 1
            less = self.lows(middle) < low[live]
            at[live[less]] = middle[less] + 1
            top[live[~less]] = middle[~less]
            live = live[at[live] < top[live]]
        found = at < end
        found[found] = self.lows(at[found]) == low[found]
        return at, found


# --- files --------------------------------------------------------------------------------------------------------------------


def save(path: str, sequences: dict[str, tuple[np.ndarray, int]], plain: dict[str, np.ndarray], facts: dict) -> None:
    """Write sequences (values, universe) and plain arrays to one file that open_level() maps; a repeated task replaces the file whole."""
    arrays, kept = dict(plain), {}
    for name, (values, universe) in sequences.items():
        own, kept[name] = EliasFano.arrays(values, universe)
        arrays |= {f"{name}.{k}": a for k, a in own.items()}
    at, table = 0, {}
    for name, a in arrays.items():
        at = -(-at // 64) * 64
        table[name] = (at, a.dtype.str, len(a))
        at += a.nbytes
    head = json.dumps({"arrays": table, "sequences": kept, "facts": facts}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        base = f.tell()
        for name, a in arrays.items():
            f.write(b"\0" * (base + table[name][0] - f.tell()))
            f.write(np.ascontiguousarray(a).tobytes())
        f.write(b"\0" * 16)
    os.replace(temporary, path)


class Level:
    """A file of save(), memory-mapped: sequences and arrays by name, and facts."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        head = json.loads(raw[8 : 8 + size].tobytes())
        base = 8 + size
        self.facts = head["facts"]
        self.array = {n: raw[base + at : base + at + k * np.dtype(kind).itemsize].view(kind) for n, (at, kind, k) in head["arrays"].items()}
        self.sequence = {n: EliasFano(x["n"], x["bits"], *(self.array[f"{n}.{k}"] for k in ("low", "high", "ones"))) for n, x in head["sequences"].items()}
