"""Elias-Fano sequences over memory-mapped arrays, queried many at a time.

A sorted sequence of n numbers below u keeps the lower l = log2(u / n) bits of each number packed, and the upper bits in
unary: number j with upper part h sets bit h + j, so the zeros end the groups of equal upper parts. The position of every
eighth zero (for searches) or one (for reading by position) is kept as well; from there the place is found by looking at a
few machine words. Where the next seven stand far away, as in the dense stretch of a very common context, their
positions are written out.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

_ONE = np.uint64(1)
_SAMPLE = 8
_FAR = 256  # bits between kept places beyond which the places between are written out


def save(path: str, arrays: dict[str, np.ndarray], meta: dict) -> None:
    """One file: a header line, then the arrays; complete or absent, whatever happens to the task."""
    places, at = {}, 0
    for name, a in arrays.items():
        places[name] = (a.dtype.str, len(a), at)
        at += -(-(a.nbytes + 8) // 8) * 8  # eight bytes to spare: words are read at any byte
    head = json.dumps({"arrays": places, "meta": meta}).encode()
    head += b" " * (-(len(head) + 8) % 8)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-(-(a.nbytes + 8) // 8) * 8 - a.nbytes))
    os.replace(temporary, path)


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    whole = np.memmap(path, np.uint8, "r")
    n = int.from_bytes(whole[:8].tobytes(), "little")
    head = json.loads(whole[8 : 8 + n].tobytes())
    arrays = {}
    for name, (kind, count, at) in head["arrays"].items():
        start, kind = 8 + n + at, np.dtype(kind)
        arrays[name] = whole[start : start + count * kind.itemsize].view(kind)
        arrays[f"{name}+"] = whole[start : start + count * kind.itemsize + 8]  # with the spare bytes
    return arrays, head["meta"]


def _words(raw: np.ndarray) -> np.ndarray:
    """The 64-bit word that starts at each byte."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", buffer=raw.data if isinstance(raw, np.memmap) else raw, strides=(1,))


def encode(name: str, values: np.ndarray, universe: int, by_position: bool = False) -> tuple[dict[str, np.ndarray], dict]:
    """Arrays and numbers that describe sorted ``values`` (repeats allowed) below ``universe``; for ``find`` or for ``get``."""
    n = len(values)
    v = values.astype(np.uint64)
    low = max(0, int(max(universe, 1) // max(n, 1)).bit_length() - 1)
    top = (v >> np.uint64(low)).astype(np.int64)
    groups = (int(universe) >> low) + 1
    bits = np.zeros(n + groups + 64, np.uint8)
    bits[top + np.arange(n)] = 1
    upper = np.packbits(bits, bitorder="little")
    places = np.nonzero(bits[: n + groups] == by_position)[0]
    kept = places[::_SAMPLE]
    far = np.nonzero(np.diff(kept, append=n + groups) > _FAR)[0]
    between = np.minimum(far[:, None] * _SAMPLE + np.arange(_SAMPLE), max(len(places) - 1, 0))
    packed = np.zeros(0, np.uint8)
    if low and n:
        part = v & np.uint64((1 << low) - 1)
        chunk, out = 1 << 15, []  # a multiple of eight numbers fills whole bytes
        for at in range(0, n, chunk):
            some = part[at : at + chunk]
            planes = ((some[:, None] >> np.arange(low, dtype=np.uint64)) & _ONE).astype(np.uint8)
            out.append(np.packbits(planes.reshape(-1), bitorder="little"))
        packed = np.concatenate(out)
    place = np.uint32 if n + groups < 1 << 32 else np.uint64
    return {f"{name}.low": packed, f"{name}.up": upper,
        f"{name}.kept": kept.astype(place),
        f"{name}.far": far.astype(np.int64), f"{name}.between": places[between].astype(place).reshape(-1)}, {"n": n, "l": low, "u": int(universe)}


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray], name: str, meta: dict):
        self.n, self.l, self.u = meta["n"], meta["l"], meta["u"]
        self.low, self.up, self.kept = _words(arrays[f"{name}.low+"]), _words(arrays[f"{name}.up+"]), arrays[f"{name}.kept"]
        self.far, self.between = arrays[f"{name}.far"], arrays[f"{name}.between"]

    def _select(self, q: np.ndarray, flip: bool) -> np.ndarray:
        """Position of one number q among the upper bits; with ``flip`` of zero number q."""
        block, left = q // _SAMPLE, q % _SAMPLE
        at = self.kept[block].astype(np.int64)
        out = at.copy()
        todo = np.nonzero(left)[0]
        if len(self.far):
            k = np.minimum(np.searchsorted(self.far, block[todo]), len(self.far) - 1)
            written = self.far[k] == block[todo]
            some = todo[written]
            out[some] = self.between[k[written] * _SAMPLE + left[some]]
            todo = todo[~written]
        at, left = at[todo] + 1, left[todo]
        while len(todo):
            shift = at & 7
            word = self.up[at >> 3]
            x = (~word if flip else word) >> shift.astype(np.uint64)  # the word from bit ``at`` on; 64 - shift bits of it
            have = np.bitwise_count(x).astype(np.int64)
            done = have >= left
            y, r = x[done], left[done]
            for i in range(1, _SAMPLE):
                y = np.where(r > i, y & (y - _ONE), y)
            out[todo[done]] = at[done] + np.bitwise_count((y & (~y + _ONE)) - _ONE)
            rest = ~done
            todo, at, left = todo[rest], at[rest] + 64 - shift[rest], left[rest] - have[rest]
        return out

    def _lows(self, j: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(j), np.uint64)
        bit = j * self.l
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.l) - 1)

    def group(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index range [a, b) of the numbers whose upper part is h: the ones between two zeros."""
        zero = np.where(h > 0, self._select(np.maximum(h - 1, 0), True), -1)
        at = zero + 1
        shift = at & 7
        x = ~self.up[at >> 3] >> shift.astype(np.uint64)  # the next zero is mostly in the word behind
        ones = np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)
        long = np.nonzero(x == 0)[0]
        if len(long):
            ones[long] = self._select(h[long], True) - at[long]
        begin = at - h
        return begin, begin + ones

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of a number that equals ``value``, or -1; by successor search inside its group."""
        value = value.astype(np.int64)
        out = np.full(len(value), -1, np.int64)
        if not self.n:
            return out
        want = value.astype(np.uint64) & np.uint64((1 << self.l) - 1)
        a, b = self.group(value >> self.l)
        who = np.nonzero(a < b)[0]
        lo, hi, want = a[who], b[who], want[who]
        low = self._lows(lo)  # most groups hold a number or two
        same = low == want
        out[who[same]] = lo[same]
        more = (low < want) & (hi - lo > 1)
        who, lo, hi, want = who[more], lo[more] + 1, hi[more], want[more]
        while len(who):
            mid = (lo + hi) >> 1
            low = self._lows(mid)
            same = low == want
            out[who[same]] = mid[same]
            under = low < want
            lo, hi = np.where(under, mid + 1, lo), np.where(under, hi, mid)
            more = ~same & (lo < hi)
            who, lo, hi, want = who[more], lo[more], hi[more], want[more]
        return out

    def get(self, j: np.ndarray) -> np.ndarray:
        """The numbers at positions j."""
        return ((self._select(j, False) - j) << self.l) + self._lows(j).astype(np.int64)
