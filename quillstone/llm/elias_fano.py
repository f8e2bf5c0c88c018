"""Elias-Fano sequences in numpy: monotone integers in about 3 + log2(u / n) bits each, over memory-mapped words.

Queries are arrays; ``at`` selects ones of the upper bits, ``find`` the zeros that bound the run of equal upper bits and
then bisects the run's lower bits.  A directory holds the ones and zeros before each word of upper bits; inside a word
bits are selected by byte sums in one register.
"""

from __future__ import annotations

import json

import numpy as np

_SEL8 = np.array([[[b for b in range(8) if i >> b & 1][k] if k < bin(i).count("1") else 0 for k in range(8)] for i in range(256)], np.uint8).ravel()
SLICE = 1 << 18
_U = np.uint64
_ONES = _U(0x0101010101010101)
_TOPS = _U(0x8080808080808080)


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th (from 0) one of each word."""
    s = x - (x >> _U(1) & _U(0x5555555555555555))
    s = (s & _U(0x3333333333333333)) + (s >> _U(2) & _U(0x3333333333333333))
    s = (s + (s >> _U(4)) & _U(0x0F0F0F0F0F0F0F0F)) * _ONES  # byte i: ones in bytes 0 to i
    whole = ((r * _ONES | _TOPS) - s & _TOPS) >> _U(7)  # bytes whose sum is r or less
    shift = (whole * _ONES >> _U(56)) << _U(3)
    r = r - ((s << _U(8)) >> shift & _U(255))
    return shift + _SEL8[(x >> shift & _U(255)) << _U(3) | r]


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Positions of the k-th (from 0) ones, or zeros, of a bit sequence."""
    word = np.searchsorted(before, k.astype(before.dtype), "right") - 1
    w = words[word]
    return (word << 6) + _select_in_word(~w if zeros else w, (k - before[word]).astype(_U)).astype(np.int64)


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> "EliasFano":
        """values: uint64, not falling."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        l = max(0, (last // max(1, n)).bit_length() - 1) if n else 0
        size = ((last >> l) + n + 1 + 64) // 64 * 64
        bits = np.zeros(size, bool)
        low = np.zeros(n * l // 64 + 2, np.uint64)
        for i in range(0, n, SLICE):  # SLICE values fill whole words of lower bits
            part = values[i : i + SLICE]
            bits[(part >> np.uint64(l)).astype(np.int64) + np.arange(i, i + len(part))] = True
            if l:
                part = part & np.uint64((1 << l) - 1)
                at = np.arange(i, i + len(part), dtype=np.int64) * l
                word, off = at >> 6, (at & 63).astype(np.uint64)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                low[word[first]] |= np.bitwise_or.reduceat(part << off, first)
                over = np.flatnonzero(off + np.uint64(l) > 64)  # one a word at most
                low[word[over] + 1] |= part[over] >> (np.uint64(64) - off[over])
        high = np.packbits(bits, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])[:-1]
        zeros = np.arange(len(high), dtype=np.int64) * 64 - ones
        kind = np.uint32 if size < 1 << 32 else np.uint64
        return cls(n, l, low, high, ones.astype(kind), zeros.astype(kind))

    def _low(self, i: np.ndarray) -> np.ndarray:
        l = self.low_bits
        if not l:
            return np.zeros(len(i), np.uint64)
        at = i * l
        word, off = at >> 6, (at & 63).astype(np.uint64)
        return (self.low[word] >> off | self.low[word + 1] << np.uint64(1) << np.uint64(63) - off) & np.uint64((1 << l) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        upper = (_select(self.high, self.ones, i, False) - i).astype(np.uint64)
        return upper << np.uint64(self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All values, read in order."""
        out = np.empty(self.n, np.uint64)
        upper = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little"))
        for i in range(0, self.n, SLICE):
            k = np.arange(i, min(self.n, i + SLICE))
            out[k] = (upper[k] - k).astype(np.uint64) << np.uint64(self.low_bits) | self._low(k)
        return out

    def two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at i and at i + 1, by one selection where both lie in one word."""
        i = np.asarray(i, np.int64)
        bit = _select(self.high, self.ones, i, False)
        rest = self.high[bit >> 6] >> (bit & 63).astype(np.uint64) >> np.uint64(1)
        after = bit + 1 + np.bitwise_count(~rest & rest - np.uint64(1))
        far = np.flatnonzero(rest == 0)
        after[far] = _select(self.high, self.ones, i[far] + 1, False)
        shift = np.uint64(self.low_bits)
        return (bit - i).astype(np.uint64) << shift | self._low(i), (after - i - 1).astype(np.uint64) << shift | self._low(i + 1)

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The index in [begin, end) of each x, or -1."""
        x = np.asarray(x, np.uint64)
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        most = int(self.at(np.array([self.n - 1]))[0] >> np.uint64(self.low_bits))
        inside = h <= most
        h = np.minimum(h, most)
        bit = np.where(h > 0, _select(self.high, self.zeros, np.maximum(h - 1, 0), True) + 1, 0)  # where the run of ones begins
        lo = bit - h
        word, off = bit >> 6, (bit & 63).astype(np.uint64)
        seen = self.high[word] >> off | self.high[np.minimum(word + 1, len(self.high) - 1)] << np.uint64(1) << np.uint64(63) - off
        run = np.bitwise_count(seen & ~(seen + np.uint64(1))).astype(np.int64)
        hi = lo + run
        long = np.flatnonzero(run >= 64 - off.astype(np.int64))
        hi[long] = _select(self.high, self.zeros, h[long], True) - h[long]
        a = np.maximum(lo, begin)
        hi = np.minimum(hi, self.n if end is None else end)
        want = x & np.uint64((1 << self.low_bits) - 1)
        b = hi.copy()
        go = np.flatnonzero(b - a > 1)
        while len(go):  # a ends at the last value that isn't above x
            mid = (a[go] + b[go]) >> 1
            above = self._low(mid) > want[go]
            a[go] = np.where(above, a[go], mid)
            b[go] = np.where(above, mid, b[go])
            go = go[b[go] - a[go] > 1]
        k = np.flatnonzero(inside & (a < hi))
        out = np.full(len(x), -1, np.int64)
        k = k[self._low(a[k]) == want[k]]
        out[k] = a[k]
        return out

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        return {f"{name}.shape": np.array([self.n, self.low_bits]), f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, held: dict[str, np.ndarray], name: str) -> "EliasFano":
        n, l = (int(v) for v in held[f"{name}.shape"])
        return cls(n, l, *(held[f"{name}.{part}"] for part in ("low", "high", "ones", "zeros")))


def packed_run(values: np.ndarray) -> bytes:
    """Sorted uint64 values as one Elias-Fano block for sequential reading: lower bits are whole bytes."""
    n = len(values)
    base, span = (int(values[0]), int(values[-1]) - int(values[0])) if n else (0, 0)
    low = min(range(9), key=lambda b: n * b + ((span >> 8 * b) + n) / 8)
    rest = values - np.uint64(base)
    upper = (rest >> np.uint64(8 * low) if low < 8 else np.zeros(n, np.uint64)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(upper[-1]) + 1 if n else 0, bool)
    bits[upper] = True
    head = np.array([n, low, base], np.uint64).tobytes()
    return head + np.ascontiguousarray(rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low]).tobytes() + np.packbits(bits, bitorder="little").tobytes()


def unpacked_run(block: bytes) -> np.ndarray:
    n, low, base = (int(x) for x in np.frombuffer(block, np.uint64, 3))
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :low] = np.frombuffer(block, np.uint8, n * low, 24).reshape(n, low)
    upper = np.flatnonzero(np.unpackbits(np.frombuffer(block, np.uint8, -1, 24 + n * low), bitorder="little")) - np.arange(n)
    return rest.view("<u8")[:, 0] + (upper.astype(np.uint64) << np.uint64(8 * low) if low < 8 else np.uint64(0)) + np.uint64(base)


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block: length of the header, header (JSON), arrays at multiples of 8 bytes."""
    head, parts, at = {}, [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[name] = [a.dtype.str, list(a.shape), at]
        parts += [raw, b"\0" * (-len(raw) % 8)]
        at += len(raw) + -len(raw) % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(parts)


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of ``packed``, memory-mapped."""
    whole = np.memmap(path, np.uint8, "r")
    size = int(whole[:8].view("<u8")[0])
    start = 8 + size
    out = {}
    for name, (kind, shape, at) in json.loads(bytes(whole[8:start])).items():
        count = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.asarray(whole[start + at : start + at + count].view(kind).reshape(shape)) if count else np.zeros(shape, kind)
    return out
