"""Vectorised views of text batches: code points, token spans and 64-bit span hashes.

Everything here works on one bounded chunk of text at a time (``chunks``), so a
Python worker's memory does not depend on the size of its partition.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd

CHUNK_CHARS = 500_000
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)

LANES = 16  # eight bytes each; longer spans are hashed by BLAKE2


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


class _Lanes:
    """Eight bytes at a time of spans of bytes (uint8) or code points (uint32)."""

    def __init__(self, codes: np.ndarray):
        self.unit = codes.itemsize
        self.data = np.concatenate((np.ascontiguousarray(codes).view(np.uint8), np.zeros(8, np.uint8)))
        self.words = np.ndarray(((len(self.data) - 8) // self.unit + 1,), "<u8", self.data, strides=(self.unit,))

    def lane(self, starts: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
        """The k-th lane of spans of ``sizes`` bytes (over 8 k), with zeros beyond their ends."""
        out = self.words[starts + k * (8 // self.unit)]
        short = np.maximum(0, 8 * (k + 1) - sizes).astype(np.uint64) * np.uint64(8)
        return out << short >> short

    def bytes(self, start: int, size: int) -> bytes:
        return self.data[start * self.unit : start * self.unit + size].tobytes()


def trim() -> None:
    """Gives freed memory back to the system, as workers are used again by tasks of other stages."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end]; equal spans hash alike wherever they stand."""
    lanes, sizes = _Lanes(codes), (ends - starts) * codes.itemsize
    out = mix64(sizes.astype(np.uint64) + _STEP)
    live = np.flatnonzero(sizes > 0)
    for k in range(LANES):
        if not len(live):
            return out
        out[live] = mix64((out[live] ^ lanes.lane(starts[live], sizes[live], k)) * _STEP + np.uint64(k))
        live = live[sizes[live] > 8 * (k + 1)]
    for i in live.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(lanes.bytes(int(starts[i]), int(sizes[i])), digest_size=8).digest(), "little")
    return out


def distinct_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each span the number of its content, and of each content a span. Equal hashes are checked on the content."""
    which, hashes = pd.factorize(span_hashes(codes, starts, ends))
    shown = np.zeros(len(hashes), np.int64)
    shown[which[::-1]] = np.arange(len(which))[::-1]
    lanes, sizes, like = _Lanes(codes), (ends - starts) * codes.itemsize, shown[which]
    odd = sizes != sizes[like]
    live = np.flatnonzero(~odd & (like != np.arange(len(which))) & (sizes > 0))
    for k in range(LANES):
        other = like[live]
        wrong = lanes.lane(starts[live], sizes[live], k) != lanes.lane(starts[other], sizes[other], k)
        odd[live[wrong]] = True
        live = live[~wrong & (sizes[live] > 8 * (k + 1))]
    whole = lambda i: lanes.bytes(int(starts[i]), int(sizes[i]))
    for i in live.tolist():
        odd[i] = whole(i) != whole(like[i])
    if odd.any():  # other contents of the same hash get numbers of their own
        which, more = which.copy(), {}
        for i in np.flatnonzero(odd).tolist():
            number, _ = more.setdefault(whole(i), (len(hashes) + len(more), i))
            which[i] = number
        shown = np.concatenate((shown, [i for _, i in more.values()]))
    return which, shown


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most ``most`` characters together, or one row."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and held + n > most:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) UTF-8 bytes of the texts, and their words' starts, ends and first word of each text.

    Words are the longest runs without blanks (``BLANKS``). The last array has one entry more than there are texts.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    codes = LOWER[np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)]
    blank = BLANKS[codes]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    bounds = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=bounds[1:])
    return codes, starts, ends, np.searchsorted(starts, bounds)


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = SPACE
    return table


def code_points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts joined, their code points, and bounds (one entry more than there are texts)."""
    joined = "".join(texts)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), bounds


def pretokens(points: np.ndarray, bounds: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a byte-pair vocabulary.

    ``spaces`` true: a pre-token may begin with one space, and white space makes
    pre-tokens of its own. False: white space only separates, and each number
    character stands alone. English contraction endings are split off in both.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    turn = first[:n].copy()
    turn[1:] |= kind[1:] != kind[:-1]
    solid = kind != SPACE
    same = np.zeros(n, bool)  # the next character is of the same text
    same[:-1] = ~first[1:n]
    if spaces:
        last = np.zeros(n, bool)  # white space just before something solid
        last[:-1] = ~solid[:-1] & solid[1:] & same[:-1]
        begin = turn | last
        joins = last & (points == 32)
        begin[1:] &= ~(solid[1:] & joins[:-1])
    else:
        begin = (turn | (kind == NUMBER)) & solid
    for p in np.flatnonzero((points == 39) & begin):
        if not same[p]:
            continue
        size = 2 if chr(points[p + 1]) in "stmd" else 3 if same[p + 1] and chr(points[p + 1]) + chr(points[p + 2]) in ("re", "ve", "ll") else 0
        if size:
            begin[p + 1 : p + size] = False
            if same[p + size - 1] and solid[p + size]:
                begin[p + size] = True
    starts = np.flatnonzero(begin)
    stop = begin | first[:n] if spaces else begin | first[:n] | ~solid
    stops = np.append(np.flatnonzero(stop), n)
    return starts, stops[np.searchsorted(stops, starts, side="right")]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start..start+count-1 of each pair, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)
