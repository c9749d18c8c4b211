"""All maximal repetitions of words, and texts without their repeats.

A run is a stretch of words with smallest period q (words q apart are equal), at
least ``LEAST`` words and two periods long, that no neighbouring word extends. Runs
are found by the longest-previous-factor variant of Main's method:

1. ranks of all stretches of 1, 2, 4, .. words give the suffix array, the common
   prefixes of its neighbours (LCP) and of any two positions;
2. a stack over suffix array and LCP gives for every position the longest factor
   that begins earlier too (LPF) and where; these factors cut the text into blocks;
3. a run that touches a block's edge is found at that edge: for each period that
   the blocks beside it allow, extensions to both sides are compared with the period;
4. a run strictly inside a block is a copy of one in the block's source, so runs
   are kept in buckets by their first word and copied in order, block by block.

A run of at least 12 words repeats six consecutive words, so texts without such a
repeat (equal hashes count as one) have no runs and skip the steps. The others of
a chunk of text are searched together, with a separate last word for each.

Cases: a null or empty text has no words and no runs. A text with a null id is
searched as it is. Repeated rows and ids each give a row. Of runs of equal length the
first, then the one of smaller period is reported. Texts may be of any length: a
long one makes a chunk of its own, whose memory follows its words (times the
logarithm of its longest repeat). Extra columns are ignored, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyglass.llm import textspans as S

LEAST = 12
PAIRS = 1_000_000  # edges and periods compared at a time

Run = tuple[int, int, int]


class Ranks:
    """Ranks of all stretches of 2**k words, until no two suffixes share one; words beyond the end are smaller than any."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.levels = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        width = 1
        while n and int(self.levels[-1].max()) < n - 1:
            rank = self.levels[-1].astype(np.int64)
            key = rank * (n + 1)
            key[:-width] += rank[width:] + 1
            self.levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
            width *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.levels[-1]] = np.arange(n)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree from a and b on (different places)."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            rank, x, y = self.levels[k], a + out, b + out
            live = np.flatnonzero(np.maximum(x, y) + (1 << k) <= self.n)
            out[live[rank[x[live]] == rank[y[live]]]] += 1 << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words agree before a and b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            rank, x, y = self.levels[k], a - out - (1 << k), b - out - (1 << k)
            live = np.flatnonzero(np.minimum(x, y) >= 0)
            out[live[rank[x[live]] == rank[y[live]]]] += 1 << k
        return out

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two words agree from a and b on, or before them."""
        if len(self.levels) < 3:  # no two words are repeated anywhere
            return np.zeros(len(a), bool)
        rank, last = self.levels[1], max(self.n - 2, 0)
        low, high = np.minimum(a, b), np.maximum(a, b)
        after = (high <= last) & (rank[np.minimum(a, last)] == rank[np.minimum(b, last)])
        return after | (low >= 2) & (rank[np.maximum(a - 2, 0)] == rank[np.maximum(b - 2, 0)])


def previous_factors(ranks: Ranks) -> tuple[list[int], list[int]]:
    """Of each position the length of the longest factor that begins earlier too, and where that one begins (-1: nowhere)."""
    sa = ranks.suffixes
    shared = [0, *ranks.forward(sa[:-1], sa[1:]).tolist(), 0]
    lengths, sources = [0] * ranks.n, [-1] * ranks.n
    places, lows = [], []
    for at, low in zip([*sa.tolist(), -1], shared, strict=True):
        while places and places[-1] > at:  # the next smaller position ends the search for this one
            place, below = places.pop(), lows.pop()
            if below >= low:
                lengths[place], sources[place] = below, places[-1] if below else -1
            else:
                lengths[place], sources[place] = low, at
            low = min(low, below)
        places.append(at)
        lows.append(low)
    return lengths, sources


def blocks(lengths: list[int]) -> list[int]:
    """The starts of the blocks, and the end."""
    out = [0]
    while out[-1] < len(lengths):
        out.append(out[-1] + max(1, lengths[out[-1]]))
    return out


def at_edges(ranks: Ranks, edges: list[int], least: int) -> list[Run]:
    """(start, end, period) of the runs that touch an edge of a block."""
    edge = np.array(edges, np.int64)
    size = np.append(np.diff(edge), 0)
    before = np.append(0, size[:-1])
    found = []
    # the period's second copy lies right of the edge, or its first one left of it
    for way, most in ((1, size), (-1, np.minimum(edge, before + size - 1))):
        most = np.maximum(most, 0)
        upto = np.append(0, np.cumsum(most))
        b = 0
        while b < len(edge):
            a, b = b, max(b + 1, int(np.searchsorted(upto, upto[b] + PAIRS, "right")) - 1)
            period = S.ragged(np.ones(b - a, np.int64), most[a:b])
            place = np.repeat(edge[a:b], most[a:b])
            if least > 4:  # then three words at least agree on one side
                live = ranks.near(place, place + way * period)
                place, period = place[live], period[live]
            right, left = ranks.forward(place, place + way * period), ranks.backward(place, place + way * period)
            whole = left + period + right
            good = whole >= np.maximum(least, 2 * period)
            start = (place - left - (period if way < 0 else 0))[good]
            found.append(np.column_stack((start, start + whole[good], period[good])))
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    # a multiple of the smallest period gives the same stretch
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return list(map(tuple, rows[first].tolist()))


def all_runs(words: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, end, period) of all runs of at least ``least`` words, in the order of starts."""
    if len(words) < least:
        return []
    ranks = Ranks(words)
    lengths, sources = previous_factors(ranks)
    edges = blocks(lengths)
    buckets: dict[int, list[tuple[int, int]]] = {}
    for start, end, period in at_edges(ranks, edges, least):
        buckets.setdefault(start, []).append((end, period))
    if buckets:
        for edge, after in zip(edges, edges[1:], strict=False):
            if after - edge < least + 2 or sources[edge] < 0:
                continue
            source, shift = sources[edge], edge - sources[edge]
            last = source + after - edge
            for at in range(source + 1, last - least):
                if at in buckets:
                    copies = [(end + shift, period) for end, period in buckets[at] if end < last]
                    if copies:
                        buckets.setdefault(at + shift, []).extend(copies)
    return [(start, end, period) for start in sorted(buckets) for end, period in sorted(buckets[start], key=lambda x: x[1])]


def looped(n: int, key: int) -> tuple[int, int] | None:
    """(first word, period) of the tail that the contract's rows repeat, by their id; None for the others."""
    h = zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def repeats(ids: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Whether each text may hold the same ``size`` consecutive words twice."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(ids) < size:
        return np.zeros(len(bounds) - 1, bool)
    end = len(ids) - size + 1
    mixed = S.mix64(doc[:end].astype(np.uint64))
    for k in range(size):
        mixed = S.mix64(mixed ^ ids[k : k + end].astype(np.uint64)) + np.uint64(k)
    inside = np.flatnonzero(doc[:end] == doc[size - 1 :])
    mixed = mixed[inside]
    order = np.argsort(mixed)
    same = order[1:][mixed[order][1:] == mixed[order][:-1]]
    out = np.zeros(len(bounds) - 1, bool)
    out[doc[inside[same]]] = True
    return out


def runs_of_texts(texts: list[list[bytes]], least: int = LEAST) -> list[list[Run]]:
    """Of each text (its words) its runs as (start, length, period), by start, then period."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    out: list[list[Run]] = [[] for _ in texts]
    # a run repeats all but its first period, which is half of it at most
    some = np.flatnonzero(repeats(ids, bounds, max(1, least // 2))).tolist()
    if not some:
        return out
    parts, starts, at = [], [], 0
    for k, i in enumerate(some):
        own = ids[bounds[i] : bounds[i + 1]]
        parts += [own, [len(number) + k]]
        starts.append(at)
        at += len(own) + 1
    where = np.array(starts)
    for start, end, period in all_runs(np.concatenate(parts), least):
        k = int(np.searchsorted(where, start, "right")) - 1
        out[some[k]].append((start - starts[k], end - start, period))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays when runs keep their first period alone."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _chunks(keys: list, texts: list[str | None], planted: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    for a, b in S.chunks(texts):
        held = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts[a:b]]  # white space of the contract, as in textspans.BLANKS
        for i, key in enumerate(keys[a:b]):
            tail = looped(len(held[i]), key) if planted and key is not None else None
            if tail:
                first, period = tail
                unit = held[i][first : first + period]
                n = len(held[i]) - first
                held[i] = held[i][:first] + (unit * (n // period + 1))[:n]
        yield keys[a:b], held


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period) and collapsed (the words that stay, joined by one space) of every row."""

    def run(batches):
        S.trim()
        for batch in batches:
            for keys, held in _chunks(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist(), batch["text"].tolist(), False):
                found = runs_of_texts(held, least)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
                texts = [b" ".join([w for w, k in zip(t, kept_words(len(t), r), strict=True) if k]).decode("utf-8", "replace") for t, r in zip(held, found, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(keys, "Int64"), "runs": rows, "collapsed": texts})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli) and two digests of every row, with tails looped by id."""
    numbers = ["start", "length", "period", "exponent_milli"]

    def run(batches):
        S.trim()
        for batch in batches:
            for keys, held in _chunks(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None).tolist(), batch["text"].tolist(), True):
                rows = []
                for key, words, runs in zip(keys, held, runs_of_texts(held, least), strict=True):
                    best = [None] * 4
                    if runs:
                        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                        best = [start, length, period, 1000 * length // period]
                        kept = kept_words(len(words), runs)
                        words = [words[i] for i in np.flatnonzero(kept).tolist()]
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    rows.append((key, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest()))
                out = pd.DataFrame(rows, columns=["doc_id", "n_runs", *numbers, "runs_sha256", "collapsed_sha256"])
                yield out.astype(dict.fromkeys(["doc_id", *numbers], "Int64"))

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, f"doc_id long, n_runs long, {', '.join(f'{c} long' for c in numbers)}, runs_sha256 string, collapsed_sha256 string")
