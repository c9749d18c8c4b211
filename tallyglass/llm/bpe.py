"""Byte-pair encoding and decoding by a segment tree over adjacent pair ranks.

Each pre-token keeps a segment tree whose leaves hold ``rank * width + position``
of the pair that begins there. The root is then the leftmost pair of lowest
rank; a merge changes three leaves and their paths, until no pair can merge.
The trees of many short pre-tokens are updated together, one merge a step;
long pre-tokens get a tree of their own. Equal pre-tokens are encoded once for
each worker's cache; they are found by hash and compared character by character.

Cases: null and empty texts have no tokens. Texts may be of any length; memory
follows the longest text. Repeated rows and ids are encoded like any other. Pairs of
equal rank are merged from the left. Extra columns are ignored, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyglass.llm import textspans as S

NONE = np.int64(1) << 62
WIDE = 256
CACHED = 150_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class PairTable:
    """(left id, right id) -> rank and merged id, by open addressing."""

    def __init__(self, pairs: list[tuple[int, int]], merged: list[int]):
        self.merged = np.array(merged or [0], np.int64)
        bits = max(4, (len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, -1, np.int64)
        self.reach = 1
        for rank, (a, b) in enumerate(pairs):
            at, step = self._slot(key := a << 32 | b), 1
            while self.keys[at] >= 0 and self.keys[at] != key:
                at, step = (at + 1) & self.mask, step + 1
            if self.keys[at] < 0:
                self.keys[at], self.ranks[at] = key, rank
            self.reach = max(self.reach, step)
        self.by_pair = None

    def _slot(self, key: int) -> int:
        return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the pair can't merge (also for negative ids)."""
        key = a << np.int64(32) | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], -1)
        left = np.flatnonzero((found != key) & (found >= 0))
        for _ in range(self.reach - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        out[(a < 0) | (b < 0)] = -1
        return out

    def lookup(self) -> dict[tuple[int, int], int]:
        if self.by_pair is None:
            full = self.keys >= 0
            self.by_pair = {(k >> 32, k & 0xFFFFFFFF): r for k, r in zip(self.keys[full].tolist(), self.ranks[full].tolist(), strict=True)}
        return self.by_pair


def merge_many(symbols: np.ndarray, sizes: np.ndarray, table: PairTable) -> np.ndarray:
    """Merges all rows of ``symbols`` (rows x width, width a power of two); -1 where nothing is left."""
    n, w = symbols.shape
    log, half = w.bit_length() - 1, 2 * w
    sym = np.full((n, w + 1), -1, np.int64)
    sym[:, :w] = np.where(np.arange(w) < sizes[:, None], symbols, -1)
    tree = np.full((n, half), NONE, np.int64)
    ranks = table.rank(sym[:, : w - 1].ravel(), sym[:, 1:w].ravel()).reshape(n, w - 1)
    tree[:, w : half - 1] = np.where(ranks >= 0, ranks << log | np.arange(w - 1), NONE)
    at = w
    while at > 1:
        tree[:, at // 2 : at] = np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2])
        at //= 2
    after = np.broadcast_to(np.arange(1, w + 2), (n, w + 1)).copy()
    after[:, w] = w
    np.putmask(after, after >= sizes[:, None], w)
    before = np.broadcast_to(np.arange(-1, w), (n, w + 1)).copy()
    before[:, 0] = w
    sym, tree, after, before = sym.ravel(), tree.ravel(), after.ravel(), before.ravel()
    rows = np.arange(n)

    def lift(base: np.ndarray, leaf: np.ndarray) -> None:
        at = leaf + w
        for _ in range(log):
            at = at >> 1
            low = base + 2 * at
            tree[base + at] = np.minimum(tree[low], tree[low + 1])

    while True:
        root = tree[rows * half + 1]
        live = root < NONE
        if not live.all():
            rows, root = rows[live], root[live]
        if not len(rows):
            break
        row, base = rows * (w + 1), rows * half
        pos, rank = root & (w - 1), root >> log
        gone, made = after[row + pos], table.merged[rank]
        follow, prior = after[row + gone], before[row + pos]
        sym[row + pos], sym[row + gone] = made, -2
        after[row + pos], before[row + follow] = follow, pos
        right = table.rank(made, sym[row + follow])
        tree[base + w + gone] = NONE
        tree[base + w + pos] = np.where(right >= 0, right << log | pos, NONE)
        lift(base, gone)
        lift(base, pos)
        some = np.flatnonzero(prior < w)
        if len(some):
            p = prior[some]
            left = table.rank(sym[row[some] + p], made[some])
            tree[base[some] + w + p] = np.where(left >= 0, left << log | p, NONE)
            lift(base[some], p)
    return sym.reshape(n, w + 1)[:, :w]


def merge_one(symbols: list[int], table: PairTable) -> list[int]:
    """Merges one long pre-token with a tree of its own."""
    pairs, merged, none = table.lookup(), table.merged.tolist(), int(NONE)
    n = len(symbols)
    w = 1 << max(1, (n - 1).bit_length())
    log = w.bit_length() - 1
    sym, after, before = [*symbols, -1], [*range(1, n + 1), n], [n, *range(n)]
    tree = [none] * (2 * w)
    for i in range(n - 1):
        rank = pairs.get((sym[i], sym[i + 1]), -1)
        if rank >= 0:
            tree[w + i] = rank << log | i
    for at in range(w - 1, 0, -1):
        tree[at] = min(tree[2 * at], tree[2 * at + 1])

    def put(leaf: int, a: int, b: int) -> None:
        rank = pairs.get((a, b), -1)
        at = leaf + w
        tree[at] = rank << log | leaf if rank >= 0 else none
        while at > 1:
            at >>= 1
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low

    while tree[1] < none:
        pos, rank = tree[1] & (w - 1), tree[1] >> log
        gone = after[pos]
        follow, prior = after[gone], before[pos]
        sym[pos], sym[gone] = merged[rank], -2
        after[pos], before[follow] = follow, pos
        put(gone, -1, -1)
        put(pos, sym[pos], sym[follow])
        if prior < n:
            put(prior, sym[prior], sym[pos])
    return [s for s in sym[:n] if s >= 0]


class Vocabulary:
    """A byte-pair vocabulary file, read as the tokenizers library reads it."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.table = PairTable([(self.ids[a], self.ids[b]) for a, b in pairs], [self.ids[a + b] for a, b in pairs])
        letters = byte_letters()
        self.of_byte = np.array([self.ids[x] for x in letters], np.int64)
        self.of_last = np.array([self.ids[x + self.suffix] for x in letters], np.int64)
        self.words = bool(self.suffix)  # white space only separates, and letters are lowered
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = [""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for token, i in [*self.ids.items(), *self.added.items()]:
            self.text_of[i] = token
        self.n_ids = len(self.text_of)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # place of a pre-token in starts and counts
        self.starts = self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def normal(self, text: str) -> str:
        if not self.words or text.isascii() and text.islower():
            return text
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens one after another, and how many each has."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        counts, parts = np.zeros(len(tokens), np.int64), []
        places = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
        for w in np.unique(places).tolist():
            of = np.flatnonzero(places == w)
            if w > WIDE:
                for i in of.tolist():
                    codes = np.frombuffer(tokens[i], np.uint8)
                    ids = self.of_byte[codes]
                    ids[-1] = self.of_last[codes[-1]]
                    ids = merge_one(ids.tolist(), self.table)
                    counts[i] = len(ids)
                    parts.append((np.array([i]), np.array(ids, np.int32)))
                continue
            for some in np.array_split(of, -(-len(of) * w // 200_000)):
                codes = np.frombuffer(b"".join(tokens[i].ljust(w, b"\0") for i in some.tolist()), np.uint8).reshape(-1, w)
                symbols = self.of_byte[codes]
                ends = sizes[some] - 1
                line = np.arange(len(some))
                symbols[line, ends] = self.of_last[codes[line, ends]]
                got = merge_many(symbols, sizes[some], self.table)
                counts[some] = (got >= 0).sum(axis=1)
                parts.append((some, got[got >= 0].astype(np.int32)))
        flat, at = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for some, ids in parts:
            flat[S.ragged(at[some], counts[some])] = ids
        return flat, counts

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, points, bounds = S.code_points(texts)
        starts, ends = S.pretokens(points, bounds, spaces=not self.words)
        which, shown = S.distinct_spans(points, starts, ends)
        if len(self.known) > CACHED:
            self._forget()
        tokens = [joined[a:b] for a, b in zip(starts[shown].tolist(), ends[shown].tolist(), strict=True)]
        at = np.array([self.known.get(t, -1) for t in tokens], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            flat, counts = self.merge([tokens[i].encode("utf-8", "replace") for i in new.tolist()])
            at[new] = len(self.starts) + np.arange(len(new))
            self.known.update(zip([tokens[i] for i in new.tolist()], at[new].tolist(), strict=True))
            self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
            self.counts = np.concatenate((self.counts, counts))
            self.flat = np.concatenate((self.flat, flat))
        sizes = self.counts[at][which] if len(which) else np.zeros(0, np.int64)
        ids = self.flat[S.ragged(self.starts[at][which], sizes)] if len(which) else np.zeros(0, np.int32)
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, total[np.searchsorted(starts, bounds)]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids (int32) of each text, in order."""
        for a, b in S.chunks(texts):
            some = [t or "" for t in texts[a:b]]
            pieces: list[str] = []
            plan: list[list[int]] = []  # of each text: pieces (>= 0) and added tokens (-1 - id)
            for t in some:
                if any(x in t for x in self.added):
                    steps = []
                    while t:
                        where = min(((t.find(x), -len(x), x) for x in self.added if x in t), default=None)
                        cut = len(t) if where is None else where[0]
                        if cut:
                            steps.append(len(pieces))
                            pieces.append(self.normal(t[:cut]))
                        if where is not None:
                            steps.append(-1 - self.added[where[2]])
                        t = t[cut + len(where[2]) :] if where is not None else ""
                    plan.append(steps)
                else:
                    plan.append([len(pieces)])
                    pieces.append(self.normal(t))
            ids, bounds = self._encode_plain(pieces)
            bounds = bounds.tolist()
            for steps in plan:
                if len(steps) == 1 and steps[0] >= 0:
                    yield ids[bounds[steps[0]] : bounds[steps[0] + 1]]
                else:
                    yield np.concatenate([np.zeros(0, np.int32), *(ids[bounds[k] : bounds[k + 1]] if k >= 0 else np.array([-1 - k], np.int32) for k in steps)])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids: tokens joined by one space for word vocabularies, else their bytes."""
        if self.words:
            return " ".join(map(self.text_of.__getitem__, ids))
        of = {x: i for i, x in enumerate(byte_letters())}
        added = {v: k for k, v in self.added.items()}
        return b"".join(added[i].encode() if i in added else bytes(of[c] for c in self.text_of[i]) for i in ids).decode("utf-8", "replace")


@functools.lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process; its cache of pre-tokens is bounded by ``CACHED``."""
    return Vocabulary(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row; a null text has none."""

    def run(batches):
        S.trim()
        vocab = vocabulary(path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": list(vocab.encode(batch["text"].tolist()))})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, ids array<int>")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and decoded_sha256 of every row."""

    def run(batches):
        S.trim()
        vocab = vocabulary(path)
        decimal = [str(i) for i in range(vocab.n_ids)]
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for ids in vocab.encode(batch["text"].tolist()):
                ids = ids.tolist()
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(vocab.decode(ids).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
