"""Cost-balanced packing of documents into token sequences of a fixed size.

A piece of n tokens costs ``n + quadratic * n**2``: the linear layers and the
attention within its document. A document longer than a sequence fills whole
sequences, which no cut could make cheaper, and leaves a remainder; remainders, in
descending cost, go to the sequence of lowest cost of all that have room, found by a
tree over the remaining capacities. Only where none has room for the whole piece
the cheapest is filled up and the rest is queued again. A group's last tokens,
fewer than one sequence, go to short sequences whose sizes are powers of two,
so nothing is padded.

Documents are packed where they are read, in groups of about ``GROUP_TOKENS``
tokens, so no row is shuffled and memory doesn't follow the partition.

Cases: a null or empty text is a document of the end id alone. Repeated rows
and equal or null ids are packed as documents of their own. Equal costs go to the
sequence made first, equal lengths in the order of rows. Extra columns are
ignored, whatever their names. An empty table has no pieces. Very long documents
are cut like others.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyglass.llm import textspans as S
from tallyglass.llm.bpe import vocabulary

GROUP_TOKENS = 1_000_000

Piece = tuple[int, int, int, int, int]


class _Open:
    """Sequences by remaining capacity; a tree over the capacities holds the lowest (cost, sequence) of each."""

    NONE = (math.inf, 0)

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [self.NONE] * (2 * self.width)
        self.by_room: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]

    def _lift(self, room: int) -> None:
        at = room + self.width
        self.tree[at] = self.by_room[room][0] if self.by_room[room] else self.NONE
        while at > 1:
            at >>= 1
            self.tree[at] = min(self.tree[2 * at], self.tree[2 * at + 1])

    def add(self, cost: float, sequence: int, room: int) -> None:
        heapq.heappush(self.by_room[room], (cost, sequence))
        if self.by_room[room][0] == (cost, sequence):
            self._lift(room)

    def take(self, size: int) -> tuple[float, int, int] | None:
        """The cheapest sequence (cost, sequence, room) with room for ``size``."""
        low, high, best, at = size + self.width, 2 * self.width, self.NONE, 0
        while low < high:
            if low & 1:
                if self.tree[low] < best:
                    best, at = self.tree[low], low
                low += 1
            low, high = low >> 1, high >> 1
        if not at:
            return None
        while at < self.width:
            at = 2 * at if self.tree[2 * at] == best else 2 * at + 1
        heapq.heappop(self.by_room[at - self.width])
        self._lift(at - self.width)
        return *best, at - self.width


def pack(sizes: list[int], capacity: int = 1024, quadratic: float = 1 / 1024) -> list[Piece]:
    """(document, start, length, sequence, offset) of all pieces; documents by position, sequences from 0."""
    cost = lambda n: n + quadratic * n * n
    pieces: list[Piece] = []
    rest: list[tuple[int, int, int]] = []  # (-length, document, start): a heap, longest first
    made = 0
    for d, n in enumerate(sizes):
        whole = n // capacity
        pieces += [(d, k * capacity, capacity, made + k, 0) for k in range(whole)]
        made += whole
        if n % capacity:
            rest.append((-(n % capacity), d, whole * capacity))
    left = -sum(x[0] for x in rest)
    heapq.heapify(rest)
    free = _Open(capacity)
    for _ in range(left // capacity):
        free.add(0.0, made, capacity)
        made += 1
    while rest:
        size, d, start = heapq.heappop(rest)
        found = free.take(-size) or free.take(1)
        if found is None:
            heapq.heappush(rest, (size, d, start))
            break
        spent, sequence, room = found
        put = min(-size, room)
        if put < -size:
            heapq.heappush(rest, (size + put, d, start + put))
        pieces.append((d, start, put, sequence, capacity - room))
        if put < room:
            free.add(spent + cost(put), sequence, room - put)
    for bit in range(left.bit_length(), -1, -1):  # what is left is under one sequence
        room = 1 << bit
        if not left % capacity & room:
            continue
        used = 0
        while used < room:
            size, d, start = heapq.heappop(rest)
            put = min(-size, room - used)
            pieces.append((d, start, put, made, used))
            if put < -size:
                heapq.heappush(rest, (size + put, d, start + put))
            used += put
        made += 1
    return pieces


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 0, quadratic: float = 1 / 1024, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id holds the partition in its upper bits; a repeated task gives the same ids.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        S.trim()
        vocab = vocabulary(path)
        made = TaskContext.get().partitionId() << 36
        keys, held, tokens = [], [], 0

        def rows():
            nonlocal made
            found = pack([len(x) for x in held], capacity, quadratic)
            out = [(keys[d], start, n, zlib.crc32(held[d][start : start + n]), len(held[d]), made + sequence, offset) for d, start, n, sequence, offset in found]
            made += max((x[3] for x in found), default=-1) + 1
            return pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

        for batch in batches:
            for key, ids in zip(batch["doc_id"].astype("Int64"), vocab.encode(batch["text"].tolist()), strict=True):
                keys.append(key)
                held.append(np.append(ids, end_id).astype("<u4"))
                tokens += len(ids) + 1
                if tokens >= group_tokens:
                    yield rows()
                    keys, held, tokens = [], [], 0
        if held:
            yield rows()

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, ", ".join(f"{x} long" for x in names))
