"""Best-two-fit packing of whole documents into as few token sequences as it can.

A sequence is filled greedily: the longest document first, then again and again the
longest that still fits. When nothing fits, its smallest document's place is offered to
two documents not yet packed: of all pairs that fit the gap that this document's
removal opens, and leave less of it than the document itself did, the pair that fits
most tightly takes its place (of equal ones the pair with the longest document).
The document goes back to the unpacked ones.

Sizes are bounded by the sequence, so the unpacked documents are stacks by size and
one number whose bits say which sizes are left. The longest size that fits is its
highest bit under the gap; a pair of a given sum is a common bit of that number
and its mirror image moved by the sum.

Documents are encoded where they are read. Only their pieces' lengths and checksums
are written, dealt out evenly and packed in groups of about ``GROUP_TOKENS``
tokens, so memory doesn't follow the partition; each group's last sequence may
stay short.

Cases: a null or empty text is a document of the end id alone. Only documents over
the capacity are cut, into pieces of the capacity and a last one. Repeated rows
and equal or null ids are packed as documents of their own. Of documents of equal size
the last dealt goes first. Extra columns are ignored, whatever their names. An empty
table has no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textspans as S
from tallyglass.llm.bpe import vocabulary
from tallyglass.llm.storage import settle

GROUP_TOKENS = 4_000_000


class _Left:
    """Unpacked documents by size."""

    def __init__(self, sizes: list[int], capacity: int):
        self.capacity = capacity
        self.by_size: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.mirror = 0  # bit n, and bit capacity - n: a document of size n is left
        for i, n in enumerate(sizes):
            self.put(n, i)

    def put(self, size: int, document: int) -> None:
        if not self.by_size[size]:
            self.bits |= 1 << size
            self.mirror |= 1 << (self.capacity - size)
        self.by_size[size].append(document)

    def take(self, size: int) -> int:
        document = self.by_size[size].pop()
        if not self.by_size[size]:
            self.bits ^= 1 << size
            self.mirror ^= 1 << (self.capacity - size)
        return document

    def longest(self, room: int) -> int:
        """The largest size left up to ``room``; 0 if there is none."""
        return max(0, (self.bits & ((2 << room) - 1)).bit_length() - 1)

    def pair(self, room: int, over: int) -> tuple[int, int] | None:
        """Two sizes left whose sum is the largest up to ``room`` and more than ``over``, the larger one first."""
        for total in range(room, over, -1):
            both = self.bits & (self.mirror >> (self.capacity - total))  # sizes n with total - n left too
            while both:
                size = both.bit_length() - 1
                if 2 * size < total:
                    break
                if 2 * size > total or len(self.by_size[size]) > 1:
                    return size, total - size
                both ^= 1 << size
        return None


def pack(sizes: list[int], capacity: int = 2048) -> list[list[int]]:
    """The documents (by position; sizes from 1 to the capacity) of each sequence, in their order there."""
    left, out = _Left(sizes, capacity), []
    while left.bits:
        room, held = capacity, []
        while size := left.longest(room):
            held.append((size, left.take(size)))
            room -= size
        smallest, document = held[-1]  # sizes descend
        better = left.pair(room + smallest, smallest) if room and len(held) > 1 else None
        if better:
            held.pop()
            held += [(size, left.take(size)) for size in better]
            left.put(smallest, document)
        out.append([d for _, d in held])
    return out


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces, and a number for each row."""

    def run(batches):
        S.trim()
        vocab = vocabulary(path)
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for key, ids in zip(batch["doc_id"].astype("Int64"), vocab.encode(batch["text"].tolist()), strict=True):
                ids = np.append(ids, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((key, piece, start, len(part), zlib.crc32(part), number))
                    number += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"]).astype({"doc_id": "Int64"})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def pack_whole(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, group_tokens: int = GROUP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces are settled, so a repeated task packs the same ones; sequence_id holds the partition in its upper bits.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pieces = settle(pieces_of(docs, path, capacity, end_id, id_col, text_col))
    tokens = pieces.agg(F.sum("length")).first()[0] or 0
    tasks = int(min(-(-tokens // group_tokens), max(200, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))) or 1

    def run(batches):
        made = TaskContext.get().partitionId() << 36
        held, total = [], 0

        def rows():
            nonlocal made
            group = pd.concat(held, ignore_index=True)
            sequences = pack(group["length"].tolist(), capacity)
            order = [d for s in sequences for d in s]
            out = group.iloc[order].reset_index(drop=True)
            out["sequence_id"] = np.repeat(np.arange(made, made + len(sequences)), [len(s) for s in sequences])
            before = out["length"].cumsum() - out["length"]
            out["offset"] = before - before.groupby(out["sequence_id"]).transform("first")
            made += len(sequences)
            return out

        for batch in batches:
            held.append(batch.assign(doc_id=batch["doc_id"].astype("Int64")))
            total += int(batch["length"].sum())
            if total >= group_tokens:
                yield rows()
                held, total = [], 0
        if held:
            yield rows()

    # spread by row, as one id may have most of them; sorted, so that a repeated task reads the same order
    dealt = pieces.repartition(tasks, F.xxhash64("row")).sortWithinPartitions("row").select(*names)
    return dealt.mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
