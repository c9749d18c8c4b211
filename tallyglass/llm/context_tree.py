"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased (A-Z) words joined by one space and closed by a
line feed. Each byte is decomposed into eight binary decisions, each with a
context tree of its own over the ``DEPTH`` bytes before; before the text stand
line feeds. A node that saw n0 zeros and n1 ones has the Krichevsky-Trofimov
block probability of these counts, and weighs it half and half against the
product of its children's weighted probabilities. The counts of the training
texts settle every weight in closed form, so the tree is exact whatever the
order of the texts. A text's score is the log10 probability of its bytes under
the mixture of all depths.

Nothing that grows with the corpus reaches the driver or is broadcast. Texts are
dealt into groups of about ``GROUP_BYTES``. A group sends the distinct grams
(context and byte) it holds, with their training counts, to the owner of the
gram's two nearest context bytes (32 to ``MOST_OWNERS`` owners); the owner merges the
groups' counts, builds all nodes of depth two and more, and answers every group
with the log probability of each of its grams. Depths zero and one are summed from
the owners, at most 256 x 255 rows, and broadcast. Counts of words, for the baseline,
travel the same way by the hash of the word. Groups and owners read their rows as a
sorted stream, one table and one batch at a time, so a task's memory follows the
distinct grams it holds, and neither the number of groups nor of repeated rows.

Cases: a null or empty text is the end alone. A null id is trained on and not
held out. Repeated rows count each time. With no training texts every decision
has probability one half. Words are told apart by 64-bit hashes, each of the whole
word. Order doesn't matter, so ties don't arise. Texts may be of any length. Extra
columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.llm import textspans as S
from tallyglass.llm.storage import settle

DEPTH = 5
GROUP_BYTES = 24_000_000
MOST_OWNERS = 4096
END = 10

Level = tuple[np.ndarray, list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


# ---- text to grams and words -------------------------------------------------


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grams of all bytes, first gram of each text (one entry more), hashes of all words, first word of each text.

    A gram is c1 .. cDEPTH and the byte itself, c1 the byte just before, as one big-endian number.
    """
    codes, starts, ends, first = S.words(texts)
    words = S.span_hashes(codes, starts, ends)
    n = len(texts)
    size = ends - starts + 1  # with the space, or the line feed, after it
    total = np.concatenate(([0], np.cumsum(size)))
    lone = (np.diff(first) == 0).astype(np.int64)
    shift = np.concatenate(([0], np.cumsum(lone)))
    begin = total[first] + shift  # a text without words is one line feed
    out = np.full(int(begin[-1]), 32, np.uint8)
    place = np.repeat(np.searchsorted(first[1:], np.arange(len(starts)), side="right"), size)
    index = S.ragged(starts, size)
    spot = np.arange(len(index)) + shift[:-1][place] if n else np.zeros(0, np.int64)
    out[spot] = codes[index]
    out[spot[total[1:] - 1]] = 32
    out[begin[1:] - 1] = END
    since = np.arange(len(out)) - np.repeat(begin[:-1], np.diff(begin))
    key = out.astype(np.uint64)
    for d in range(1, DEPTH + 1):
        back = np.full(len(out), END, np.uint64)
        back[d:] = out[:-d] if d < len(out) else back[d:]
        back[since < d] = END
        key |= back << np.uint64(8 * (DEPTH + 1 - d))
    return key, begin, words, first


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and summed counts."""
    keys = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(keys) else counts


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, "<u8"), dtype=np.uint64)


def _owner(kind: int, keys: np.ndarray, owners: int) -> np.ndarray:
    """Grams by their two nearest context bytes, words by their hash."""
    return ((S.mix64(keys >> np.uint64(8 * (DEPTH - 1))) if kind == 0 else keys) % np.uint64(owners)).astype(np.int64)


Parts = list[tuple[np.ndarray, np.ndarray]]


def _runs(batches, *by: str):
    """(values of ``by``, rows) of the runs of equal values in batches that are sorted by them; a run may come in parts."""
    for pdf in batches:
        if len(pdf):
            keys = [pdf[c].to_numpy() for c in by]
            turn = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for low, high in zip([0, *turn.tolist()], [*turn.tolist(), len(pdf)], strict=True):
                yield tuple(int(k[low]) for k in keys), pdf.iloc[low:high]


def _add(parts: Parts, keys: np.ndarray, counts: np.ndarray) -> None:
    parts.append((keys, counts))
    if len(parts) > 8:
        parts[:] = [_merged(parts)]


def _count_texts(pdf: pd.DataFrame, parts: tuple[Parts, Parts]) -> None:
    """Adds the training counts of the grams and words of some texts."""
    texts, held = pdf["text"].tolist(), pdf["held_out"].to_numpy(bool)
    for a, b in S.chunks(texts):
        found = grams(texts[a:b])
        for kind in (0, 1):
            keys, first = found[2 * kind], found[2 * kind + 1]
            learned = np.repeat(~held[a:b], np.diff(first))
            unique, back = np.unique(keys, return_inverse=True)
            _add(parts[kind], unique, np.bincount(back, learned, len(unique)).astype(np.int64))


def _sent(group: int, parts: tuple[Parts, Parts], owners: int) -> pd.DataFrame:
    """What one group sends: kind (0 grams, 1 words), owner, keys and training counts."""
    rows = []
    for kind in (0, 1):
        keys, counts = _merged([_NONE, *parts[kind]])
        owner = _owner(kind, keys, owners)
        order = np.argsort(owner, kind="stable")
        cut = np.flatnonzero(np.diff(owner[order])) + 1
        for some in np.split(order, cut):
            if len(some):
                rows.append((group, kind, int(owner[some[0]]), _pack_keys(keys[some]), _pack(counts[some].astype("<u8"))))
    return pd.DataFrame(rows, columns=["grp", "kind", "owner", "keys", "counts"])


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# ---- the tree -----------------------------------------------------------------

_small = np.array([math.lgamma(i + 0.5) for i in range(4096)])
_whole = np.array([math.lgamma(i + 1.0) for i in range(4096)])


def _log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """log gamma of n + 1/2, or of n + 1."""
    x = np.maximum(n, 1024) + (0.5 if half else 1.0)
    far = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 4096, (_small if half else _whole)[np.minimum(n, 4095)], far)


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log Krichevsky-Trofimov probability of any sequence with these counts."""
    return _log_gamma(n0, True) + _log_gamma(n1, True) - _log_gamma(n0 + n1, False) - math.log(math.pi)


def levels(keys: np.ndarray, counts: np.ndarray, top: int) -> list[Level]:
    """From depth DEPTH up to ``top``: for each level, the map from the level below, and for each bit the node of each gram and the nodes' (n0, n1)."""
    out: list[Level] = []
    up = np.arange(len(keys))
    for depth in range(DEPTH, top - 1, -1):
        if depth < DEPTH:
            shorter = (keys >> np.uint64(16)) << np.uint64(8) | keys & np.uint64(255)
            keys, up = np.unique(shorter, return_inverse=True)
            counts = np.bincount(up, counts, len(keys)).astype(np.int64)
        nodes, seen = [], []
        for bit in range(8):
            part = keys >> np.uint64(8 - bit)
            new = np.concatenate(([True], part[1:] != part[:-1])) if len(part) else np.zeros(0, bool)
            node = np.cumsum(new) - 1
            one = (keys >> np.uint64(7 - bit) & np.uint64(1)).astype(bool)
            count = int(node[-1]) + 1 if len(node) else 0
            seen.append((np.bincount(node, np.where(one, 0, counts), count).astype(np.int64), np.bincount(node, np.where(one, counts, 0), count).astype(np.int64)))
            nodes.append(node)
        out.append((up, nodes, seen))
    return out


def weigh(tree: list[Level]) -> tuple[list[list[np.ndarray]], list[np.ndarray]]:
    """The share of each node's own estimate (levels as in the tree), and the top level's log weighted probabilities by bit."""
    shares: list[list[np.ndarray]] = []
    weighted: list[np.ndarray] = []
    for k, (up, nodes, seen) in enumerate(tree):
        share, now = [], []
        for bit, (n0, n1) in enumerate(seen):
            own = log_block(n0, n1)
            if k == 0:
                share.append(np.ones(len(own)))
                now.append(own)
                continue
            below = tree[k - 1][1][bit]
            last = np.concatenate((np.flatnonzero(np.diff(below)), [len(below) - 1])) if len(below) else np.zeros(0, np.int64)
            children = np.bincount(nodes[bit][up[last]], weighted[bit], len(own))
            share.append(1 / (1 + np.exp(np.clip(children - own, -700, 700))))
            now.append(np.logaddexp(own, children) - math.log(2))
        shares.append(share)
        weighted = now
    return shares, weighted


def owner_tops(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """Of one owner: for each depth-two node its n0, n1 and log weighted probability, with the context byte and the bits read."""
    tree = levels(keys, counts, 2)
    _, weighted = weigh(tree)
    mine = keys
    for _ in range(DEPTH - 2):
        mine = np.unique((mine >> np.uint64(16)) << np.uint64(8) | mine & np.uint64(255))
    frames = []
    for bit in range(8):
        node = tree[-1][1][bit]
        at = np.concatenate(([0], np.flatnonzero(np.diff(node)) + 1)) if len(node) else np.zeros(0, np.int64)
        n0, n1 = tree[-1][2][bit]
        frames.append(pd.DataFrame({"near": (mine[at] >> np.uint64(16)).astype(np.int64), "read": (1 << bit) | ((mine[at] & np.uint64(255)) >> np.uint64(8 - bit)).astype(np.int64), "n0": n0, "n1": n1, "weighted": weighted[bit]}))
    return pd.concat(frames)


class Top:
    """Depths zero and one, from the sums over depth-two nodes by (near, read)."""

    def __init__(self, near: np.ndarray, read: np.ndarray, n0: np.ndarray, n1: np.ndarray, weighted: np.ndarray):
        self.counts = np.zeros((2, 257, 256), np.int64)  # row 256: depth zero
        self.share = np.full((257, 256), 0.5)
        self.counts[0, near, read], self.counts[1, near, read] = n0, n1
        self.counts[:, 256] = self.counts[:, :256].sum(axis=1)
        below = np.zeros((257, 256))
        below[near, read] = weighted
        own = log_block(self.counts[0], self.counts[1])
        mixed = np.logaddexp(own, below) - math.log(2)
        below[256] = mixed[:256].sum(axis=0)
        self.share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def gram_scores(keys: np.ndarray, counts: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each gram's byte in its context."""
    tree = levels(keys, counts, 2)
    shares, _ = weigh(tree)
    total = np.zeros(len(keys))
    near = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    byte = (keys & np.uint64(255)).astype(np.int64)
    for bit in range(8):
        one = (byte >> 7 - bit & 1).astype(bool)
        p = np.full(len(keys), 0.5)
        at = np.arange(len(keys))
        for k, (up, nodes, seen) in enumerate(tree):
            at = up[at]
            node = nodes[bit][at]
            n0, n1 = seen[bit][0][node], seen[bit][1][node]
            own = (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1)
            share = shares[k][bit][node]
            p = share * own + (1 - share) * p
        read = (1 << bit) | (byte >> 8 - bit)
        for row in (near, np.full(len(keys), 256)):
            n0, n1 = top.counts[0, row, read], top.counts[1, row, read]
            share = top.share[row, read]
            p = share * (np.where(one, n1, n0) + 0.5) / (n0 + n1 + 1) + (1 - share) * p
        total += np.log10(p)
    return total


# ---- the distributed passes ---------------------------------------------------


def _merge(batches):
    """One row for each kind and owner, with the groups' counts summed."""
    last, parts = None, []
    for key, rows in _runs(batches, "kind", "owner"):
        if last is not None and key != last:
            yield _table(last, parts)
            parts = []
        last = key
        for k, c in zip(rows["keys"], rows["counts"], strict=True):
            _add(parts, _unpack_keys(k), _unpack(c, "<u8").astype(np.int64))
    if last is not None:
        yield _table(last, parts)


def _table(key: tuple[int, ...], parts: Parts) -> pd.DataFrame:
    keys, counts = _merged(parts)
    return pd.DataFrame([(*key, _pack_keys(keys), _pack(counts.astype("<u8")))], columns=["kind", "owner", "keys", "counts"])


def _tops(batches):
    """Of each owner its depth-two nodes, or of its words (near -1) the sum of counts and how many are above zero."""
    for pdf in batches:
        for kind, k, c in zip(pdf["kind"], pdf["keys"], pdf["counts"], strict=True):
            counts = _unpack(c, "<u8").astype(np.int64)
            if kind == 0:
                yield owner_tops(_unpack_keys(k), counts)
            else:
                yield pd.DataFrame({"near": [-1], "read": [0], "n0": [int(counts.sum())], "n1": [int((counts > 0).sum())], "weighted": [0.0]})


def score_documents(docs: DataFrame, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Documents whose crc32 of the id as text leaves ``held_fold`` modulo ``folds`` aren't learned from.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(False)).alias("held_out")
    size = docs.agg(F.sum(F.octet_length("text")), F.count_if(~held)).first()
    groups = max(1, math.ceil((size[0] or 0) / GROUP_BYTES))
    dealt = docs.select("doc_id", "text", held, F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(groups)).alias("grp"))
    owners = min(MOST_OWNERS, max(32, 8 * groups))

    def count(batches):
        last, parts = None, ([], [])
        for key, rows in _runs(batches, "grp"):
            if last is not None and key != last:
                yield _sent(*last, parts, owners)
                parts = ([], [])
            last = key
            _count_texts(rows, parts)
        if last is not None:
            yield _sent(*last, parts, owners)

    sorted_ = lambda df, by, *more: df.repartition(*by).sortWithinPartitions(*by, *more)
    sent = settle(sorted_(dealt, ["grp"]).select("grp", "text", "held_out").mapInPandas(count, "grp long, kind int, owner long, keys binary, counts binary"))
    merged = settle(sorted_(sent.drop("grp"), ["kind", "owner"]).mapInPandas(_merge, "kind int, owner long, keys binary, counts binary"))
    summary = merged.mapInPandas(_tops, "near long, read long, n0 long, n1 long, weighted double")
    rows = summary.groupBy("near", "read").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("weighted")).toPandas()
    words, tops = rows[rows["near"] < 0], rows[rows["near"] >= 0].sort_values(["near", "read"])
    learned = int(size[1] or 0)
    n_train, n_distinct = int(words["n0"].sum()) + learned, int(words["n1"].sum()) + (learned > 0)
    top = docs.sparkSession.sparkContext.broadcast(Top(*(tops[c].to_numpy() for c in ("near", "read", "n0", "n1", "weighted"))))

    def answer(batches):
        keys = values = None
        for (kind, _, asks), rows in _runs(batches, "kind", "owner", "asks"):
            if not asks:  # the owner's table comes first
                keys, counts = _unpack_keys(rows["keys"].iloc[0]), _unpack(rows["counts"].iloc[0], "<u8").astype(np.int64)
                values = gram_scores(keys, counts, top.value) if kind == 0 else counts.astype(float)
                continue
            yield pd.DataFrame({"grp": rows["grp"], "kind": kind, "keys": rows["keys"], "answers": [_pack(values[np.searchsorted(keys, _unpack_keys(k))]) for k in rows["keys"]]})

    tables = merged.select("kind", "owner", F.lit(0).alias("asks"), F.lit(-1).cast("long").alias("grp"), "keys", "counts")
    asking = sent.select("kind", "owner", F.lit(1).alias("asks"), "grp", "keys", F.lit(None).cast("binary").alias("counts"))
    answers = sorted_(tables.unionByName(asking), ["kind", "owner"], "asks").mapInPandas(answer, "grp long, kind int, keys binary, answers binary")

    def known(rows: list[pd.DataFrame]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Sorted keys and answers of grams, and of words."""
        out = []
        for kind in (0, 1):
            mine = [r[r["kind"] == kind] for r in rows]
            keys = np.concatenate([_NONE[0], *(_unpack_keys(k) for r in mine for k in r["keys"])])
            order = np.argsort(keys)
            out.append((keys[order], np.concatenate([np.zeros(0), *(_unpack(x, "<f8") for r in mine for x in r["answers"])])[order]))
        return out

    def score(batches):
        last, held, table = None, [], None
        for (grp, is_text), rows in _runs(batches, "grp", "is_text"):
            if grp != last:
                last, held, table = grp, [], None
            if not is_text:
                held.append(rows)
                continue
            if table is None:  # a group's answers come first
                table, held = known(held), []
            yield scored(rows, table)

    def scored(pdf: pd.DataFrame, table: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        scores, bases, sizes, hits, lengths = [], [], [], [], []
        texts = pdf["text"].tolist()
        whole = n_train + n_distinct + 1
        for a, b in S.chunks(texts):
            keys, begin, words, first = grams(texts[a:b])
            unique, back = np.unique(keys, return_inverse=True)
            total = np.concatenate(([0.0], np.cumsum(table[0][1][np.searchsorted(table[0][0], unique)][back])))
            for i in range(b - a):
                scores.append(total[begin[i + 1]] - total[begin[i]])
            c = table[1][1][np.searchsorted(table[1][0], words)] if len(words) else np.zeros(0)
            base = np.concatenate(([0.0], np.cumsum(np.log10((c + 1) / whole))))
            hit = np.concatenate(([0], np.cumsum(c > 0)))
            bases.append(base[first[1:]] - base[first[:-1]] + math.log10((learned + 1) / whole))
            hits.append(hit[first[1:]] - hit[first[:-1]] + (learned > 0))
            sizes.append(np.diff(first) + 1)
            lengths.append(np.diff(begin))
        score = np.array(scores)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "held_out": pdf["held_out"],
                "n_tokens": np.concatenate(sizes),
                "n_known": np.concatenate(hits),
                "train_tokens": n_train,
                "base_score": np.concatenate(bases),
                "score": score,
                "bits_per_byte": -score / math.log10(2) / np.concatenate(lengths),
            }
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = dealt.select("grp", F.lit(1).alias("is_text"), "doc_id", "text", "held_out", F.lit(0).alias("kind"), none("binary", "keys"), none("binary", "answers"))
    tables = answers.select("grp", F.lit(0).alias("is_text"), none("long", "doc_id"), none("string", "text"), F.lit(False).alias("held_out"), "kind", "keys", "answers")
    return sorted_(tables.unionByName(texts), ["grp"], "is_text").mapInPandas(score, schema)
