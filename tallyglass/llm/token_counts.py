"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a chunk of text are laid out as a trie, level by
level: a node is a distinct prefix. The unigram forward score of a node, the
best sum of piece scores over all segmentations of its prefix, is computed once
from its ancestors and shared by every pre-token below it. Each pre-token's
terminal node gives its token count, and a text's count is the sum over its
pre-tokens. Of segmentations with the same score the one with fewer tokens
counts.

Piece scores come from the vocabulary file's order by Zipf's law: the piece of
rank r has log probability -log(r + 1) - log(sum of 1 / (r + 1)). A character
without a piece costs one byte token for each of its UTF-8 bytes, each a unit
below the least piece. A space counts as the vocabulary's space mark.

Cases: null and empty texts count 0. Texts and pre-tokens may be of any length;
where few pre-tokens reach a depth, the rest of the trie is walked in sorted
order, one node after another, with the same recurrence. Repeated rows and ids
count each for themselves, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tallyglass.llm import textspans as S

FEW = 8  # pre-tokens; a trie that is no wider is walked node by node
CACHED = 150_000
MARK = 0x2581
_CODE = 21  # bits of a code point


class PieceTrie:
    """Pieces as a trie: children by (node, code point), and the score of the piece that ends at each node."""

    def __init__(self, scores: dict[str, float]):
        edges: dict[int, int] = {}
        ends: dict[int, float] = {}
        for piece, score in scores.items():
            at = 0
            for c in piece:
                at = edges.setdefault(at << _CODE | ord(c), len(edges) + 1)
            ends[at] = score
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.score = np.full(len(edges) + 1, -np.inf)
        self.score[list(ends)] = list(ends.values())

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The children by these code points, -1 where there are none (or no node)."""
        key = nodes << _CODE | codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (nodes >= 0), self.child[at], -1)


class UnigramCounts:
    """Counts of a piece vocabulary; keeps the counts of known pre-tokens up to ``CACHED``."""

    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: text and log probability."""
        self.scores = dict(pieces)
        self.most = max(map(len, self.scores))
        self.byte = min(self.scores.values()) - 1.0
        self.trie = PieceTrie(self.scores)
        self.known: dict[str, int] = {}

    def _walk(self, tokens: list[str], depth: int, heads: list[tuple[list[float], list[int]]]) -> list[int]:
        """Counts of pre-tokens from the best scores and counts of their prefixes of up to ``depth`` (the last ``most`` of them)."""
        out, low = [0] * len(tokens), max(0, depth + 1 - self.most)
        last, best, few = "", [], []
        for i in sorted(range(len(tokens)), key=tokens.__getitem__):
            token = tokens[i]
            same = len(os.path.commonprefix((last, token)))
            if same > depth:  # the prefix is scored already
                del best[same + 1 - low :], few[same + 1 - low :]
            else:
                best, few = (list(x) for x in heads[i])
            for d in range(low + len(best), len(token) + 1):
                top, least = -math.inf, 0
                for k in range(1, min(d, self.most) + 1):
                    score, n = self.scores.get(token[d - k : d]), 1
                    if score is None:
                        if k > 1:
                            continue
                        n = len(token[d - 1].encode("utf-8", "surrogatepass"))
                        score = self.byte * n
                    score += best[d - k - low]
                    n += few[d - k - low]
                    if score > top or score == top and n < least:
                        top, least = score, n
                best.append(top)
                few.append(least)
            out[i], last = few[-1], token
        return out

    def count_many(self, tokens: list[str]) -> np.ndarray:
        """Counts of distinct pre-tokens, given longest first."""
        out = np.zeros(len(tokens), np.int64)
        _, points, bounds = S.code_points(tokens)
        starts, sizes = bounds[:-1], np.diff(bounds)
        best, few, node = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(len(starts), np.int64)]
        states: list[np.ndarray] = []  # of the nodes one level up: where the piece trie stands after their last 1, 2, .. code points
        for d in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            live = int(np.searchsorted(-sizes, -d, side="right"))
            if live <= FEW:
                low = max(0, d - self.most)
                heads = [([float(best[j][node[j][i]]) for j in range(low, d)], [int(few[j][node[j][i]]) for j in range(low, d)]) for i in range(live)]
                out[:live] = self._walk(tokens[:live], d - 1, heads)
                break
            code = points[starts[:live] + d - 1].astype(np.int64)
            which, keys = pd.factorize(node[d - 1][:live] << _CODE | code)
            shown = np.zeros(len(keys), np.int64)
            shown[which] = np.arange(live)
            above, code = node[d - 1][shown], code[shown]
            states = [self.trie.step(at, code) for at in (np.zeros(len(keys), np.int64), *(x[above] for x in states[: self.most - 1]))]
            top, least = np.full(len(shown), -np.inf), np.zeros(len(shown), np.int64)
            for k, at in enumerate(states, 1):
                score, n = np.where(at >= 0, self.trie.score[at], -np.inf), np.ones(len(shown), np.int64)
                if k == 1:
                    width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
                    lone = score == -np.inf
                    score, n = np.where(lone, self.byte * width, score), np.where(lone, width, 1)
                came = node[d - k][shown]
                score, n = score + best[d - k][came], n + few[d - k][came]
                take = (score > top) | (score == top) & (n < least)
                top, least = np.where(take, score, top), np.where(take, n, least)
            best.append(top)
            few.append(least)
            node.append(which)
            ends = np.flatnonzero(sizes[:live] == d)
            out[ends] = least[which[ends]]
        return out

    def count(self, texts: list[str | None]) -> np.ndarray:
        done = [np.zeros(0, np.int64)]
        for a, b in S.chunks(texts):
            joined, points, bounds = S.code_points([t or "" for t in texts[a:b]])
            starts, ends = S.pretokens(points, bounds, spaces=True)
            joined = joined.replace(" ", chr(MARK))
            points = np.where(points == 32, np.uint32(MARK), points)
            which, shown = S.distinct_spans(points, starts, ends)
            if len(self.known) > CACHED:
                self.known = {}
            tokens = [joined[a:b] for a, b in zip(starts[shown].tolist(), ends[shown].tolist(), strict=True)]
            new = sorted((t for t in tokens if t not in self.known), key=len, reverse=True)
            self.known.update(zip(new, self.count_many(new).tolist(), strict=True))
            total = np.zeros(len(which) + 1, np.int64)
            np.cumsum(np.array([self.known[t] for t in tokens], np.int64)[which], out=total[1:])
            done.append(np.diff(total[np.searchsorted(starts, bounds)]))
        return np.concatenate(done)


def zipf_scores(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece file with log probabilities by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    kept.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(kept))))
    return [(model.id_to_piece(i), -math.log(r + 1) - total) for r, i in enumerate(kept)]


@functools.lru_cache(2)
def counter(path: str) -> UnigramCounts:
    return UnigramCounts(zipf_scores(path))


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_chars (code points) of every row."""

    def run(batches):
        S.trim()
        counts = counter(path)
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": counts.count(texts), "n_chars": [len(t or "") for t in texts]})

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInPandas(run, "doc_id long, n_tokens long, n_chars long")
