import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyglass.llm import bpe, packing, token_counts
from tallyglass.llm import textspans as S

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
VOCABULARIES = {f: (bpe.Vocabulary(P.path(f)), Tokenizer.from_file(P.path(f))) for f in FILES}
PIECES = st.sampled_from(["the", " the", "'s", "'LL", "Ünï", "é", "é", "ΑΣ", "中文", "½", "12", "_", "%%%", "  ", "\n", "\t ", " ", "😀", "<|endoftext|>", "a" * 300, "x", "'"])


@pytest.mark.parametrize("name", FILES)
@settings(deadline=None, max_examples=150)
@given(texts=st.lists(st.lists(PIECES, max_size=12).map("".join), max_size=4))
def test_same_as_library(name, texts):
    ours, theirs = VOCABULARIES[name]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_long_texts_and_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 3)
    ours, theirs = VOCABULARIES["byte_bpe_50k.json"]
    texts = ["ab" * 20_000, " word" * 30_000, "", "one two three four five"] * 2
    assert [x.tolist() for x in ours.encode(texts)] == [theirs.encode(t).ids for t in texts]


def test_digests(spark):
    docs = spark.createDataFrame([(1, "The cat", 1), (2, None, 2), (2, "", 2), (None, "x", 3)], "doc_id long, text string, ids_sha256 int")
    rows = bpe.encode_digests(docs, P.path(FILES[0])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 2), (2, 0), (2, 0)]
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {empty}
    assert bpe.encode_digests(docs.limit(0), P.path(FILES[0])).count() == 0
    theirs = VOCABULARIES[FILES[1]][1]
    encoded = bpe.encode_documents(docs, P.path(FILES[1])).collect()
    assert sorted(((r.doc_id or 0), r.ids) for r in encoded) == [(0, theirs.encode("x").ids), (1, theirs.encode("The cat").ids), (2, []), (2, [])]


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(1, 300), max_size=40))
def test_packing_is_whole_and_gapless(sizes):
    pieces = packing.pack(sizes, 64)
    for d, n in enumerate(sizes):
        at = 0
        for start, length in sorted((p[1], p[2]) for p in pieces if p[0] == d):
            assert start == at and length > 0
            at += length
        assert at == n
    used = {}
    for _, _, length, sequence, offset in sorted(pieces, key=lambda p: (p[3], p[4])):
        assert offset == used.get(sequence, 0)
        used[sequence] = offset + length
    assert all(n == 64 or n & (n - 1) == 0 and n < 64 for n in used.values())
    assert sorted(used) == list(range(len(used)))


def plain_pack(sizes, capacity, quadratic):
    """The same rule with a search through all sequences."""
    pieces, rest, made = [], [], 0
    for d, n in enumerate(sizes):
        for k in range(n // capacity):
            pieces.append((d, k * capacity, capacity, made, 0))
            made += 1
        if n % capacity:
            rest.append((d, n - n % capacity, n % capacity))
    total = sum(x[2] for x in rest)
    spent = {made + k: 0.0 for k in range(total // capacity)}
    used = dict.fromkeys(spent, 0)
    made += len(spent)
    while rest and any(u < capacity for u in used.values()):
        rest.sort(key=lambda x: (-x[2], x[0], x[1]))
        d, start, size = rest.pop(0)
        able = [q for q in used if capacity - used[q] >= size] or [q for q in used if used[q] < capacity]
        q = min(able, key=lambda q: (spent[q], q))
        put = min(size, capacity - used[q])
        pieces.append((d, start, put, q, used[q]))
        used[q] += put
        spent[q] += put + quadratic * put * put
        if put < size:
            rest.append((d, start + put, size - put))
    return pieces, sum(x[2] for x in rest)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([8, 64, 100, 128]))
def test_packing_like_a_search_through_all_sequences(sizes, capacity):
    want, short = plain_pack(sizes, capacity, 1 / 64)
    got = packing.pack(sizes, capacity, 1 / 64)
    assert got[: len(want)] == want and sum(p[2] for p in got[len(want) :]) == short < capacity


def test_packing_balances_cost():
    import random

    random.seed(1)
    pieces = packing.pack([random.randint(10, 900) for _ in range(3000)], 1024)
    cost = {}
    for _, _, n, sequence, _ in pieces:
        cost[sequence] = cost.get(sequence, 0) + n + n * n / 1024
    values = sorted(cost.values())
    assert values[len(values) // 20] > 0.6 * values[-1 - len(values) // 20]


def test_packed_documents(spark):
    docs = spark.createDataFrame([(1, "a b c " * 700, 1), (2, None, 1), (3, "", 1), (3, "", 1), (None, "x", 1)], "doc_id long, text string, start int")
    rows = packing.pack_documents(docs.coalesce(1), P.path(FILES[1])).collect()
    ids = [*VOCABULARIES[FILES[1]][1].encode("a b c " * 700).ids, 0]
    mine = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.start)
    assert sum(r.length for r in mine) == len(ids) == mine[0].doc_tokens
    for r in mine:
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 3
    assert packing.pack_documents(docs.limit(0), P.path(FILES[1])).count() == 0


def best_split(token, scores, byte):
    """Least tokens among best scores, by trying every first piece."""
    import functools

    @functools.cache
    def go(i):
        if i == len(token):
            return 0.0, 0
        out = []
        for j in range(i + 1, len(token) + 1):
            score, n = scores.get(token[i:j]), 1
            if score is None:
                if j > i + 1:
                    continue
                n = len(token[i].encode())
                score = byte * n
            rest = go(j)
            out.append((round(score + rest[0], 9), -(n + rest[1])))
        top = max(out)
        return top[0], -top[1]

    return go(0)[1]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text("abé 中\n'", max_size=30), max_size=4))
def test_token_counts(texts):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "aba": -2.5, "▁": -1.0, "▁a": -1.25, "é": -3.0, "bb": -2.75}
    model = token_counts.UnigramCounts(list(scores.items()))
    got = model.count([*texts, None])
    for text, n in zip(texts, got.tolist(), strict=False):
        joined, points, bounds = S.code_points([text])
        starts, ends = S.pretokens(points, bounds, True)
        assert n == sum(best_split(joined[a:b].replace(" ", "▁"), scores, model.byte) for a, b in zip(starts, ends, strict=True))
    assert got[-1] == 0


def test_token_counts_like_a_unigram_model(monkeypatch):
    from tokenizers.models import Unigram

    pieces = token_counts.zipf_scores(P.path("piece_bpe_32k.model"))
    theirs = Unigram([("<unk>", -1e9), *pieces], 0, False)
    words = ["▁the", "▁tokenization", "▁internationalisation", "abcdefghij" * 9, "abcdefghij" * 8 + "xyz", "inter", "international", "▁a"] + ["wo" + "rd" * k for k in range(30)]
    for few in (0, 4, 100):  # level by level, both, node by node
        monkeypatch.setattr(token_counts, "FEW", few)
        model = token_counts.UnigramCounts(pieces)
        new = sorted(set(words), key=len, reverse=True)
        assert model.count_many(new).tolist() == [len(theirs.tokenize(w)) for w in new]


def test_token_counts_of_rows(spark):
    docs = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (1, "a b", 7), (None, "x" * 5000, 7)], "doc_id long, text string, n_tokens int")
    got = token_counts.count_tokens(docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 5000), (1, 3), (1, 3), (2, 0)]
    assert token_counts.count_tokens(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


def morse(n):
    """Two different words of n (a power of two) letters that many polynomial hashes can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 2048])
def test_words_of_equal_polynomial_hashes(n):
    one, other = morse(n)
    for name in FILES:
        ours, theirs = VOCABULARIES[name]
        texts = [one, other, f"{one} {other}", f"{other} {one}"]
        assert [x.tolist() for x in bpe.Vocabulary(P.path(name)).encode(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "ba": -2.125, "bba": -2.5, "▁": -1.0}
    got = token_counts.UnigramCounts(list(scores.items())).count([f"{one} {other}", one])
    alone = [int(token_counts.UnigramCounts(list(scores.items())).count([w])[0]) for w in (one, f" {other}")]
    assert got.tolist() == [sum(alone), alone[0]]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(S, "span_hashes", lambda codes, starts, ends: np.zeros(len(starts), np.uint64))
    joined, points, bounds = S.code_points(["ab", "cd", "ab", "abc", "", "cd", "x" * 300, "x" * 299 + "y", "x" * 300])
    which, shown = S.distinct_spans(points, bounds[:-1], bounds[1:])
    texts = [joined[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [texts[shown[k]] for k in which] == texts and len(shown) == len(set(texts))
    ours, theirs = bpe.Vocabulary(P.path(FILES[1])), VOCABULARIES[FILES[1]][1]
    assert [x.tolist() for x in ours.encode(texts)] == [theirs.encode(t).ids for t in texts]
