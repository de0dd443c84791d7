from __future__ import annotations

import random

import pytest

from anchorlake.llm import pieces, tokens
from anchorlake.llm.tokens import Bpe, encode_corpus, token_counts, vocabulary_path


@pytest.fixture(scope="module")
def bpe():
    return Bpe(open(vocabulary_path(), "rb").read())


def test_joins_give_what_one_run_gives(bpe):
    random.seed(4)
    for _ in range(150):
        s = "".join(random.choice("etaoinshr"[: random.randint(2, 9)]) for _ in range(random.randint(5, 1500))).encode()
        k = random.randint(1, 60)
        assert bpe.join_all([bpe.piece(s[j : j + k]) for j in range(0, len(s), k)]) == bpe.piece(s)


def test_long_texts_are_encoded_exactly(bpe):
    random.seed(6)
    kinds = ["a", "abc ", "天地玄黄", "=-", " \n", "don't ", "0123", "x\n\n", "é👍", "  \t"]
    for i in range(30):
        s = "".join(random.choice(random.choice(kinds)) for _ in range(40_000)) if i % 3 else random.choice(kinds)[:1] * 50_000 + "\n\n" + "b" * 9000
        assert bpe.encode(s) == bpe.bpe.encode_ordinary(s)
    s = "x " * 20_000 + "w\n\n" + "q" * 50_000 + "\n\n" + "z" * 10_000
    assert bpe.encode(s) == bpe.bpe.encode_ordinary(s)


def test_corpus(spark, bpe, monkeypatch):
    texts = ["", None, "hello world", "<|endoftext|> is text", " ", "a" * 40_000, "word " * 9000 + "中" * 20_000, "hello world"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, "hello world", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_corpus(df).collect())
    assert got == sorted((i, bpe.bpe.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert encode_corpus(df.limit(0)).collect() == []
    counts = {(r["doc_id"], r["tokens"]) for r in token_counts(df, ["doc_id"]).collect()}
    assert counts == {(i, len(ids)) for i, ids in got}


@pytest.mark.parametrize("limit,overlap", [(50, 10), (20, 0), (5, 2), (200, 90)])
def test_pieces(bpe, limit, overlap):
    random.seed(limit)
    texts = ["".join(random.choice(["word ", "Sentence. ", "line\n", "para\n\n", "x" * 90, "天地。", "👍", "don't "]) for _ in range(300)), "a" * 3000, "👍" * 500, "\n" * 999, "short " * (limit // 2)]
    for t in texts:
        raw, n = t.encode(), len(bpe.encode(t))
        cut = pieces.split(bpe, t, limit, overlap)
        assert (n > limit) == bool(cut)
        if not cut:
            continue
        assert cut[0][0] == 0 and cut[-1][1] == len(raw)
        for first, end, size, kind in cut:
            text = raw[first:end].decode()  # whole code points
            assert size == len(bpe.encode(text)) and (size <= limit or len(text) == 1)
        for a, b in zip(cut, cut[1:]):
            assert a[0] < b[0] <= a[1]  # nothing is left out, each goes on
            if overlap == 0:
                assert b[0] == a[1]


def test_pieces_end_at_boundaries_and_overlap(bpe):
    t = ("one two three four. " * 8 + "\n\n") * 40
    cut = pieces.split(bpe, t, 100, 20)
    assert {k for *_, k in cut[:-1]} == {"paragraph"}
    shared = [len(bpe.encode(t.encode()[b[0] : a[1]].decode())) for a, b in zip(cut, cut[1:])]
    assert all(19 <= n <= 42 for n in shared)


def test_split_corpus(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "w " * 3000, 3), (4, "w " * 900, 4)], "doc_id long, text string, piece int")
    got = pieces.split_oversized(df, limit=1000, overlap=100).collect()
    assert {r["doc_id"] for r in got} == {3} and all(r["tokens"] <= 1000 for r in got)
    assert [r["piece"] for r in sorted(got, key=lambda r: r["piece"])] == list(range(len(got)))
    with pytest.raises(ValueError):
        pieces.split_oversized(df, limit=10, overlap=5)
    assert tokens.LONG > tokens.PIECE > tokens.RUN
