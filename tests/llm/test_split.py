import os

import random
import re

import pytest

from quillon.llm.split import WHITE, pieces_of, split_oversized

WS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in WHITE) + "]")


@pytest.mark.parametrize("seed", range(4))
def test_properties(seed):
    rng = random.Random(seed)
    for _ in range(400):
        limit, overlap = rng.choice([(10, 3), (12, 0), (30, 8), (50, 20)])
        letters = rng.choice(["ab ", "a \n.", "abcdefgh ", "a", "ab。 ", "abcdefghijklmnop\n\n. "])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(200)))
        got = pieces_of(text, limit, overlap)
        if not text:
            assert got == []
            continue
        assert got[0][0] == 0 and got[-1][1] == len(text)
        assert all(0 < e - s <= limit for s, e, _ in got)
        for (s, e, _), (s2, e2, _) in zip(got, got[1:]):
            assert s < s2 <= e < e2 and e - s2 <= overlap
        forced = any(f for *_, f in got)
        assert len(text) <= limit or forced == (max(map(len, WS.split(text))) > limit)


def test_prefers_strong_places():
    text = "Một câu ngắn. " * 3 + "\n\n" + "hai ba bốn " * 3
    assert text[: pieces_of(text, 60, 10)[0][1]].endswith("\n\n")


def test_run_of_exactly_the_limit_is_free():
    assert not any(f for *_, f in pieces_of("ab " + "x" * 20 + " cd", 20, 5))
    assert any(f for *_, f in pieces_of("ab " + "x" * 21 + " cd", 20, 5))


def test_bytes_as_unit(spark):
    df = spark.createDataFrame([(1, "điều khoản " * 20)], "k long, t string")
    for r in split_oversized(df, ["k"], "t", 50, 10, unit="bytes").collect():
        assert len(r.piece.encode()) <= 50


def test_table(spark):
    long = "từ ngữ " * 500
    rows = [(1, None, "x"), (2, "", "x"), (3, "ngắn", "x"), (4, long, "x"), (4, long, "x"), (5, "y" * 3000, "x")]
    df = spark.createDataFrame(rows, "node_key long, t string, piece string")
    got = split_oversized(df, ["node_key"], "t").collect()
    assert {r.node_key for r in got} == {3, 4, 5}
    assert {r.text_forced for r in got if r.node_key == 4} == {False} and {r.text_forced for r in got if r.node_key == 5} == {True}
    one = sorted({(r.piece_no, r.start_pos, r.end_pos, r.piece) for r in got if r.node_key == 4})
    whole, at = "", 0
    for _, s, e, piece in one:
        assert piece == long[s:e] and len(piece) <= 1200
        whole, at = whole + long[at:e], e
    assert whole == long
    assert split_oversized(df.where("false"), ["node_key"], "t").count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, ["node_key"], "t", 10, 10)


def test_pieces_by_tokens(spark):
    from quillon.llm.bpe import DEFAULT_VOCABULARY, Encoder

    if not os.path.exists(DEFAULT_VOCABULARY):
        pytest.skip("no public vocabulary here")
    encoder = Encoder.of(DEFAULT_VOCABULARY)
    text = "Điều 1. Phạm vi điều chỉnh\n\nLuật này quy định về bến thuyền 漢字😀. " * 40
    sizes = encoder.sizes(text)
    offsets, ids = encoder.encode([text])
    assert sizes.sum() == len(ids) and len(sizes) == len(text)
    df = spark.createDataFrame([(1, text), (2, "ngắn"), (3, ""), (4, None), (5, "é" * 30)], "k long, t string")
    rows = sorted(split_oversized(df, ["k"], "t", 64, 8, unit="tokens").collect())
    assert {r.k for r in rows} == {1, 2, 5}
    mine = [r for r in rows if r.k == 1]
    assert all(sizes[r.start_pos : r.end_pos].sum() <= 64 for r in mine) and mine[-1].end_pos == len(text)
    assert "".join([mine[0].piece] + [b.piece[a.end_pos - b.start_pos :] for a, b in zip(mine, mine[1:])]) == text
    large = split_oversized(df, ["k"], "t", 64, 8, unit="tokens", small=False).collect()
    assert {r.k for r in large} == {1}
    with pytest.raises(ValueError):
        split_oversized(df, ["k"], "t", 64, 8, unit="words")
