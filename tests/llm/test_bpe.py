import os
import random

import pytest

from quillon.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT_VOCABULARY), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.DEFAULT_VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def ids(encoder, texts):
    offsets, values = encoder.encode(texts)
    return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def random_text(rng):
    pools = [range(32, 127), range(0x20), range(0x80, 0x250), range(0x300, 0x370), range(0xE00, 0xF00), range(0x2000, 0x2070), range(0x4E00, 0x4F00), range(0x1F300, 0x1F600), [32, 10, 39], [0x1C, 0x85, 0xA0, 0x3000]]
    return "".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randrange(50)))


def test_equals_library_on_random_texts(library):
    rng = random.Random(5)
    texts = [random_text(rng) for _ in range(3000)]
    assert ids(bpe.Encoder(bpe.DEFAULT_VOCABULARY), texts) == library(texts)


def test_equals_library_on_hard_texts(library):
    texts = ["", " ", "  ", "a" * 5000, "ab" * 3000, "'s''s it's I'LL we'll 's", "<|endoftext|>", " \n\n  x  ", "a \n b\n \nc", "　　 a", "điều 5. Khoản 2", "塩田の理事会は窯の検査票を返還する" * 40]
    assert ids(bpe.Encoder(bpe.DEFAULT_VOCABULARY), texts) == library(texts)


def test_lockstep_equals_one_by_one():
    v = bpe.Vocabulary()
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoin thsr") for _ in range(rng.randrange(2, 60))).encode() for _ in range(400)]
    alone = [v.encode_one(v.byte_ids[list(w)].tolist()) for w in words]
    assert v.encode_words(words) == alone


def test_memory_is_renewed(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMO", 50)
    rng, encoder = random.Random(9), bpe.Encoder(bpe.DEFAULT_VOCABULARY)
    for _ in range(5):
        texts = [random_text(rng) for _ in range(60)]
        assert ids(encoder, texts) == library(texts)


def test_column_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "xin chào", 8), (4, "xin chào", 9)], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == [] and got[3] == got[4] and got[3]
    counts = {r.doc_id: r.n_tokens for r in bpe.count_column(df, ["doc_id"], "text").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert bpe.encode_column(df.where("false"), "doc_id", "text").count() == 0


def test_positions_fit_any_text():
    from quillon.llm import bpe

    assert bpe._POS >= 36 and 62 - bpe._POS > 20
