import unicodedata

import pytest

from quillon.llm.canonical import alike_classes, alike_pairs, canonical_column, confusables

BASE = "Điều 5. Tổ chức thí điểm, mục VIII"
ALIKE = [
    unicodedata.normalize("NFD", BASE),
    BASE.replace(" ", " "),
    BASE.replace("chức", "ch​ức­"),
    "  " + BASE.replace(" ", " \n\t") + "　",
    BASE.replace("5", "５").replace("m", "ｍ"),
    BASE.replace("o", "о").replace("T", "Т").replace("c", "с"),
    BASE.replace("Đ", "Ð"),
    BASE.replace("VIII", "Ⅷ"),
    BASE.replace(",", "，"),
    unicodedata.normalize("NFD", BASE).replace("o", "ο"),
]
DIFFERENT = [BASE.lower(), BASE.replace("Đ", "D"), BASE.replace("chức", "chưc"), BASE + "-", BASE.replace(",", ";"), BASE.replace("5", "6")]


@pytest.fixture(scope="module")
def forms(spark):
    df = spark.createDataFrame(list(enumerate([BASE, *ALIKE, *DIFFERENT, None, "", " ​ "])), "k long, t string")
    return {r.k: r.canonical for r in canonical_column(df, "k", "t").collect()}


def test_alike_texts_meet(forms):
    assert {forms[i] for i in range(len(ALIKE) + 1)} == {BASE}


def test_different_texts_stay_apart(forms):
    n = len(ALIKE) + 1
    others = [forms[i] for i in range(n, n + len(DIFFERENT))]
    assert len(set(others)) == len(others) and BASE not in others


def test_null_and_blank(forms):
    n = len(ALIKE) + len(DIFFERENT) + 1
    assert forms[n] is None and forms[n + 1] == forms[n + 2] == ""


def test_visible_differences_of_signs_and_tones(spark):
    rows = ["hòa", "hoà", "a-b", "a–b", "a‑b", "a−b"]
    got = [r.canonical for r in canonical_column(spark.createDataFrame(list(enumerate(rows)), "k long, t string"), "k", "t").orderBy("k").collect()]
    assert got[0] != got[1] and got[2] == got[4] and len({got[2], got[3], got[5]}) == 3


def test_pairs_copies_and_extra_columns(spark):
    rows = [(1, "ab c"), (2, "ab c"), (3, "ab  c"), (4, "аb c"), (5, "x"), (6, None), (7, " "), (8, "  ")]
    df = spark.createDataFrame([(k, t, "form", 0) for k, t in rows], "node_key long, t string, form string, k int")
    got = {(r.key_a, r.key_b) for r in alike_pairs(df, "node_key", "t").collect()}
    assert got == {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    classes = {(r.first_key, r.copies) for r in alike_classes(df, "node_key", "t").collect()}
    assert classes == {(1, 2), (3, 1), (4, 1)}
    assert alike_pairs(df.where("false"), "node_key", "t").count() == 0


def test_look_alikes_of_the_public_data(spark):
    table = confusables(spark)
    assert [table[c] for c in "αρυνоᎪⲞ"] == list("apuvoAO")
    assert all(c.isupper() == to.isupper() for c, to in table.items()) and not {"ı", "ĸ", "ɑ"} & set(table)


def test_a_hot_form_costs_what_its_pairs_cost(spark):
    import time

    n = 80_000
    df = spark.range(n).selectExpr("id AS k", "if(id = 7, 'ab  c', 'ab c') AS t")
    alike_pairs(df.limit(100), "k", "t").count()
    began = time.time()
    assert alike_pairs(df, "k", "t").count() == n - 1
    assert time.time() - began < 20
