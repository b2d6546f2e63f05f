"""Small fixtures for the structure and citation functions."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.functions import citations as C
from quillon.functions import legal as L
from quillon.functions import metadata as M
from quillon.functions import text as T
from quillon.operators import search, store


def keep(spark, names):
    rows = spark.createDataFrame([(1, n) for n in names], "q int, id string")
    return sorted(r.id for r in search.drop_descendants(rows, "q", "id").collect())


@pytest.mark.parametrize(
    "given, kept",
    [
        (["law.art_1", "law.art_1.clause_1"], ["law.art_1"]),
        (["law.art_2", "law.art_2.clause_1.point_a"], ["law.art_2"]),
        (["law.art_3__dup_0", "law.art_3.clause_1"], ["law.art_3__dup_0"]),
        (["law.art_4.clause_1", "law.art_5.clause_1"], ["law.art_4.clause_1", "law.art_5.clause_1"]),
        (["doc_1.sec_1", "doc_1.sec_1.sub_1", "doc_1.sec_2.sub_2", "doc_1.sec_2.sub_2.p_a"], ["doc_1.sec_1", "doc_1.sec_2.sub_2"]),
    ],
)
def test_drop_descendants(spark, given, kept):
    assert keep(spark, given) == kept


@pytest.mark.parametrize(
    "main, ref, stays",
    [("law.dieu_5", "law.dieu_3", True), ("law.dieu_5.khoan_1", "law.dieu_5", False), ("law.dieu_5", "law.dieu_5.khoan_1", False), ("law.dieu_5", "law.dieu_5", False), ("law.dieu_5", "law.dieu_55", True)],
)
def test_family(spark, main, ref, stays):
    assert spark.range(1).select(search.outside_family(F.lit(main), F.lit(ref)).alias("x")).first().x is stays


def test_best_references(spark):
    rows = spark.createDataFrame([("m", f"law.dieu_{i}", s) for i, s in ((1, 9.0), (2, 4.0), (3, 7.5), (4, None))], "main string, ref string, score double")
    assert [r.ref for r in search.best_references(rows, "main", "ref", "score", most=2).orderBy("rank").collect()] == ["law.dieu_1", "law.dieu_3"]


def test_decode(spark):
    given = ["91_2015_qh13.dieu_6.khoan_1.diem_a", "111_2021_vb.dieu_10__dup_0.khoan_2__dup_0", "x.modau.dieu_1_2", "x", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "n int, id string")
    got = df.select("n", *(c.alias(k) for k, c in ids.decode(F.col("id")).items())).orderBy("n").collect()
    assert (got[0].so_hieu, got[0].dieu, got[0].khoan, got[0].diem) == ("91_2015_qh13", "Điều 6", "Khoản 1", "Điểm a")
    assert (got[1].dieu, got[1].khoan, got[2].dieu, got[3].dieu, got[4].dieu) == ("Điều 10", "Khoản 2", "Điều 1.2", None, None)


def test_roman_and_numbers(spark):
    df = spark.createDataFrame([(6,), (0,), (-3,), (1994,), (None,)], "n int")
    assert [r.x for r in df.select(T.to_roman(F.col("n")).alias("x")).collect()] == ["vi", "0", "-3", "mcmxciv", None]
    df = spark.createDataFrame([("VI",), ("mười hai",), ("xyz",)], "w string")
    assert [r.x for r in df.select(T.to_number(F.col("w")).alias("x")).collect()] == ["6", "12", "xyz"]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Chương VI. Quy định", ("chuong", "vi")), ("Phần thứ hai", ("phan", "2")), ("ĐIỀU 5.", ("dieu", "5")), ("Điều 5a. Tên", ("dieu", "5a")), ("1. Chữ", ("so_cap_1", "1")),
        ("1.2. Chữ", ("so_cap_2", "1_2")), ("đ) Chữ", ("chu_thuong", "đ")), ("i. Chữ", ("muc_roman", "i")), ("Nơi nhận:", ("noi_nhan", "")), ("Văn bản này", None),
    ],
)
def test_heading_in_both_engines(spark, line, expected):
    h = spark.range(1).select(T.heading(F.lit(line)).alias("h")).first().h
    assert L.heading(line) == expected
    assert (h and tuple(h)) == (expected and (expected[0], {"phan": "hai"}.get(expected[0], expected[1])))


def test_document_heads(spark):
    df = spark.createDataFrame([("Số: 135/VBHN-VPQH\nLuật",), ("Luật số: 91/2015/QH14 về",), ("theo 12/2022/NĐ-CP nay",), ("không có",), (None,)], "t string")
    assert [r.x for r in df.select(T.document_number(F.col("t")).alias("x")).collect()] == ["135_vbhn-vpqh", "91_2015_qh14", "12_2022_nđ-cp", "", ""]
    titled = spark.createDataFrame([("QUỐC HỘI\nBỘ LUẬT\n---\nDÂN SỰ\nCăn cứ Hiến pháp",), ("không tên",), ("",), (None,), ("LUẬT\n" + "\n".join("abcdef"),)], "t string")
    assert [r.x for r in titled.select(M.title(F.col("t")).alias("x")).collect()] == ["BỘ LUẬT DÂN SỰ", "", "", None, "LUẬT a b c d"]


def test_agency_and_dates(spark):
    texts = [
        "BỘ TÀI CHÍNH\nHà Nội, ngày 2 tháng 3 năm 2015\nĐiều 9. Hiệu lực thi hành\nLuật này có hiệu lực thi hành từ ngày 1 tháng 7 năm 2016.",
        "Hà Nội, ngày 2 tháng 3 năm 2015; có hiệu lực kể từ ngày ký",
        "được Quốc hội thông qua ngày 5 tháng 6 năm 2014; " + "x" * 5000 + " áp dụng từ ngày 1 tháng 1 năm 2017",
        "áp dụng từ ngày 1 tháng 1 năm 2011\nĐiều 8. Tổ chức thực hiện\nkhông\nĐiều 9. Điều khoản thi hành\nhiệu lực từ ngày 9 tháng 9 năm 2019",
        "có hiệu lực kể từ ngày ký",
        "",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = df.select(M.agency(F.col("t")).alias("a"), M.issue_date(F.col("t")).alias("i"), M.effective_date(F.col("t")).alias("e"), "k").orderBy("k").collect()
    assert [r.a for r in got] == ["Bộ Tài Chính", "", "Quốc Hội", "", "", "", None]
    assert [r.i for r in got] == ["02/03/2015", "02/03/2015", "05/06/2014", "01/01/2011", "", "", None]
    assert [r.e for r in got] == ["01/07/2016", "02/03/2015", "01/01/2017", "09/09/2019", "", "", None]


def test_citations():
    assert C.list_items("khoản", "các khoản 1, 2 và 3 Điều 5") == ["1", "2", "3"]
    own = {"luat_id": "nay", "dieu_id": "nay.dieu_2"}
    assert C.extract_refs("theo khoản 1, khoản 2 Điều 5 Luật này", own) == ["nay.dieu_5.khoan_1", "nay.dieu_5.khoan_2", "nay"]
    assert C.extract_refs("điểm a, b khoản 1 Điều 4 của Nghị định số 12/2022/NQ-CP", own) == ["12_2022_nq-cp.dieu_4.khoan_1.diem_a", "12_2022_nq-cp.dieu_4.khoan_1.diem_b"]
    assert C.extract_refs("từ Điều 3 đến Điều 5", own)[:3] == ["nay.dieu_3", "nay.dieu_4", "nay.dieu_5"]
    assert "nay.dieu_9" not in C.extract_refs("từ Điều 9 đến Điều 3", {"luat_id": "x"})
    assert C.extract_refs("khoản 2 và điểm c", own) == ["nay.dieu_2.diem_c"]
    assert C.extract_refs("", own) == []
    assert C.self_refs("Điều này và thời điểm này", {"dieu_id": "a.dieu_1", "diem_id": "a.dieu_1.diem_b"}) == ["a.dieu_1"]


def test_tokens_join_what_waits_to_the_article_that_follows():
    assert C.extract_refs("từ khoản 1 đến khoản 3 Điều 5 của Luật Đất đai.", {}) == [f"luat_dat_dai.dieu_5.khoan_{i}" for i in (1, 2, 3)]
    assert C.extract_refs("khoản 1 Điều 5 và khoản 2 Điều 6 Nghị định số 12/2022/NĐ-CP", {}) == ["12_2022_nd-cp.dieu_5.khoan_1", "12_2022_nd-cp.dieu_6.khoan_2"]
    assert C.extract_refs("mục 2 chương III Thông tư số 5/2020/TT-BTC", {}) == ["5_2020_tt-btc.chuong_iii", "5_2020_tt-btc.chuong_iii.muc_2"]
    assert C.extract_refs("theo Luật Đất đai, điểm a khoản này", {"dieu_id": "a.dieu_1", "khoan_id": "a.dieu_1.khoan_2"}) == ["a.dieu_1.khoan_2.diem_a"]
    assert C.extract_refs("Chương này và danh mục này", {"chuong_id": "a.chuong_i", "muc_id": "a.muc_1", "luat_id": "a"}) == ["a.chuong_i"]
    assert C.extract_refs("Điều 7 của Luật Giá, Điều 8 của Luật Phí.", {}) == ["luat_gia.dieu_7", "luat_phi.dieu_8"]


def test_references_of_a_model():
    item = {"raw_text": "khoản 2 Điều 5 Luật Giá", "ref_doc_name": "Luật Giá 2012", "target_ids": {"dieu": "5", "khoan": "2", "diem": "none"}, "confidence": "0.9"}
    assert C.model_reference(item)["ref_id"] == "luat_gia_2012.dieu_5.khoan_2" and C.model_reference(item)["confidence"] == 0.9
    whole = {"raw_text": "Thông tư số 45/2017/TT-BTC", "ref_doc_id": "45/2017/TT-BTC", "target_ids": {"dieu": "45"}}
    assert C.model_reference(whole)["ref_id"] == "45_2017_tt-btc"
    own = {"raw_text": "Điều 3 Luật này", "is_self_ref": True, "target_ids": {"dieu": "3.1", "chuong": "2015_x"}}
    assert C.model_reference(own, {"luat_id": "91_2015_qh13"})["ref_id"] == "91_2015_qh13.dieu_3_1"
    assert C.model_reference(own) is None and C.model_reference({"ref_doc_id": "108"}) is None and C.model_reference({"ref_doc_id": "dieu_4"}) is None
    assert C.is_junk("4.dieu_4.khoan_3") and not C.is_junk("bblds_2015.dieu_1") and C.is_junk(None)
    assert C.cites_whole_document("Nghị định này") and not C.cites_whole_document("Điều 5 Nghị định này") and not C.cites_whole_document(None)
    assert len(C.merged_candidates(["x" * 2000, "y" * 2000])) == 3000


def test_model_output():
    assert L.safe_json('Đây: {hỏng} rồi ```json\n{"a": [1, 2]}\n```') == '{"a":[1,2]}'
    assert L.safe_json("không") is None
    assert L.html_to_text("<p>Một <b>hai</b></p><script>x('</p>')</script><div>ba&nbsp;bốn</div>") == "Một hai\nba bốn"
    assert L.likeness("Bộ luật hình sự", "BỘ LUẬT HÌNH SỰ") == 1.0 and L.normalize_name("Đường  Ấp") == "đuong ap"


def test_chunks():
    text = "câu một. câu hai! câu ba? " * 40
    assert all(len(c.split()) <= 12 for c in L.greedy_pack(text, 12)) and " ".join(L.greedy_pack(text, 12)).split() == text.split()
    chunks = L.fixed_chunks(text, 100, 20)
    assert all(len(c) <= 100 for c in chunks) and chunks[0] == text[: len(chunks[0])]
    assert all(len(c) <= 50 for c in L.fixed_chunks("x" * 500, 50, 10)) and L.fixed_chunks("", 10, 2) == []
    words = " ".join(map(str, range(5000)))
    parts = L.oversize_split(words)
    assert parts[0].split()[-200:] == parts[1].split()[:200] and parts[-1].split()[-1] == "4999" and L.oversize_split("a b") == ["a b"]


def test_tree():
    text = "Mở đầu\nChương I\nQUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\nNội dung chung\n1. Khoản một\na) Điểm a\ntiếp\n2. Khoản hai\nĐiều 1. Lặp\nPhụ lục I.\nBảng"
    rows = {r[1]: r for r in L.flat_chunks("d", text)}
    assert list(rows) == ["d.modau_1", "d.chuong_i", "d.chuong_i.dieu_1__dup_0", "d.chuong_i.dieu_1.khoan_1", "d.chuong_i.dieu_1.khoan_1.diem_a", "d.chuong_i.dieu_1.khoan_2", "d.chuong_i.dieu_1__dup_1", "d.phu_luc_i"]
    assert rows["d.chuong_i"][5] == "Chương I : QUY ĐỊNH CHUNG" and rows["d.chuong_i.dieu_1__dup_0"][6] == "Nội dung chung"
    assert rows["d.chuong_i.dieu_1.khoan_1"][7] == "1. Khoản một\na) Điểm a\ntiếp" and rows["d.chuong_i.dieu_1.khoan_1.diem_a"][6] == "tiếp"
    assert rows["d.chuong_i.dieu_1.khoan_1"][4] == "Chương I : QUY ĐỊNH CHUNG\nĐiều 1. Phạm vi\nNội dung chung"
    assert L.flat_chunks("d", "") == []


def test_stores(spark):
    base = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "k string, v int, flag int")
    delta = spark.createDataFrame([("b", 2, 0), ("c", 3, 1)], "k string, v int, flag int")
    assert sorted(tuple(r) for r in store.upsert(base, delta, "k", keep=("flag",)).collect()) == [("a", 1, 0), ("b", 2, 1), ("c", 3, 1)]
    triples = spark.createDataFrame([("x", None), ("x", "y")], "s string, t string")
    more = spark.createDataFrame([("x", None), ("x", "z"), ("x", "z")], "s string, t string")
    assert sorted(map(str, (tuple(r) for r in store.add_missing(triples, more, ["s", "t"]).collect()))) == ["('x', 'y')", "('x', 'z')", "('x', None)"]
    rows = spark.createDataFrame([(1, k) for k in range(0, 200_000, 20_000)] + [(None, 5)], "g int, k long")
    got = {(r.g, r.k): r.n for r in store.ordinal(rows, "g", "k", "n").collect()}
    assert got[(1, 180_000)] == 10 and got[(None, 5)] == 1


def test_top_k_limits(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "k long, v array<float>")
    assert [r.k for r in search.top_k(rows, "v", [1.0, 0.0], 3, "k").collect()] == [1, 4]
    with pytest.raises(ValueError):
        search.top_k(rows, "v", [1.0, 0.0], 101, "k")


def test_ids_unique_in_a_document_and_in_a_batch(spark):
    rows = [(1, "d", "a"), (2, "d", "a"), (3, "d", "a.1"), (4, "d", "a"), (5, "d", "b"), (6, "d", "b"), (7, "e", "a"), (8, "d", "c.1"), (9, "d", "c"), (10, "d", "c"), (11, "d", None), (12, "d", None), (13, None, "a"), (14, None, "a")]
    df = spark.createDataFrame(rows, "o long, doc string, id string")
    got = {r.o: r.unique_id for r in ids.unique_in_document(df, "doc", "id", "o").collect()}
    assert got == {1: "a", 2: "a.1", 3: "a.1.1", 4: "a.2", 5: "b", 6: "b.1", 7: "a", 8: "c.1", 9: "c", 10: "c.2", 11: None, 12: None, 13: "a", 14: "a.1"}
    assert ids.unique_in_document(df.where("false"), "doc", "id", "o").count() == 0
    batch = df.where("id is not null").withColumn("batch", F.lit(1))
    assert {r.o: r.unique_id for r in ids.batch_numbers(batch, "batch", "id", "o").collect() if ".batch." in r.unique_id} == {2: "a.batch.1", 4: "a.batch.2", 6: "b.batch.3", 7: "a.batch.4", 10: "c.batch.5", 13: "a.batch.6", 14: "a.batch.7"}
