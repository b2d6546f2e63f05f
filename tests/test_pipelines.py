import pytest
from pyspark.sql import functions as F

from quillon.operators import search
from quillon.plans import pipelines as P

LAW = "Số: 12/2022/NĐ-CP\nNGHỊ ĐỊNH\nQuy định về bến thuyền\nĐiều 1. Phạm vi\nQuy định về bến thuyền và phí cầu phao\nĐiều 2. Thu phí\n1. Mức phí cầu phao là mười đồng\n2. Miễn phí cho người cao tuổi\nĐiều 3. Hiệu lực thi hành\nNghị định này có hiệu lực từ ngày 1 tháng 2 năm 2023."


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("12_2022_nđ-cp", LAW), ("x", None), (None, "y"), ("trống", "")], "so_hieu string, text string")


@pytest.fixture(scope="module")
def chunks(docs):
    return P.index_documents(docs, "so_hieu", "text").persist()


def test_metadata(docs):
    row = P.document_metadata(docs.withColumnRenamed("so_hieu", "k"), "k", "text").where("k = '12_2022_nđ-cp'").first()
    assert (row.so_hieu, row.loai, row.ten_van_ban, row.ngay_co_hieu_luc, row.so_dieu) == ("12_2022_nđ-cp", "nghi_dinh", "NGHỊ ĐỊNH Quy định về bến thuyền", "01/02/2023", 3)


def test_index(chunks):
    rows = {r.chunk_id: r for r in chunks.collect()}
    assert "12_2022_nđ-cp.dieu_2.khoan_1" in rows and rows["12_2022_nđ-cp.dieu_2.khoan_1"].text.startswith("Điều 2. Thu phí\n1. Mức phí")
    assert all(len(r.vector) == 64 and r.error is None and r.trang_thai == 1 for r in rows.values())


def test_long_contents_become_parts(spark):
    docs = spark.createDataFrame([("d", "Điều 1. Dài\n" + "từ " * 4500)], "so_hieu string, text string")
    got = sorted(r.chunk_id for r in P.chunk_documents(docs, "so_hieu", "text").collect())
    assert got == ["d.dieu_1_part_0", "d.dieu_1_part_1", "d.dieu_1_part_2"]


def test_replacement(spark, chunks):
    meta = spark.createDataFrame([("12_2022_nđ-cp", "a", 1)], "so_hieu string, ten_van_ban string, trang_thai int")
    new = spark.createDataFrame([("13_2024_nđ-cp", "b", 1)], "so_hieu string, ten_van_ban string, trang_thai int")
    relations = spark.createDataFrame([("p", "q", "can_cu")], "entity_start string, entity_end string, relation_type string")
    change = spark.createDataFrame([("13_2024_nđ-cp", "12_2022_nđ-cp", "thay_the"), ("p", "q", "can_cu")], "entity_start string, entity_end string, relation_type string")
    m, c, r = P.replace_documents(meta, chunks, relations, new, chunks.where("false"), change)
    assert {(x.so_hieu, x.trang_thai) for x in m.collect()} == {("12_2022_nđ-cp", 0), ("13_2024_nđ-cp", 1)}
    assert {x.trang_thai for x in c.collect()} == {0} and r.count() == 2


def test_sub_questions(spark):
    rows = [(1, '```json\n{"sub_questions": [{"query": "a", "intent": "general"}, {"query": "b", "intent": "lạ"}]}\n```'), (2, "không đọc được"), (3, '{"sub_questions": []}')]
    got = P.sub_questions(spark.createDataFrame(rows, "q long, a string"), "q", "a").orderBy("q", "pos").collect()
    assert [(r.q, r.query, r.branch) for r in got] == [(1, "a", "general"), (1, "b", "fallback"), (2, "", "fallback"), (3, "", "fallback")]


def test_answers(spark, chunks):
    class Echo:
        def generate(self, prompt):
            return prompt.split("\n")[1][:40]

    questions = spark.createDataFrame([(1, "mức phí cầu phao"), (2, "")], "id long, text string")
    got = {r.query: r for r in P.answer(questions, "id", "text", chunks, Echo).collect()}
    assert set(got) == {1, 2} and got[2].answer is None
    assert "12_2022_nđ-cp - Điều 2" in got[1].citations and got[1].answer.startswith("[Nguồn 1]")
    with pytest.raises(ValueError):
        P.build_prompts(chunks, "không có chỗ")


def test_queries_in_blocks(spark, chunks, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "ROW_BLOCK", 3)
    asked = chunks.select("chunk_id", "vector", F.col("chunk_id").alias("other"))
    ask = lambda q, k, **how: search.top_k_of_queries(asked, "chunk_id", "vector", q, "chunk_id", "vector", k, **how)
    got = ask(asked, 1).collect()
    assert len(got) == asked.count() and all(r.distance < 1e-6 for r in got)
    assert ask(asked.where("false"), 1).count() == 0
    assert all(r.query != r.key for r in ask(asked, 3, unlike=("other", "other")).collect())


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_blocks_of_odd_vectors(spark, metric):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, []), (6, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0]), (None, [1.0, 0.0])], "k long, v array<float>")
    got = search.top_k_of_queries(rows, "k", "v", rows.where("k in (1, 3, 7) or k is null"), "k", "v", 2, metric).orderBy("query", "rank").collect()
    assert [(r.query, r.key) for r in got] == [(1, 1), (1, 6), (7, 7)]


def test_second_stage_needs_a_reranker_and_texts(spark):
    rows = spark.createDataFrame([(1, "x", 0.5), (2, None, 0.9), (3, "y", 0.7)], "k long, t string, s double")
    assert [r.k for r in search.two_stage(rows, [], "t", F.col("s"), 2, "k").orderBy("rank").collect()] == [3, 1]
    for text, score in (("t", None), ("none", F.col("s"))):
        with pytest.raises(ValueError):
            search.two_stage(rows, [], text, score, 2, "k")


def test_apology_and_side_output(spark, docs, chunks):
    class Echo:
        def generate(self, prompt):
            return ""

    questions = spark.createDataFrame([(1, "mức phí cầu phao"), (2, "")], "id long, text string")
    assert {r.answer for r in P.answer_all(questions, "id", "text", chunks, Echo).collect()} == {P.APOLOGY}
    lines = P.chunk_lines(docs, "so_hieu", "text").where("so_hieu = '12_2022_nđ-cp'").orderBy("seq").collect()
    assert '"kind":"van_ban"' in lines[0].line and len(lines) > 4
