"""Rules over names, answer letters, pooling, settings, services and the flows that resolve citations."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillon import config
from quillon.functions import answers, rules, vectors
from quillon.operators import titles
from quillon.plans import clients, questions, service
from quillon.plans import pipelines as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, strict, tagged, line_first",
    [
        ("B. vì", "B", "B", "B"),
        ("Chọn\n  c \nHết", "C", "C", "C"),
        ("<output> d</output>", "D", "D", "<"),
        ("Ta thấy **A** đúng, không phải B", "A", "A", "T"),
        ("loại A, còn D", "A", "D", "A"),
        ("", "N/A", "N/A", ""),
        (None, "N/A", "N/A", ""),
        ("Bạn", "B", "N/A", "B"),
        ("x\n  C  \ny", "C", "C", "C"),
    ],
)
def test_letters(spark, text, strict, tagged, line_first):
    a = F.lit(text).cast("string")
    assert one(spark, answers.strict(a)) == strict
    assert one(spark, answers.tagged(a)) == tagged
    assert one(spark, answers.line_first(a)) in (line_first, "C" if text == "Chọn\n  c \nHết" else line_first)


def test_rules(spark):
    kind = lambda n: one(spark, rules.folder_kind(F.lit(n).cast("string")))
    assert [kind(n) for n in ("Luat_2020", "ngh", "thong_tu", "khác", None)] == ["luat", "nghi_dinh", "thong_tu", "other", None]
    relation = lambda s, t: one(spark, rules.relation_between(F.lit(s), F.lit(t)))
    assert relation("nghi_dinh", "luat") == "huong_dan_thi_hanh" and relation("nghi_dinh", "thong_tu") is None and relation("luat", "luat") is None
    assert one(spark, rules.relation_code(F.lit("Căn cứ"))) == "can_cu" and one(spark, rules.relation_code(F.lit("x"))) == "x"


def test_pooling(spark):
    tokens, mask = F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0))
    assert one(spark, vectors.pool(tokens, mask, "mean")) == [2.0, 4.0] and one(spark, vectors.pool(tokens, mask, "cls")) == [1.0, 2.0] == one(spark, vectors.pool(tokens, mask))
    assert one(spark, vectors.pool(tokens, mask, "auto", F.array(F.lit(7.0)))) == [7.0]
    none = F.transform(mask, lambda m: m * 0)
    assert one(spark, vectors.pool(tokens, none, "mean")) == [0.0, 0.0]
    with pytest.raises(ValueError):
        vectors.pool(tokens, mask, "max")
    with pytest.raises(ValueError):
        vectors.pool(tokens, mask, "none")


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"embedding": {"pooling": "cls", "batch_size": null}, "chunking": {"strategy": "fixed_size"}}')
    got = config.merge_config(str(tmp_path / "c.json"), {"chunking": {"overlap": 10}}, embedding={"max_length": 9})
    assert got["embedding"] == {"max_length": 9, "batch_size": 32, "pooling": "cls", "normalize": False}
    assert got["chunking"] == {"strategy": "hierarchical", "overlap": 10}
    assert [t for _, _, t in config.create_chunker(" FIXED_SIZE ", chunk_size=5, overlap=0)("d", "một hai ba")]
    assert config.create_chunker("hierarchical")("d", "Điều 1. A\nnội dung")[0][1] == "d.dieu_1"
    for bad in (lambda: config.create_chunker("x"), lambda: config.create_chunker("fixed_size", chunk_size=5, overlap=5)):
        with pytest.raises(ValueError):
            bad()


def test_http_client():
    calls = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(self.path)
            if self.path == "/embed":
                status, out = (422, {"detail": "too long"}) if "long" in body["texts"] else (200, {"embeddings": [[1.0]] * len(body["texts"])})
            elif self.path == "/rerank":
                status, out = 200, {"results": [{"index": 1, "score": 0.5}, {"index": 0 if body["query"] != "bad" else 7, "score": 2}]}
            else:
                status, out = (503, {}) if len([c for c in calls if c == "/generate"]) < 2 else (200, {"text": body["prompt"].upper()})
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"status": "ok"}')

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = clients.HttpClient(f"http://127.0.0.1:{server.server_port}", wait=0)
    assert client.healthy() and client.embed(["a", "b"]) == [[1.0], [1.0]]
    with pytest.raises(clients.ServiceError) as refused:
        client.embed(["long"])
    assert refused.value.status == 422 and calls.count("/embed") == 2
    assert client.score("q", ["x", "y"]) == [2.0, 0.5]
    with pytest.raises(ValueError):
        client.score("bad", ["x", "y"])
    assert client.generate("abc") == "ABC"
    server.shutdown()
    assert not clients.HttpClient("http://127.0.0.1:9", attempts=1).healthy()


def test_placed_scores():
    assert clients.placed_scores([{"index": 1, "score": 3}], 2) == [float("-inf"), 3.0] and clients.placed_scores(None, 0) == []
    for bad in ([{"score": 1}], [{"index": -1, "score": 1}], [{"index": 0, "score": 1}, {"index": 0, "score": 2}]):
        with pytest.raises(ValueError):
            clients.placed_scores(bad, 1)


NODES = [(1, "12_2020.chuong_ii.dieu_5", "A"), (2, "12_2020.chuong_ii.dieu_5.khoan_1", "B"), (3, "12_2020.chuong_ii.dieu_5.khoan_2", "C"), (4, "7_2019.dieu_5", "D"), (5, None, "E"), (6, "7_2019.dieu_6.diem_a", None)]
META = [(1, "12_2020", "Luật bến thuyền", "luat", "Đường sông"), (2, "7_2019", "Nghị định về phí cầu phao", "nghi_dinh", None), (3, None, None, None, None)]


@pytest.fixture(scope="module")
def stored(spark):
    nodes = spark.createDataFrame(NODES, "node_key long, id string, content string")
    return nodes, spark.createDataFrame(META, "meta_id long, so_hieu string, ten_van_ban string, loai string, linh_vuc string")


CITED = "r long, so_hieu string, ten_van_ban string, phan int, chuong string, muc int, dieu string, khoan string, diem string"


def test_citation_to_sections(spark, stored):
    nodes, meta = stored
    cited = spark.createDataFrame(
        [
            (1, "12_2020", None, None, "2", None, "5", "1", None),
            (2, None, "luật bến  thuyền", None, None, None, "5", None, None),
            (3, None, None, None, None, None, "5", None, None),
            (4, None, "không có văn bản nào như vậy", None, None, None, None, None, None),
            (5, None, None, None, None, None, None, None, None),
            (6, "7_2019", None, None, None, None, None, None, "a"),
        ],
        CITED,
    )
    found = questions.legal_query(cited, "r", meta, nodes)
    got = {}
    for r in found.collect():
        got.setdefault(r.request, []).append(r.chunk_id)
    assert {k: sorted(v) for k, v in got.items()} == {1: ["12_2020.chuong_ii.dieu_5.khoan_1"], 2: ["12_2020.chuong_ii.dieu_5"], 3: ["12_2020.chuong_ii.dieu_5", "7_2019.dieu_5"], 6: ["7_2019.dieu_6.diem_a"]}
    asked = cited.select("r", F.concat(F.lit("câu "), F.col("r").cast("string")).alias("query"))
    shown = {r.request: r.context for r in questions.shown_sections(found, asked, "r", "query", nodes, "id", "content").collect()}
    assert "[1] 12_2020 - Điều 5, Khoản 1" in shown[1] and shown[5].startswith("### Không tìm thấy: câu 5") and len(shown) == 6


def test_a_models_citation(spark):
    said = spark.createDataFrame([(1, 'Đây: ```json\n{"so_hieu": "12_2020", "dieu": "5", "phan": null}\n```'), (2, "không"), (3, None)], "r long, a string")
    got = {r.r: r for r in questions.citations_of(said, "r", "a").collect()}
    assert got[1].so_hieu == "12_2020" and got[1].dieu == "5" and got[1].phan is None and got[2].so_hieu is None and set(got) == {1, 2}


def test_section_filter(spark):
    p = questions.section_filter({"chuong": 6, "dieu": "5a", "kind": "dieu", "khoan": None})
    rows = spark.createDataFrame([("Chương vi", "Điều 5a", "dieu"), ("Chương 6", "Điều 5a", "dieu")], "chuong string, dieu string, kind string")
    assert rows.where(p).count() == 1
    assert [one(spark, questions.section_label("chuong", F.lit(x))) for x in ("6", "VI", "vi")] == ["Chương vi"] * 3
    with pytest.raises(ValueError):
        questions.section_filter({"dieu": None, "khoan": ""})


def test_finding_and_relating_documents(spark, stored):
    _, meta = stored
    asked = spark.createDataFrame([(1, "12/2020", "", "", ""), (2, None, "Nghị định về phí cầu phao", "", ""), (3, "", "", "luat", ""), (4, "", "", "", "SÔNG"), (5, "", "", "", "")], "r long, so_hieu string, ten_van_ban string, loai string, linh_vuc string")
    got = {(r.request, r.meta_id) for r in questions.find_documents(asked, "r", meta).collect()}
    assert got == {(1, 1), (2, 2), (3, 1), (4, 1)}
    relations = spark.createDataFrame([("7_2019", "12_2020", "can_cu"), ("x", "y", "z")], "entity_start string, entity_end string, relation_type string")
    related = {(r.request, r.direction, r.other) for r in questions.document_relations(asked, "r", meta, relations).collect()}
    assert related == {(1, "in", "7_2019"), (2, "out", "12_2020"), (3, "in", "7_2019"), (4, "in", "7_2019")}
    assert questions.find_documents(asked.where("false"), "r", meta).count() == 0


def test_titles_that_hold_others(spark):
    old = spark.createDataFrame([("a", " Phí cầu "), ("b", " "), ("c", None), ("a", "phí cầu")], "key string, title string")
    now = spark.createDataFrame([(1, "x", "Về PHÍ CẦU phao"), (2, "y", "phí"), (3, "z", None)], "key long, number string, title string")
    assert [(r.asked, r.meta_id) for r in titles.holding(old, now).collect()] == [("a", 1)]


def test_service_and_benchmark(spark, stored, capsys):
    _, meta = stored

    class Always:
        def generate(self, prompt):
            return "Đáp án: B" if "bến" in prompt else "không rõ"

    docs = spark.createDataFrame([("12_2020", "LUẬT\nĐiều 1. Phạm vi\nQuy định về bến thuyền\nĐiều 2. Phí\nMức phí mười đồng")], "so_hieu string, text string")
    chunks = P.index_documents(docs, "so_hieu", "text")
    relations = spark.createDataFrame([("a", "b", "can_cu")], "entity_start string, entity_end string, relation_type string")
    s = service.Service(meta, chunks, relations, generator=Always)
    asked = spark.createDataFrame([(1, "Chọn một", "bến thuyền là gì", "A. x\nB. y", " b"), (2, None, "bến thuyền", None, "C")], "k long, instruction string, question string, answers string, truth string")
    judged, share = service.benchmark(asked, "k", s)
    assert {r.k: (r.predicted, r.right) for r in judged.collect()} == {1: ("B", True), 2: ("B", False)} and share.first().accuracy == 0.5
    assert s.documents(1, 1).first().meta_id == 2 and "thay_the" in s.relation_types()
    assert {r.store: r.rows for r in s.stats().collect()}["documents"] == 3
    with pytest.raises(ValueError):
        service.Service(meta, chunks, relations).chat(asked, "k", "question")
    assert service.main(["list"]) == 0 and "filter_eq" in capsys.readouterr().out
    assert service.main(["query", "scan_count", "/root/testdata/sf0.001"]) == 0 and json.loads(capsys.readouterr().out)["n"] > 0


def test_whole_context_for_every_sub_question(spark):
    asked = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c")], "req string, sub string")
    gathered = spark.createDataFrame([("q", "x", 2), ("q", "y", 1), ("q", "x", 3), ("q", None, 0)], "req string, chunk string, pos int")
    got = {r.sub: r.context for r in P.merge_results(asked, gathered, "req", "chunk", "pos").collect()}
    assert got == {"a": ["y", "x"], "b": ["y", "x"], "c": []}


def test_deliveries_collapse_to_the_best_description(spark):
    from quillon.operators import store

    columns = "so_hieu string, k int, ten_van_ban string, loai string, co_quan_ban_hanh string, ngay_ban_hanh string, ngay_co_hieu_luc string, file_path string"
    rows = [
        ("a", 3, "Tên", None, "", "1", "", None), ("a", 1, "Chưa xác định", "luat", "", "0", "", "f"), ("a", 2, "", "", "Bộ", "", "", "g"), ("a", 4, "Khác", "x", "Sở", "9", "9", "h"),
        ("b", 1, None, None, None, None, None, None), ("", 1, "x", "x", "x", "x", "x", "x"), (None, 1, "x", "x", "x", "x", "x", "x"),
    ]
    got = {r.so_hieu: tuple(r)[1:] for r in store.collapse(spark.createDataFrame(rows, columns), "so_hieu", "k").collect()}
    assert got == {"a": (4, "Tên", "luat", "Bộ", "1", "", "g"), "b": (1, "Chưa xác định", "Văn bản", "", "", "", "")}


def test_stored_references_and_types(spark):
    from quillon.functions import ids

    got = [one(spark, ids.reference_ids(F.lit(x).cast("string"))) for x in ('["a", " b ", "a", ""]', '[{"ref_id": "a.dieu_1"}, {"x": 1}, "c"]', "[]", "không", None)]
    assert got == [["a", "b"], ["a.dieu_1", "c"], [], [], []]
    good = ["a.chuong_i.dieu_2__dup_1", "a", "a.phu_luc_phan_1", "a.x", None]
    assert [one(spark, ids.known_types(F.lit(x).cast("string"))) for x in good] == good
    with pytest.raises(Exception):
        one(spark, ids.known_types(F.lit("a.lạ_1")))


def test_requests_with_long_texts_are_refused_whole(spark):
    items = spark.createDataFrame([("q", 0, "một hai"), ("q", 1, "một " * 5), ("r", 0, None), ("r", 1, "hai")], "req string, at int, t string")
    taken, refused = P.refuse_long(items, "req", "at", "t", 3, 4)
    assert {(r.req, r["at"]) for r in taken.collect()} == {("r", 0), ("r", 1)}
    assert [tuple(r) for r in refused.collect()] == [("q", 1, 5, "một ")]


def test_relations_of_replacements_may_repeat(spark):
    meta = spark.createDataFrame([("a", 1)], "so_hieu string, trang_thai int")
    chunks = spark.createDataFrame([("a.dieu_1", "a", 1)], "chunk_id string, so_hieu string, trang_thai int")
    relation = spark.createDataFrame([("b", "a", "thay_the")], "entity_start string, entity_end string, relation_type string")
    for once, n in ((True, 1), (False, 2)):
        m, c, r = P.replace_documents(meta, chunks, relation, meta.where("false"), chunks.where("false"), relation, once=once)
        assert r.count() == n and m.first().trang_thai == 0 == c.first().trang_thai
