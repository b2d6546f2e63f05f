import datetime as dt
import io
import zipfile

from quillon.operators.orphans import OrphanState
from quillon.plans import clients
from quillon.sources import files
from quillon.streaming.ingest import EVENTS, follow_orphans, ingest_documents

DOC = "document_metadata"


def event(kind, key, day, ref=None):
    return (kind, ref, "entity_end" if ref else None, DOC, key, dt.datetime(2024, 1, day))


def test_orphans_follow_a_stream(spark, tmp_path):
    steps = [[event("reference", "a", 3, 1), event("reference", "b", 3, 2), event("parent", "a", 1)], [event("parent", "b", 9)], [event("removal", "a", 1), event("deletion", "a", 20)]]
    state = OrphanState(spark)
    seen = []
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        follow_orphans(stream, state, str(tmp_path / f"checkpoint{n}"), availableNow=True).awaitTermination() if n == 0 else state.advance(
            parents=spark.createDataFrame([(DOC, k, t, 1 if kind == "parent" else -1) for kind, _, _, _, k, t in rows if kind in ("parent", "removal")], "target_table string, key string, seen_at timestamp_ntz, op int"),
            deletions=spark.createDataFrame([(DOC, k) for kind, _, _, _, k, _ in rows if kind == "deletion"], "target_table string, key string"),
        )
        seen.append({r.id: r.kind for r in state.orphans().collect()})
    assert seen == [{2: "missing"}, {2: "late"}, {1: "deleted", 2: "late"}]


def test_a_stream_that_is_started_again_goes_on(spark, tmp_path):
    """A new state on the same folder, and the same checkpoint, as after the loss of the driver."""
    steps = [[event("reference", "a", 3, 1), event("reference", "b", 3, 2), event("parent", "a", 1)], [event("parent", "b", 9)], [event("removal", "a", 1), event("reference", "c", 4, 3)]]
    seen = []
    for rows in steps:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        state = OrphanState(spark, path=str(tmp_path / "state"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        follow_orphans(stream, state, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
        seen.append({r.id: r.kind for r in OrphanState(spark, path=str(tmp_path / "state")).orphans().collect()})
    assert seen == [{2: "missing"}, {2: "late"}, {1: "missing", 2: "late", 3: "missing"}]


def test_ingest(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    ingest_documents(stream, lambda d: d.selectExpr("id", "upper(text) as text"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()
    assert {r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"X", "Y"}


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("co_quan_ban_hanh,count\nBộ A,5\nBộ B,không\nBộ C,7\n", encoding="utf-8")
    assert {r[0] for r in files.read_counts(spark, str(tmp_path / "a.csv")).select("co_quan_ban_hanh", "count").collect()} == {"Bộ A", "Bộ C"}
    (tmp_path / "b.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert files.read_json_lines(spark, str(tmp_path / "b.jsonl"), "id int").where("id is not null").count() == 2
    (tmp_path / "c.json").write_text('[{"id": 1, "answer": "A"}, {"id": 2, "answer": "B"}]')
    assert {r.answer for r in files.read_json_array(spark, str(tmp_path / "c.json"), "id int, answer string").collect()} == {"A", "B"}
    rows = spark.range(10)
    parts = [{r.id for r in files.shard(rows, "id", 3, i).collect()} for i in range(3)]
    assert parts == [{0, 1, 2}, {3, 4, 5}, {6, 7, 8, 9}]


def test_folder_of_documents(spark, tmp_path):
    folder = tmp_path / "luat"
    folder.mkdir()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", '<w:document><w:p><w:r><w:t>Điều 1.</w:t></w:r></w:p><w:p><w:r><w:t xml:space="preserve">A &amp; B</w:t></w:r></w:p></w:document>')
    (folder / "a.docx").write_bytes(packed.getvalue())
    (folder / "b.txt").write_text("chữ", encoding="utf-8")
    (folder / "c.pdf").write_bytes(b"%PDF")
    (folder / "d.exe").write_bytes(b"x")
    found = files.read_folder(spark, str(tmp_path))
    assert {(r.folder, r.extension) for r in found.collect()} == {("luat", "docx"), ("luat", "txt"), ("luat", "pdf")}
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.extract_text(found, files.TEXT_EXTRACTORS).collect()}
    assert got["a.docx"] == ("Điều 1.\nA & B", None) and got["b.txt"][0] == "chữ" and "no extractor" in got["c.pdf"][1]


def test_clients(spark):
    class Failing:
        def generate(self, prompt):
            if "lỗi" in prompt:
                raise RuntimeError("no service")
            return prompt.upper()

    df = spark.createDataFrame([(1, "bến thuyền", "bến"), (2, None, "x"), (3, "lỗi", "y")], "id long, text string, q string")
    vectors = {r.id: r.vector for r in clients.embed(df, "id", "text").collect()}
    assert abs(sum(x * x for x in vectors[1]) - 1) < 1e-5 and not any(vectors[2])
    assert {r.id: r.score for r in clients.score(df, "id", "q", "text").collect()}[1] == 1.0
    answers = {r.id: (r.answer, r.error) for r in clients.generate(df, "id", "text", Failing, size=1).collect()}
    assert answers[1] == ("BẾN THUYỀN", None) and "no service" in answers[3][1]


def _docx(body):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return packed.getvalue()


def test_marked_documents():
    p = lambda text, style="": f"<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda text: f"<w:tc>{p(text)}</w:tc>"
    body = p("Chương I", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("ý", "<w:pPr><w:numPr/></w:pPr>") + f"<w:tbl><w:tr>{cell('a')}{cell('b &amp; c')}</w:tr></w:tbl>" + p("")
    assert files.docx_markdown(_docx(body)) == "# Chương I\n- ý\n| a | b & c |\n"
    assert files.docx_text(_docx(body)) == "Chương I\ný\na | b & c\n"


def test_pdf_and_doc_files(spark, tmp_path):
    import zlib

    import pytest

    stream = zlib.compress(b"BT /F1 12 Tf (Dieu 1\\. A \\(b\\)) Tj ET\nBT [(Hai) -250 (ba)] TJ ET")
    pdf = b"%PDF-1.4\n1 0 obj\n<</Length " + str(len(stream)).encode() + b"/Filter/FlateDecode>>\nstream\n" + stream + b"\nendstream\nendobj\n"
    assert files.pdf_streams(pdf) == "Dieu 1. A (b)\nHaiba"
    for bad in (b"x", b"%PDF-1.4\n"):
        with pytest.raises(Exception):
            files.pdf_text(bad)
    with pytest.raises(RuntimeError):
        files.by_command(["no-such-program"])(b"")
    with pytest.raises(ValueError):
        files.refuse_unknown("a.xyz")
    (tmp_path / "a.md").write_text("**Điều 1**\n\n\n\n> chữ", encoding="utf-8")
    (tmp_path / "b.pdf").write_bytes(pdf)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.extract_clean(files.read_folder(spark, str(tmp_path))).collect()}
    assert got["a.md"][0] == "Điều 1\n\nchữ" and got["b.pdf"][1] is None


def test_queries_from_files_and_resumed_shards(spark, tmp_path):
    (tmp_path / "q.txt").write_text(" câu hỏi \n", encoding="utf-8")
    assert files.read_query(f"@file:{tmp_path}/q.txt") == "câu hỏi" and files.read_query("x") == "x"
    assert {r.id for r in files.shard(spark.range(10), "id", 2, 1, done=2).collect()} == {7, 8, 9}


def test_appending_and_delivering_again(spark):
    import pytest

    from quillon.operators import store
    from quillon.session import with_retry

    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    delta = spark.createDataFrame([("b",), ("c",), ("c",), (None,)], "k string")
    assert sorted(r.k for r in store.append(base, delta, "k").collect()) == ["a", "b", "c"] and store.append(base, delta).count() == 6
    with pytest.raises(ValueError):
        store.append(base, delta.withColumnRenamed("k", "x"))
    again = spark.createDataFrame([("b", 7), ("b", 9), (None, 1)], "k string, v int")
    assert {r.k: r.v for r in store.keep_last(base, again, "k", "v").collect()} == {"a": 1, "b": 9}
    assert store.removed_count(base, delta, ["k"]).first().removed == 1
    tries = []

    def failing():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 5

    assert with_retry(failing, wait=0) == 5 and len(tries) == 3
    with pytest.raises(OSError):
        with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=0)
