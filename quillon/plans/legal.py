"""Queries of the structure and citation functions, which SQL cannot express; tests hold them against small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import citations as C
from quillon.functions import legal as L
from quillon.functions import metadata as M
from quillon.functions import text as T
from quillon.functions.keys import bare
from quillon.io import spread, table
from quillon.operators import search, titles


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).where("text is not null")


def extract_title(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", M.title(F.col("text")).alias("title"))


def effective_date(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", M.effective_date(F.col("text")).alias("in_force"))


def issue_date(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", M.issue_date(F.col("text")).alias("issued"))


def agency_of_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", M.agency(F.col("text")).alias("agency"))


def normalize_vn(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "document_metadata").where("ten_van_ban is not null")
    return m.select("meta_id", T.apply(F.lower(bare(F.col("ten_van_ban"))), [(T.WHITE + "+", " "), *T.STRIP]).alias("name"))


def list_items(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.array_join(T.listed("khoản", F.col("text")), "|").alias("clauses"))


#: Words that refer to the section in which they stand, put behind each content of the test.
_OWN_WORDS = " Theo khoản này, điều này, tại thời điểm này và danh mục này của Luật này."


def self_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Self-references of each node, resolved by its own id."""
    rows = spread(table(spark, sf, "document_node").select("node_key", "id", "content")).where("id is not null and content is not null")
    both = rows.select("node_key", F.concat("id", F.lit("\u0001"), "content", F.lit(_OWN_WORDS)).alias("both"))
    found = L.per_text(both, "node_key", "both", _self, "refs", "array<string>")
    return found.select("node_key", F.array_join("refs", "|").alias("refs"))


def _context(node_id: str) -> dict[str, str]:
    parts = node_id.split(".")
    held = {f"{p.split('_')[0]}_id": ".".join(parts[: i + 1]) for i, p in enumerate(parts) if i}
    return held | {"luat_id": parts[0]}


def _self(both: str) -> list[str]:
    node_id, text = both.split("\u0001", 1)
    return C.self_refs(text, _context(node_id))


def extract_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Citations in each node's text."""
    rows = spread(table(spark, sf, "document_node").select("node_key", "id", "content")).where("id is not null and content is not null").where(T.matches(F.col("content"), T.REFERENCE))
    both = rows.select("node_key", F.concat("id", F.lit("\u0001"), "content").alias("both"))
    found = L.per_text(both, "node_key", "both", _refs, "refs", "array<string>")
    return found.select("node_key", F.posexplode("refs").alias("pos", "ref_id"))


def _refs(both: str) -> list[str]:
    node_id, text = both.split("\u0001", 1)
    return C.extract_refs(text, _context(node_id))


def parse_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of every document."""
    rows = _docs(spark, sf).select("doc_id", "text")
    columns = "seq int, node_id string, kind string, parent_id string, parent_context string, title string, content string, full_text string"
    return L.rows_per_text(rows, "doc_id", "text", lambda k, t: L.flat_chunks(str(k), t), columns)


def safe_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", F.concat(F.lit("Kết quả {chưa rõ}: "), "props", F.lit(" hết")).alias("a"))
    return L.per_text(rows, "event_id", "a", L.safe_json, "json", "string")


def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of pages made of each node's title and content."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    title, content = F.col("title"), F.col("content")
    page = F.concat(F.lit("<html><style>p {color: red}</style><body><div class='x'>"), escaped(title), F.lit("</div><script>var a = '<p>';</script><table><tr><td>"), escaped(content), F.lit("</td></tr></table><p>hết<br>trang&nbsp;</p></body></html>"))
    pages = spread(table(spark, sf, "document_node").select("node_key", "title", "content")).select("node_key", page.alias("page"))
    read = L.per_text(pages, "node_key", "page", L.html_to_text, "plain", "string")
    return read.select("node_key", F.md5(T.apply(F.col("plain"), [(T.WHITE + "+", " "), *T.STRIP])).alias("digest"))


def _pieces(function):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return L.rows_per_text(_docs(spark, sf), "doc_id", "text", lambda _, t: list(enumerate(function(t))), "piece_no int, piece string")

    return query


def _alike(spark: SparkSession, sf: str, least: float, most: int | None = None) -> DataFrame:
    """Titles of removed documents beside all titles of at least so much likeness."""
    old = table(spark, sf, "document_legacy").select(F.col("so_hieu").alias("key"), F.col("ten_van_ban").alias("title"))
    now = table(spark, sf, "document_metadata").select(F.col("meta_id").cast("long").alias("key"), F.col("so_hieu").alias("number"), F.col("ten_van_ban").alias("title"))
    return titles.alike(old, now, least, most).select("meta_id", "asked", "so_hieu", "ratio")


def fuzzy_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs of at least half likeness."""
    return _alike(spark, sf, 0.5)


def doc_metadata_search(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of at least half likeness, the five best of each title."""
    ranked = search.rerank(_alike(spark, sf, 0.5, 5), ["asked"], F.col("ratio"), 5, "meta_id")
    return ranked.select("asked", "meta_id", "so_hieu", "ratio", "rank")


def resolve_title(spark: SparkSession, sf: str) -> DataFrame:
    """The document that a title most likely names."""
    ranked = search.rerank(_alike(spark, sf, 0.6, 1), ["asked"], F.col("ratio"), 1, "meta_id")
    return ranked.select("asked", "meta_id", "so_hieu", "ratio")


def oversize_split(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _docs(spark, sf).select("doc_id", F.posexplode(T.word_windows(F.col("text"), 100, 90, 20)).alias("piece_no", "piece"))
    return pieces.select("doc_id", "piece_no", F.md5("piece").alias("digest"))


QUERIES = {f.__name__: f for f in (extract_title, effective_date, issue_date, agency_of_text, normalize_vn, list_items, self_refs, extract_refs, parse_tree, safe_json, html_to_text, fuzzy_ratio, doc_metadata_search, resolve_title, oversize_split)} | {"greedy_pack": _pieces(L.greedy_pack), "fixed_chunks": _pieces(L.fixed_chunks)}
_DOCS = "documents WHERE text IS NOT NULL"
_SPLIT = f"list_filter(regexp_split_to_array(text, '{T.WHITE}+'), lambda w: w <> '')"
_PACKED = f"""
WITH RECURSIVE p AS (SELECT doc_id, string_split(regexp_replace({T.apply_sql('text', T.STRIP)}, '([.!?;]){T.WHITE}+', '\\1' || chr(1), 'g'), chr(1)) AS a FROM {_DOCS}),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, s, len(list_filter(regexp_split_to_array(s, '{T.WHITE}+'), lambda w: w <> '')) AS n FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS s FROM p) WHERE s <> ''),
walk(doc_id, pos, chunk, held) AS (
  SELECT doc_id, pos, 0, n FROM s WHERE pos = 1
  UNION ALL SELECT s.doc_id, s.pos, CASE WHEN w.held + s.n > 200 THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN w.held + s.n > 200 THEN s.n ELSE w.held + s.n END FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.pos = w.pos + 1)
SELECT w.doc_id, CAST(w.chunk AS INT) AS piece_no, string_agg(s.s, ' ' ORDER BY s.pos) AS piece FROM walk w JOIN s ON s.doc_id = w.doc_id AND s.pos = w.pos GROUP BY 1, 2"""
_PARTS = "string_split(id, '.')"


def _section(kind: str) -> str:
    """The id up to its last segment of a kind."""
    places = f"list_filter(range(2, len({_PARTS}) + 1), lambda i: starts_with({_PARTS}[i], '{kind}_'))"
    return f"CASE WHEN len({places}) > 0 THEN array_to_string(list_slice({_PARTS}, 1, ({places})[-1]), '.') END"


ORACLE: dict[str, str] = {
    "self_refs": f"SELECT node_key, array_to_string(list_filter([{_section('khoan')}, {_section('dieu')}, {_PARTS}[1]], lambda x: x <> ''), '|') AS refs FROM document_node WHERE id IS NOT NULL AND content IS NOT NULL",
    "html_to_text": f"SELECT node_key, md5(trim(regexp_replace(coalesce(title, '') || ' ' || coalesce(content, '') || ' hết trang', '{T.WHITE}+', ' ', 'g'))) AS digest FROM document_node",
    "extract_title": f"SELECT doc_id, {M.title_sql('text')} AS title FROM {_DOCS}",
    "effective_date": f"SELECT doc_id, {M.effective_date_sql('text')} AS in_force FROM {_DOCS}",
    "issue_date": f"SELECT doc_id, {M.issue_date_sql('text')} AS issued FROM {_DOCS}",
    "agency_of_text": f"SELECT doc_id, {M.agency_sql('text')} AS agency FROM {_DOCS}",
    "normalize_vn": f"SELECT meta_id, coalesce(trim(regexp_replace(lower(strip_accents(list_aggregate(list_transform(regexp_extract_all(ten_van_ban, '(?s).'), lambda c: CASE WHEN ord(c) BETWEEN 65281 AND 65374 THEN chr(ord(c) - 65248) WHEN ord(c) BETWEEN 8544 AND 8555 THEN list_extract(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'], ord(c) - 8543) WHEN c = '‑' THEN '‐' ELSE c END), 'string_agg', ''))), '{T.WHITE}+', ' ', 'g')), '') AS name FROM document_metadata WHERE ten_van_ban IS NOT NULL",
    "list_items": f"SELECT doc_id, coalesce(array_to_string({T.listed_sql('khoản', 'text')}, '|'), '') AS clauses FROM {_DOCS}",
    "safe_json": "SELECT event_id, CAST(json(props) AS VARCHAR) AS json FROM events",
    "greedy_pack": _PACKED,
    "oversize_split": f"SELECT doc_id, CAST(i AS INT) AS piece_no, md5(CASE WHEN len(w) > 100 THEN array_to_string(list_slice(w, i * 70 + 1, i * 70 + 90), ' ') ELSE text END) AS digest FROM (SELECT doc_id, text, w, unnest(range(CASE WHEN len(w) > 100 THEN CAST(ceil((len(w) - 20) / 70.0) AS BIGINT) ELSE 1 END)) AS i FROM (SELECT doc_id, text, {_SPLIT} AS w FROM {_DOCS}))",
}
