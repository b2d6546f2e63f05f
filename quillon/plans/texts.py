"""Queries of the text functions and their SQL twins.

Long results are compared by their length and digest, so that whole texts are
compared without being returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.io import spread, table

Q = T.quote


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text")).where("text is not null")


def _shown(df: DataFrame, key: str, value: Column) -> DataFrame:
    return df.select(key, value.alias("v")).select(key, F.char_length("v").alias("chars"), F.md5("v").alias("digest"))


def _shown_sql(key: str, value: str, source: str) -> str:
    return f"SELECT {key}, length(v) AS chars, md5(v) AS digest FROM (SELECT {key}, {value} AS v FROM {source})"


def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_docs(spark, sf), "doc_id", T.apply(F.col("text"), T.CLEAN))


def html_strip_regex(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(_docs(spark, sf), "doc_id", T.apply(F.col("text"), T.HTML))


def word_count(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("words"))


def length_guard(spark: SparkSession, sf: str) -> DataFrame:
    """All texts longer than an embedder takes, with their size and a preview."""
    words = T.word_count(F.col("text"))
    return _docs(spark, sf).select("doc_id", words.alias("words"), F.left("text", F.lit(200)).alias("preview")).where("words > 256")


def shorten(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.shorten(F.col("text"), 80).alias("short"))


def sliding_chunks(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _docs(spark, sf).select("doc_id", F.posexplode(T.sliding_chunks(F.col("text"), 500, 400)).alias("pos", "piece"))
    return pieces.select("doc_id", "pos", F.char_length("piece").alias("chars"), F.md5("piece").alias("digest"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    parts = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", rf"(?<=[.!?;]){T.WHITE}+")).alias("pos", "s"))
    return parts.select("doc_id", "pos", T.apply(F.col("s"), T.STRIP).alias("s")).where("s <> ''")


def split_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).select("doc_id", "pos", F.md5("s").alias("digest"))


def has_ref(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.matches(F.col("text"), T.REFERENCE).alias("has_ref"))


def ref_candidate_count(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.count_if(T.matches(F.col("s"), T.REFERENCE)).alias("candidates"))


_ARTICLE = rf"(?m)^{T.WHITE}*Điều{T.WHITE}+\d+[a-zA-Z]?\."


def count_articles(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.regexp_count("text", F.lit("(?d)" + _ARTICLE)).alias("articles"))


def extract_type(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.document_type(F.col("text")).alias("type"))


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "document_metadata").where("so_hieu is not null")
    return m.select("meta_id", F.concat(F.lit("CỘNG HÒA\nNghị định số: "), F.replace(F.upper("so_hieu"), F.lit("_"), F.lit("/")), F.lit("\n"), F.coalesce("ten_van_ban", F.lit(""))).alias("head"))


_NUMBERED = "(SELECT meta_id, 'CỘNG HÒA' || chr(10) || 'Nghị định số: ' || replace(upper(so_hieu), '_', '/') || chr(10) || coalesce(ten_van_ban, '') AS head FROM document_metadata WHERE so_hieu IS NOT NULL)"


def extract_doc_number(spark: SparkSession, sf: str) -> DataFrame:
    return _numbered(spark, sf).select("meta_id", T.document_number(F.col("head")).alias("number"))


def doc_number_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", T.document_number(F.col("text")).alias("number"))


def slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_relation").select("id", T.slug(F.col("entity_start")).alias("slug"))


def format_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_relation").select("id", T.format_id(F.col("entity_end")).alias("key"))


def parse_heading(spark: SparkSession, sf: str) -> DataFrame:
    """Type and index of every line of every document that is a heading."""
    heads = _docs(spark, sf).select("doc_id", F.posexplode(F.transform(_trimmed_lines(), T.heading)).alias("line_no", "h"))
    return heads.where("h is not null").select("doc_id", "line_no", "h.type", "h.idx")


def _trimmed_lines() -> Column:
    """Lines as an array: a trimmed line is then computed once, however often it is used."""
    return F.transform(F.split("text", "\n"), lambda l: T.apply(l, T.STRIP))


_LINES = f"(SELECT doc_id, line_no, {T.apply_sql('l', T.STRIP)} AS l FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS l FROM documents WHERE text IS NOT NULL))"
_HEAD = T.heading_sql("l")


def heading_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The article that each line stands under: the last article heading above it."""
    article_of = lambda l: T.extract(l, rf"(?i)^điều{T.WHITE}+(\d+)[.:]")
    lines = _docs(spark, sf).select("doc_id", F.posexplode(F.transform(_trimmed_lines(), article_of)).alias("line_no", "a"))
    above = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)  # as many as the document has lines
    return lines.select("doc_id", "line_no", F.last("a", ignorenulls=True).over(above).alias("article")).where("article is not null")


def normalize_number(spark: SparkSession, sf: str) -> DataFrame:
    """Roman numerals of chapter lines as digits."""
    heads = parse_heading(spark, sf).where("type = 'chuong'")
    return heads.select("doc_id", "line_no", T.to_number(F.col("idx")).alias("number"))


_NUMERAL_SQL = "CASE lower(idx) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.NUMERALS.items()) + " ELSE idx END"


def to_roman(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata").select("meta_id", T.to_roman(F.col("so_dieu")).alias("roman"))


_ROMAN_SQL = "CASE WHEN so_dieu >= 1 THEN repeat('m', so_dieu // 1000) || " + " || ".join("[" + ", ".join(f"'{T.roman(d * 10**e) if d else ''}'" for d in range(10)) + f"][(so_dieu // {10**e}) % 10 + 1]" for e in (2, 1, 0)) + " ELSE CAST(so_dieu AS VARCHAR) END"


def extract_date(spark: SparkSession, sf: str) -> DataFrame:
    """Date of a written signature line."""
    d = F.col("o_orderdate")
    line = F.concat(F.lit("Hà Nội, ngày "), F.dayofmonth(d).cast("string"), F.lit(" tháng "), F.month(d).cast("string"), F.lit(" năm "), F.year(d).cast("string"))
    orders = table(spark, sf, "orders").select("o_orderkey", line.alias("l"))
    part = lambda g: F.regexp_extract("l", r"(?iu)ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})", g)
    return orders.select("o_orderkey", F.concat_ws("/", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3)).alias("signed"))


def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written as dd/MM/yyyy, padded or not, as dates; others null."""
    m = table(spark, sf, "document_metadata")
    p = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"
    piece = lambda g: F.regexp_extract("ngay_ban_hanh", p, g)
    iso = F.concat_ws("-", piece(3), F.lpad(piece(2), 2, "0"), F.lpad(piece(1), 2, "0"))
    return m.select("meta_id", F.when(F.col("ngay_ban_hanh").rlike(p), F.try_to_date(iso, "yyyy-MM-dd")).cast("string").alias("issued"))


def extract_agency(spark: SparkSession, sf: str) -> DataFrame:
    """First listed kind of agency named in the name, the longer keywords first."""
    name = F.upper(F.col("co_quan_ban_hanh"))
    found = F.when(F.lit(False), "")
    for keyword, kind in AGENCIES:
        found = found.when(F.contains(name, F.lit(keyword)), kind)
    return table(spark, sf, "document_metadata").select("meta_id", found.otherwise("").alias("agency"))


AGENCIES = (("HỘI ĐỒNG LẬP PHÁP", "Hội Đồng Lập Pháp"), ("HỘI ĐỒNG", "Hội Đồng"), ("TỔNG CỤC", "Tổng Cục"), ("ỦY BAN", "Ủy Ban"), ("BỘ ", "Bộ"), ("BAN ", "Ban"), ("VIỆN", "Viện"), ("CỤC", "Cục"))
_AGENCY = "CASE " + " ".join(f"WHEN contains(upper(co_quan_ban_hanh), '{k}') THEN '{v}'" for k, v in AGENCIES) + " ELSE '' END"
#: What a model writes where it knows no index.
_STOP = ("none", "null", "unknown", "không rõ", "khong ro", "this", "current", "nay", "này", "hien_tai", "hiện tại", "hien tai", "same", "self")


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "document_node").select("node_key", F.posexplode("reference").alias("pos", "ref_id"))
    return refs.select("node_key", "pos", F.explode(F.split("ref_id", r"\.")).alias("part")).distinct()


def normalize_target(spark: SparkSession, sf: str) -> DataFrame:
    """Indexes of cited sections; document numbers and years are not taken for one."""
    v = F.regexp_replace(F.trim("part"), "^[a-z]+_", "")
    bad = F.lower(v).isin("", *_STOP) | v.rlike(r"[_/-]") | v.rlike(r"\d{4}")
    return _targets(spark, sf).select("node_key", "pos", "part", F.when(~bad, T.format_id(F.replace(v, F.lit("."), F.lit("_")))).alias("target"))


def valid_doc_id(spark: SparkSession, sf: str) -> DataFrame:
    p = F.lower("part")
    ok = (p != "") & ~p.rlike(r"^\d{1,3}[a-z]?$") & ~p.rlike("^(dieu|khoan|diem|phan|chuong|muc)_") & p.rlike(r"[_/-]|[a-z].*[0-9].*[a-z]")
    return _targets(spark, sf).select("node_key", "pos", "part", ok.alias("valid"))


def normalize_ref(spark: SparkSession, sf: str) -> DataFrame:
    """A reference put together again from its folded document key and its sections."""
    refs = table(spark, sf, "document_node").select("node_key", F.posexplode("reference").alias("pos", "ref_id"))
    parts = F.split("ref_id", r"\.")
    return refs.select("node_key", "pos", F.concat_ws(".", T.format_id(F.element_at(parts, 1)), F.nullif(F.array_join(F.slice(parts, 2, 1000), "."), F.lit(""))).alias("ref"))


def folder_type(spark: SparkSession, sf: str) -> DataFrame:
    """Document type from the folder of the stored file."""
    folder = F.lower(F.element_at(F.split("file_path", "/"), -2))
    found = F.when(F.col("file_path").isNull() | (F.size(F.split("file_path", "/")) < 2), "unknown")
    for _, code in sorted(T.TYPES, key=lambda x: -len(x[1])):
        found = found.when(F.contains(folder, F.lit(code)), code)
    return table(spark, sf, "document_metadata").select("meta_id", found.otherwise("other").alias("folder_type"))


_FOLDER = "CASE WHEN file_path IS NULL OR len(string_split(file_path, '/')) < 2 THEN 'unknown' " + " ".join(f"WHEN contains(lower(string_split(file_path, '/')[-2]), '{c}') THEN '{c}'" for _, c in sorted(T.TYPES, key=lambda x: -len(x[1]))) + " ELSE 'other' END"


def fenced_json(spark: SparkSession, sf: str) -> DataFrame:
    """A number out of JSON inside a fence of a model's answer."""
    answer = F.concat(F.lit("Kết quả:\n```json\n"), F.col("props"), F.lit("\n```\nHết."))
    body = F.trim(F.regexp_extract(answer, r"(?s)```(?:json)?(.*?)```", 1))
    return table(spark, sf, "events").select("event_id", F.get_json_object(body, "$.k").cast("bigint").alias("k"))


def explode_subquestions(spark: SparkSession, sf: str) -> DataFrame:
    """Sub-questions of a model's JSON answer, one row each."""
    j = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("query"), F.lit("GENERAL").alias("intent")), F.struct(F.col("props").alias("query"), F.lit("LEGAL_QUERY").alias("intent"))).alias("sub_questions")))
    parsed = F.from_json(j, "struct<sub_questions: array<struct<query: string, intent: string>>>")
    return table(spark, sf, "events").select("event_id", F.posexplode(parsed["sub_questions"]).alias("pos", "q")).select("event_id", "pos", "q.query", "q.intent")


def answer_letter(spark: SparkSession, sf: str) -> DataFrame:
    """The letter chosen in an answer: tagged, then announced, then bracketed, then the last one alone near the end."""
    a = table(spark, sf, "orders").select("o_orderkey", answer_text().alias("a"))
    return a.select("o_orderkey", letter_of(F.col("a")).alias("letter"))


def answer_text() -> Column:
    k, sign = F.col("o_orderkey"), F.substring(F.lit("ABCD"), (F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int"), F.lit(1))
    return F.when(k % 5 == 0, F.concat(F.lit("<output> "), sign)).when(k % 5 == 1, F.concat(F.lit("Vậy đáp án: "), sign)).when(k % 5 == 2, F.concat(F.lit("Ta thấy ("), sign, F.lit(") đúng"))).when(k % 5 == 3, F.concat(F.lit("xét các ý, cuối cùng còn lại "), sign)).otherwise(F.lit("không rõ"))


def letter_of(a: Column) -> Column:
    pick = lambda p: F.nullif(F.upper(F.regexp_extract(a, p, 1)), F.lit(""))
    return F.coalesce(pick(r"(?iu)<output>\s*([A-D])"), pick(r"(?iu)(?:đáp án|chọn|là|output|answer)\s*:?\s*([A-D])(?:$|[^\p{L}\p{N}_])"), pick(r"[(\[*]+([A-D])[)\]*]+"), pick(r"(?:^|.*[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])"), F.lit("N/A"))


_ANSWERS = "(SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '<output> ' || s WHEN 1 THEN 'Vậy đáp án: ' || s WHEN 2 THEN 'Ta thấy (' || s || ') đúng' WHEN 3 THEN 'xét các ý, cuối cùng còn lại ' || s ELSE 'không rõ' END AS a FROM (SELECT o_orderkey, substr('ABCD', CAST(o_custkey % 4 + 1 AS INT), 1) AS s FROM orders))"
_PICK = lambda p: f"nullif(upper(regexp_extract(a, {Q(p)}, 1)), '')"
_LETTER = f"coalesce({_PICK(r'(?i)<output>\s*([A-D])')}, {_PICK(r'(?i)(?:đáp án|chọn|là|output|answer)\s*:?\s*([A-D])(?:$|[^\p{L}\p{N}_])')}, {_PICK(r'[(\[*]+([A-D])[)\]*]+')}, {_PICK(r'(?:^|.*[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])')}, 'N/A')"

QUERIES = {
    f.__name__: f
    for f in (clean_text, html_strip_regex, word_count, length_guard, shorten, sliding_chunks, split_sentences, has_ref, ref_candidate_count, count_articles, extract_type, extract_doc_number, doc_number_in_text, slug, format_id, parse_heading, heading_fill, normalize_number, to_roman, extract_date, parsed_dates, extract_agency, normalize_target, valid_doc_id, normalize_ref, folder_type, fenced_json, explode_subquestions, answer_letter)
}
_DOCS = "documents WHERE text IS NOT NULL"
_WORDS = f"len(list_filter(regexp_split_to_array(text, {Q(T.WHITE + '+')}), lambda w: w <> ''))"
_FLAT = T.apply_sql("text", [(T.WHITE + "+", " "), *T.STRIP])
_SENT = f"(SELECT doc_id, pos, {T.apply_sql('s', T.STRIP)} AS s FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS s FROM (SELECT doc_id, string_split(regexp_replace(text, {Q(f'([.!?;]){T.WHITE}+')}, '\\1' || chr(1), 'g'), chr(1)) AS p FROM {_DOCS})))"
_PARTS = "(SELECT DISTINCT node_key, pos, unnest(string_split(ref_id, '.')) AS part FROM (SELECT node_key, unnest(range(len(reference))) AS pos, unnest(reference) AS ref_id FROM document_node))"
_V = "regexp_replace(trim(part), '^[a-z]+_', '')"
ORACLE = {
    "clean_text": _shown_sql("doc_id", T.apply_sql("text", T.CLEAN), _DOCS),
    "html_strip_regex": _shown_sql("doc_id", T.apply_sql("text", T.HTML), _DOCS),
    "word_count": f"SELECT doc_id, {_WORDS} AS words FROM {_DOCS}",
    "length_guard": f"SELECT * FROM (SELECT doc_id, {_WORDS} AS words, left(text, 200) AS preview FROM {_DOCS}) WHERE words > 256",
    "shorten": f"SELECT doc_id, CASE WHEN length(f) > 80 THEN left(f, 77) || '...' ELSE f END AS short FROM (SELECT doc_id, {_FLAT} AS f FROM {_DOCS})",
    "sliding_chunks": f"SELECT doc_id, CAST(i AS INT) AS pos, length(p) AS chars, md5(p) AS digest FROM (SELECT doc_id, i, substr(text, CAST(i * 400 + 1 AS INT), 500) AS p FROM (SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 500) / 400.0) + 1) AS BIGINT))) AS i FROM {_DOCS}))",
    "split_sentences": f"SELECT doc_id, CAST(pos AS INT) AS pos, md5(s) AS digest FROM {_SENT} WHERE s <> ''",
    "has_ref": f"SELECT doc_id, regexp_matches(text, {Q(T.REFERENCE)}) AS has_ref FROM {_DOCS}",
    "ref_candidate_count": f"SELECT doc_id, count(*) AS sentences, count(*) FILTER (WHERE regexp_matches(s, {Q(T.REFERENCE)})) AS candidates FROM {_SENT} WHERE s <> '' GROUP BY 1",
    "count_articles": f"SELECT doc_id, len(regexp_extract_all(text, {Q(_ARTICLE)})) AS articles FROM {_DOCS}",
    "extract_type": f"SELECT doc_id, {T.document_type_sql('text')} AS type FROM {_DOCS}",
    "extract_doc_number": f"SELECT meta_id, {T.document_number_sql('head')} AS number FROM {_NUMBERED}",
    "doc_number_in_text": f"SELECT doc_id, {T.document_number_sql('text')} AS number FROM {_DOCS}",
    "slug": f"SELECT id, {T.slug_sql('entity_start')} AS slug FROM document_relation",
    "format_id": f"SELECT id, {T.format_id_sql('entity_end')} AS key FROM document_relation",
    "parse_heading": f"SELECT doc_id, CAST(line_no AS INT) AS line_no, type, idx FROM (SELECT doc_id, line_no, {_HEAD[0]} AS type, {_HEAD[1]} AS idx FROM {_LINES} WHERE l <> '') WHERE type IS NOT NULL",
    "heading_fill": f"SELECT doc_id, CAST(line_no AS INT) AS line_no, article FROM (SELECT doc_id, line_no, last_value(CASE WHEN regexp_matches(l, {Q(rf'(?i)^điều{T.WHITE}+(\d+)[.:]')}) THEN regexp_extract(l, {Q(rf'(?i)^điều{T.WHITE}+(\d+)[.:]')}, 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS article FROM {_LINES}) WHERE article IS NOT NULL",
    "normalize_number": f"SELECT doc_id, CAST(line_no AS INT) AS line_no, {_NUMERAL_SQL} AS number FROM (SELECT doc_id, line_no, {_HEAD[0]} AS type, {_HEAD[1]} AS idx FROM {_LINES} WHERE l <> '') WHERE type = 'chuong'",
    "to_roman": f"SELECT meta_id, {_ROMAN_SQL} AS roman FROM document_metadata",
    "extract_date": "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS signed FROM orders",
    "parsed_dates": r"SELECT meta_id, CAST(CASE WHEN regexp_matches(ngay_ban_hanh, '^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$') THEN try_strptime(trim(ngay_ban_hanh), '%d/%m/%Y')::DATE END AS VARCHAR) AS issued FROM document_metadata",
    "extract_agency": f"SELECT meta_id, {_AGENCY} AS agency FROM document_metadata",
    "normalize_target": f"SELECT node_key, CAST(pos AS INT) AS pos, part, CASE WHEN NOT (lower({_V}) IN ('', {', '.join(Q(x) for x in _STOP)}) OR regexp_matches({_V}, '[_/-]') OR regexp_matches({_V}, '\\d{{4}}')) THEN {T.format_id_sql(f'replace({_V}, {Q(".")}, {Q("_")})')} END AS target FROM {_PARTS}",
    "valid_doc_id": f"SELECT node_key, CAST(pos AS INT) AS pos, part, lower(part) <> '' AND NOT regexp_matches(lower(part), '^\\d{{1,3}}[a-z]?$') AND NOT regexp_matches(lower(part), '^(dieu|khoan|diem|phan|chuong|muc)_') AND regexp_matches(lower(part), '[_/-]|[a-z].*[0-9].*[a-z]') AS valid FROM {_PARTS}",
    "normalize_ref": f"SELECT node_key, CAST(pos AS INT) AS pos, concat_ws('.', {T.format_id_sql('p[1]')}, nullif(array_to_string(list_slice(p, 2, 1000), '.'), '')) AS ref FROM (SELECT node_key, unnest(range(len(reference))) AS pos, string_split(unnest(reference), '.') AS p FROM document_node)",
    "folder_type": f"SELECT meta_id, {_FOLDER} AS folder_type FROM document_metadata",
    "fenced_json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "explode_subquestions": "SELECT event_id, 0 AS pos, event_type AS query, 'GENERAL' AS intent FROM events UNION ALL SELECT event_id, 1, props, 'LEGAL_QUERY' FROM events",
    "answer_letter": f"SELECT o_orderkey, {_LETTER} AS letter FROM {_ANSWERS}",
}
