"""Queries of rules over names, answer letters, pooling, and the flows that resolve citations and relations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import answers, rules, vectors
from quillon.io import table
from quillon.operators import titles
from quillon.plans import questions
from quillon.plans.retrieval import _DECODE

# answers


def _answers() -> Column:
    """Answers of several shapes, made of an order."""
    k, letter = F.col("o_orderkey"), F.substring(F.lit("ABCD"), (F.pmod(F.col("o_custkey"), F.lit(4)) + 1).cast("int"), F.lit(1))
    shapes = [F.concat(letter, F.lit(". vì thế")), F.concat(F.lit("Chọn phương án\n  "), letter, F.lit(" \nHết")), F.concat(F.lit("<output> "), F.lower(letter)), F.concat(F.lit("Đáp án: "), letter), F.concat(F.lit("có lẽ ("), letter, F.lit(")")), F.lit("không rõ"), F.lit(" "), letter]
    out = F.when(k % 9 == 8, F.lit(None).cast("string"))
    for i, shape in enumerate(shapes):
        out = out.when(k % 9 == i, shape)
    return out


_ANSWERED = "(SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN s || '. vì thế' WHEN 1 THEN 'Chọn phương án' || chr(10) || '  ' || s || ' ' || chr(10) || 'Hết' WHEN 2 THEN '<output> ' || lower(s) WHEN 3 THEN 'Đáp án: ' || s WHEN 4 THEN 'có lẽ (' || s || ')' WHEN 5 THEN 'không rõ' WHEN 6 THEN ' ' WHEN 7 THEN s END AS a FROM (SELECT o_orderkey, substr('ABCD', CAST(o_custkey % 4 + 1 AS INT), 1) AS s FROM orders))"
_S = r"(?:^|[^\p{L}\p{M}\p{N}_])([A-D])(?:$|[^\p{L}\p{M}\p{N}_])"


def _letters(way: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return table(spark, sf, "orders").select("o_orderkey", answers.WAYS[way](_answers()).alias("letter"))

    return query


def question_text(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part")
    return n.select("p_partkey", answers.question_text(F.col("p_brand"), F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_type"))).alias("asked"))


# names


def folder_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Kind of the folder of each stored file, and its relation to a law."""
    folder = F.try_element_at(F.split("file_path", "/"), F.lit(-2))
    kind = rules.folder_kind(folder)
    return table(spark, sf, "document_metadata").select("meta_id", kind.alias("kind"), rules.relation_between(kind, F.lit("luat")).alias("relation_type"))


def law_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations that follow from folders: every document of a kind that relates to laws, with how many laws it meets."""
    m = table(spark, sf, "document_metadata").where("so_hieu <> ''").select("so_hieu", F.col("loai").alias("kind")).distinct()
    laws = m.where("kind = 'luat'").agg(F.count(F.lit(1)).alias("laws"))
    related = m.select("so_hieu", rules.relation_between(F.col("kind"), F.lit("luat")).alias("relation_type")).where("relation_type is not null")
    return related.crossJoin(F.broadcast(laws)).select("so_hieu", "relation_type", "laws")  # one row


def relation_codes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "document_relation")
    shown = F.when(F.col("relation_type") == "thay_the", "Thay thế").when(F.col("relation_type") == "can_cu", "Căn cứ").otherwise(F.col("relation_type"))
    return r.select("id", rules.relation_code(shown).alias("code"))


def agency_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Agencies that many documents name and that the name rules keep, the most frequent first."""
    name = F.lower(F.trim("co_quan_ban_hanh"))
    counts = table(spark, sf, "document_metadata").where("co_quan_ban_hanh <> ''").groupBy(name.alias("agency")).agg(F.count(F.lit(1)).alias("n"))
    kept = rules.name_filter(F.col("agency"), ("chính phủ", "quốc hội"), ("bộ ", "ủy ban ", "hội đồng "), ("ban ", "cục ", "tổng cục "), ("mặt trận",), {"hội": ("hội đồng", "quốc hội")}, {"ủy ban ": ("ủy ban nhân dân",)})
    return counts.where(kept & (F.col("n") > 1))


# pooling


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors cut into sixteen tokens of equal length, every fifth masked."""
    e = table(spark, sf, "embeddings")
    size = F.floor(F.size("embedding") / 16).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * size + 1, size))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when((F.col("vec_id") + i) % 5 == 0, 0.0).otherwise(1.0))
    return e.select("vec_id", tokens.alias("tokens"), mask.alias("mask"))


def _pooled(way: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        pooled = _tokens(spark, sf).select("vec_id", F.posexplode(vectors.pool(F.col("tokens"), F.col("mask"), way)).alias("pos", "x"))
        return pooled.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))

    return query


_CUT = "SELECT vec_id, t, j, embedding[t * w + j + 1]::DOUBLE AS x, CASE WHEN (vec_id + t) % 5 = 0 THEN 0 ELSE 1 END AS m FROM (SELECT vec_id, embedding, len(embedding) // 16 AS w, unnest(range(16)) AS t FROM embeddings), range(1024) r(j) WHERE j < w"

# titles and sections


def title_contains(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose title holds the first six words of a removed one's."""
    old = table(spark, sf, "document_legacy").where("ten_van_ban <> ''").select(F.col("so_hieu").alias("key"), F.substring_index("ten_van_ban", " ", 6).alias("title"))
    now = table(spark, sf, "document_metadata").select(F.col("meta_id").cast("long").alias("key"), F.col("so_hieu").alias("number"), F.col("ten_van_ban").alias("title"))
    return titles.holding(old, now)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of sections: an article of every document, with a clause in some."""
    m = table(spark, sf, "document_metadata").where("so_hieu <> ''")
    null = F.lit(None)
    return m.select(
        F.col("meta_id").cast("long").alias("request"), "so_hieu", F.lit("").alias("ten_van_ban"), null.cast("int").alias("phan"), F.when(F.col("meta_id") % 7 == 0, (F.col("meta_id") % 3 + 1).cast("string")).alias("chuong"),
        null.cast("int").alias("muc"), F.when(F.col("meta_id") % 7 != 0, (F.col("meta_id") % 4 + 1).cast("string")).alias("dieu"), F.when(F.col("meta_id") % 2 == 0, F.lit("1")).alias("khoan"), null.cast("string").alias("diem"),
    )


def legal_query(spark: SparkSession, sf: str) -> DataFrame:
    """The first five sections that each citation means."""
    nodes = table(spark, sf, "document_node")
    return questions.legal_query(_requests(spark, sf), "request", table(spark, sf, "document_metadata"), nodes).select("request", "chunk_id", "rank")


def find_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents found by number, in any spelling, and by type or field where no number is given."""
    m = table(spark, sf, "document_metadata").where("meta_id % 20 = 0")
    k = F.col("meta_id") % 3
    asked = m.select(
        F.col("meta_id").alias("request"), F.when(k == 0, F.upper(F.replace("so_hieu", F.lit("_"), F.lit("/")))).alias("so_hieu"), F.lit("").alias("ten_van_ban"), F.when(k == 1, F.col("loai")).alias("loai"), F.when(k == 2, F.col("linh_vuc")).alias("linh_vuc"),
    )
    return questions.find_documents(asked, "request", table(spark, sf, "document_metadata")).select("request", "meta_id", "rank")


def document_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of the documents that a request names by number."""
    m = table(spark, sf, "document_metadata").where("meta_id % 20 = 0 and so_hieu <> ''")
    empty = F.lit("")
    asked = m.select(F.col("meta_id").alias("request"), "so_hieu", empty.alias("ten_van_ban"), empty.alias("loai"), empty.alias("linh_vuc"))
    found = questions.document_relations(asked, "request", table(spark, sf, "document_metadata"), table(spark, sf, "document_relation"))
    return found.groupBy("request", "entity", "direction", "other", "relation_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f"letter_{way}": _letters(way) for way in answers.WAYS} | {f"pool_{way}": _pooled(way) for way in ("cls", "mean")} | {f.__name__: f for f in (question_text, folder_kind, law_relations, relation_codes, agency_filter, title_contains, legal_query, find_documents, document_relations)}

_KIND = "CASE WHEN f IS NULL THEN NULL " + " ".join(f"WHEN contains(f, '{k}') OR contains('{k}', f) THEN '{k}'" for k in rules.FOLDERS) + " ELSE 'other' END"
_REL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.RELATION_OF.items())
_NUM = r"regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'đ', 'd'), '[^\p{{L}}\p{{M}}\p{{N}}]+', '_', 'g'), '^_|_$', '', 'g')"
ORACLE = {
    "letter_strict": f"SELECT o_orderkey, coalesce(nullif(regexp_extract(upper(a), '{_S}', 1), ''), nullif(regexp_extract(trim(upper(a)), '^([A-D])', 1), ''), 'N/A') AS letter FROM {_ANSWERED}",
    "letter_tagged": f"SELECT o_orderkey, coalesce(upper(nullif(regexp_extract(a, '(?i)<output>\\s*([A-D])', 1), '')), upper(nullif(regexp_extract(a, '(?i)(?:đáp án|chọn|là|output|answer)\\s*:?\\s*([A-D])(?:$|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', 1), '')), nullif(regexp_extract(a, '[(\\[*]+([A-D])[)\\]*]+', 1), ''), CASE WHEN upper(trim(a)) IN ('A', 'B', 'C', 'D') THEN upper(trim(a)) END, list_filter(regexp_split_to_array(upper(right(a, 50)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w IN ('A', 'B', 'C', 'D'))[-1], 'N/A') AS letter FROM {_ANSWERED}",
    "letter_line_first": f"SELECT o_orderkey, coalesce(nullif(regexp_extract(a, '(?m)^[ \\t]*([ABCD])[ \\t]*$', 1), ''), nullif(regexp_extract(left(a, 10), '[ABCD]'), ''), left(trim(a), 1), '') AS letter FROM {_ANSWERED}",
    "pool_cls": f"SELECT vec_id, CAST(j AS INT) AS pos, round(x, 6) AS x FROM ({_CUT}) WHERE t = 0",
    "pool_mean": f"SELECT vec_id, CAST(j AS INT) AS pos, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS x FROM ({_CUT}) GROUP BY 1, 2",
    "question_text": "SELECT p_partkey, coalesce(p_brand, '') || chr(10) || 'Câu hỏi: ' || coalesce(p_name, '') || chr(10) || CASE WHEN p_size > 25 THEN coalesce(p_type, '') ELSE '' END AS asked FROM part",
    "folder_kind": f"SELECT meta_id, {_KIND} AS kind, CASE {_KIND} {_REL} END AS relation_type FROM (SELECT meta_id, lower(trim(string_split(file_path, '/')[-2])) AS f FROM document_metadata)",
    "law_relations": f"WITH m AS (SELECT DISTINCT so_hieu, loai FROM document_metadata WHERE so_hieu <> '') SELECT so_hieu, CASE loai {_REL} END AS relation_type, (SELECT count(*) FROM m WHERE loai = 'luat') AS laws FROM m WHERE loai IN ({', '.join(repr(k) for k in rules.RELATION_OF)})",
    "relation_codes": "SELECT id, relation_type AS code FROM document_relation",
    "agency_filter": "SELECT * FROM (SELECT lower(trim(co_quan_ban_hanh)) AS agency, count(*) AS n FROM document_metadata WHERE co_quan_ban_hanh <> '' GROUP BY 1) WHERE n > 1 AND (agency IN ('chính phủ', 'quốc hội') OR regexp_matches(agency, '^(bộ |ủy ban |hội đồng )')) AND NOT regexp_matches(agency, '^(ban |cục |tổng cục )') AND NOT contains(agency, 'mặt trận') AND (NOT contains(agency, 'hội') OR contains(agency, 'hội đồng') OR contains(agency, 'quốc hội')) AND (NOT starts_with(agency, 'ủy ban ') OR agency = 'ủy ban nhân dân')",
    "title_contains": "SELECT l.so_hieu AS asked, m.meta_id, m.so_hieu FROM (SELECT DISTINCT so_hieu, lower(trim(array_to_string(list_slice(string_split(ten_van_ban, ' '), 1, 6), ' '))) AS part FROM document_legacy WHERE ten_van_ban <> '') l JOIN document_metadata m ON contains(lower(m.ten_van_ban), l.part) WHERE l.part <> ''",
    "legal_query": f"""
WITH q AS (SELECT meta_id AS request, so_hieu, CASE WHEN meta_id % 7 = 0 THEN 'Chương ' || ['i', 'ii', 'iii'][CAST(meta_id % 3 + 1 AS INT)] END AS chuong, CASE WHEN meta_id % 7 <> 0 THEN 'Điều ' || (meta_id % 4 + 1) END AS dieu, CASE WHEN meta_id % 2 = 0 THEN 'Khoản 1' END AS khoan FROM document_metadata WHERE so_hieu <> ''),
c AS (SELECT node_key, id, {_DECODE} FROM document_node WHERE id IS NOT NULL),
f AS (SELECT q.request, c.id, min(c.node_key) AS node_key FROM q JOIN c ON c.so_hieu = q.so_hieu AND (q.chuong IS NULL OR q.chuong = c.chuong) AND (q.dieu IS NULL OR q.dieu = c.dieu) AND (q.khoan IS NULL OR q.khoan = c.khoan) GROUP BY ALL),
r AS (SELECT *, regexp_replace(id, '__dup_[^.]*', '', 'g') AS base FROM (SELECT request, id, row_number() OVER (PARTITION BY request ORDER BY node_key, id) AS rank FROM f) WHERE rank <= 5)
SELECT request, id AS chunk_id, rank FROM r WHERE NOT EXISTS (SELECT 1 FROM r p WHERE p.request = r.request AND starts_with(r.base, p.base || '.'))""",
    "find_documents": f"""
WITH q AS (SELECT meta_id AS request, meta_id % 3 AS k, so_hieu, loai, linh_vuc FROM document_metadata WHERE meta_id % 20 = 0),
h AS (SELECT q.request, m.meta_id FROM q JOIN document_metadata m ON {_NUM.format('q.so_hieu')} = {_NUM.format('m.so_hieu')} WHERE q.k = 0 AND q.so_hieu <> ''
  UNION ALL SELECT q.request, m.meta_id FROM q JOIN document_metadata m ON q.loai = m.loai WHERE q.k = 1 AND q.loai <> ''
  UNION ALL SELECT q.request, m.meta_id FROM q JOIN document_metadata m ON contains(lower(m.linh_vuc), lower(trim(q.linh_vuc))) WHERE q.k = 2 AND q.linh_vuc <> '')
SELECT request, meta_id, rank FROM (SELECT request, meta_id, row_number() OVER (PARTITION BY request ORDER BY meta_id) AS rank FROM h) WHERE rank <= 10""",
    "document_relations": f"""
WITH d AS (SELECT DISTINCT request, so_hieu FROM (SELECT q.meta_id AS request, m.so_hieu, row_number() OVER (PARTITION BY q.meta_id ORDER BY m.meta_id) AS n FROM document_metadata q JOIN document_metadata m ON {_NUM.format('q.so_hieu')} = {_NUM.format('m.so_hieu')} WHERE q.meta_id % 20 = 0 AND q.so_hieu <> '') WHERE n <= 5)
SELECT request, so_hieu AS entity, direction, other, relation_type, count(*) AS n FROM d JOIN (SELECT entity_start AS own, 'out' AS direction, entity_end AS other, relation_type FROM document_relation UNION ALL SELECT entity_end, 'in', entity_start, relation_type FROM document_relation) r ON d.so_hieu = r.own GROUP BY ALL""",
}
