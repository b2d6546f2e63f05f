"""Queries of vector search, reranking and id operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids, vectors
from quillon.io import table
from quillon.operators import search, store
from quillon.plans import questions

METRIC_SQL = {
    "cosine": "1 - list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
    "l2": "list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "ip": "1 - list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])",
}
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _distance(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _topk(metric: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _distance(search.top_k_of_row(_embeddings(spark, sf), "vec_id", "embedding", 0, 10, metric))

    return query


def _topk_sql(metric: str) -> str:
    return f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT e.vec_id, e.label, {METRIC_SQL[metric]} AS d FROM embeddings e, {_Q}) ORDER BY d, vec_id LIMIT 10"


def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    where = search.metadata_filter({"label": [1, 2, 3]})
    return _distance(search.top_k_of_row(_embeddings(spark, sf), "vec_id", "embedding", 0, 10, where=where, threshold=1.0))


def search_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return _distance(search.top_k_of_row(_embeddings(spark, sf), "vec_id", "embedding", 0, 20, where=search.metadata_filter({"label": 4})))


def batch_knn(spark: SparkSession, sf: str) -> DataFrame:
    """The three nearest vectors of another label for every row whose id is divisible by 20, against all rows."""
    e = _embeddings(spark, sf)
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    found = search.top_k_of_queries(e, "vec_id", "embedding", asked, "query_id", "q", 3, unlike=("label", "q_label"))
    return found.select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "rank")


def _two_stage(e: DataFrame, group: list[str] | None = None) -> DataFrame:
    near = search.top_k_of_row(e, "vec_id", "embedding", 0, 50)
    second = e.where("vec_id = 1").select(F.col("embedding").alias("_s"))
    scored = near.crossJoin(F.broadcast(second))  # one row
    return search.rerank(scored, group or [], F.round(vectors.dot(F.col("embedding"), F.col("_s")), 6), 5, "vec_id").drop("_s")


def search_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    return _two_stage(_embeddings(spark, sf)).select("vec_id", "score_rerank", "rank")


def rerank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The two best rows of each label by inner product with the first vector."""
    e = _embeddings(spark, sf)
    q = e.where("vec_id = 0").select(F.col("embedding").alias("_q"))
    ranked = search.rerank(e.crossJoin(F.broadcast(q)), ["label"], F.round(vectors.dot(F.col("embedding"), F.col("_q")), 6), 2, "vec_id")  # one row
    return ranked.select("label", "vec_id", "score_rerank", "rank")


def _active_chunks(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embedding_result")
    return v.where("chunk_id is not null and size(vector) = 64 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < 1e30)").withColumn("kind", F.col("metadata").getItem("section_type")).withColumn("active", F.col("metadata").getItem("trang_thai") == "1")


def agent_vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Active leaf chunks nearest to the first usable vector, without chunks whose ancestor is among them, reranked."""
    chunks = _active_chunks(spark, sf).where(F.col("kind").isin("dieu", "khoan", "diem") & F.col("active"))
    q = chunks.orderBy("vec_id").limit(1).select(F.col("vector").alias("_q"))
    scored = chunks.crossJoin(F.broadcast(q)).withColumn("distance", F.round(vectors.cosine_distance(F.col("vector"), F.col("_q")), 6))  # one row
    near = scored.where("distance is not null").orderBy("distance", "vec_id").limit(50).withColumn("query", F.lit(0))
    kept = search.drop_descendants(near, "query", "chunk_id")
    best = search.rerank(kept, ["query"], F.round(vectors.dot(F.col("vector"), F.col("_q")), 4), 5, "vec_id")
    return best.select("vec_id", "chunk_id", "distance", "rank")


def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf).select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def vec_resize(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf).select("vec_id", F.posexplode(vectors.resize(F.col("embedding"), 80)).alias("pos", "x"))
    return e.select("vec_id", "pos", F.round(F.col("x").cast("double"), 6).alias("x"))


def vec_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = _embeddings(spark, sf).select("vec_id", F.posexplode(vectors.normalize(F.col("embedding"))).alias("pos", "x"))
    return e.select("vec_id", "pos", F.round("x", 5).alias("x"))


def vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Of several vectors of one chunk the last delivered holds."""
    v = table(spark, sf, "embedding_result").where("chunk_id is not null and chunk_id <> ''")
    last = v.groupBy("chunk_id").agg(F.max("vec_id").alias("vec_id"))
    return last


def get_by_ids(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    return search.lookup_in_order(parts, "p_partkey", [30, 7, 99, 10**9, 12]).select("pos", "p_partkey", "p_name")


def get_by_metadata(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embedding_result").where(F.col("metadata").getItem("section_type") == "diem")
    return v.orderBy("vec_id").limit(20).select("vec_id", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.lit(0.0).alias("distance"))


def leaf_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_node").where(F.col("type").isin(*search.LEAF_TYPES)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    where = search.metadata_filter({"type": ["khoan", "diem"], "parent_context": None})
    return table(spark, sf, "document_node").where(where).select("node_key", "type")


def _decoded(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "document_node").where("id is not null")
    return nodes.select("node_key", F.col("id").alias("chunk_id"), *(c.alias(n) for n, c in ids.decode(F.col("id")).items()))


def decode_section_id(spark: SparkSession, sf: str) -> DataFrame:
    return _decoded(spark, sf).drop("chunk_id")


def chunk_metadata_search(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks under article 3, clause 2, whatever the document."""
    where = questions.section_filter({"dieu": 3, "khoan": 2})
    return _decoded(spark, sf).where(where).select("node_key", "chunk_id", "so_hieu")


def base_chunk_id(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_node").where("id is not null").select("node_key", ids.base_chunk_id(F.col("id")).alias("base_id"))


def explode_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "document_node").where("id is not null")
    return nodes.select("node_key", F.posexplode(ids.ancestors(F.col("id"))).alias("level", "ancestor_id"))


def filter_redundant(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks with text of a document taken as one result list: those below another of the list go."""
    rows = table(spark, sf, "document_node").where("id is not null and content <> ''")
    return search.drop_descendants(rows, "so_hieu", "id").select("node_key", F.col("id").alias("chunk_id"))


def _references(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_node").where("id is not null").select("node_key", F.col("id").alias("main_id"), F.posexplode("reference").alias("pos", "ref_id"))


def ref_family_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).where(search.outside_family(F.col("main_id"), F.col("ref_id")))


def _scored_references(spark: SparkSession, sf: str) -> DataFrame:
    """References outside the family that are stored, with a repeatable stand-in for a model's score."""
    refs = _references(spark, sf).where(search.outside_family(F.col("main_id"), F.col("ref_id")))
    stored = table(spark, sf, "document_node").where("id is not null").groupBy(F.col("id").alias("s_id")).agg(F.max("node_key").alias("s_key"))
    return refs.join(stored, F.col("ref_id") == F.col("s_id")).select("node_key", "main_id", "ref_id", (F.pmod(F.col("s_key") * 7 + F.col("node_key"), F.lit(101)) / 10).alias("score")).distinct()


def top_refs(spark: SparkSession, sf: str) -> DataFrame:
    return search.best_references(_scored_references(spark, sf), "node_key", "ref_id", "score").select("node_key", "ref_id", "score", "rank")


def evaluate_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Per chunk, how many references were judged and which were kept, best first."""
    scored = _scored_references(spark, sf)
    kept = search.best_references(scored, "node_key", "ref_id", "score").groupBy("node_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref_id"))), lambda x: x["ref_id"]), "|").alias("kept"))  # at most three a chunk
    judged = scored.groupBy("node_key").agg(F.count(F.lit(1)).alias("judged"))
    return judged.join(kept, "node_key", "left")


def dup_suffix(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "document_node").where("id is not null").withColumn("base", ids.base_chunk_id(F.col("id")))
    return ids.dup_suffix(nodes, "so_hieu", "base", "node_key").select("node_key", "unique_id")


def id_uniquify(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "document_node").where("id is not null")
    return ids.unique_in_document(nodes, "so_hieu", "id", "node_key").select("node_key", "unique_id")


def batch_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every repeat of an id in a batch of documents, here all of them, gets ``.batch.K``, K counting the repeats of the whole batch in order."""
    nodes = table(spark, sf, "document_node").where("id is not null").withColumn("batch", F.lit(0))
    return ids.batch_numbers(nodes, "batch", "id", "node_key").select("node_key", "unique_id")


def chunk_index(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "document_node").where("type is null or type <> 'van_ban'").select("node_key", "so_hieu")
    return store.ordinal(nodes, "so_hieu", "node_key", "chunk_index").select("node_key", "chunk_index")


def parent_context(spark: SparkSession, sf: str) -> DataFrame:
    """Titles and contents of the ancestors that are stored, outermost first, one a line."""
    nodes = table(spark, sf, "document_node").where("id is not null")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    own = F.nullif(F.concat_ws("\n", blank("title"), blank("content")), F.lit(""))
    one = nodes.groupBy("id").agg(F.max("node_key").alias("node_key"))
    texts = nodes.select(F.col("node_key").alias("t_key"), own.alias("text")).where("text is not null")
    shown = one.join(texts, F.col("node_key") == F.col("t_key")).select(F.col("id").alias("t_id"), "text")
    up = one.select("node_key", F.posexplode(ids.ancestors(F.col("id"))).alias("level", "up"))
    met = up.join(shown, F.col("up") == F.col("t_id")).groupBy("node_key").agg(F.array_sort(F.collect_list(F.struct("level", "text"))).alias("t"))  # as many as the id has segments
    return met.select("node_key", F.md5(F.array_join(F.transform("t", lambda x: x["text"]), "\n")).alias("digest"))


def flatten_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes with a title, content or references in document order; full text only for articles and clauses."""
    nodes = table(spark, sf, "document_node")
    kept = nodes.where("coalesce(title, '') <> '' or coalesce(content, '') <> '' or coalesce(size(reference), 0) > 0")
    placed = store.ordinal(kept.select("node_key", "so_hieu", "type", "full_text"), "so_hieu", "node_key", "seq")
    return placed.select("node_key", "seq", F.when(F.col("type").isin("khoan", "dieu"), F.char_length("full_text")).alias("full_chars"))


def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    text = F.concat_ws("\n", blank("parent_context"), blank("title"), blank("content"))
    return table(spark, sf, "document_node").select("node_key", F.char_length(text).alias("chars"), F.md5(text).alias("digest"))


def embed_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored beside a vector: decoded id, references as JSON, validity; empty values become null."""
    nodes = table(spark, sf, "document_node").where("id is not null")
    d = ids.decode(F.col("id"))
    refs = F.when(F.size("reference") > 0, F.to_json("reference"))
    full = F.when(F.col("type").isin("khoan", "dieu"), F.nullif(F.col("full_text"), F.lit("")))
    return nodes.select("node_key", d["so_hieu"].alias("so_hieu"), d["dieu"].alias("dieu"), d["khoan"].alias("khoan"), F.nullif(F.col("type"), F.lit("")).alias("section_type"), F.nullif(F.col("parent_id"), F.lit("")).alias("parent_id"), refs.alias("reference"), F.md5(full).alias("full_digest"), F.lit(1).alias("trang_thai"))


def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "document_node").where("size(reference) > 0")
    return nodes.select("node_key", F.array_join(F.array_distinct("reference"), "|").alias("refs"))


def parse_reference(spark: SparkSession, sf: str) -> DataFrame:
    """References read back from their stored JSON text, trimmed, without empty ones."""
    stored = table(spark, sf, "document_node").where("reference is not null").select("node_key", F.to_json("reference").alias("j"))
    refs = F.filter(F.transform(F.from_json("j", "array<string>"), lambda x: F.trim(x)), lambda x: x != "")
    return stored.select("node_key", F.size(refs).alias("n"), F.array_join(refs, "|").alias("refs"))


def reference_ids(spark: SparkSession, sf: str) -> DataFrame:
    """References stored as a list of ids, or, for odd rows, of objects."""
    n = table(spark, sf, "document_node").where("reference is not null")
    stored = F.when(F.col("node_key") % 2 == 0, F.to_json("reference")).otherwise(F.to_json(F.transform("reference", lambda x: F.struct(F.concat(F.lit(" "), x).alias("ref_id"), F.lit(1).alias("score")))))
    return n.select("node_key", F.array_join(ids.reference_ids(stored), "|").alias("refs"))


def merge_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Shards merged one after the other, an id that is there already being left out: the first shard wins."""
    v = table(spark, sf, "embedding_result").where("chunk_id <> ''").withColumn("shard", F.pmod(F.col("vec_id"), F.lit(3)))
    first = v.groupBy("chunk_id").agg(F.min(F.struct("shard", "vec_id")).alias("m"))
    return first.select("chunk_id", F.col("m.shard").cast("int").alias("shard"), F.col("m.vec_id").alias("vec_id"))


QUERIES = {f"vector_topk_{m}": _topk(m) for m in METRIC_SQL} | {
    f.__name__: f
    for f in (vector_threshold, search_by_type, batch_knn, search_two_stage, rerank_topk, agent_vector_search, mean_pool, vec_resize, vec_normalize, vector_upsert, get_by_ids, get_by_metadata, leaf_filter, metadata_filter, decode_section_id, chunk_metadata_search, base_chunk_id, explode_ancestors, filter_redundant, ref_family_filter, top_refs, evaluate_refs, dup_suffix, id_uniquify, batch_dedup, chunk_index, parent_context, flatten_tree, embed_text, embed_metadata, ordered_distinct, parse_reference, reference_ids, merge_shards)
}

_BASE = "regexp_replace(id, '__dup_[^.]*', '', 'g')"
_SEGS = "list_transform(list_slice(string_split(id, '.'), 2, 1000), lambda s: regexp_replace(s, '__dup_[0-9]+$', ''))"


def _label(kind: str) -> str:
    own = f"list_filter({_SEGS}, lambda s: starts_with(s, '{kind}_'))"
    return f"CASE WHEN len({own}) > 0 THEN '{ids.LABELS[kind]} ' || translate(regexp_replace(({own})[-1], '^{kind}_', ''), '_', '.') END"


_DECODE = "regexp_replace(string_split(id, '.')[1], '__dup_[0-9]+$', '') AS so_hieu, " + ", ".join(f"{_label(k)} AS {k}" for k in ids.DECODED)
_ANC = "list_transform(generate_series(1, len(string_split({0}, '.')) - 1), lambda i: array_to_string(list_slice(string_split({0}, '.'), 1, i), '.'))"
_REFS = "SELECT node_key, id AS main_id, unnest(range(len(reference))) AS pos, unnest(reference) AS ref_id FROM document_node WHERE id IS NOT NULL"
_OUT = "NOT (main_id = ref_id OR starts_with(main_id, ref_id || '.') OR starts_with(ref_id, main_id || '.'))"
_SCORED = f"SELECT DISTINCT r.node_key, r.main_id, r.ref_id, ((s.s_key * 7 + r.node_key) % 101) / 10.0::DOUBLE AS score FROM ({_REFS}) r JOIN (SELECT id AS s_id, max(node_key) AS s_key FROM document_node WHERE id IS NOT NULL GROUP BY 1) s ON r.ref_id = s.s_id WHERE {_OUT}"
_TOPREFS = f"SELECT * FROM (SELECT node_key, ref_id, score, row_number() OVER (PARTITION BY node_key ORDER BY score DESC, ref_id) AS rank FROM ({_SCORED}) WHERE score >= 6) WHERE rank <= 3"

ORACLE = {f"vector_topk_{m}": _topk_sql(m) for m in METRIC_SQL} | {
    "vector_threshold": f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT * FROM (SELECT e.vec_id, e.label, {METRIC_SQL['cosine']} AS d FROM embeddings e, {_Q} WHERE e.label IN (1, 2, 3)) ORDER BY d, vec_id LIMIT 10) WHERE d <= 1.0",
    "search_by_type": f"SELECT vec_id, label, round(d, 6) AS distance FROM (SELECT e.vec_id, e.label, {METRIC_SQL['cosine']} AS d FROM embeddings e, {_Q} WHERE e.label = 4) ORDER BY d, vec_id LIMIT 20",
    "batch_knn": f"SELECT query_id, vec_id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {METRIC_SQL['cosine']}, e.vec_id) AS rank FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q ON e.label <> q.label) WHERE rank <= 3",
    "search_two_stage": f"SELECT vec_id, score_rerank, rank FROM (SELECT vec_id, s AS score_rerank, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], z.embedding::DOUBLE[]), 6) AS s FROM (SELECT e.vec_id, e.embedding FROM embeddings e, {_Q} ORDER BY {METRIC_SQL['cosine']}, e.vec_id LIMIT 50) e, (SELECT embedding FROM embeddings WHERE vec_id = 1) z)) WHERE rank <= 5",
    "rerank_topk": f"SELECT label, vec_id, s AS score_rerank, rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rank FROM (SELECT e.label, e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS s FROM embeddings e, {_Q})) WHERE rank <= 2",
    "agent_vector_search": f"""
WITH c AS (SELECT vec_id, chunk_id, vector::DOUBLE[] AS v FROM embedding_result WHERE chunk_id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR abs(x) >= 1e30)) = 0
  AND metadata['section_type'] IN ('dieu', 'khoan', 'diem') AND metadata['trang_thai'] = '1'),
q AS (SELECT v FROM c ORDER BY vec_id LIMIT 1),
n AS (SELECT * FROM (SELECT c.vec_id, c.chunk_id, round(CASE WHEN list_inner_product(c.v, c.v) > 0 THEN 1 - list_inner_product(c.v, q.v) / (sqrt(list_inner_product(c.v, c.v)) * sqrt(list_inner_product(q.v, q.v))) END, 6) AS distance, round(list_inner_product(c.v, q.v), 4) AS s, {_BASE.replace('(id', '(chunk_id')} AS base FROM c, q) WHERE distance IS NOT NULL ORDER BY distance, vec_id LIMIT 50),
k AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM n p WHERE starts_with(n.base, p.base || '.')))
SELECT vec_id, chunk_id, distance, rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM k) WHERE rank <= 5""",
    "mean_pool": "SELECT label, CAST(pos AS INT) AS pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings) GROUP BY ALL",
    "vec_resize": "SELECT vec_id, CAST(pos AS INT) AS pos, round(x::DOUBLE, 6) AS x FROM (SELECT vec_id, unnest(range(80)) AS pos, unnest(list_slice(list_concat(embedding, list_transform(range(80), lambda i: 0::FLOAT)), 1, 80)) AS x FROM embeddings)",
    "vec_normalize": "SELECT vec_id, CAST(pos AS INT) AS pos, round(x::DOUBLE / n, 5) AS x FROM (SELECT vec_id, greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9) AS n, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)",
    "vector_upsert": "SELECT chunk_id, max(vec_id) AS vec_id FROM embedding_result WHERE chunk_id <> '' GROUP BY 1",
    "get_by_ids": "SELECT CAST(w.pos AS INT) AS pos, p_partkey, p_name FROM (SELECT unnest(range(5)) AS pos, unnest([30, 7, 99, 1000000000, 12]) AS i) w JOIN part ON p_partkey = i",
    "get_by_metadata": "SELECT vec_id, coalesce(chunk_id, '') AS chunk_id, 0.0::DOUBLE AS distance FROM embedding_result WHERE metadata['section_type'] = 'diem' ORDER BY vec_id LIMIT 20",
    "leaf_filter": "SELECT type, count(*) AS n FROM document_node WHERE type IN ('dieu', 'khoan', 'diem', 'phu_luc_phan') GROUP BY 1",
    "metadata_filter": "SELECT node_key, type FROM document_node WHERE type IN ('khoan', 'diem')",
    "decode_section_id": f"SELECT node_key, {_DECODE} FROM document_node WHERE id IS NOT NULL",
    "chunk_metadata_search": f"SELECT node_key, chunk_id, so_hieu FROM (SELECT node_key, id AS chunk_id, {_DECODE} FROM document_node WHERE id IS NOT NULL) WHERE dieu = 'Điều 3' AND khoan = 'Khoản 2'",
    "base_chunk_id": f"SELECT node_key, {_BASE} AS base_id FROM document_node WHERE id IS NOT NULL",
    "explode_ancestors": f"SELECT node_key, CAST(unnest(range(len(string_split(id, '.')) - 1)) AS INT) AS level, unnest({_ANC.format('id')}) AS ancestor_id FROM document_node WHERE id IS NOT NULL AND contains(id, '.')",
    "filter_redundant": f"WITH l AS (SELECT node_key, id, so_hieu, {_BASE} AS base FROM document_node WHERE id IS NOT NULL AND content <> ''), u AS (SELECT node_key, so_hieu, unnest({_ANC.format('base')}) AS up FROM l WHERE contains(base, '.')) SELECT node_key, id AS chunk_id FROM l WHERE node_key NOT IN (SELECT u.node_key FROM u JOIN l p ON p.so_hieu = u.so_hieu AND p.base = u.up)",
    "ref_family_filter": f"SELECT node_key, main_id, CAST(pos AS INT) AS pos, ref_id FROM ({_REFS}) WHERE {_OUT}",
    "top_refs": _TOPREFS,
    "evaluate_refs": f"SELECT j.node_key, j.judged, k.kept FROM (SELECT node_key, count(*) AS judged FROM ({_SCORED}) GROUP BY 1) j LEFT JOIN (SELECT node_key, string_agg(ref_id, '|' ORDER BY rank) AS kept FROM ({_TOPREFS}) GROUP BY 1) k USING (node_key)",
    "dup_suffix": f"SELECT node_key, CASE WHEN count(*) OVER (PARTITION BY so_hieu, base) > 1 THEN base || '__dup_' || (row_number() OVER (PARTITION BY so_hieu, base ORDER BY node_key) - 1) ELSE base END AS unique_id FROM (SELECT node_key, so_hieu, {_BASE} AS base FROM document_node WHERE id IS NOT NULL)",
    "id_uniquify": "SELECT node_key, CASE WHEN n > 0 THEN id || '.' || n ELSE id END AS unique_id FROM (SELECT node_key, id, row_number() OVER (PARTITION BY so_hieu, id ORDER BY node_key) - 1 AS n FROM document_node WHERE id IS NOT NULL)",
    "batch_dedup": "SELECT node_key, CASE WHEN again THEN id || '.batch.' || CAST(sum(CASE WHEN again THEN 1 ELSE 0 END) OVER (ORDER BY node_key) AS BIGINT) ELSE id END AS unique_id FROM (SELECT node_key, id, row_number() OVER (PARTITION BY id ORDER BY node_key) > 1 AS again FROM document_node WHERE id IS NOT NULL)",
    "chunk_index": "SELECT node_key, row_number() OVER (PARTITION BY so_hieu ORDER BY node_key) AS chunk_index FROM document_node WHERE type IS NULL OR type <> 'van_ban'",
    "parent_context": f"WITH one AS (SELECT id, max(node_key) AS node_key FROM document_node WHERE id IS NOT NULL GROUP BY 1), t AS (SELECT o.id, o.node_key, concat_ws(chr(10), nullif(d.title, ''), nullif(d.content, '')) AS x FROM one o JOIN document_node d USING (node_key)), u AS (SELECT node_key, unnest(range(len(string_split(id, '.')) - 1)) AS level, unnest({_ANC.format('id')}) AS up FROM t WHERE contains(id, '.')) SELECT u.node_key, md5(string_agg(t.x, chr(10) ORDER BY level)) AS digest FROM u JOIN t ON u.up = t.id WHERE t.x <> '' GROUP BY 1",
    "flatten_tree": "SELECT node_key, row_number() OVER (PARTITION BY so_hieu ORDER BY node_key) AS seq, CASE WHEN type IN ('khoan', 'dieu') THEN CAST(length(full_text) AS INT) END AS full_chars FROM document_node WHERE coalesce(title, '') <> '' OR coalesce(content, '') <> '' OR coalesce(len(reference), 0) > 0",
    "embed_text": "SELECT node_key, length(t) AS chars, md5(t) AS digest FROM (SELECT node_key, concat_ws(chr(10), nullif(parent_context, ''), nullif(title, ''), nullif(content, '')) AS t FROM document_node)",
    "embed_metadata": f"SELECT d.node_key, d.so_hieu, d.dieu, d.khoan, nullif(n.type, '') AS section_type, nullif(n.parent_id, '') AS parent_id, CASE WHEN len(n.reference) > 0 THEN CAST(to_json(n.reference) AS VARCHAR) END AS reference, md5(CASE WHEN n.type IN ('khoan', 'dieu') THEN nullif(n.full_text, '') END) AS full_digest, 1 AS trang_thai FROM (SELECT node_key, {_DECODE} FROM document_node WHERE id IS NOT NULL) d JOIN document_node n USING (node_key)",
    "ordered_distinct": "SELECT node_key, array_to_string(list_filter(reference, lambda x, i: list_position(reference, x) = i), '|') AS refs FROM document_node WHERE len(reference) > 0",
    "parse_reference": "SELECT node_key, len(r) AS n, coalesce(array_to_string(r, '|'), '') AS refs FROM (SELECT node_key, list_filter(list_transform(reference, lambda x: trim(x)), lambda x: x <> '') AS r FROM document_node WHERE reference IS NOT NULL)",
    "reference_ids": "SELECT node_key, coalesce(array_to_string(list_filter(r, lambda x, i: x <> '' AND list_position(r, x) = i), '|'), '') AS refs FROM (SELECT node_key, list_transform(reference, lambda x: trim(x)) AS r FROM document_node WHERE reference IS NOT NULL)",
    "merge_shards": "SELECT chunk_id, CAST(vec_id % 3 AS INT) AS shard, vec_id FROM (SELECT chunk_id, vec_id, row_number() OVER (PARTITION BY chunk_id ORDER BY vec_id % 3, vec_id) AS n FROM embedding_result WHERE chunk_id <> '') WHERE n = 1",
}
