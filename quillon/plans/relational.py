"""Queries of scans, filters, joins, aggregates, stores, flow and evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import ids
from quillon.io import table
from quillon.operators import search, store
from quillon.plans import pipelines
from quillon.plans.texts import _ANSWERS, _LETTER, answer_text, letter_of
from quillon.sources import files


def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("priority"))


def scan_count(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))


def shard_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the second of three positional shards; the last shard takes the remainder."""
    return files.shard(table(spark, sf, "orders"), "o_orderkey", 3, 1).select("o_orderkey", "o_custkey")


def page(spark: SparkSession, sf: str) -> DataFrame:
    """A page of a listing: the feature is its limit."""
    return table(spark, sf, "orders").orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey", "o_totalprice")


def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Agencies with their counts, written as CSV and read back; rows that do not fit the schema go."""
    path = files.shared_path(spark, "csv")
    counts = table(spark, sf, "document_metadata").where("co_quan_ban_hanh <> ''").groupBy("co_quan_ban_hanh").agg(F.count(F.lit(1)).alias("count"))
    counts.write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_counts(spark, path)


def filter_eq(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata").where(F.col("loai") == "luat").select("meta_id", "so_hieu")


def filter_isin_normalized(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "document_metadata")
    return m.where(F.lower(F.trim("co_quan_ban_hanh")).isin("hội đồng lập pháp", "tổng cục bến bãi")).select("meta_id", "co_quan_ban_hanh")


def or_ilike_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in force whose number or title holds a phrase, the first hundred."""
    m = table(spark, sf, "document_metadata")
    hit = F.col("so_hieu").ilike("%hđlp%") | F.col("ten_van_ban").ilike("%quy chế%")
    return m.where((F.col("trang_thai") == 1) & hit).orderBy("meta_id").limit(100).select("meta_id", "so_hieu")


def search_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata").where(F.col("ten_van_ban").ilike("%BÁO CÁO TÁC ĐỘNG%")).select("meta_id")


def ilike_limit(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata").where(F.col("linh_vuc").ilike("%bến%")).orderBy("meta_id").limit(20).select("meta_id", "linh_vuc")


def agency_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Agencies kept by name rules and a least count, most frequent first."""
    name = F.lower(F.trim("co_quan_ban_hanh"))
    counts = table(spark, sf, "document_metadata").where("co_quan_ban_hanh <> ''").groupBy(name.alias("agency")).agg(F.count(F.lit(1)).alias("n"))
    a = F.col("agency")
    kept = (a.isin("hội đồng lập pháp") | a.startswith("bộ ") | a.startswith("tổng cục")) & ~a.contains("ubnd") & (F.col("n") > 2)
    return counts.where(kept).orderBy(F.desc("n"), "agency")


def coalesce_defaults(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "document_metadata")
    full = lambda c, d: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)).alias(c)
    return m.select("meta_id", full("ten_van_ban", ""), full("linh_vuc", "Chưa xác định"), full("ngay_co_hieu_luc", "Chưa xác định"))


def verdict_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors whose chunk is stored: verdicts on unknown ids do not count."""
    v = table(spark, sf, "embedding_result").where("chunk_id <> ''")
    known = table(spark, sf, "document_node").where("id is not null").select(F.col("id").alias("known")).distinct()
    return v.join(known, F.col("chunk_id") == F.col("known"), "left_semi").select("vec_id", "chunk_id")


def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    o, c = o.select(F.col("o_custkey").cast("string").alias("id"), "o_orderkey"), c.select(F.col("c_custkey").cast("string").alias("c_id"), "c_name")
    return o.join(c, F.col("id") == F.col("c_id")).select("id", "o_orderkey", "c_name")


def _segment_type() -> Column:
    return F.when(F.col("r_regionkey") % 2 == 0, "can_cu").otherwise("huong_dan_thi_hanh")


def cross_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Every nation with every region: two small dimension tables, the type from the pair."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.crossJoin(F.broadcast(r)).select(F.col("n_name").alias("entity_start"), F.col("r_name").alias("entity_end"), _segment_type().alias("relation_type"))


def relation_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by type over the whole vocabulary, types without any included."""
    known = spark.createDataFrame([(t,) for t in RELATIONS], "relation_type string")
    counts = table(spark, sf, "document_relation").groupBy(F.col("relation_type").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, F.col("relation_type") == F.col("t"), "left").select("relation_type", F.coalesce("n", F.lit(0)).alias("n"))


RELATIONS = ("thay_the", "can_cu", "huong_dan_thi_hanh", "sua_doi_bo_sung", "bai_bo", "hop_nhat", "dan_chieu", "tham_chieu", "lien_quan", "dinh_chinh")


def relations_of(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "document_metadata").where("so_hieu <> ''").select("so_hieu").distinct()
    return store.relations_of(table(spark, sf, "document_relation"), docs, "so_hieu").groupBy("entity", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first_other"))


def relation_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Relations of one batch added to those there already, each triple once: here the older half meets the newer."""
    r = table(spark, sf, "document_relation").select("entity_start", "entity_end", "relation_type", "created_at")
    keys = ["entity_start", "entity_end", "relation_type"]
    cut = F.lit("2023-01-01").cast("timestamp_ntz")
    base = r.where(F.col("created_at") < cut).select(*keys).distinct()
    delta = r.where(F.coalesce(F.col("created_at") >= cut, F.lit(True))).select(*keys)
    return store.add_missing(base, delta, keys)


def delete_triple(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "document_relation")
    gone = r.where("relation_type = 'bai_bo'").select("entity_start", "entity_end", "relation_type")
    return store.remove(r, gone, ["entity_start", "entity_end", "relation_type"]).select("id", "relation_type")


def nearest_position(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase the click of the same user that is nearest in time, the earlier event on ties: the neighbours before and after are found by windows, not by a join of all pairs."""
    e = table(spark, sf, "events").where("event_type in ('purchase', 'click')").select("event_id", "user_id", F.col("event_type").alias("t"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    click = F.when(F.col("t") == "click", F.struct("at", F.col("event_id").alias("id")))
    so_far = lambda *order: F.last(click, ignorenulls=True).over(Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # noqa: E731  a running value either way
    before, after = so_far("at", "event_id"), so_far(F.desc("at"), F.desc("event_id"))
    both = e.select("event_id", "t", "at", before.alias("b"), after.alias("a")).where("t = 'purchase' and (a is not null or b is not null)")
    gap_b, gap_a = F.col("at") - F.col("b.at"), F.col("a.at") - F.col("at")
    return both.select("event_id", F.least(gap_b, gap_a).alias("gap"))


def db_stats(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("indexed") == 1).alias("indexed"))


def chunk_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_node").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def agency_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "document_metadata").groupBy(F.lower("co_quan_ban_hanh").alias("agency")).agg(F.count(F.lit(1)).alias("n"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Running counters of an indexing job: chunks, usable vectors, unusable ones."""
    v = table(spark, sf, "embedding_result")
    usable = F.coalesce(F.size("vector") == 64, F.lit(False))
    return v.groupBy(F.col("metadata").getItem("section_type").alias("kind")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(usable).alias("usable"), F.count_if(~usable).alias("failed"))


def resync_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All deliveries of a document collapsed to one row."""
    return store.collapse(table(spark, sf, "document_metadata"), "so_hieu", "meta_id")


def ordered_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Line numbers of an order joined in order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))  # at most some dozen an order
    return lines.select("l_orderkey", F.array_join(F.transform("x", lambda s: s["l_partkey"].cast("string")), ". ").alias("parts"))


def fan_in(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs of several branches, one list: numbered branch by branch."""
    e = table(spark, sf, "events")
    branches = [e.where(F.col("event_type") == t).select(F.lit(i).alias("branch"), "user_id", "event_id") for i, t in enumerate(("purchase", "click"))]
    whole = branches[0].unionByName(branches[1])
    return whole.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("branch", "event_id")).alias("m")).select("user_id", "n", F.col("m.event_id").alias("first_event"))


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions against the truth: the truth of a third of the orders comes from a second table, else from the row."""
    o = table(spark, sf, "orders")
    sign = lambda k: F.substring(F.lit("ABCD"), (F.pmod(k, F.lit(4)) + 1).cast("int"), F.lit(1))
    inline = sign(F.col("o_custkey") + F.floor(F.col("o_totalprice")) * 0 + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0))
    truth = table(spark, sf, "customer").where("c_nationkey < 8").select("c_custkey", sign(F.col("c_custkey")).alias("held"))
    joined = o.select("o_orderkey", "o_custkey", "o_orderpriority", answer_text().alias("a"), inline.alias("inline")).join(truth, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", "o_orderpriority", letter_of(F.col("a")).alias("predicted"), F.coalesce("held", "inline").alias("truth"))


def eval_join(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).select("o_orderkey", "predicted", "truth", (F.col("predicted") == F.col("truth")).alias("is_correct"))


def _accuracy() -> list[Column]:
    right = F.sum(F.when(F.col("predicted") == F.col("truth"), 1).otherwise(0))
    return [F.count(F.lit(1)).alias("n"), right.alias("correct"), F.round(F.coalesce(F.try_divide(right.cast("double") * 100, F.count_if(F.col("predicted") != "N/A")), F.lit(0.0)), 6).alias("accuracy")]


def eval_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).agg(*_accuracy())


def eval_by_topic(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).groupBy(F.col("o_orderpriority").alias("topic")).agg(*_accuracy())


def eval_per_class(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf).groupBy("truth").agg(*_accuracy())


def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    p = _evaluated(spark, sf).groupBy("truth").pivot("predicted", ["A", "B", "C", "D", "N/A"]).agg(F.count(F.lit(1)))
    return p.select("truth", *(F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(n) for c, n in (("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("N/A", "none"))))


def eval_error_patterns(spark: SparkSession, sf: str) -> DataFrame:
    wrong = _evaluated(spark, sf).where("predicted <> truth").groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n"))
    total = wrong.agg(F.sum("n").alias("all_wrong"))
    return wrong.crossJoin(F.broadcast(total)).select("truth", "predicted", "n", F.round(F.col("n") * 100.0 / F.col("all_wrong"), 6).alias("percent"))  # one row


def eval_error_join(spark: SparkSession, sf: str) -> DataFrame:
    """Wrong answers on documents that could not be indexed: here orders with too many lines."""
    wrong = _evaluated(spark, sf).where("predicted <> truth")
    failed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines")).where("lines > 5")
    return wrong.join(failed, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "predicted", "truth", "lines")


def upsert_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries merged by document: the last one holds, the validity flag stays that of the first."""
    m = table(spark, sf, "document_metadata").where("so_hieu <> ''").select("so_hieu", "meta_id", "indexed", "trang_thai", "created_at")
    keys = ["so_hieu"]
    first = store.latest(m, keys, F.asc_nulls_first("created_at"), F.asc("meta_id"))
    last = store.latest(m, keys, F.desc_nulls_last("created_at"), F.desc("meta_id"))
    return store.upsert(first, last, "so_hieu", keep=("trang_thai",)).select("so_hieu", "meta_id", "indexed", "trang_thai")


def deactivate(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of documents that another document replaces lose their validity."""
    gone = table(spark, sf, "document_relation").where("relation_type = 'thay_the'")
    n = store.backfill(table(spark, sf, "document_node").select("node_key", "so_hieu"), "trang_thai", 1)
    return store.deactivate(n, "so_hieu", gone, "entity_end", "trang_thai").select("node_key", "trang_thai")


def backfill(spark: SparkSession, sf: str) -> DataFrame:
    return store.backfill(table(spark, sf, "document_metadata").select("meta_id", "trang_thai"), "trang_thai", 1)


def replace_document(spark: SparkSession, sf: str) -> DataFrame:
    """State of every document after all replacements: replaced ones are out of force, with the number of relations added."""
    m = table(spark, sf, "document_metadata").where("so_hieu <> ''").select("so_hieu").distinct()
    r = table(spark, sf, "document_relation").where("relation_type = 'thay_the'").select("entity_start", "entity_end").distinct()
    flagged = store.deactivate(store.backfill(m, "trang_thai", 1), "so_hieu", r, "entity_end", "trang_thai")
    added = r.groupBy(F.col("entity_start").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return flagged.join(added, F.col("so_hieu") == F.col("s"), "left").select("so_hieu", "trang_thai", F.coalesce("n", F.lit(0)).alias("relations"))


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    """First event of a user and kind."""
    e = table(spark, sf, "events").withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return search.first_seen(e, "k", "ts", "event_id").select("k", "event_id")


def display_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    l = store.ordinal(table(spark, sf, "events"), "user_id", "event_id", "n")
    return l.select("event_id", F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "event_type").alias("shown"))


def range_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Articles ``from a to b``; nothing if b comes before a or the range is longer than allowed."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct()
    inside = F.when((F.col("a") <= F.col("b")) & (F.col("b") < F.col("a") + 500), F.sequence("a", "b"))
    return l.select("l_orderkey", "a", "b", F.explode(inside).alias("article")).groupBy("a", "b").agg(F.countDistinct("l_orderkey").alias("orders"), F.min("article").alias("low"), F.max("article").alias("high"))


def route_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Branch of each request; what is empty or unknown goes to the fallback."""
    route = F.when(F.col("event_type") == "purchase", "legal_query").when(F.col("event_type") == "click", "general").when(F.col("event_type") == "view", "doc_relation").otherwise("fallback")
    return table(spark, sf, "events").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


def merge_results(spark: SparkSession, sf: str) -> DataFrame:
    """Every sub-question (kind) of a request (user) receives the whole context gathered for the request, in order, without repeats."""
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "props")
    asked = e.select("user_id", "event_type").distinct()
    merged = pipelines.merge_results(asked, e, "user_id", "props", "event_id")
    return merged.select("user_id", "event_type", F.size("context").alias("n"), F.md5(F.array_join("context", "\n---\n")).alias("digest"))


def build_context(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered sources of each order joined and cut to the context's length."""
    o = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))  # at most some dozen an order
    shown = F.transform("x", lambda s, i: F.concat(F.lit("[Nguồn "), (i + 1).cast("string"), F.lit("] part "), s["l_partkey"].cast("string")))
    context = F.left(F.array_join(shown, "\n\n"), F.lit(pipelines.CONTEXT))
    return o.select("l_orderkey", F.char_length(context).alias("chars"), F.md5(context).alias("digest"))


def doc_display(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "document_metadata")
    state = F.when(F.col("trang_thai") == 0, "hết hiệu lực").otherwise("còn hiệu lực")
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    return m.select("meta_id", F.concat_ws(" | ", part("Số: ", "so_hieu"), part("Loại: ", "loai"), part("Ngày: ", "ngay_ban_hanh"), state).alias("shown"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "document_node").where("id is not null and type in ('khoan', 'diem', 'dieu')")
    d = ids.decode(F.col("id"))
    return n.select("node_key", F.concat_ws(" - ", d["so_hieu"], F.nullif(F.concat_ws(", ", d["dieu"], d["khoan"]), F.lit(""))).alias("citation"))


def evaluate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """First-seen chunks of a result list without those below another one, kept by the verdict: here the chunk's validity."""
    v = table(spark, sf, "embedding_result").where("chunk_id <> ''")
    first = v.groupBy("chunk_id").agg(F.min(F.struct("vec_id", F.col("metadata").getItem("trang_thai").alias("ok"), F.col("metadata").getItem("so_hieu").alias("doc"))).alias("m"))
    rows = first.select("chunk_id", "m.vec_id", "m.ok", "m.doc").where("doc is not null")
    return search.drop_descendants(rows, "doc", "chunk_id").where("ok = '1'").select("vec_id", "chunk_id")


def context_with_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of each chunk's text together with those of the chunks it refers to."""
    n = table(spark, sf, "document_node").where("id is not null")
    held = n.groupBy("id").agg(F.max(F.struct("node_key", F.char_length(F.coalesce("content", F.lit(""))).alias("c"))).alias("m")).select(F.col("id").alias("r_id"), F.col("m.c").alias("r_chars"))
    refs = n.select("node_key", F.explode(F.array_distinct("reference")).alias("ref")).join(held, F.col("ref") == F.col("r_id")).groupBy(F.col("node_key").alias("k")).agg(F.sum("r_chars").alias("ref_chars"), F.count(F.lit(1)).alias("refs"))
    return n.join(refs, F.col("node_key") == F.col("k")).select("node_key", "refs", (F.coalesce(F.char_length("content"), F.lit(0)) + F.col("ref_chars")).alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (scan_project, scan_count, shard_slice, page, csv_scan, filter_eq, filter_isin_normalized, or_ilike_search, search_by_name, ilike_limit, agency_rules, coalesce_defaults, verdict_filter, join_inner, cross_relations, relation_stats, relations_of, relation_dedup, delete_triple, nearest_position, db_stats, chunk_type_counts, agency_distribution, index_stats, resync_docs, ordered_concat, fan_in, eval_join, eval_accuracy, eval_by_topic, eval_per_class, eval_confusion, eval_error_patterns, eval_error_join, upsert_docs, deactivate, backfill, replace_document, dedup_first, display_ordinal, range_expand, route_intent, merge_results, build_context, doc_display, citations, evaluate_chunks, context_with_refs)
}

_EVAL = f"(SELECT a.o_orderkey, o.o_orderpriority, {_LETTER} AS predicted, coalesce(t.held, substr('ABCD', CAST((o.o_custkey + CASE WHEN o.o_orderkey % 3 = 0 THEN 1 ELSE 0 END) % 4 + 1 AS INT), 1)) AS truth FROM {_ANSWERS} a JOIN orders o USING (o_orderkey) LEFT JOIN (SELECT c_custkey, substr('ABCD', CAST(c_custkey % 4 + 1 AS INT), 1) AS held FROM customer WHERE c_nationkey < 8) t ON t.c_custkey = o.o_custkey)"
_ACC = "count(*) AS n, CAST(sum(CASE WHEN predicted = truth THEN 1 ELSE 0 END) AS BIGINT) AS correct, round(coalesce(sum(CASE WHEN predicted = truth THEN 1 ELSE 0 END)::DOUBLE * 100 / nullif(count(*) FILTER (WHERE predicted <> 'N/A'), 0), 0), 6) AS accuracy"
_BASE = "regexp_replace(chunk_id, '__dup_[^.]*', '', 'g')"
_LAB = lambda k, v: f"(CASE WHEN regexp_matches(id, '\\.{k}_') THEN '{v} ' || translate(regexp_replace(list_filter(list_transform(list_slice(string_split(id, '.'), 2, 1000), lambda s: regexp_replace(s, '__dup_[0-9]+$', '')), lambda s: starts_with(s, '{k}_'))[-1], '^{k}_', ''), '_', '.') END)"
ORACLE = {
    "scan_project": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority AS priority FROM orders",
    "scan_count": "SELECT count(*) AS n FROM orders",
    "shard_slice": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders) WHERE n >= total // 3 AND n < 2 * (total // 3)",
    "page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "csv_scan": "SELECT co_quan_ban_hanh, count(*) AS \"count\" FROM document_metadata WHERE co_quan_ban_hanh <> '' GROUP BY 1",
    "filter_eq": "SELECT meta_id, so_hieu FROM document_metadata WHERE loai = 'luat'",
    "filter_isin_normalized": "SELECT meta_id, co_quan_ban_hanh FROM document_metadata WHERE lower(trim(co_quan_ban_hanh)) IN ('hội đồng lập pháp', 'tổng cục bến bãi')",
    "or_ilike_search": "SELECT meta_id, so_hieu FROM document_metadata WHERE trang_thai = 1 AND (so_hieu ILIKE '%hđlp%' OR ten_van_ban ILIKE '%quy chế%') ORDER BY meta_id LIMIT 100",
    "search_by_name": "SELECT meta_id FROM document_metadata WHERE ten_van_ban ILIKE '%BÁO CÁO TÁC ĐỘNG%'",
    "ilike_limit": "SELECT meta_id, linh_vuc FROM document_metadata WHERE linh_vuc ILIKE '%bến%' ORDER BY meta_id LIMIT 20",
    "agency_rules": "SELECT * FROM (SELECT lower(trim(co_quan_ban_hanh)) AS agency, count(*) AS n FROM document_metadata WHERE co_quan_ban_hanh <> '' GROUP BY 1) WHERE (agency = 'hội đồng lập pháp' OR starts_with(agency, 'bộ ') OR starts_with(agency, 'tổng cục')) AND NOT contains(agency, 'ubnd') AND n > 2",
    "coalesce_defaults": "SELECT meta_id, coalesce(nullif(ten_van_ban, ''), '') AS ten_van_ban, coalesce(nullif(linh_vuc, ''), 'Chưa xác định') AS linh_vuc, coalesce(nullif(ngay_co_hieu_luc, ''), 'Chưa xác định') AS ngay_co_hieu_luc FROM document_metadata",
    "verdict_filter": "SELECT vec_id, chunk_id FROM embedding_result WHERE chunk_id <> '' AND chunk_id IN (SELECT id FROM document_node WHERE id IS NOT NULL)",
    "join_inner": "SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "cross_relations": "SELECT n_name AS entity_start, r_name AS entity_end, CASE WHEN r_regionkey % 2 = 0 THEN 'can_cu' ELSE 'huong_dan_thi_hanh' END AS relation_type FROM nation, region",
    "relation_stats": f"SELECT k AS relation_type, count(r.id) AS n FROM (SELECT unnest([{', '.join(repr(t) for t in RELATIONS)}]) AS k) LEFT JOIN document_relation r ON r.relation_type = k GROUP BY 1",
    "relations_of": "WITH d AS (SELECT DISTINCT so_hieu AS entity FROM document_metadata WHERE so_hieu <> '') SELECT entity, direction, count(*) AS n, min(other) AS first_other FROM (SELECT entity, 'out' AS direction, entity_end AS other FROM d JOIN document_relation ON entity = entity_start UNION ALL SELECT entity, 'in', entity_start FROM d JOIN document_relation ON entity = entity_end) GROUP BY ALL",
    "relation_dedup": "SELECT DISTINCT entity_start, entity_end, relation_type FROM document_relation",
    "delete_triple": "SELECT id, relation_type FROM document_relation WHERE NOT (relation_type = 'bai_bo' AND entity_start IS NOT NULL AND entity_end IS NOT NULL) OR relation_type IS NULL",
    "nearest_position": "SELECT p.event_id, min(abs(epoch_us(p.ts) - epoch_us(c.ts))) AS gap FROM events p JOIN events c ON c.user_id = p.user_id AND c.event_type = 'click' WHERE p.event_type = 'purchase' GROUP BY 1",
    "db_stats": "SELECT count(*) AS documents, count(*) FILTER (WHERE indexed = 1) AS indexed FROM document_metadata",
    "chunk_type_counts": "SELECT type, count(*) AS n FROM document_node GROUP BY 1",
    "agency_distribution": "SELECT lower(co_quan_ban_hanh) AS agency, count(*) AS n FROM document_metadata GROUP BY 1",
    "index_stats": "SELECT metadata['section_type'] AS kind, count(*) AS chunks, count(*) FILTER (WHERE coalesce(len(vector) = 64, false)) AS usable, count(*) FILTER (WHERE NOT coalesce(len(vector) = 64, false)) AS failed FROM embedding_result GROUP BY 1",
    "resync_docs": """
WITH RECURSIVE r AS (SELECT so_hieu, row_number() OVER (PARTITION BY so_hieu ORDER BY meta_id) AS n, count(*) OVER (PARTITION BY so_hieu) AS rows, coalesce(nullif(nullif(ten_van_ban, ''), 'Chưa xác định'), '') AS ten_van_ban, coalesce(nullif(nullif(loai, ''), 'Chưa xác định'), '') AS loai, coalesce(nullif(nullif(co_quan_ban_hanh, ''), 'Chưa xác định'), '') AS co_quan_ban_hanh, coalesce(nullif(nullif(ngay_ban_hanh, ''), 'Chưa xác định'), '') AS ngay_ban_hanh, coalesce(nullif(nullif(ngay_co_hieu_luc, ''), 'Chưa xác định'), '') AS ngay_co_hieu_luc, coalesce(nullif(nullif(file_path, ''), 'Chưa xác định'), '') AS file_path FROM document_metadata WHERE so_hieu <> ''),
d AS (SELECT * FROM r WHERE n = 1 UNION ALL SELECT r.so_hieu, r.n, r.rows, CASE WHEN (d.ten_van_ban = '' AND r.ten_van_ban <> '') OR (d.co_quan_ban_hanh = '' AND r.co_quan_ban_hanh <> '') THEN coalesce(nullif(r.ten_van_ban, ''), d.ten_van_ban) ELSE d.ten_van_ban END, CASE WHEN (d.ten_van_ban = '' AND r.ten_van_ban <> '') OR (d.co_quan_ban_hanh = '' AND r.co_quan_ban_hanh <> '') THEN coalesce(nullif(r.loai, ''), d.loai) ELSE d.loai END, CASE WHEN (d.ten_van_ban = '' AND r.ten_van_ban <> '') OR (d.co_quan_ban_hanh = '' AND r.co_quan_ban_hanh <> '') THEN coalesce(nullif(r.co_quan_ban_hanh, ''), d.co_quan_ban_hanh) ELSE d.co_quan_ban_hanh END, CASE WHEN (d.ten_van_ban = '' AND r.ten_van_ban <> '') OR (d.co_quan_ban_hanh = '' AND r.co_quan_ban_hanh <> '') THEN coalesce(nullif(r.ngay_ban_hanh, ''), d.ngay_ban_hanh) ELSE d.ngay_ban_hanh END, CASE WHEN (d.ten_van_ban = '' AND r.ten_van_ban <> '') OR (d.co_quan_ban_hanh = '' AND r.co_quan_ban_hanh <> '') THEN coalesce(nullif(r.ngay_co_hieu_luc, ''), d.ngay_co_hieu_luc) ELSE d.ngay_co_hieu_luc END, CASE WHEN (d.ten_van_ban = '' AND r.ten_van_ban <> '') OR (d.co_quan_ban_hanh = '' AND r.co_quan_ban_hanh <> '') THEN coalesce(nullif(r.file_path, ''), d.file_path) ELSE d.file_path END FROM d JOIN r ON r.so_hieu = d.so_hieu AND r.n = d.n + 1)
SELECT so_hieu, rows, coalesce(nullif(ten_van_ban, ''), 'Chưa xác định') AS ten_van_ban, coalesce(nullif(loai, ''), 'Văn bản') AS loai, coalesce(nullif(co_quan_ban_hanh, ''), '') AS co_quan_ban_hanh, coalesce(nullif(ngay_ban_hanh, ''), '') AS ngay_ban_hanh, coalesce(nullif(ngay_co_hieu_luc, ''), '') AS ngay_co_hieu_luc, coalesce(nullif(file_path, ''), '') AS file_path FROM d WHERE n = rows""",
    "ordered_concat": "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '. ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1",
    "fan_in": "SELECT user_id, count(*) AS n, arg_min(event_id, (CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END) * 1000000000000 + event_id) AS first_event FROM events WHERE event_type IN ('purchase', 'click') GROUP BY 1",
    "eval_join": f"SELECT o_orderkey, predicted, truth, predicted = truth AS is_correct FROM {_EVAL}",
    "eval_accuracy": f"SELECT {_ACC} FROM {_EVAL}",
    "eval_by_topic": f"SELECT o_orderpriority AS topic, {_ACC} FROM {_EVAL} GROUP BY 1",
    "eval_per_class": f"SELECT truth, {_ACC} FROM {_EVAL} GROUP BY 1",
    "eval_confusion": f"SELECT truth, count(*) FILTER (WHERE predicted = 'A') AS a, count(*) FILTER (WHERE predicted = 'B') AS b, count(*) FILTER (WHERE predicted = 'C') AS c, count(*) FILTER (WHERE predicted = 'D') AS d, count(*) FILTER (WHERE predicted = 'N/A') AS none FROM {_EVAL} GROUP BY 1",
    "eval_error_patterns": f"SELECT truth, predicted, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 6) AS percent FROM (SELECT truth, predicted, count(*) AS n FROM {_EVAL} WHERE predicted <> truth GROUP BY ALL)",
    "eval_error_join": f"SELECT o_orderkey, predicted, truth, lines FROM {_EVAL} JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE predicted <> truth AND lines > 5",
    "upsert_docs": "SELECT so_hieu, last(meta_id ORDER BY created_at NULLS FIRST, meta_id) AS meta_id, last(indexed ORDER BY created_at NULLS FIRST, meta_id) AS indexed, first(trang_thai ORDER BY created_at NULLS FIRST, meta_id) AS trang_thai FROM document_metadata WHERE so_hieu <> '' GROUP BY 1",
    "deactivate": "SELECT node_key, CASE WHEN so_hieu IN (SELECT entity_end FROM document_relation WHERE relation_type = 'thay_the' AND entity_end IS NOT NULL) THEN 0 ELSE 1 END AS trang_thai FROM document_node",
    "backfill": "SELECT meta_id, coalesce(trang_thai, 1) AS trang_thai FROM document_metadata",
    "replace_document": "WITH r AS (SELECT DISTINCT entity_start, entity_end FROM document_relation WHERE relation_type = 'thay_the') SELECT so_hieu, CASE WHEN so_hieu IN (SELECT entity_end FROM r WHERE entity_end IS NOT NULL) THEN 0 ELSE 1 END AS trang_thai, coalesce(n, 0) AS relations FROM (SELECT DISTINCT so_hieu FROM document_metadata WHERE so_hieu <> '') LEFT JOIN (SELECT entity_start AS s, count(*) AS n FROM r GROUP BY 1) ON so_hieu = s",
    "dedup_first": "SELECT k, event_id FROM (SELECT concat_ws(':', user_id, event_type) AS k, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "display_ordinal": "SELECT event_id, '[' || row_number() OVER (PARTITION BY user_id ORDER BY event_id) || '] ' || event_type AS shown FROM events",
    "range_expand": "SELECT a, b, count(DISTINCT l_orderkey) AS orders, a AS low, b AS high FROM (SELECT l_orderkey, l_linenumber AS a, CAST(l_quantity AS INT) AS b FROM lineitem) WHERE a <= b AND b < a + 500 GROUP BY a, b",
    "route_intent": "SELECT CASE event_type WHEN 'purchase' THEN 'legal_query' WHEN 'click' THEN 'general' WHEN 'view' THEN 'doc_relation' ELSE 'fallback' END AS route, count(*) AS n FROM events GROUP BY 1",
    "merge_results": "SELECT q.user_id, q.event_type, c.n, c.digest FROM (SELECT DISTINCT user_id, event_type FROM events) q JOIN (SELECT user_id, CAST(count(*) AS INT) AS n, md5(string_agg(props, chr(10) || '---' || chr(10) ORDER BY event_id)) AS digest FROM (SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY ALL) GROUP BY 1) c USING (user_id)",
    "build_context": "SELECT l_orderkey, CAST(length(c) AS INT) AS chars, md5(c) AS digest FROM (SELECT l_orderkey, left(string_agg('[Nguồn ' || n || '] part ' || l_partkey, chr(10) || chr(10) ORDER BY n), 8000) AS c FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) GROUP BY 1)",
    "doc_display": "SELECT meta_id, concat_ws(' | ', 'Số: ' || nullif(so_hieu, ''), 'Loại: ' || nullif(loai, ''), 'Ngày: ' || nullif(ngay_ban_hanh, ''), CASE WHEN trang_thai = 0 THEN 'hết hiệu lực' ELSE 'còn hiệu lực' END) AS shown FROM document_metadata",
    "citations": f"SELECT node_key, concat_ws(' - ', regexp_replace(string_split(id, '.')[1], '__dup_[0-9]+$', ''), nullif(concat_ws(', ', {_LAB('dieu', 'Điều')}, {_LAB('khoan', 'Khoản')}), '')) AS citation FROM document_node WHERE id IS NOT NULL AND type IN ('khoan', 'diem', 'dieu')",
    "evaluate_chunks": f"WITH f AS (SELECT chunk_id, min(vec_id) AS vec_id FROM embedding_result WHERE chunk_id <> '' GROUP BY 1), r AS (SELECT f.*, metadata['trang_thai'] AS ok, metadata['so_hieu'] AS doc, {_BASE.replace('(chunk_id', '(f.chunk_id')} AS base FROM f JOIN embedding_result e USING (vec_id)), u AS (SELECT vec_id, doc, unnest(list_transform(generate_series(1, len(string_split(base, '.')) - 1), lambda i: array_to_string(list_slice(string_split(base, '.'), 1, i), '.'))) AS up FROM r WHERE doc IS NOT NULL AND contains(base, '.')) SELECT vec_id, chunk_id FROM r WHERE doc IS NOT NULL AND ok = '1' AND vec_id NOT IN (SELECT u.vec_id FROM u JOIN r p ON p.doc = u.doc AND p.base = u.up)",
    "context_with_refs": "WITH n AS (SELECT node_key, id, length(coalesce(content, '')) AS c, reference FROM document_node WHERE id IS NOT NULL), h AS (SELECT id, arg_max(c, node_key) AS c FROM n GROUP BY 1), x AS (SELECT DISTINCT node_key, ref FROM (SELECT node_key, unnest(reference) AS ref FROM n)) SELECT n.node_key, count(*) AS refs, CAST(any_value(n.c) + sum(h.c) AS BIGINT) AS chars FROM n JOIN x USING (node_key) JOIN h ON h.id = x.ref GROUP BY 1",
}
