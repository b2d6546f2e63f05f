"""Queries of the general training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.keys import is_blank, number_key
from quillon.io import table
from quillon.operators.hierarchy import Hierarchy
from quillon.operators.orphans import OrphanState
from quillon.session import Scratch

#: Time between the two steps in which p4 feeds its state; the result does not depend on it.
STEP = "2024-01-01 00:00:00"


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return Hierarchy(table(spark, sf, "document_node")).found()


def p3_paths(spark: SparkSession, sf: str) -> DataFrame:
    return Hierarchy(table(spark, sf, "document_node")).paths()


def p3_spans(spark: SparkSession, sf: str) -> DataFrame:
    return Hierarchy(table(spark, sf, "document_node")).spans().select("node_id", "root", "tree_depth", "entry", "exit", "n_descendants")


def p3_rooted(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes that reach a root, with path, depth and number of descendants: what the tours give, side by side."""
    h = Hierarchy(table(spark, sf, "document_node"))
    found = h.found().where("depth >= 0").select("node_id", "root_id", "depth")
    spans = h.spans().select(F.col("node_id").alias("s_id"), "n_descendants")
    paths = h.paths().select(F.col("node_id").alias("p_id"), F.md5("path").alias("path_digest"))
    return found.join(spans, F.col("node_id") == F.col("s_id")).join(paths, F.col("node_id") == F.col("p_id")).select("node_id", "root_id", "depth", "path_digest", "n_descendants")


def p3_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of each node that a row with a key divisible by 20 names."""
    rows = table(spark, sf, "document_node")
    return Hierarchy(rows).descendants(rows.where("node_key % 20 = 0 and id is not null").select("id"))


def endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """``(id, side, target_table, key, created_at)`` of every endpoint that is not blank."""
    rel = table(spark, sf, "document_relation")
    sides = [rel.select("id", F.lit(s).alias("side"), F.col(s).alias("end"), "created_at") for s in ("entity_start", "entity_end")]
    both = sides[0].unionByName(sides[1]).where(~is_blank(F.col("end")))
    node = F.col("end").contains(".")
    nodes = both.where(node).select("id", "side", F.lit("document_node").alias("target_table"), F.col("end").alias("key"), "created_at")
    return nodes.unionByName(both.where(~node).select("id", "side", F.lit("document_metadata").alias("target_table"), number_key(F.col("end")).alias("key"), "created_at"))


def orphan_state(spark: SparkSession, sf: str) -> OrphanState:
    """The state after two advances: rows up to :data:`STEP`, then the later ones and the deletions.  Keys are made once, of columns that both advances read."""
    scratch = Scratch(spark, "keyed")
    numbers = lambda t, *more: table(spark, sf, t).where(~is_blank(F.col("so_hieu"))).select(F.lit("document_metadata").alias("target_table"), number_key(F.col("so_hieu")).alias("key"), *more)
    refs = scratch.save(endpoints(spark, sf), "refs")
    docs = scratch.save(numbers("document_metadata", F.col("created_at").alias("seen_at"), F.lit(1).alias("op")), "docs")
    nodes = table(spark, sf, "document_node").where("id is not null and id <> ''").select(F.lit("document_node").alias("target_table"), F.col("id").alias("key"), F.col("loaded_at").alias("seen_at"), F.lit(1).alias("op"))
    early = lambda c: F.coalesce(F.col(c) < F.lit(STEP).cast("timestamp_ntz"), F.lit(True))
    parents = docs.unionByName(nodes)
    state = OrphanState(spark)
    state.advance(refs.where(early("created_at")), parents.where(early("seen_at")))
    return state.advance(refs.where(~early("created_at")), parents.where(~early("seen_at")), numbers("document_legacy"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_state(spark, sf).orphans()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_state(spark, sf).snapshot()


QUERIES = {"p3_found": p3_found, "p3_paths": p3_paths, "p3_spans": p3_spans, "p3_rooted": p3_rooted, "p3_descendants": p3_descendants, "p4_found": p4_found, "p4_report": p4_report}

_KEY = r"regexp_replace(regexp_replace(replace(lower(nfc_normalize({0})), 'đ', 'd'), '[^\p{{L}}\p{{M}}\p{{N}}]+', '_', 'g'), '^_|_$', '', 'g')"
_WS = r"[^\x{{9}}-\x{{D}}\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]"


def _p4(select: str) -> str:
    key = lambda c: _KEY.format(c)
    ws = _WS.replace("{{", "{").replace("}}", "}")
    return f"""
WITH ends AS (
  SELECT id, 'entity_start' AS side, entity_start AS e, created_at FROM document_relation
  UNION ALL SELECT id, 'entity_end', entity_end, created_at FROM document_relation),
refs AS (
  SELECT id, side, created_at, CASE WHEN contains(e, '.') THEN 'document_node' ELSE 'document_metadata' END AS target_table,
         CASE WHEN contains(e, '.') THEN e ELSE {key('e')} END AS k
  FROM ends WHERE regexp_matches(e, '{ws}')),
par AS (
  SELECT 'document_metadata' AS t, {key('so_hieu')} AS k, min(coalesce(created_at, TIMESTAMP '0001-01-01')) AS seen FROM document_metadata WHERE regexp_matches(so_hieu, '{ws}') GROUP BY ALL
  UNION ALL SELECT 'document_node', id, min(coalesce(loaded_at, TIMESTAMP '0001-01-01')) FROM document_node WHERE id <> '' GROUP BY ALL),
leg AS (SELECT DISTINCT {key('so_hieu')} AS k FROM document_legacy WHERE regexp_matches(so_hieu, '{ws}')),
judged AS (
  SELECT id, side, target_table,
    CASE WHEN p.k IS NOT NULL AND (created_at IS NULL OR seen <= created_at) THEN 'ok' WHEN p.k IS NOT NULL THEN 'late'
         WHEN target_table = 'document_metadata' AND l.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind,
    coalesce(strftime(created_at, '%Y-%m'), 'none') AS period
  FROM refs r LEFT JOIN par p ON p.t = r.target_table AND p.k = r.k LEFT JOIN leg l ON l.k = r.k)
{select}"""


ORACLE = {
    "p3_found": """
WITH RECURSIVE last AS (
  SELECT id, nullif(arg_max(coalesce(parent_id, ''), node_key), '') AS p FROM document_node WHERE id IS NOT NULL GROUP BY id),
up AS (SELECT a.id, b.id AS p FROM last a LEFT JOIN last b ON a.p = b.id),
down(id, root, depth) AS (
  SELECT id, id, 0 FROM up WHERE p IS NULL
  UNION ALL SELECT u.id, d.root, d.depth + 1 FROM up u JOIN down d ON u.p = d.id),
lost AS (SELECT id, p FROM up WHERE id NOT IN (SELECT id FROM down)),
walk(id, pos) AS (SELECT id, p FROM lost UNION SELECT w.id, l.p FROM walk w JOIN lost l ON w.pos = l.id),
ring AS (SELECT w.id, min(v.pos) AS low FROM walk w JOIN walk v ON v.id = w.id WHERE w.id = w.pos GROUP BY w.id)
SELECT id AS node_id, root AS root_id, CAST(depth AS INT) AS depth FROM down
UNION ALL
SELECT DISTINCT l.id, r.low, CASE WHEN EXISTS (SELECT 1 FROM ring x WHERE x.id = l.id) THEN -1 ELSE -2 END
FROM lost l JOIN walk w ON w.id = l.id JOIN ring r ON r.id = w.pos""",
    "p3_rooted": """
WITH RECURSIVE last AS (
  SELECT id, nullif(arg_max(coalesce(parent_id, ''), node_key), '') AS p FROM document_node WHERE id IS NOT NULL GROUP BY id),
up AS (SELECT a.id, b.id AS p FROM last a LEFT JOIN last b ON a.p = b.id),
down(id, root, line) AS (
  SELECT id, id, [id] FROM up WHERE p IS NULL
  UNION ALL SELECT u.id, d.root, list_append(d.line, u.id) FROM up u JOIN down d ON u.p = d.id),
below AS (SELECT id, count(*) - 1 AS n FROM (SELECT unnest(line) AS id FROM down) GROUP BY id)
SELECT d.id AS node_id, d.root AS root_id, CAST(len(d.line) - 1 AS INT) AS depth, md5(array_to_string(d.line, ' > ')) AS path_digest, b.n AS n_descendants FROM down d JOIN below b ON b.id = d.id""",
    "p4_found": _p4("SELECT id, side, target_table, kind, period FROM judged WHERE kind <> 'ok'"),
    "p4_report": _p4("SELECT target_table, period, kind, count(*) AS orphans FROM judged WHERE kind <> 'ok' GROUP BY ALL"),
}
