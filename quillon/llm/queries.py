"""Queries of the operators for language models and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.io import table
from quillon.llm import canonical, knn, split
from quillon.llm.bpe import encode_column
from quillon.llm.mixing import Mixture
from quillon.llm.sentences import sentence_column

FIELDS = ["content", "full_text"]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    texts = split.text_fields(table(spark, sf, "document_node"), "node_key", FIELDS)
    pieces = split.split_oversized(texts, ["node_key", "field"], "value", with_text=False, small=False)
    return pieces.where("piece_no = 0").select("node_key", "field", F.when(F.col("text_forced"), "forced").otherwise("free").alias("cut"))


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    texts = split.text_fields(table(spark, sf, "document_node"), "node_key", FIELDS)
    return split.split_oversized(texts, ["node_key", "field"], "value").drop("text_forced")


def p1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Contents cut to at most 512 tokens of a public tokenizer, repeating up to 64."""
    return split.split_oversized(table(spark, sf, "document_node"), ["node_key"], "content", 512, 64, with_text=False, unit="tokens").drop("text_forced")


def p1_limits(spark: SparkSession, sf: str) -> DataFrame:
    """What holds for the pieces of every text: none is too long, they begin and end with the text, leave nothing out and repeat at most the overlap, and put together they are the text."""
    pieces = p1_pieces(spark, sf).withColumn("_last", F.lag("end_pos").over(Window.partitionBy("node_key", "field").orderBy("piece_no")))
    repeated = F.col("_last") - F.col("start_pos")
    fresh = F.substring("piece", F.coalesce(repeated, F.lit(0)).cast("int") + 1, F.lit(1 << 30))
    good = (F.char_length("piece") == F.col("end_pos") - F.col("start_pos")) & F.when(F.col("_last").isNull(), F.col("start_pos") == 0).otherwise(repeated.between(0, 200))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", fresh.alias("t")))), lambda x: x["t"]), "")  # one text's pieces
    return pieces.groupBy("node_key", "field").agg(F.max(F.col("end_pos") - F.col("start_pos")).alias("longest"), F.bool_and(good).alias("joined"), F.md5(text).alias("digest")).select("node_key", "field", (F.col("longest") <= 1200).alias("within"), "joined", "digest")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = knn.similar_pairs(table(spark, sf, "embedding_result"), "vec_id", "vector", k=5, least=0.9)
    return pairs.select(F.col("a").alias("vec_a"), F.col("b").alias("vec_b"))


def p2_search(spark: SparkSession, sf: str) -> DataFrame:
    """The five most similar rows, however similar, of each row whose id is divisible by 20."""
    found = knn.nearest(table(spark, sf, "embedding_result"), "vec_id", "vector", k=5, margin=None, max_probes=8, every_query=20)
    return found.select(F.col("a").alias("vec_id"), F.col("b").alias("neighbour"), "similarity", "rank")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    titles = canonical.alike_pairs(table(spark, sf, "document_metadata"), "meta_id", "ten_van_ban")
    contents = canonical.alike_pairs(table(spark, sf, "document_node"), "node_key", "content")
    name = lambda t: F.lit(t).alias("tbl")
    return titles.select(name("document_metadata"), "key_a", "key_b").unionByName(contents.select(name("document_node"), "key_a", "key_b"))


def p5_titles(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_column(table(spark, sf, "document_metadata"), "meta_id", "ten_van_ban")


def p5_contents(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.canonical_column(table(spark, sf, "document_node"), "node_key", "content")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_column(table(spark, sf, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    return Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target")).rows()


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target")).shares()


def p7_margins(spark: SparkSession, sf: str) -> DataFrame:
    return Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target")).margins()


def p7_met(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each source with any text comes to its weight among such sources, to half a hundredth or the size of one row, within its repeats."""
    mixture = Mixture(table(spark, sf, "documents"), table(spark, sf, "mix_target"))
    largest = mixture.sized.groupBy(F.col("source").alias("s")).agg(F.max("n_tokens").alias("largest"))
    rows = mixture.shares().join(largest, F.col("source") == F.col("s"), "left")
    live = F.col("largest").isNotNull()
    every = rows.agg(F.sum(F.when(live, F.col("weight"))).alias("live_weight"), F.sum("tokens").alias("all_tokens"))
    judged = rows.crossJoin(F.broadcast(every))  # one row
    room = F.greatest(F.lit(0.005), F.try_divide(F.col("largest").cast("double"), F.col("all_tokens")))
    met = F.when(live, F.abs(F.col("share") - F.col("weight") / F.col("live_weight")) <= room).otherwise(F.col("share") == 0)
    return judged.select("source", live.alias("live"), met.alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_column(table(spark, sf, "documents"), "doc_id", "text", "lang")


QUERIES = {"p8_found": p8_found, "p1_found": p1_found, "p1_pieces": p1_pieces, "p1_tokens": p1_tokens, "p1_limits": p1_limits, "p2_found": p2_found, "p2_search": p2_search, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_margins": p7_margins, "p7_met": p7_met, "p5_found": p5_found, "p5_titles": p5_titles, "p5_contents": p5_contents, "p6_ids": p6_ids}

# The twin of problem 5 goes its own way: text by text into characters, each looked up in a short list or moved by its block, and put together again.
_FOLD = (
    "CASE WHEN ord(c) BETWEEN 65281 AND 65374 THEN chr(ord(c) - 65248) WHEN ord(c) BETWEEN 8544 AND 8555 THEN list_extract(['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'], ord(c) - 8543) "
    "WHEN ord(c) BETWEEN 8560 AND 8571 THEN list_extract(['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii'], ord(c) - 8559) "
    "WHEN c IN ('\u2010', '\u2011') THEN '-' WHEN c = '\u2026' THEN '...' WHEN c IN ('Ð', 'Ɖ') THEN 'Đ' "
    "WHEN ord(c) IN (173, 847, 8288, 65279) OR ord(c) BETWEEN 8203 AND 8207 OR ord(c) BETWEEN 8234 AND 8238 THEN '' "
    "WHEN ord(c) IN (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8232, 8233, 8239, 8287, 12288) OR ord(c) BETWEEN 8192 AND 8202 THEN ' ' "
    + " ".join(f"WHEN c = '{x}' THEN '{y}'" for x, y in [("А", "A"), ("В", "B"), ("Е", "E"), ("К", "K"), ("М", "M"), ("Н", "H"), ("О", "O"), ("Р", "P"), ("С", "C"), ("Т", "T"), ("У", "Y"), ("Х", "X"), ("Ѕ", "S"), ("І", "I"), ("Ј", "J"), ("а", "a"), ("е", "e"), ("о", "o"), ("р", "p"), ("с", "c"), ("у", "y"), ("х", "x"), ("ѕ", "s"), ("і", "i"), ("ј", "j"), ("һ", "h"), ("ԁ", "d"), ("Α", "A"), ("Β", "B"), ("Ε", "E"), ("Ζ", "Z"), ("Η", "H"), ("Ι", "I"), ("Κ", "K"), ("Μ", "M"), ("Ν", "N"), ("Ο", "O"), ("Ρ", "P"), ("Τ", "T"), ("Υ", "Y"), ("Χ", "X"), ("ο", "o"), ("ν", "v"), ("α", "a"), ("ρ", "p"), ("ι", "i"), ("ɡ", "g"), ("ɑ", "a")])
    + " ELSE c END"
)


def _shown(t: str, k: str, c: str) -> str:
    """``(k, s, f)`` of a table: key, text as stored, and as it prints; texts that are composed Latin letters and single blanks alone are taken as they are."""
    odd = f"FROM {t} WHERE {c} IS NOT NULL AND NOT (regexp_full_match({c}, '[ -~À-ưẠ-ỹ]*') AND NOT contains({c}, '  ') AND nfc_normalize({c}) = {c} AND NOT regexp_matches({c}, '[ÐƉ]'))"
    return (
        f"SELECT k, s, trim(regexp_replace(nfc_normalize(list_aggregate(list_transform(regexp_extract_all(s, '(?s).'), lambda c: {_FOLD}), 'string_agg', '')), ' +', ' ', 'g')) AS f FROM (SELECT {k} AS k, {c} AS s {odd})"
        f" UNION ALL SELECT {k}, {c}, trim({c}) FROM {t} WHERE {c} IS NULL OR {k} NOT IN (SELECT {k} {odd})"
    )


_P5 = "SELECT '{t}' AS tbl, a.k AS key_a, b.k AS key_b FROM ({q}) a JOIN ({q}) b ON a.f = b.f AND a.k < b.k AND a.s <> b.s WHERE a.f <> ''"
ORACLE = {
    "p1_found": r"""
SELECT node_key, field, CASE WHEN list_max(list_transform(regexp_split_to_array(v, '[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'), lambda x: length(x))) > 1200 THEN 'forced' ELSE 'free' END AS cut
FROM (SELECT node_key, 'content' AS field, content AS v FROM document_node UNION ALL SELECT node_key, 'full_text', full_text FROM document_node) WHERE length(v) > 1200""",
    "p5_found": " UNION ALL ".join(_P5.format(t=t, q=_shown(t, k, c)) for t, k, c in (("document_metadata", "meta_id", "ten_van_ban"), ("document_node", "node_key", "content"))),
    "p5_titles": f"SELECT k AS meta_id, f AS canonical FROM ({_shown('document_metadata', 'meta_id', 'ten_van_ban')})",
    "p5_contents": f"SELECT k AS node_key, f AS canonical FROM ({_shown('document_node', 'node_key', 'content')})",
    "p1_limits": "SELECT node_key, field, TRUE AS within, TRUE AS joined, md5(v) AS digest FROM (SELECT node_key, 'content' AS field, content AS v FROM document_node UNION ALL SELECT node_key, 'full_text', full_text FROM document_node) WHERE v <> ''",
    "p7_met": "SELECT source, EXISTS (SELECT 1 FROM documents d WHERE d.source = t.source AND d.text <> '') AS live, TRUE AS met, TRUE AS capped FROM mix_target t",
    "p2_found": """
WITH w AS (SELECT vec_id AS k, vector::DOUBLE[] AS v FROM embedding_result WHERE len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT k, list_transform(v, lambda x: x / n)::DOUBLE[64] AS v FROM (SELECT k, v, sqrt(list_inner_product(v, v)) AS n FROM w) WHERE n > 0),
p AS (SELECT a.k AS a, b.k AS b, array_inner_product(a.v, b.v) AS s FROM u a JOIN u b ON a.k <> b.k WHERE array_inner_product(a.v, b.v) >= 0.9)
SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p) WHERE n <= 5""",
}
