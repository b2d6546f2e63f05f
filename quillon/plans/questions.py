"""Questions that name documents: which document is meant, which section, and what it relates to.

Each flow takes a table of requests and is one plan for all of them.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import ids, legal
from quillon.functions import text as T
from quillon.functions.keys import number_key
from quillon.operators import search, store, titles

#: Levels of a section that are named by a number, and by a letter or word.
NUMBERED, LETTERED = ("phan", "chuong", "muc", "dieu", "khoan"), ("diem", "tap")
SECTION = (*NUMBERED, *LETTERED)
LEAST_LIKENESS = 0.5
#: How found and missing sections are shown.
FOUND, SOURCES, MISSING, NO_RESULT, NO_PLACE = "### Trích xuất chính xác: ", "**Trích nguồn:**", "### Không tìm thấy: ", "Không có kết quả phù hợp.", "N/A"
CITATION = "struct<so_hieu: string, ten_van_ban: string, phan: int, chuong: string, muc: int, dieu: string, khoan: string, diem: string>"


def section_label(level: str, index: Column) -> Column:
    """The stored label of a section: ``6`` at level ``dieu`` is ``Điều 6``; chapters are stored with lower-case Roman numerals."""
    text = F.trim(index.cast("string"))
    if level == "chuong":
        number = T.to_number(F.lower(text)).try_cast("int")
        text = F.coalesce(T.to_roman(number), F.lower(text))
    return F.when(text != "", F.concat(F.lit(ids.LABELS[level] + " "), text))


def section_filter(conditions: dict[str, object], columns: dict[str, Column] | None = None) -> Column:
    """A predicate over decoded sections: levels by number or letter, other columns as they are; at least one condition."""
    tests = []
    for name, value in conditions.items():
        if value is None or value == "":
            continue
        column = columns[name] if columns else F.col(name)
        tests.append(column == (section_label(name, F.lit(value)) if name in SECTION else F.lit(value.strip() if isinstance(value, str) else value)))
    if not tests:
        raise ValueError("at least one condition is needed")
    return reduce(and_, tests)


def find_documents(requests: DataFrame, request: str, metadata: DataFrame, most: int = 10, least: float = LEAST_LIKENESS) -> DataFrame:
    """``(request, meta_id, so_hieu, score, rank)``: documents that a request means.

    A request has the columns ``so_hieu``, ``ten_van_ban``, ``loai`` and ``linh_vuc``;
    the first that is not empty counts: the number under any spelling; the title by
    likeness to titles and numbers, whichever is greater; the type; a part of the field.
    """
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    asked = requests.select(F.col(request).alias("request"), "so_hieu", "ten_van_ban", "loai", "linh_vuc")
    meta = metadata.select(F.col("meta_id").cast("long").alias("meta_id"), F.col("so_hieu").alias("number"), F.col("ten_van_ban").alias("title"), F.col("loai").alias("kind"), F.col("linh_vuc").alias("field"))
    shown = lambda df, score: df.select("request", "meta_id", F.col("number").alias("so_hieu"), score.alias("score"))
    one = F.lit(1.0)
    by_number = asked.where(given("so_hieu")).join(meta, number_key(F.col("so_hieu")) == number_key(F.col("number")))
    titled = asked.where(~given("so_hieu") & given("ten_van_ban")).select(F.col("request").cast("string").alias("key"), F.col("ten_van_ban").alias("title"))
    like = [titles.alike(titled, meta.where(F.col(c).isNotNull()).select(F.col("meta_id").alias("key"), "number", F.col(c).alias("title")), least, most) for c in ("title", "number")]
    by_title = like[0].unionByName(like[1]).groupBy("asked", "meta_id", F.col("so_hieu")).agg(F.max("ratio").alias("score"))
    by_title = by_title.select(F.col("asked").cast(requests.schema[request].dataType).alias("request"), "meta_id", "so_hieu", "score")
    rest = asked.where(~given("so_hieu") & ~given("ten_van_ban"))
    by_kind = rest.where(given("loai")).join(meta, F.col("loai") == F.col("kind"))
    by_field = rest.where(~given("loai") & given("linh_vuc")).join(meta, F.contains(F.lower("field"), F.lower(F.trim("linh_vuc"))))
    every = reduce(DataFrame.unionByName, (shown(by_number, one), by_title, shown(by_kind, one), shown(by_field, one)))
    best = Window.partitionBy("request").orderBy(F.desc("score"), "meta_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)


def sections_of(requests: DataFrame, request: str, chunks: DataFrame, chunk_id: str, order: str, most: int = 5) -> DataFrame:
    """``(request, chunk_id, rank)``: the first ``most`` chunks of each request's document and levels, without those below another one.

    A request has ``so_hieu`` and any of :data:`SECTION`; what is null does not count, but
    a request without any condition finds nothing.
    """
    levels = [c for c in SECTION if c in requests.columns]
    labels = {c: section_label(c, F.col(c)) for c in levels}
    asked = requests.select(F.col(request).alias("request"), F.nullif(F.col("so_hieu"), F.lit("")).alias("q_so_hieu"), *(labels[c].alias(f"q_{c}") for c in levels))
    d = ids.decode(F.col(chunk_id))
    placed = chunks.where(F.col(chunk_id).isNotNull()).select(F.col(chunk_id).alias("chunk_id"), F.col(order).alias("_order"), d["so_hieu"].alias("c_so_hieu"), *(d[c].alias(f"c_{c}") for c in levels))
    same = reduce(and_, (F.col(f"q_{c}").isNull() | (F.col(f"q_{c}") == F.col(f"c_{c}")) for c in levels), F.lit(True))
    # requests with a document meet its chunks; those with levels alone meet the chunks of their lowest level
    named = asked.where("q_so_hieu is not null").join(placed, (F.col("q_so_hieu") == F.col("c_so_hieu")) & same)
    lowest = lambda side: F.coalesce(*(F.when(F.col(f"q_{c}").isNotNull(), F.concat(F.lit(c + ":"), F.col(f"{side}_{c}"))) for c in reversed(levels)))
    found = named
    if levels:
        open_ = asked.where("q_so_hieu is null").withColumn("q_low", lowest("q")).where("q_low is not null")
        tagged = placed.withColumn("c_low", F.explode(F.array_compact(F.array(*(F.concat(F.lit(c + ":"), F.col(f"c_{c}")) for c in levels)))))
        found = named.unionByName(open_.join(tagged, (F.col("q_low") == F.col("c_low")) & same).drop("q_low", "c_low"))
    first = Window.partitionBy("request").orderBy("_order", "chunk_id")
    ranked = found.select("request", "chunk_id", "_order").distinct().withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)
    return search.drop_descendants(ranked, "request", "chunk_id").select("request", "chunk_id", "rank")


def citations_of(answers: DataFrame, request: str, answer: str) -> DataFrame:
    """The citation that a model read out of each request, as columns; what cannot be read is all null."""
    parsed = legal.per_text(answers.where(F.col(answer).isNotNull()), request, answer, legal.safe_json, "_json", "string")
    return parsed.select(request, F.from_json("_json", CITATION).alias("_c")).select(request, "_c.*")


def legal_query(citations: DataFrame, request: str, metadata: DataFrame, chunks: DataFrame, chunk_id: str = "id", order: str = "node_key", most: int = 5) -> DataFrame:
    """``(request, chunk_id, rank)`` of requests that cite a section; a document that is named by its title only is looked up first."""
    number = F.nullif(F.col("so_hieu"), F.lit(""))
    titled = citations.where(number.isNull() & (F.coalesce("ten_van_ban", F.lit("")) != "")).select(request, F.lit(None).cast("string").alias("so_hieu"), "ten_van_ban", F.lit(None).cast("string").alias("loai"), F.lit(None).cast("string").alias("linh_vuc"))
    known = find_documents(titled, request, metadata, 1).select(F.col("request").alias("_r"), F.col("so_hieu").alias("_n"))
    whole = citations.join(known, F.col(request) == F.col("_r"), "left").withColumn("so_hieu", F.coalesce(number, "_n")).drop("_r", "_n")
    return sections_of(whole, request, chunks, chunk_id, order, most)


def shown_sections(found: DataFrame, requests: DataFrame, request: str, query: str, chunks: DataFrame, chunk_id: str, text: str) -> DataFrame:
    """``(request, context)``: the sections found with what they cite, or that there are none."""
    d = ids.decode(F.col("chunk_id"))
    place = F.concat_ws(", ", d["dieu"], d["khoan"])
    cited = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), d["so_hieu"], F.lit(" - "), F.when(place != "", place).otherwise(NO_PLACE))
    rows = found.join(chunks.select(F.col(chunk_id).alias("_c"), F.col(text).alias("_t")), F.col("chunk_id") == F.col("_c")).select("request", F.struct("rank", F.coalesce("_t", F.lit("")).alias("t"), cited.alias("c")).alias("x"))
    lists = rows.groupBy("request").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a request's few sections
    texts, marks = F.array_join(F.transform("x", lambda s: s["t"]), "\n\n"), F.array_join(F.transform("x", lambda s: s["c"]), "\n")
    body = F.concat(F.lit(FOUND), F.col(query), F.lit("\n\n"), texts, F.lit(f"\n{SOURCES}\n"), marks)
    nothing = F.concat(F.lit(MISSING), F.col(query), F.lit(f"\n\n{NO_RESULT}"))
    joined = requests.select(F.col(request).alias("_r"), F.col(query)).join(lists, F.col("_r") == F.col("request"), "left")
    return joined.select(F.col("_r").alias("request"), F.when(F.col("x").isNotNull(), body).otherwise(nothing).alias("context"))


def document_relations(requests: DataFrame, request: str, metadata: DataFrame, relations: DataFrame, most: int = 5) -> DataFrame:
    """``(request, entity, direction, other, relation_type)``: relations of at most ``most`` documents that each request means."""
    meant = find_documents(requests, request, metadata, most).where("so_hieu <> ''").select("request", "so_hieu").distinct()
    related = store.relations_of(relations, meant.select("so_hieu").distinct(), "so_hieu")
    return meant.join(related, F.col("so_hieu") == F.col("entity")).select("request", "entity", "direction", "other", "relation_type")
