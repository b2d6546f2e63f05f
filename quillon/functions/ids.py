"""Lineage ids: ``<document>.<type>_<index>(.<type>_<index>)*``, with duplicate marks ``__dup_N``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import store

#: Display labels of section types.
LABELS = {"phan": "Phần", "chuong": "Chương", "muc": "Mục", "dieu": "Điều", "khoan": "Khoản", "diem": "Điểm", "tap": "Tập", "phu_luc": "Phụ lục"}
DECODED = ("phan", "chuong", "muc", "dieu", "khoan", "diem", "tap")


def base_chunk_id(chunk_id: Column) -> Column:
    """The id without duplicate marks."""
    return F.regexp_replace(chunk_id, r"__dup_[^.]*", "")


def ancestors(chunk_id: Column) -> Column:
    """All proper prefixes of an id, the document first; none for a document."""
    parts = F.split(chunk_id, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).otherwise(F.array().cast("array<string>"))


def parent_of(chunk_id: Column) -> Column:
    parts = F.split(chunk_id, r"\.")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))


def section_type(chunk_id: Column) -> Column:
    """Type of the last segment; null for a document."""
    last = F.element_at(F.split(base_chunk_id(chunk_id), r"\."), -1)
    return F.when(F.instr(chunk_id, ".") > 0, F.regexp_replace(last, "_[^_]*$", ""))


def _starting(kind: str):
    return lambda segment: segment.rlike(f"^{kind}_")


def decode(chunk_id: Column) -> dict[str, Column]:
    """Named parts of an id: the document and the label of each level; of several segments of one type the last holds.

    A trailing ``__dup_<digits>`` of a segment does not count, segments without ``_`` are
    skipped and the remaining ``_`` of an index are shown as dots.
    """
    segments = F.transform(F.slice(F.split(chunk_id, r"\."), 2, 1000), lambda s: F.regexp_replace(s, "__dup_[0-9]+$", ""))
    out = {"so_hieu": F.regexp_replace(F.element_at(F.split(chunk_id, r"\."), 1), "__dup_[0-9]+$", "")}
    for kind in DECODED:
        own = F.filter(segments, _starting(kind))
        index = F.translate(F.regexp_replace(F.try_element_at(own, F.lit(-1)), f"^{kind}_", ""), "_", ".")
        out[kind] = F.when(F.size(own) > 0, F.concat(F.lit(LABELS[kind] + " "), index))
    return out


def known_types(chunk_id: Column) -> Column:
    """The id as it is; an id with a segment of an unknown type is an error of the job.  Segments without ``_`` do not count."""
    kinds = F.transform(F.filter(F.slice(F.split(chunk_id, r"\."), 2, 1000), lambda s: s.contains("_")), lambda s: F.regexp_replace(F.regexp_replace(s, "__dup_[0-9]+$", ""), "_[^_]*$", ""))
    strange = F.filter(kinds, lambda k: ~k.isin(*LABELS, "phu_luc_phan", "modau"))
    return F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown section type in "), chunk_id))).otherwise(chunk_id)


def reference_ids(stored: Column) -> Column:
    """Ids out of a JSON list of ids or of objects with a ``ref_id``: trimmed, each once, in order; an empty list for anything else."""
    items = F.coalesce(F.from_json(stored, "array<string>"), F.array().cast("array<string>"))
    plain = F.transform(items, lambda x: F.trim(F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.ref_id")).otherwise(x)))
    return F.array_distinct(F.filter(plain, lambda x: F.coalesce(x != "", F.lit(False))))


def dup_suffix(rows: DataFrame, document: str, chunk_id: str, *order: str) -> DataFrame:
    """Ids that occur more than once in a document get ``__dup_N`` in document order, N from 0; adds ``unique_id``."""
    group = Window.partitionBy(document, chunk_id)
    n = F.count(F.lit(1)).over(group)
    at = F.row_number().over(group.orderBy(*order)) - 1
    return rows.withColumn("unique_id", F.when(n > 1, F.concat(F.col(chunk_id), F.lit("__dup_"), at.cast("string"))).otherwise(F.col(chunk_id)))


def number_repeats(rows: DataFrame, key: list[str], chunk_id: str, *order: str) -> DataFrame:
    """The second and later occurrences of an id get ``.1``, ``.2`` ...; adds ``unique_id``."""
    at = F.row_number().over(Window.partitionBy(*key, chunk_id).orderBy(*order)) - 1
    return rows.withColumn("unique_id", F.when(at > 0, F.concat(F.col(chunk_id), F.lit("."), at.cast("string"))).otherwise(F.col(chunk_id)))


def unique_in_document(rows: DataFrame, document: str, chunk_id: str, order: str) -> DataFrame:
    """Ids made unique inside a document in the order of the unique key ``order``: a later one gets the first of ``.1``, ``.2`` ... that is not in use yet; adds ``unique_id``.

    An id can only meet ids of its own family, those with the same text before trailing
    numbers.  Families without such numbers, or without repeats, are numbered by windows;
    only the others are gone through row by row, each by itself.  Null ids stay null.
    """
    family = F.regexp_replace(chunk_id, r"(\.[0-9]+)+$", "")
    marked = rows.withColumn("_family", family).withColumn("_at", F.row_number().over(Window.partitionBy(document, chunk_id).orderBy(order)))
    kin = Window.partitionBy(document, "_family")
    judged = marked.withColumn("_mixed", F.coalesce(F.max(F.col(chunk_id) != F.col("_family")).over(kin) & (F.max("_at").over(kin) > 1), F.lit(False)))
    plain = F.when((F.col("_at") > 1) & F.col(chunk_id).isNotNull(), F.concat(F.col(chunk_id), F.lit("."), (F.col("_at") - 1).cast("string"))).otherwise(F.col(chunk_id))
    slim = judged.where("_mixed").select(F.col(document).alias("d"), F.col("_family").alias("f"), F.col(chunk_id).alias("i"), F.col(order).alias("o"))

    def in_order(table: pa.Table) -> pa.Table:
        used: set[str] = set()
        names = []
        table = table.sort_by("o")
        for own in table["i"].to_pylist():
            name, n = own, 0
            while name in used:
                n += 1
                name = f"{own}.{n}"
            used.add(name)
            names.append(name)
        return pa.table({"_o": table["o"], "_u": pa.array(names, pa.string())})

    named = slim.groupBy("d", "f").applyInArrow(in_order, f"_o {rows.schema[order].dataType.simpleString()}, _u string")
    both = judged.join(named, F.col(order) == F.col("_o"), "left")
    return both.withColumn("unique_id", F.coalesce("_u", plain)).drop("_family", "_at", "_mixed", "_o", "_u")


def batch_numbers(rows: DataFrame, batch: str, chunk_id: str, order: str) -> DataFrame:
    """The second and later occurrences of an id in a batch get ``.batch.K``, K counting such occurrences over the whole batch in the order of the integer key ``order``; adds ``unique_id``."""
    at = F.row_number().over(Window.partitionBy(batch, chunk_id).orderBy(order))
    marked = rows.withColumn("_again", at > 1)
    numbered = store.ordinal(marked.where("_again"), batch, order, "_k").withColumn("unique_id", F.concat(F.col(chunk_id), F.lit(".batch."), F.col("_k").cast("string"))).drop("_k", "_again")
    return marked.where(~F.col("_again")).withColumn("unique_id", F.col(chunk_id)).drop("_again").unionByName(numbered)
