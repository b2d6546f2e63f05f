"""Document and relation stores as table-to-table operators.

A store is a table; an operator takes its present state and the change and returns the
next state, so a write is one plan that the caller saves where it likes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the last in the given order."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def upsert(base: DataFrame, delta: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``delta`` replace those of the same key, new ones are added; columns in ``keep`` stay as they are in ``base`` where it has the row."""
    b, d = base.alias("b"), delta.alias("d")
    both = b.join(d, F.col(f"b.{key}") == F.col(f"d.{key}"), "full")
    fresh = F.col(f"d.{key}").isNotNull()
    out = []
    for c in base.columns:
        old, new = F.col(f"b.{c}"), F.col(f"d.{c}")
        held = F.col(f"b.{key}").isNotNull()
        out.append((F.when(held, old).otherwise(new) if c in keep else F.when(fresh, new).otherwise(old)).alias(c))
    return both.select(*out)


def append(base: DataFrame, delta: DataFrame, key: str | None = None) -> DataFrame:
    """``base`` and the rows of ``delta``: its columns must be among those of ``base``, missing ones become null.  With ``key``, rows without a key, or with one that is there already, are left out, and of several with one key one is kept."""
    strange = [c for c in delta.columns if c not in base.columns]
    if strange:
        raise ValueError(f"columns that the store does not have: {', '.join(strange)}")
    rows = delta.select(*(F.col(c).cast(base.schema[c].dataType).alias(c) if c in delta.columns else F.lit(None).cast(base.schema[c].dataType).alias(c) for c in base.columns))
    if key is None:
        return base.unionByName(rows)
    fresh = rows.where(F.col(key).isNotNull()).dropDuplicates([key])
    return base.unionByName(fresh.join(base.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_anti"))


def keep_last(base: DataFrame, delta: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of both with one row a key: the last in ``order``, those of ``delta`` after those of ``base``; rows without a key go.  This is how vectors are delivered again."""
    both = base.withColumn("_new", F.lit(0)).unionByName(delta.withColumn("_new", F.lit(1)), allowMissingColumns=True).where(F.col(key).isNotNull())
    return latest(both, [key], F.desc("_new"), *(F.desc(c) for c in order)).drop("_new")


def removed_count(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows :func:`remove` takes out."""
    marks = gone.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    same = reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_k_{k}") for k in keys))
    return base.join(marks, same, "left_semi").agg(F.count(F.lit(1)).alias("removed"))


def deactivate(rows: DataFrame, key: str, gone: DataFrame, gone_key: str, flag: str) -> DataFrame:
    """``flag`` becomes 0 where the key is among ``gone``; one plan serves documents and chunks alike."""
    marks = gone.select(F.col(gone_key).alias("_gone")).distinct()
    return rows.join(marks, F.col(key) == F.col("_gone"), "left").withColumn(flag, F.when(F.col("_gone").isNotNull(), F.lit(0)).otherwise(F.col(flag))).drop("_gone")


def backfill(rows: DataFrame, column: str, value: object) -> DataFrame:
    """The column with a default where it is null; added where it is absent."""
    return rows.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in rows.columns else F.lit(value))


def add_missing(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``delta`` without repeats and without rows whose keys (null equal to null) are in ``base``, appended to it."""
    fresh = delta.dropDuplicates(keys)
    known = base.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys))
    return base.unionByName(fresh.join(known, same, "left_anti"))


def remove(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` without the rows whose keys are in ``gone``."""
    marks = gone.select(*(F.col(k).alias(f"_k_{k}") for k in keys)).distinct()
    same = reduce(lambda x, y: x & y, (F.col(k) == F.col(f"_k_{k}") for k in keys))
    return base.join(marks, same, "left_anti")


def relations_of(relations: DataFrame, entities: DataFrame, entity: str) -> DataFrame:
    """Relations of each entity, by the side on which it stands: ``(entity, direction, other, relation_type)``."""
    e = entities.select(F.col(entity).alias("entity"))
    side = lambda own, other, name: e.join(relations, F.col("entity") == F.col(own)).select("entity", F.lit(name).alias("direction"), F.col(other).alias("other"), "relation_type")
    return side("entity_start", "entity_end", "out").unionByName(side("entity_end", "entity_start", "in"))


def ordinal(rows: DataFrame, group: str, key: str, name: str, block_bits: int = 16) -> DataFrame:
    """1-based place of a row in its group by an integer key, for groups of any size: places inside blocks of neighbouring keys plus the counts of the blocks before."""
    cut = F.shiftright(F.col(key), block_bits)
    marked = rows.withColumn("_block", cut)
    sizes = marked.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), before.alias("_before"))
    inner = marked.withColumn("_in", F.row_number().over(Window.partitionBy(group, "_block").orderBy(key)))
    joined = inner.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(name, F.col("_in") + F.col("_before")).drop("_block", "_g", "_b", "_before", "_in")


#: What stands for an unknown title and type.
UNKNOWN, SOME_TYPE = "Chưa xác định", "Văn bản"
DESCRIBED = ("ten_van_ban", "loai", "co_quan_ban_hanh", "ngay_ban_hanh", "ngay_co_hieu_luc", "file_path")


def collapse(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One described document a key, out of many rows in ``order``.

    The first row describes it; a later row takes over if it names the title where that is
    unknown, or the agency where there is none, and keeps what it leaves empty.  Only the
    first row, the first with a title and the first with an agency can do so, so a key of
    any number of rows is three rows of an aggregate.  The unknown title counts as empty.
    """
    clean = lambda c: F.coalesce(F.nullif(F.nullif(F.col(c), F.lit("")), F.lit(UNKNOWN)), F.lit("")).alias(c)
    named = rows.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, F.struct(F.col(order).alias("at"), *(clean(c) for c in DESCRIBED)).alias("r"))
    first = lambda test: F.min(F.when(test, F.col("r")))  # noqa: E731  the order comes first in the row
    three = named.groupBy(key).agg(F.array_sort(F.array_distinct(F.array_compact(F.array(F.min("r"), first(F.col("r.ten_van_ban") != ""), first(F.col("r.co_quan_ban_hanh") != ""))))).alias("x"), F.count(F.lit(1)).alias("rows"))

    def over(old: Column, new: Column) -> Column:
        better = ((old["ten_van_ban"] == "") & (new["ten_van_ban"] != "")) | ((old["co_quan_ban_hanh"] == "") & (new["co_quan_ban_hanh"] != ""))
        filled = F.struct(new["at"].alias("at"), *(F.coalesce(F.nullif(new[c], F.lit("")), old[c]).alias(c) for c in DESCRIBED))
        return F.when(better, filled).otherwise(old)

    best = three.select(key, "rows", F.aggregate(F.slice("x", 2, 2), F.element_at("x", 1), over).alias("r"))
    instead = {"ten_van_ban": UNKNOWN, "loai": SOME_TYPE}
    return best.select(key, "rows", *(F.coalesce(F.nullif(F.col(f"r.{c}"), F.lit("")), F.lit(instead.get(c, ""))).alias(c) for c in DESCRIBED))
