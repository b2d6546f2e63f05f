"""Vector search, reranking and result filters as plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from quillon.functions.ids import ancestors, base_chunk_id
from quillon.functions.vectors import METRICS

#: Section types that hold text of their own; the default filter of a search.
LEAF_TYPES = ("dieu", "khoan", "diem", "phu_luc_phan")
MOST_RESULTS = 100
#: Rows and queries that meet in one tile.
ROW_BLOCK, QUERY_BLOCK = 4096, 1024


def metadata_filter(conditions: dict[str, object], columns: dict[str, Column] | None = None) -> Column | None:
    """Conjunction of conditions: a list means membership, a scalar equality; nothing means no filter."""
    folded: Column | None = None
    for name, value in conditions.items():
        if value is None:
            continue
        column = columns[name] if columns else F.col(name)
        test = column.isin(*value) if isinstance(value, (list, tuple, set)) else column == F.lit(value)
        folded = test if folded is None else folded & test
    return folded


def top_k(rows: DataFrame, vector: str, query: list[float] | Column, k: int, key: str, metric: str = "cosine", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """Filter, then the ``k`` rows of least distance (ties to the smaller key), then the inclusive threshold; adds ``distance``."""
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k must be between 1 and {MOST_RESULTS}")
    q = query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query))
    kept = rows if where is None else rows.where(where)
    ranked = kept.withColumn("distance", METRICS[metric](F.col(vector), q)).where("distance is not null").orderBy("distance", key).limit(k)
    return ranked if threshold is None else ranked.where(F.col("distance") <= threshold)


def top_k_of_row(rows: DataFrame, key: str, vector: str, query_key: object, k: int, metric: str = "cosine", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """As :func:`top_k` with the vector of the row ``query_key``; that one row is joined to all."""
    q = rows.where(F.col(key) == F.lit(query_key)).select(F.col(vector).alias("_q")).limit(1)
    other = rows if where is None else rows.where(where)
    scored = other.crossJoin(F.broadcast(q)).withColumn("distance", METRICS[metric](F.col(vector), F.col("_q"))).drop("_q")  # one row
    ranked = scored.where("distance is not null").orderBy("distance", key).limit(k)
    return ranked if threshold is None else ranked.where(F.col("distance") <= threshold)


def _blocks(df: DataFrame, columns: list[str], size: int, prefix: str) -> DataFrame:
    """Rows packed into blocks of at most ``size``, each column as an array."""
    schema = StructType([StructField(f"{prefix}_{c}", ArrayType(df.schema[c].dataType)) for c in columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.concat_arrays([c])) for c in part.columns]
                yield pa.RecordBatch.from_arrays(lists, names=schema.names)

    return df.select(*columns).mapInArrow(pack, schema)


def _matrix(column: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of usable vectors, and all of them, unusable ones empty."""
    vectors = [np.array(v, dtype=np.float64) if v is not None and None not in v else np.empty(0) for v in column]
    return np.flatnonzero([len(v) > 0 for v in vectors]), vectors


def _distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    dots = q @ x.T
    if metric == "ip":
        return 1 - dots
    if metric == "l2":
        return np.maximum((q**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * dots, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / (np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1)))


def top_k_of_queries(rows: DataFrame, key: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, metric: str = "cosine", unlike: tuple[str, str] | None = None) -> DataFrame:
    """``(query, key, distance, rank)``: the ``k`` nearest rows of each query, ties to the smaller key.

    Rows and queries are packed into blocks, every block of rows meets every block of
    queries once, as a tile of one matrix product, and a tile keeps ``k`` rows a query.
    So any number of queries is one pass.  With ``unlike``, a column of the rows and one
    of the queries must differ (null equals null).  Rows and queries without a key take no part.  Vectors that are null, empty, hold a null or have
    another length than the query's, and cosines with a zero vector, give no pair.
    """
    own, theirs = ([unlike[0]], [unlike[1]]) if unlike else ([], [])
    r = _blocks(rows.where(F.col(key).isNotNull()), [key, vector, *own], ROW_BLOCK, "r")
    q = _blocks(queries.where(F.col(query).isNotNull()), [query, query_vector, *theirs], QUERY_BLOCK, "q")
    schema = StructType([StructField("query", queries.schema[query].dataType), StructField("key", rows.schema[key].dataType), StructField("distance", DoubleType())])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                get = {n: b.column(n)[i].values for n in b.schema.names}
                row_keys, query_keys = get[f"r_{key}"], get[f"q_{query}"]
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                x_at, xs = _matrix(get[f"r_{vector}"].to_pylist())
                q_at, qs = _matrix(get[f"q_{query_vector}"].to_pylist())
                order = np.argsort(np.argsort(np.array(row_keys.to_pylist(), dtype=object), kind="stable")) if len(row_keys) else np.empty(0, int)
                for dim in {len(qs[a]) for a in q_at}:
                    qi = np.array([a for a in q_at if len(qs[a]) == dim])
                    xi = np.array([a for a in x_at if len(xs[a]) == dim], dtype=int)
                    if not len(xi):
                        continue
                    d = _distances(metric, np.stack([qs[a] for a in qi]), np.stack([xs[a] for a in xi]))
                    d[~np.isfinite(d)] = np.inf
                    if unlike:
                        mine, other = (np.array(get[n].to_pylist(), dtype=object) for n in (f"r_{own[0]}", f"q_{theirs[0]}"))
                        d[other[qi][:, None] == mine[xi][None, :]] = np.inf
                    keep = min(k, len(xi))
                    border = np.partition(d, keep - 1, axis=1)[:, keep - 1]
                    a, c = np.nonzero((d <= border[:, None]) & np.isfinite(d))
                    ranked = np.lexsort((order[xi[c]], d[a, c], a))
                    a, c = a[ranked], c[ranked]
                    first = np.searchsorted(a, a)
                    best = np.arange(len(a)) - first < k
                    found.append((qi[a[best]], xi[c[best]], d[a[best], c[best]]))
                if found:
                    qi, xi, d = (np.concatenate(p) for p in zip(*found))
                    yield pa.RecordBatch.from_arrays([query_keys.take(pa.array(qi)), row_keys.take(pa.array(xi)), pa.array(d)], names=["query", "key", "distance"])

    pairs = r.crossJoin(q).mapInArrow(tile, schema)  # blocks, not rows
    nearest = Window.partitionBy("query").orderBy("distance", "key")
    return pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def rerank(rows: DataFrame, group: list[str], score: Column, k: int, tie: str) -> DataFrame:
    """The ``k`` best rows of each group by ``score``; adds ``score_rerank`` and ``rank``."""
    scored = rows.withColumn("score_rerank", score)
    best = Window.partitionBy(*group).orderBy(F.desc("score_rerank"), tie) if group else Window.orderBy(F.desc("score_rerank"), tie)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= max(1, k))


def two_stage(found: DataFrame, group: list[str], text: str, score: Column | None, k: int, tie: str) -> DataFrame:
    """The ``k`` best of what a first stage found, by a second stage's score.  Without a score, or without the text that it judges, there is no second stage: an error."""
    if score is None:
        raise ValueError("a second stage needs a reranker")
    if text not in found.columns:
        raise ValueError(f"a second stage needs the column {text}")
    return rerank(found.where(F.col(text).isNotNull()), group, score, k, tie)


def drop_descendants(rows: DataFrame, group: str, chunk_id: str) -> DataFrame:
    """Drop a row if a proper ancestor of its id is in the same result list; duplicate marks do not count and equal ids do not drop each other.

    Ancestors are exploded and met by an anti join on (group, id), so that a list of any
    size is spread over tasks.
    """
    numbered = rows.withColumn("_base", base_chunk_id(F.col(chunk_id)))
    present = numbered.select(F.col(group).alias("p_group"), F.col("_base").alias("p_base")).distinct()
    inner = numbered.select(group, "_base").distinct().select(group, "_base", F.explode(ancestors(F.col("_base"))).alias("_up"))
    covered = inner.join(present, (F.col(group) == F.col("p_group")) & (F.col("_up") == F.col("p_base")), "left_semi").select(F.col(group).alias("c_group"), F.col("_base").alias("c_base")).distinct()
    return numbered.join(covered, (F.col(group) == F.col("c_group")) & (F.col("_base") == F.col("c_base")), "left_anti").drop("_base")


def outside_family(main: Column, ref: Column) -> Column:
    """True unless ``ref`` is ``main`` or one of its ancestors or descendants."""
    return ~((main == ref) | main.startswith(F.concat(ref, F.lit("."))) | ref.startswith(F.concat(main, F.lit("."))))


def best_references(scored: DataFrame, main: str, ref: str, score: str, least: float = 6.0, most: int = 3) -> DataFrame:
    """Of each main row the ``most`` references with a score of at least ``least``, best first; adds ``rank``."""
    order = Window.partitionBy(main).orderBy(F.desc(score), ref)
    return scored.where(F.col(score) >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, the first in the given order."""
    at = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def lookup_in_order(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the given ids in the order of the request, missing ones left out; adds ``pos``."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(ids)), f"pos int, _id {dict(rows.dtypes)[key]}")
    return rows.join(wanted, F.col(key) == F.col("_id")).drop("_id").orderBy("pos")
