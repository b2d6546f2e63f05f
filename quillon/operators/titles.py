"""Likeness of every title of one table to every title of another, without loss.

All pairs are compared.  The likeness is ``2 * M / (len(a) + len(b))`` of the normalized
names, ``M`` being the characters in matching blocks.  These blocks are a common
subsequence, so the length of the longest one, found for many titles at once by bit
vectors, bounds ``M``: only pairs whose bound reaches the least likeness asked for are
scored.  Where all pairs are asked for this is done inside the JVM, for distinct names
(:mod:`quillon.functions.blocks`; :mod:`quillon.functions.matching` for remote sessions,
which have none).  Where the ``most`` best of each title are asked for they are scored one
by one, best bounds first until no bound is left that reaches the last of them.  Nothing
else drops a pair.

Defined results: titles that are null, or empty after normalization, take no part.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import is_remote

from quillon.functions import blocks as jvm_blocks
from quillon.functions import matching
from quillon.functions.legal import normalize_name

#: Titles that meet in one task at a time.
ASKED_BLOCK, TITLE_BLOCK, CHUNK = 64, 16384, 16384
#: Tasks for all pairs, where blocks of asked titles are fewer.
MOST_TASKS = 512
#: Rows of a name that are kept in one list, and rows for each distinct name of a block on the average, at most.
ROWS, COPIES = 1024, 8
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def encode(names: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The characters of ``names``, sorted, and chunks ``(places, lengths, codes)`` of falling length; ``codes`` has a row for each position."""
    points = [np.frombuffer(n.encode("utf-32-le"), dtype=np.uint32) for n in names]
    alphabet = np.unique(np.concatenate(points)) if points else np.empty(0, np.uint32)
    lengths = np.array([len(p) for p in points], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    chunks = []
    for s in range(0, len(order), CHUNK):
        places = order[s : s + CHUNK]
        codes = np.zeros((lengths[places[0]], len(places)), dtype=np.int32)
        for column, p in enumerate(places):
            codes[: lengths[p], column] = np.searchsorted(alphabet, points[p])
        chunks.append((places, lengths[places], codes))
    return alphabet, chunks


def common(name: str, alphabet: np.ndarray, chunks: list) -> np.ndarray:
    """Length of the longest common subsequence of ``name`` and each encoded name."""
    points = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)
    words = (len(points) + 63) // 64
    masks = np.zeros((words, len(alphabet)), dtype=np.uint64)
    at = np.searchsorted(alphabet, points)
    for i, (p, c) in enumerate(zip(points, at)):
        if c < len(alphabet) and alphabet[c] == p:
            masks[i // 64, c] |= np.uint64(1 << (i % 64))
    out = np.zeros(sum(len(c[0]) for c in chunks), dtype=np.int64)
    for places, lengths, codes in chunks:
        v = np.full((words, len(places)), _ONES)
        for t in range(len(codes)):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # names longer than t
            c, carry = codes[t, :n], None
            for w in range(words):
                own = v[w, :n]
                u = own & masks[w][c]
                total = own + u
                over = total < u
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                v[w, :n] = total | (own ^ u)
        out[places] = sum(np.bitwise_count(~v[w]).astype(np.int64) for w in range(words))
    return out


def _ratios(a: str, names: list[str], places: list[int]) -> list[float]:
    matcher = difflib.SequenceMatcher(None, a)
    out = []
    for p in places:
        matcher.set_seq2(names[p])
        out.append(round(matcher.ratio(), 6))
    return out


def alike_in(name: str, names: list[str], alphabet: np.ndarray, chunks: list, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``names``, encoded in ``chunks``, with a likeness to ``name`` of at least ``least``, and the likenesses."""
    points = np.frombuffer(name.encode("utf-32-le"), dtype=np.uint32)
    codes = np.searchsorted(alphabet, points)
    codes[alphabet[np.minimum(codes, len(alphabet) - 1)] != points] = len(alphabet)  # no title has it
    length = common(name, alphabet, chunks)
    found, likenesses = [], []
    for places, lengths, columns in chunks:
        total = lengths + len(name)
        near = 2.0 * length[places] / total + 1e-6 >= least  # likenesses are rounded
        alone = near & ((lengths >= matching.FREQUENT) | (len(name) > matching.LONGEST))
        found.append(places[alone])
        likenesses.append(np.array(_ratios(name, names, places[alone].tolist()), dtype=float))
        at = np.flatnonzero(near & ~alone)
        need = np.ceil((least - 1e-6) * total[at] / 2 - 1e-9)
        m = matching.matched(codes, columns[:, at].T, lengths[at], need)
        reached = m >= need
        found.append(places[at[reached]])
        likenesses.append(np.array([round(x, 6) for x in (2.0 * m[reached] / total[at[reached]]).tolist()], dtype=float))
    place, ratio = np.concatenate(found), np.concatenate(likenesses)
    return place[ratio >= least], ratio[ratio >= least]


def _best_in(name: str, names: list[str], lengths: np.ndarray, alphabet: np.ndarray, chunks: list, least: float, most: int, top: list[float]) -> tuple[list[int], list[float]]:
    """As :func:`alike_in`, without those that are certainly not among the ``most`` best; ``top`` has the best likenesses so far."""
    bound = 2.0 * common(name, alphabet, chunks) / (lengths + len(name)) + 1e-6  # likenesses are rounded
    near = np.flatnonzero(bound >= least)
    near = near[np.argsort(-bound[near], kind="stable")]
    places, ratios = [], []
    for p in near.tolist():
        if len(top) == most and bound[p] < top[-1]:
            break
        ratio = _ratios(name, names, [p])[0]
        if ratio >= least:
            places.append(p)
            ratios.append(ratio)
            top.append(ratio)
            top.sort(reverse=True)
            del top[most:]
    return places, ratios


def _score(least: float, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[float]] = {}  # of the asked titles of this task: their best likenesses so far
        for b in batches:
            for asked, titles in zip(b.column("asked").to_pylist(), b.column("titles").to_pylist()):
                names = [x["name"] for x in titles]
                alphabet, chunks = encode(names)
                lengths = np.array([len(n) for n in names])
                for one in asked:
                    if most:
                        places, ratios = _best_in(one["name"], names, lengths, alphabet, chunks, least, most, best.setdefault((one["key"], one["name"]), []))
                    else:
                        places, ratios = alike_in(one["name"], names, alphabet, chunks, least)
                    columns = [
                        pa.array([one["key"]] * len(places), pa.string()),
                        pa.array([titles[p]["key"] for p in places], pa.int64()),
                        pa.array([titles[p]["number"] for p in places], pa.string()),
                        pa.array(ratios, pa.float64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["asked", "meta_id", "so_hieu", "ratio"])

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = pa.array([normalize_name(t) for t in b.column("title").to_pylist()], pa.string())
        yield b.set_column(b.schema.get_field_index("title"), "name", names)


def _packed(df: DataFrame, size: int, block: str, rows: str) -> tuple[DataFrame, int]:
    blocks = max(1, -(-df.count() // size))
    schema = ", ".join(f"{'name' if c == 'title' else c} {kind}" for c, kind in df.dtypes)
    df = df.mapInArrow(_named, schema).where("name <> ''")  # each title is normalized once, not for every block that it meets
    row = F.struct(*df.columns)
    return df.groupBy(F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).alias(block)).agg(F.collect_list(row).alias(rows)), blocks


def _grouped(df: DataFrame, size: int, block: str, names: str) -> tuple[DataFrame, int]:
    """Blocks of some ``size`` distinct names, sorted, each with its rows."""
    own = [c for c in df.columns if c != "title"]
    schema = ", ".join(f"{'name' if c == 'title' else c} {kind}" for c, kind in df.dtypes)
    df = df.mapInArrow(_named, schema).where("name <> ''")
    rows, distinct = df.agg(F.count("*"), F.count_distinct("name")).first()
    blocks = max(1, -(-distinct // size), -(-rows // (size * COPIES)))
    salt = F.pmod(F.xxhash64(*own), F.lit(max(1, rows >> 20)))  # of a name with very many rows no list has all
    lists = df.groupBy("name", salt.alias("salt")).agg(F.collect_list(F.struct(*own)).alias("rows"))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("rows") - 1) / ROWS).cast("int")), lambda i: F.slice("rows", i * ROWS + 1, ROWS))
    lists = lists.select("name", "salt", F.posexplode(parts).alias("part", "rows"))
    return lists.groupBy(F.pmod(F.xxhash64("name", "salt", "part"), F.lit(blocks)).alias(block)).agg(F.sort_array(F.collect_list(F.struct("name", "rows"))).alias(names)), blocks


def _all_alike(asked: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    a, blocks = _grouped(asked, ASKED_BLOCK, "block", "asked")
    t, t_blocks = _grouped(titles, TITLE_BLOCK, "t_block", "titles")
    tasks = max(blocks, min(blocks * t_blocks, MOST_TASKS))
    met = a.crossJoin(t).repartitionById(tasks, F.pmod(F.col("block") * t_blocks + F.col("t_block"), F.lit(tasks)).cast("int"))
    packed = jvm_blocks.alike_of(asked.sparkSession, least)(F.col("asked.name"), F.col("titles.name"))
    at = lambda shift: F.shiftright("x", shift).bitwiseAND(F.lit(jvm_blocks.LAST)).cast("int")
    pairs = met.select("asked", "titles", F.explode(packed).alias("x"))
    pairs = pairs.select(F.col("asked")[at(jvm_blocks.ASKED)]["rows"].alias("of"), F.col("titles")[at(jvm_blocks.TITLE)]["rows"].alias("by"), (at(0) / F.lit(1e6)).alias("ratio"))
    return pairs.select(F.inline("of").alias("asked"), "by", "ratio").select("asked", F.inline("by").alias("meta_id", "so_hieu"), "ratio")


def alike(asked: DataFrame, titles: DataFrame, least: float, most: int | None = None) -> DataFrame:
    """``(asked, meta_id, so_hieu, ratio)`` of pairs of ``asked (key, title)`` and ``titles (key, number, title)`` with a likeness of at least ``least``.

    With ``most`` pairs may be missing that are certainly not among the ``most`` best of
    their asked title (later pairs of equal likeness are kept); else all pairs are given.
    """
    asked, titles = asked.where("title is not null"), titles.where("title is not null")
    if not most and not is_remote():
        return _all_alike(asked, titles, least)
    a, blocks = _packed(asked, ASKED_BLOCK, "block", "asked")
    t, t_blocks = _packed(titles, TITLE_BLOCK, "t_block", "titles")
    met = a.crossJoin(t)
    if most:  # the best of an asked title so far are known in one task
        met = met.repartition(blocks, "block")
    else:
        tasks = max(blocks, min(blocks * t_blocks, MOST_TASKS))
        met = met.repartitionById(tasks, F.pmod(F.col("block") * t_blocks + F.col("t_block"), F.lit(tasks)).cast("int"))
    return met.select("asked", "titles").mapInArrow(_score(least, most), "asked string, meta_id long, so_hieu string, ratio double")


def holding(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """``(asked, meta_id, so_hieu)``: every title that holds an asked one, whatever the case; distinct asked titles meet the others in blocks, as in :func:`alike`.

    Asked titles are trimmed; blank ones hold nothing.
    """
    a = asked.where(F.trim("title") != "").select(F.col("key").alias("asked"), F.lower(F.trim("title")).alias("part")).distinct()
    packed = a.groupBy(F.pmod(F.xxhash64("part"), F.lit(max(1, -(-a.count() // ASKED_BLOCK)))).alias("block")).agg(F.collect_list(F.struct("asked", "part")).alias("parts"))
    met = titles.where("title is not null").crossJoin(packed)  # a block of asked titles, not a title, meets each row
    hits = met.select("key", "number", F.inline(F.filter("parts", lambda p: F.contains(F.lower("title"), p["part"]))))
    return hits.select("asked", F.col("key").alias("meta_id"), F.col("number").alias("so_hieu"))
