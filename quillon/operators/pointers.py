"""Distributed resolution of pointer chains (list ranking by contraction).

A table ``(key, ptr, steps, gain, done)`` holds one pointer a row.  ``done`` rows
have reached their end, which is ``ptr``.  A round *jumps*: every row follows its
pointer as far as it can, adding up ``steps`` and ``gain`` on the way; after that
only rows that some unfinished row still points at are needed, the others are
peeled off.  The first round follows pointers inside partitions of neighbouring
keys, which leaves only the rows on partition borders; when more than
``core_limit`` rows remain, random mates are spliced out, which removes a
constant share of any chain in each round.  The rest, never more than
``core_limit`` rows, is solved at once, and peeled rows take up their results in
reverse order.  The work is a geometric series; no row set beyond the fixed
``core_limit`` ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import Scratch

POINTER_SCHEMA = "key long, ptr long, steps long, gain long, done boolean"
LOCAL_ROWS = 1 << 21  # of 33 bytes; the rows that one task holds at a time
CORE_LIMIT = 1 << 18  # 262,144 rows of 33 bytes: the only set that one task solves alone


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Rows at hand, at most about ``LOCAL_ROWS`` at a time: any set of rows may jump together, so a partition of any size needs bounded memory."""
    got, held = [], 0

    def made() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(got)
        return {n: t[n].combine_chunks().to_numpy(zero_copy_only=False).copy() for n in ("key", "ptr", "steps", "gain", "done")}

    for b in batches:
        if b.num_rows:
            got.append(b)
            held += b.num_rows
        if held >= LOCAL_ROWS:
            yield made()
            got, held = [], 0
    if got:
        yield made()


def _local_next(a: dict[str, np.ndarray]) -> np.ndarray:
    """Place of each unfinished row's target among the rows at hand, else -1."""
    order = np.argsort(a["key"], kind="stable")
    keys = a["key"][order]
    at = np.minimum(np.searchsorted(keys, a["ptr"]), len(keys) - 1)
    return np.where(~a["done"].astype(bool) & (keys[at] == a["ptr"]), order[at], -1)


def _chase(a: dict[str, np.ndarray], nxt: np.ndarray) -> np.ndarray:
    """Follow local pointers by doubling; returns which rows still run, i.e. in or into a local cycle."""
    a["done"] = a["done"].astype(bool)
    for _ in range(int(np.ceil(np.log2(len(nxt) + 1))) + 1):
        i = np.flatnonzero(nxt >= 0)
        if not len(i):
            break
        j = nxt[i]
        steps, gain, ptr, done, nx = a["steps"][i] + a["steps"][j], a["gain"][i] + a["gain"][j], a["ptr"][j], a["done"][j], nxt[j]
        a["steps"][i], a["gain"][i], a["ptr"][i], a["done"][i], nxt[i] = steps, gain, ptr, done, nx
    return nxt >= 0


def _peel(nxt: np.ndarray) -> np.ndarray:
    """Peel leaves until none is left: the rows that stay are exactly those on cycles."""
    n = len(nxt)
    degree = np.bincount(nxt[nxt >= 0], minlength=n)
    alive = nxt >= 0
    leaves = np.flatnonzero(alive & (degree == 0))
    while len(leaves):
        alive[leaves] = False
        to = nxt[leaves]
        np.subtract.at(degree, to, 1)
        to = np.unique(to)
        leaves = to[alive[to] & (degree[to] == 0)]
    return alive


def _cycle_minima(a_key: np.ndarray, nxt: np.ndarray, on: np.ndarray) -> np.ndarray:
    """The smallest key of each cycle among the rows ``on`` cycles."""
    i = np.flatnonzero(on)
    if not len(i):
        return a_key[:0]
    place = np.full(len(nxt), -1)
    place[i] = np.arange(len(i))
    step, low = place[nxt[i]], a_key[i].copy()
    for _ in range(int(np.ceil(np.log2(len(i) + 1))) + 1):
        low, step = np.minimum(low, low[step]), step[step]
    return np.unique(low)


def _batch(a: dict[str, np.ndarray], keep: np.ndarray | slice = slice(None)) -> pa.RecordBatch:
    names = ("key", "ptr", "steps", "gain", "done")
    return pa.RecordBatch.from_arrays([pa.array(a[n][keep]) for n in names], names=list(names))


def _jump_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a in _gather(batches):
        _chase(a, _local_next(a))
        yield _batch(a)


def _jump_local_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As :func:`_jump_local`; rows in or into a local cycle end there, and the row with a cycle's smallest key is marked by gain -1.

    Marks are no gains: a row that leads to a marked row is not marked, and rows that are done keep theirs.
    """
    for a in _gather(batches):
        marks = np.where(a["done"].astype(bool), a["gain"], 0)
        nxt = _local_next(a)
        first = nxt.copy()
        caught = _chase(a, nxt)
        if caught.any():
            rest = np.where(caught, first, -1)
            rest[(rest >= 0) & ~caught[np.maximum(rest, 0)]] = -1
            on = _peel(rest)
            minima = _cycle_minima(a["key"], rest, on)
            a["done"][caught] = True
            marks[np.isin(a["key"], minima)] = -1
        a["gain"] = marks
        yield _batch(a)


def _jump_mates(rows: DataFrame, turn: int, cut: bool) -> DataFrame:
    """Rows with coin 1 step over a target with coin 0; a finished target ends its followers.

    With ``cut``, a row that comes back to itself ends there and is marked.
    """
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2))
    target = rows.select(F.col("key").alias("t_key"), F.col("ptr").alias("t_ptr"), F.col("steps").alias("t_steps"), F.col("gain").alias("t_gain"), F.col("done").alias("t_done"))
    hop = F.col("t_done") | ((coin(F.col("key")) == 1) & (coin(F.col("t_key")) == 0))
    loop = (F.col("t_ptr") == F.col("key")) & hop & ~F.col("t_done") if cut else F.lit(False)
    gain = F.when(loop, F.lit(-1)).otherwise(F.lit(0)) if cut else F.col("gain") + F.when(hop, F.col("t_gain")).otherwise(F.lit(0))
    moved = (
        rows.where(~F.col("done"))
        .join(target, F.col("ptr") == F.col("t_key"))
        .select(
            "key",
            F.when(hop, F.col("t_ptr")).otherwise(F.col("ptr")).alias("ptr"),
            (F.col("steps") + F.when(hop, F.col("t_steps")).otherwise(F.lit(0))).alias("steps"),
            gain.cast("long").alias("gain"),
            ((hop & F.col("t_done")) | loop).alias("done"),
        )
    )
    return rows.where("done").unionByName(moved)


def _survivors(jumped: DataFrame) -> DataFrame:
    needed = jumped.where(~F.col("done")).select(F.col("ptr").alias("need")).distinct()
    return jumped.join(needed, F.col("key") == F.col("need"), "left_semi")


def contract(rows: DataFrame, place, scratch: Scratch, label: str, cut: bool = False, core_limit: int = CORE_LIMIT) -> tuple[list[DataFrame], DataFrame]:
    """Contract ``rows`` to at most ``core_limit`` rows and solve those.

    ``place`` is the column by which neighbouring keys meet in a partition.
    Returns the jumped table of every round and the solved core.  With ``cut``,
    pointers may run in cycles: the rows marked by gain -1, in the rounds or in the
    core, are then one row of each cycle.
    """
    local = _jump_local_cut if cut else _jump_local
    levels = [scratch.save(rows.repartition(place).mapInArrow(local, POINTER_SCHEMA), f"{label}-jump0")]
    turn = 0
    while True:
        left = scratch.save(_survivors(levels[-1]), f"{label}-left{turn}")
        if left.count() <= core_limit:
            break
        turn += 1
        levels.append(scratch.save(_jump_mates(left, turn, cut), f"{label}-jump{turn}"))
        scratch.drop(f"{label}-left{turn - 1}")
    core = left.repartition(1).mapInArrow(local, POINTER_SCHEMA)
    return levels, scratch.save(core, f"{label}-core")


def expand(levels: list[DataFrame], core: DataFrame) -> DataFrame:
    """Hand the core's results back through the rounds: ``(key, ptr, steps, gain)`` of every row, ``ptr`` being its end."""
    solved = core
    for level in reversed(levels):
        end = solved.select(F.col("key").alias("t_key"), F.col("ptr").alias("t_ptr"), F.col("steps").alias("t_steps"), F.col("gain").alias("t_gain"))
        late = level.where(~F.col("done")).join(end, F.col("ptr") == F.col("t_key")).select("key", F.col("t_ptr").alias("ptr"), (F.col("steps") + F.col("t_steps")).alias("steps"), (F.col("gain") + F.col("t_gain")).alias("gain"))
        solved = level.where("done").select("key", "ptr", "steps", "gain").unionByName(late)
    return solved
