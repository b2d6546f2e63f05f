"""References to records that do not exist, kept as incremental keyed state.

The state is two logs of weighted rows in a folder: parents ``(target_table, key, live,
first_seen, gone)`` and references ``(id, side, target_table, key, created_at, kind)``.
A row that no longer holds is taken back by the same row with a negative weight, so an
advance appends what changed and never rewrites what did not: new references probe the
parents of their keys; arriving parents resolve waiting orphans of their key; removals and
deletions reopen the key's references.  The counts of :meth:`OrphanState.snapshot` are
sums of weights.  After every :data:`COMPACT_EVERY` advances the logs are merged, so a
reader meets a bounded number of parts and the cost of merging is shared by the advances.

A version counts once its marker is written, after all its rows.  A state opened again
on its folder goes on from the last such version; an advance that names the number of a
batch which is already in is skipped, so a replayed batch is not applied twice.

Defined results: null and blank endpoints are no references.  A reference without
time is never late.  A parent row without time counts as there from the start.  A key all
of whose parent rows were removed is as if it never had any.  Repeated references each
count.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import Scratch

REFS = "id long, side string, target_table string, key string, created_at timestamp_ntz, kind string"
INDEX = "target_table string, key string, live long, first_seen timestamp_ntz, gone boolean"
#: Stands for parents whose row has no time.
ALWAYS = "0001-01-01 00:00:00"
COMPACT_EVERY = 16


def _kind(documents: str) -> Column:
    known = F.coalesce(F.col("p_live") > 0, F.lit(False))
    return (
        F.when(known & (F.col("created_at").isNull() | (F.col("p_seen") <= F.col("created_at"))), "ok")
        .when(known, "late")
        .when(F.coalesce(F.col("p_gone"), F.lit(False)) & (F.col("target_table") == documents), "deleted")
        .otherwise("missing")
    )


def _holding(log: DataFrame, ddl: str) -> DataFrame:
    """Rows of a log that hold, with their weight."""
    names = [x.split()[0] for x in ddl.split(", ")]
    return log.groupBy(*names).agg(F.sum("weight").alias("weight")).where("weight > 0")


def _of_keys(log: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col("target_table").alias("k_table"), F.col("key").alias("k_key")).distinct()
    return log.join(k, (F.col("target_table") == F.col("k_table")) & (F.col("key") == F.col("k_key")), "left_semi")


class OrphanState:
    """Pending-orphan state in ``path``, or in the shared scratch folder if none is named."""

    def __init__(self, spark: SparkSession, documents: str = "document_metadata", path: str | None = None):
        self.spark, self.documents = spark, documents
        self.scratch = None if path else Scratch(spark, "orphans")
        self.path = (path or self.scratch.path).rstrip("/")
        self.version = self.base = 0
        self.batch = -1
        commits = self._fs_path("commits")
        fs = self._fs(commits)
        for status in fs.listStatus(commits) if fs.exists(commits) else []:
            version, base, batch = map(int, status.getPath().getName().split("_"))
            if version > self.version:
                self.version, self.base, self.batch = version, base, batch

    def _fs_path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commit(self, version: int, base: int, batch: int) -> None:
        marker = self._fs_path(f"commits/{version}_{base}_{batch}")
        self._fs(marker).create(marker, True).close()
        self.version, self.base, self.batch = version, base, batch

    def _log(self, name: str, ddl: str, upto: int) -> DataFrame:
        """Rows of the versions that count."""
        there = [p for v in range(self.base, upto + 1) if self._fs(p := self._fs_path(f"{name}/{v}")).exists(p)]
        schema = f"{ddl}, weight long"
        return self.spark.read.schema(schema).parquet(*(p.toString() for p in there)) if there else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}/{version}")

    def advance(self, references: DataFrame | None = None, parents: DataFrame | None = None, deletions: DataFrame | None = None, batch: int | None = None) -> OrphanState:
        """One step.  ``references(id, side, target_table, key, created_at)``; ``parents(target_table, key, seen_at, op)`` with op 1 for an arriving row and -1 for a removed one; ``deletions(target_table, key)``."""
        if batch is not None and batch <= self.batch:
            return self
        version = self.version + 1
        changes = []
        if parents is not None:
            seen = F.coalesce(F.col("seen_at"), F.lit(ALWAYS).cast("timestamp_ntz"))
            changes.append(parents.select("target_table", "key", F.col("op").cast("long").alias("live"), F.when(F.col("op") > 0, seen).alias("first_seen"), F.lit(False).alias("gone")))
        if deletions is not None:
            changes.append(deletions.select("target_table", "key", F.lit(0).cast("long").alias("live"), F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(True).alias("gone")))
        changed = changes[0] if len(changes) == 1 else changes[0].unionByName(changes[1]) if changes else None
        if changed is not None:
            self._write(self._merged_parents(changed), "index", version)
        todo = []
        if references is not None:
            todo.append(references.select("id", "side", "target_table", "key", "created_at", F.lit(None).cast("string").alias("was"), F.lit(1).cast("long").alias("weight")))
        if changed is not None and self.version:
            again = _holding(_of_keys(self._log("refs", REFS, self.version), changed), REFS)
            todo.append(again.withColumnRenamed("kind", "was").select("id", "side", "target_table", "key", "created_at", "was", "weight"))
        if todo:
            self._write(self._judged(todo[0] if len(todo) == 1 else todo[0].unionByName(todo[1]), version), "refs", version)
        self._commit(version, self.base, self.batch if batch is None else batch)
        if version - self.base >= COMPACT_EVERY:
            self.compact()
        return self

    def _merged_parents(self, changed: DataFrame) -> DataFrame:
        """What the parents' log gets: the new rows of the touched keys, and their old ones taken back."""
        changed = changed.withColumn("old", F.lit(False))
        if self.version:
            held = _holding(_of_keys(self._log("index", INDEX, self.version), changed), INDEX).drop("weight")
            changed = changed.unionByName(held.withColumn("old", F.lit(True)))
        row = lambda live, seen, gone, weight: F.struct(live.alias("live"), seen.alias("first_seen"), gone.alias("gone"), F.lit(weight).cast("long").alias("weight"))
        was = F.when(F.col("old"), F.struct("live", "first_seen", "gone"))
        merged = changed.groupBy("target_table", "key").agg(F.sum("live").alias("live"), F.min("first_seen").alias("seen"), F.max("gone").alias("gone"), F.max(was).alias("was"))
        now = row(F.col("live"), F.when(F.col("live") > 0, F.col("seen")), F.col("gone"), 1)
        back = F.when(F.col("was").isNotNull(), row(F.col("was.live"), F.col("was.first_seen"), F.col("was.gone"), -1))
        return merged.select("target_table", "key", F.inline(F.array_compact(F.array(now, back))))

    def _judged(self, todo: DataFrame, version: int) -> DataFrame:
        """What the references' log gets: rows of a kind that is new, and the rows they replace taken back."""
        log = self._log("index", INDEX, version)
        held = _holding(_of_keys(log, todo) if self.version else log, INDEX)
        parents = held.select(F.col("target_table").alias("p_table"), F.col("key").alias("p_key"), F.col("live").alias("p_live"), F.col("first_seen").alias("p_seen"), F.col("gone").alias("p_gone"))
        hit = (F.col("target_table") == F.col("p_table")) & (F.col("key") == F.col("p_key"))
        now = todo.join(parents, hit, "left").withColumn("now", _kind(self.documents)).where("was is null or was <> now")
        both = F.array(F.struct(F.col("now").alias("kind"), F.col("weight").alias("w")), F.struct(F.col("was").alias("kind"), (-F.col("weight")).alias("w")))
        rows = now.select("id", "side", "target_table", "key", "created_at", F.inline(both))
        return rows.where("kind is not null").withColumnRenamed("w", "weight")

    def compact(self) -> None:
        """Merge the logs into one part each."""
        last, version = self.version, self.version + 1
        for name, ddl in (("index", INDEX), ("refs", REFS)):
            self._write(_holding(self._log(name, ddl, last), ddl), name, version)
        first, self.base = self.base, version
        self._commit(version, version, self.batch)
        for v in range(first, version):
            for name in ("index", "refs"):
                gone = self._fs_path(f"{name}/{v}")
                self._fs(gone).delete(gone, True)

    def orphans(self) -> DataFrame:
        """Open references: ``(id, side, target_table, kind, period)``."""
        held = _holding(self._log("refs", REFS, self.version).where("kind <> 'ok'"), REFS)
        period = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none"))
        return held.select("id", "side", "target_table", "kind", period.alias("period"), F.explode(F.sequence(F.lit(1), F.col("weight"))).alias("_copy")).drop("_copy")

    def snapshot(self) -> DataFrame:
        """Counts of open references per table, period and kind: sums of weights."""
        log = self._log("refs", REFS, self.version).where("kind <> 'ok'")
        period = F.coalesce(F.date_format("created_at", "yyyy-MM"), F.lit("none"))
        return log.groupBy("target_table", period.alias("period"), "kind").agg(F.sum("weight").alias("orphans")).where("orphans > 0")
