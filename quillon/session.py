"""Session construction and the shared scratch folder of iterative operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def build_session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ``conf`` overrides any setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _base(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where it is unset and all tasks run on this machine (tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def ship(spark: SparkSession) -> None:
    """Make this package importable in the workers, wherever they run; once for each application."""
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    context._quillon_shipped = True
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon_package.zip"
    with zipfile.ZipFile(target, "w") as package:
        for source in sorted(root.rglob("*.py")):
            package.write(source, source.relative_to(root.parent))
    context.addPyFile(str(target))
    atexit.register(shutil.rmtree, str(target.parent), True)


def with_retry(action: Callable[[], T], attempts: int = 3, wait: float = 20.0) -> T:
    """What ``action`` gives, tried again after a pause; the last failure is raised.  For services on the driver: tasks are repeated by Spark."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except Exception:  # noqa: BLE001  raised at the last attempt
            if attempt == attempts:
                raise
            time.sleep(wait)
    raise ValueError("at least one attempt is needed")


class Scratch:
    """A folder of written tables that cut lineage and survive the loss of executors.

    Tables that a returned plan still reads stay until the session ends; others
    are removed by :meth:`drop` as soon as they are superseded.
    """

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.path = f"{_base(spark).rstrip('/')}/quillon/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._clear)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def _clear(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a plan that reads it back."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self._delete(f"{self.path}/{name}")


def default_cores() -> int:
    return int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
