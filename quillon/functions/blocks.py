"""``Blocks.java`` as a function on columns: compiled by Spark's own Java compiler, once for each application, and sent to the executors as a jar."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from importlib.resources import files
from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

NAME = "quillon.Blocks"
#: Where a number that the function gives has the places of the asked name and of the title; the likeness in millionths is at 0. Each is :data:`LAST` at most.
ASKED, TITLE, LAST = 40, 20, (1 << 20) - 1


def _object(spark: SparkSession):
    context = spark.sparkContext
    if getattr(context, "_quillon_blocks", None) is None:
        jvm = context._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.cook((files(__package__) / "Blocks.java").read_text(encoding="utf-8"))
        folder = Path(tempfile.mkdtemp(prefix="quillon-"))
        atexit.register(shutil.rmtree, str(folder), True)
        with zipfile.ZipFile(folder / "quillon_blocks.jar", "w") as jar:
            for name, code in compiler.getBytecodes().items():
                jar.writestr(f"{name.replace('.', '/')}.class", bytes(code))
        context._jsc.addJar(str(folder / "quillon_blocks.jar"))
        context._quillon_blocks = compiler.getClassLoader().loadClass(NAME).getConstructors()[0].newInstance(context._gateway.new_array(jvm.java.lang.Object, 0))
    return context._quillon_blocks


def alike_of(spark: SparkSession, least: float) -> Callable[[Column, Column], Column]:
    """Of arrays of names and of titles: an array of packed numbers, one for each pair with a likeness of at least ``least``."""
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.spark.sql.types.DataType.fromJson(ArrayType(LongType(), False).json())
    function = jvm.org.apache.spark.sql.functions.udf(_object(spark), kind)

    def apply(names: Column, titles: Column) -> Column:
        columns = [c._jc for c in (names, titles, F.lit(float(least)))]
        return Column(function.apply(jvm.PythonUtils.toSeq(columns)))

    return apply
