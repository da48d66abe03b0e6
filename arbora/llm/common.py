"""What the operators of this subpackage share: table access, durable intermediate tables, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder the driver has it in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH")) if x)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where it names none and all tasks run on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts lineage and survives lost executors.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/arbora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(spark)
    atexit.register(remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Like durable, but dealt by key: grouping or joining what is read by this key needs no shuffle of it."""
    spark = df.sparkSession
    name = f"arbora_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    atexit.register(remove, spark, path)
    return spark.table(name)


def remove(spark: SparkSession, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM has gone; the folder is the cluster's to clear
        pass


def give_back(spark: SparkSession | None = None) -> bool:
    """Returns freed memory to the system, so that idle workers don't hold what their largest piece of work took.

    spark: on the driver, of its JVM, too (what compiling of plans took outside the heap); whether the JVM could.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    if spark is None:
        return False
    try:
        gateway = spark.sparkContext._gateway
        java = gateway.jvm.java.lang
        kinds, values = gateway.new_array(java.Class, 4), gateway.new_array(java.Object, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.Class.forName(name)
        values[0], values[1] = gateway.jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        java.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
        return True
    except Exception:  # a JVM without that command
        return False


_compiled: dict[tuple[str, str], object] = {}


def java_function(spark: SparkSession, source: str, value: bytes, returns: str):
    """A function of columns that the Java class in this folder's file `source` computes, with value as a broadcast.

    The driver compiles it, once, with the compiler that Spark generates its code with, and sends it to the executors
    as a jar, so no one else needs a compiler or this folder.
    """
    context = spark.sparkContext
    jvm = context._jvm
    key = (context.applicationId, source)
    if key not in _compiled:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook((Path(__file__).parent / source).read_text())
        code = compiler.getBytecodes()
        jar = f"{tempfile.mkdtemp(prefix='arbora-')}/{Path(source).stem}-{uuid.uuid4().hex}.jar"
        with zipfile.ZipFile(jar, "w") as z:
            for name in code:
                z.writestr(f"{name.replace('.', '/')}.class", bytes(code[name]))
        _compiled[key] = compiler.getClassLoader().loadClass(f"arbora.{Path(source).stem}"), os.path.realpath(jar)
    made, jar = _compiled[key]
    spark.sql(f"ADD JAR '{jar}'")  # a session's own, so each session adds it
    arguments = context._gateway.new_array(jvm.java.lang.Object, 1)
    arguments[0] = context._jsc.broadcast(value)
    name = f"arbora_{uuid.uuid4().hex}"
    spark._jsparkSession.udf().register(name, made.getConstructors()[0].newInstance(arguments), jvm.org.apache.spark.sql.types.DataType.fromDDL(returns))
    return lambda *columns: F.call_function(name, *columns)


@contextlib.contextmanager
def no_cycles() -> Iterator[None]:
    """For work that makes no cycles but holds many objects, which the collector's passes would cost more than the work; a worker that is used again has its collector back."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def remainder(column, n: int):
    """crc32 of a number as text, modulo n: the folds that the queries fix."""
    return F.crc32(column.cast("string").cast("binary")) % n


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys (whole numbers, not null) from batches that are sorted by them; holds one run and one batch."""
    held: pa.Table | None = None
    for b in batches:
        if not len(b):
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        edge = np.flatnonzero(np.any([np.diff(held.column(c).to_numpy()) != 0 for c in keys], axis=0)) + 1
        for s, e in zip([0, *edge[:-1]], edge):
            yield held.slice(s, e - s)
        held = held.slice(edge[-1]) if len(edge) else held
    if held is not None and len(held):
        yield held


def cells(rows: DataFrame, group: str, sizes: DataFrame, size: int) -> DataFrame:
    """Deals each group's rows into parts of about `size`, and each part to the cells (_i, _j), _i <= _j, where it meets every part.

    sizes: (group, _n). Adds _p, _i, _j. All cells of all groups are dealt evenly over the tasks (a cell has at most
    two parts), so that a large group's cells don't meet in a few.
    """
    parts = sizes.select(group, F.ceil(F.col("_n") / size).cast("int").alias("_parts"))
    dealt = rows.join(parts, group).withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int"))
    met = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_o"))
    met = met.withColumns({"_i": F.least("_p", "_o"), "_j": F.greatest("_p", "_o")})
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    task = F.pmod(F.xxhash64(group) + F.col("_i") * F.col("_parts") - F.expr("_i * (_i - 1) div 2") + F.col("_j") - F.col("_i"), F.lit(n)).cast("int")
    return met.withColumn("_task", task).repartitionById(n, "_task").drop("_o", "_parts", "_task").sortWithinPartitions(group, "_i", "_j")
