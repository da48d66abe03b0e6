"""Operators on long sequences (rows) that expressions over one row can't plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it back, so that loops keep short plans and survive lost executors.

    The files go when the driver's process ends.
    """
    spark = df.sparkSession
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", place)
    path = f"{place.rstrip('/')}/arbora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(removed, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark, path: str) -> None:
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # the JVM has gone; the folder is the cluster's to clear
        pass


def transitive_closure(seeds: DataFrame, edges: DataFrame, key: str = "item") -> DataFrame:
    """fn:transitive-closure: seeds and all they reach over edges (src, dst), by semi-naive iteration: only new items step."""
    every = front = durable(seeds.select(F.col(key).alias("item")).distinct())
    while True:
        step = front.join(edges.select(F.col("src").alias("item"), "dst"), "item").select(F.col("dst").alias("item")).distinct()
        front = durable(step.join(every, "item", "left_anti"))
        if not front.limit(1).count():
            return every.withColumnRenamed("item", key)
        every = every.union(front)


def iterate_while(seed, step: Callable, test: Callable, limit: int = 10_000):
    """fn:iterate-while over a driver value."""
    for _ in range(limit):
        if not test(seed):
            break
        seed = step(seed)
    return seed


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Places from 1 in an order (none: as the rows come), without one task that sorts all: rows are sorted in ranges, and ranges counted."""
    sorted_ = durable((df.orderBy(*order) if order else df).withColumn("#m", F.monotonically_increasing_id()))
    part = F.shiftright("#m", 33)
    sizes = sorted_.groupBy(part.alias("#p")).agg(F.count(F.lit(1)).alias("#n"))
    other = sizes.select(F.col("#p").alias("#q"), F.col("#n").alias("#k"))
    before = sizes.join(other, F.col("#q") < F.col("#p"), "left").groupBy("#p").agg(F.coalesce(F.sum("#k"), F.lit(0)).alias("#before"))
    return sorted_.withColumn("#p", part).join(F.broadcast(before), "#p").withColumn(name, F.col("#m") - F.shiftleft("#p", 33) + F.col("#before") + 1).drop("#m", "#p", "#before")


def value_index(df: DataFrame, path: str, key: str, partitions: int | None = None) -> None:
    """A value index: the rows sorted by their key, so that equality and range look-ups read only files whose statistics fit."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def index_lookup(spark, path: str, key: str, low=None, high=None, equal=None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    if equal is not None:
        return df.where(F.col(key) == equal)
    if low is not None:
        df = df.where(F.col(key) >= low if include_low else F.col(key) > low)
    if high is not None:
        df = df.where(F.col(key) <= high if include_high else F.col(key) < high)
    return df
