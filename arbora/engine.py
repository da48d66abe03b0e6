"""The entry point: an engine with named collections that runs queries."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from arbora.plans.compiler import Compiler
from arbora.plans.parser import QueryError
from arbora.sources import readers


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from the folder the driver has it in."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


class Engine:
    """Collections are DataFrames by name; a query's result is a DataFrame that has not run."""

    def __init__(self, spark: SparkSession, base: str | None = None):
        ship(spark)
        self.spark, self.base, self.tables, self.documents = spark, base, {}, {}

    def register(self, name: str, df: DataFrame) -> Engine:
        self.tables[name] = df
        return self

    def register_documents(self, name: str, df: DataFrame, id_column: str, text_column: str, method: str = "xml", failing: str = "raise") -> Engine:
        """Makes a column of XML or HTML texts the documents that doc(name) gives."""
        self.documents[name] = readers.documents(df, id_column, text_column, method, failing)
        return self

    def nodes(self, name: str) -> DataFrame:
        if name not in self.documents:
            raise QueryError("FODC0002", f"no documents {name}")
        return self.documents[name]

    def collection(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if self.base is not None:
            return self.spark.read.parquet(f"{self.base}/{name}.parquet")
        if self.spark.catalog.tableExists(name):
            return self.spark.table(name)
        raise QueryError("FODC0002", f"no collection {name}")

    def query(self, text: str, **variables: object) -> DataFrame:
        return Compiler(self.spark, self.collection, variables, self.nodes).query(text)
