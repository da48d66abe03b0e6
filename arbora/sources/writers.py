"""Sinks: results as Parquet, JSON, text or XML rows, and documents as markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators import nodes
from arbora.plans.parser import QueryError


def write(df: DataFrame, place: str, method: str = "parquet", mode: str = "errorifexists", row_tag: str = "item", separator: str = "\n") -> None:
    """A query's result; json writes a line a row, text the one column, adaptive each row as JSON text."""
    out = df.write.mode(mode)
    if method in ("parquet", "json", "orc"):
        getattr(out, method)(place)
    elif method == "xml":
        out.format("xml").option("rowTag", row_tag).save(place)
    elif method == "text":
        df.select(F.col(df.columns[0]).cast("string")).write.mode(mode).option("lineSep", separator).text(place)
    elif method == "adaptive":
        df.select(F.to_json(F.struct("*"))).write.mode(mode).text(place)
    else:
        raise QueryError("SEPM0016", f"unknown method {method}")


def write_documents(node_table: DataFrame, place: str, method: str = "xml", mode: str = "errorifexists") -> None:
    """Whole documents as rows (doc_id, text) of markup."""
    nodes.serialize(node_table, method).write.mode(mode).parquet(place)
