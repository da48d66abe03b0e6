"""The node table: one row per node in document order, with the sizes and levels from which every axis is a predicate.

nodes(doc_id, pre, size, level, parent, kind, ns, prefix, local, value, string_value): pre counts all nodes but
attributes from 0 (the document); an attribute has its owner's pre as parent and a pre of its own behind the owner.
"""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, pre long, size long, level int, parent long, kind string, ns string, prefix string, local string, value string, string_value string"
ARROW = pa.schema([("doc_id", pa.int64()), ("pre", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("parent", pa.int64()), *[(n, pa.string()) for n in ("kind", "ns", "prefix", "local", "value", "string_value")]])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Builder:
    """Rows of one document, from the events of a parser."""

    def __init__(self):
        self.rows: list[list] = [[0, 0, 0, None, "document", None, None, None, None, None]]
        self.open, self.parts, self.held = [0], [[]], []

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(ARROW), ARROW.types)], schema=ARROW)

    def add(self, kind: str, ns, prefix, local, value, string_value) -> int:
        pre = len(self.rows)
        self.rows.append([pre, 0, len(self.open), self.open[-1], kind, ns, prefix, local, value, string_value])
        return pre

    def flush(self) -> None:
        if self.held:
            t = "".join(self.held)
            self.held = []
            self.add("text", None, None, None, t, t)
            self.parts[-1].append(t)

    def start(self, name: str, attrs: dict[str, str], scope: dict[str, str]) -> None:
        self.flush()
        prefix, _, local = name.rpartition(":")
        pre = self.add("element", scope.get(prefix), prefix, local, None, None)
        self.open.append(pre)
        self.parts.append([])
        for k, v in attrs.items():
            p, _, n = k.rpartition(":")
            self.add("attribute", scope.get(p) if p else None, p, n, v, v)

    def end(self) -> None:
        self.flush()
        pre, own = self.open.pop(), "".join(self.parts.pop())
        self.rows[pre][1] = len(self.rows) - 1 - pre
        self.rows[pre][9] = own
        self.parts[-1].append(own)

    def text(self, t: str) -> None:
        self.held.append(t)

    def leaf(self, kind: str, name: str, value: str) -> None:
        self.flush()
        self.add(kind, None, "", name, value, value)

    def close(self) -> None:
        self.flush()
        while len(self.open) > 1:
            self.end()
        self.rows[0][1], self.rows[0][9] = len(self.rows) - 1, "".join(self.parts[0])


def name(c: str = "") -> Column:
    """fn:name of rows whose columns have the prefix c."""
    return F.when(F.coalesce(F.length(f"{c}prefix"), F.lit(0)) > 0, F.concat(f"{c}prefix", F.lit(":"), f"{c}local")).otherwise(F.coalesce(F.col(f"{c}local"), F.lit("")))


def generate_id() -> Column:
    return F.concat(F.lit("d"), F.col("doc_id"), F.lit("n"), F.col("pre"))


def root(nodes: DataFrame, of: DataFrame) -> DataFrame:
    return nodes.where("pre = 0").join(of.select("doc_id").distinct(), "doc_id", "left_semi")


def outermost(nodes: DataFrame) -> DataFrame:
    """Nodes that no other of them holds."""
    o = nodes.select(F.col("doc_id").alias("d"), F.col("pre").alias("p"), F.col("size").alias("s"))
    return nodes.join(o, (F.col("doc_id") == F.col("d")) & (F.col("p") < F.col("pre")) & (F.col("pre") <= F.col("p") + F.col("s")), "left_anti")


def innermost(nodes: DataFrame) -> DataFrame:
    """Nodes that hold no other of them."""
    o = nodes.select(F.col("doc_id").alias("d"), F.col("pre").alias("p"))
    return nodes.join(o, (F.col("doc_id") == F.col("d")) & (F.col("pre") < F.col("p")) & (F.col("p") <= F.col("pre") + F.col("size")), "left_anti")


def has_children(nodes: DataFrame, of: DataFrame) -> DataFrame:
    kids = nodes.where("kind <> 'attribute'").select("doc_id", F.col("parent").alias("pre")).distinct().withColumn("has", F.lit(True))
    return of.join(kids, ["doc_id", "pre"], "left").withColumn("has_children", F.coalesce("has", F.lit(False))).drop("has")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Node sets by identity; sort by (doc_id, pre) for document order."""
    return a.unionByName(b).dropDuplicates(["doc_id", "pre"])


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_semi")


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_anti")


def markup(rows: list[dict], method: str = "xml") -> str:
    """The text of one document's rows, which are in document order."""
    out: list[str] = []
    ends: list[tuple[int, str]] = []
    k = 0
    while k < len(rows):
        r = rows[k]
        while ends and ends[-1][0] < r["pre"]:
            out.append(ends.pop()[1])
        if r["kind"] == "element":
            n = f"{r['prefix']}:{r['local']}" if r["prefix"] else r["local"]
            attrs = ""
            while k + 1 < len(rows) and rows[k + 1]["kind"] == "attribute":
                k += 1
                a = rows[k]
                attrs += f" {(a['prefix'] + ':') if a['prefix'] else ''}{a['local']}={quoteattr(a['value'])}"
            inside = r["pre"] + r["size"] > rows[k]["pre"]
            if inside or method == "html" and n not in VOID:
                out.append(f"<{n}{attrs}>")
                ends.append((r["pre"] + r["size"], f"</{n}>"))
            else:
                out.append(f"<{n}{attrs}>" if method == "html" else f"<{n}{attrs}/>")
        elif r["kind"] == "text":
            out.append(r["value"] if method == "text" else escape(r["value"]))
        elif r["kind"] == "comment":
            out.append(f"<!--{r['value']}-->")
        elif r["kind"] == "processing-instruction":
            out.append(f"<?{r['local']} {r['value']}?>")
        k += 1
    return "".join(out + [e for _, e in reversed(ends)])


def serialize(nodes: DataFrame, method: str = "xml") -> DataFrame:
    """(doc_id, text) of whole documents; a document's nodes meet in one task, as the document did when it was parsed."""

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["pre"])
        text = rows[0]["string_value"] if method == "text" else markup(rows, method)
        return pa.table({"doc_id": [rows[0]["doc_id"]], "text": [text]})

    return nodes.groupBy("doc_id").applyInArrow(work, "doc_id long, text string")
