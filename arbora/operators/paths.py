"""Paths over the node table: each step is a join on its axis's predicate, each predicate a filter, semi join or rank.

A path that begins with // and a name is a plain filter on the table, so Spark prunes it; child and attribute steps
are equi-joins on the parent; the other axes are joins on the document with a range condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators import nodes as N
from arbora.plans.parser import QueryError, parse

COLUMNS = ("doc_id", "pre", "size", "level", "parent", "kind", "ns", "prefix", "local", "value", "string_value")
REVERSE = ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")


def axis(name: str) -> Column:
    n, c = (lambda x: F.col(x)), (lambda x: F.col(f"c_{x}"))
    plain = n("kind") != "attribute"
    inside = (n("pre") > c("pre")) & (n("pre") <= c("pre") + c("size"))
    return {
        "child": (n("parent") == c("pre")) & plain,
        "attribute": (n("parent") == c("pre")) & (n("kind") == "attribute"),
        "descendant": inside & plain,
        "descendant-or-self": (inside & plain) | (n("pre") == c("pre")),
        "self": n("pre") == c("pre"),
        "parent": n("pre") == c("parent"),
        "ancestor": (n("pre") < c("pre")) & (c("pre") <= n("pre") + n("size")),
        "ancestor-or-self": (n("pre") <= c("pre")) & (c("pre") <= n("pre") + n("size")),
        "following-sibling": (n("parent") == c("parent")) & (n("pre") > c("pre")) & plain & (c("kind") != "attribute"),
        "preceding-sibling": (n("parent") == c("parent")) & (n("pre") < c("pre")) & plain & (c("kind") != "attribute"),
        "following": (n("pre") > c("pre") + c("size")) & plain,
        "preceding": (n("pre") + n("size") < c("pre")) & plain,
    }[name]


def test(what, axis_name: str) -> Column:
    principal = "attribute" if axis_name == "attribute" else "element"
    if what[0] == "name":
        ok = F.col("kind") == principal
        if what[1] == "*":
            return ok
        prefix, _, local = what[1].rpartition(":")
        return ok & (F.col("local") == local) & ((F.col("prefix") == prefix) if prefix else F.lit(True))
    kind = what[1]
    if kind == "node":
        return F.lit(True)
    kind = {"document-node": "document"}.get(kind, kind)
    named = (F.col("local") == what[2]) if len(what) > 2 and what[2] and what[2] != "*" else F.lit(True)
    return (F.col("kind") == kind) & named


class Paths:
    def __init__(self, nodes: DataFrame):
        self.nodes = nodes.select(*COLUMNS)

    def select(self, path: str, context: DataFrame | None = None) -> DataFrame:
        """Nodes of a path, without duplicates; from the documents' roots, or from given nodes."""
        start = self.nodes.where("pre = 0") if context is None else context.select(*COLUMNS)
        return self.run(parse(path)[2], start.withColumn("o", F.lit(0).cast("long")), root=context is None).select(*COLUMNS).dropDuplicates(["doc_id", "pre"])

    def run(self, node, context: DataFrame, root: bool = False) -> DataFrame:
        """Rows (*COLUMNS, o): o is the context node that a row was reached from."""
        if node[0] in ("root", "call"):
            return self.nodes.where("pre = 0").join(context.select("doc_id", "o").distinct(), "doc_id") if not root else context
        if node[0] == "context":
            return context
        if node[0] == "binary" and node[1] in ("|", "union"):
            return self.run(node[2], context, root).unionByName(self.run(node[3], context, root)).dropDuplicates(["doc_id", "o", "pre"])
        if node[0] == "filter":
            return self.predicate(self.run(node[1], context, root).withColumn("g", F.col("o")), node[2], False).drop("g")
        if node[0] != "step":
            raise QueryError("XPST0003", f"{node[0]} is no path")
        _, left, name, what, predicates = node
        short = left[0] == "step" and left[2] == "descendant-or-self" and left[3] == ("kind", "node") and not left[4] and name == "child"
        if short and not any(self.positional(p) for p in predicates):
            left, name = left[1], "descendant"
        if root and name == "descendant" and left == ("root",):
            out = self.nodes.where(test(what, name)).where("pre > 0 and kind <> 'attribute'").withColumn("o", F.lit(0).cast("long")).withColumn("g", F.lit(0).cast("long"))
        else:
            ctx = self.run(left, context, root).dropDuplicates(["doc_id", "o", "pre"])
            c = ctx.select("doc_id", "o", *[F.col(x).alias(f"c_{x}") for x in ("pre", "size", "parent", "kind")])
            out = self.nodes.where(test(what, name)).alias("n").join(c, "doc_id").where(axis(name)) if name not in ("child", "attribute", "parent", "self") else self.equal(test(what, name), c, name)
            out = out.withColumn("g", F.col("c_pre")).select(*COLUMNS, "o", "g")
        for p in predicates:
            out = self.predicate(out, p, name in REVERSE)
        return out.drop("g").dropDuplicates(["doc_id", "o", "pre"])

    def equal(self, wanted: Column, c: DataFrame, name: str) -> DataFrame:
        left = self.nodes.where(wanted)
        if name in ("child", "attribute"):
            left = left.where((F.col("kind") == "attribute") if name == "attribute" else (F.col("kind") != "attribute"))
            return left.join(c.withColumnRenamed("doc_id", "c_doc"), (F.col("doc_id") == F.col("c_doc")) & (F.col("parent") == F.col("c_pre"))).drop("c_doc")
        key = "c_parent" if name == "parent" else "c_pre"
        return left.join(c.withColumnRenamed("doc_id", "c_doc"), (F.col("doc_id") == F.col("c_doc")) & (F.col("pre") == F.col(key))).drop("c_doc")

    def positional(self, p) -> bool:
        return p[0] == "literal" and p[2] == "integer" or p[0] == "call" and p[1] == "last" or isinstance(p, (tuple, list)) and any(x[:2] == ("call", "position") or x[:2] == ("call", "last") for x in p if isinstance(x, tuple) and len(x) > 1)

    def predicate(self, rows: DataFrame, p, reverse: bool) -> DataFrame:
        if self.positional(p):
            group = Window.partitionBy("doc_id", "o", "g")
            rows = rows.withColumn("#p", F.row_number().over(group.orderBy(F.desc("pre") if reverse else F.asc("pre")))).withColumn("#n", F.count(F.lit(1)).over(group))
            value = lambda x: {"literal": lambda: F.lit(x[1]), "call": lambda: F.col("#p" if x[1] == "position" else "#n")}[x[0]]()
            if p[0] in ("value", "general"):
                a, b = value(p[2]), value(p[3])
                ok = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[p[1]]
            else:
                ok = F.col("#p") == value(p)
            return rows.where(ok).drop("#p", "#n")
        if p[0] == "binary" and p[1] == "and":
            return self.predicate(self.predicate(rows, p[2], reverse), p[3], reverse)
        if p[0] == "binary" and p[1] == "or":
            return self.predicate(rows, p[2], reverse).unionByName(self.predicate(rows, p[3], reverse)).dropDuplicates(["doc_id", "o", "g", "pre"])
        if p[0] == "call" and p[1].removeprefix("fn:") == "not":
            return rows.join(self.predicate(rows, p[2][0], reverse).select("doc_id", "pre").distinct(), ["doc_id", "pre"], "left_anti")
        if p[0] == "call" and p[1] in ("contains", "starts-with", "ends-with"):
            how = {"contains": F.contains, "starts-with": F.startswith, "ends-with": F.endswith}[p[1]]
            return self.matching(rows, p[2][0], how(F.col("string_value"), F.lit(p[2][1][1])))
        if p[0] in ("value", "general") and p[3][0] == "literal":
            v = F.col("string_value")
            v = v.try_cast("double") if p[3][2] != "string" else v
            b = F.lit(float(p[3][1]) if p[3][2] != "string" else p[3][1])
            return self.matching(rows, p[2], {"eq": v == b, "ne": v != b, "lt": v < b, "le": v <= b, "gt": v > b, "ge": v >= b}[p[1]])
        return self.matching(rows, p, F.lit(True))

    def matching(self, rows: DataFrame, path, ok: Column) -> DataFrame:
        if path == ("context",):
            return rows.where(ok)
        inner = rows.select(*COLUMNS).dropDuplicates(["doc_id", "pre"]).withColumn("o", F.col("pre"))
        hit = self.run(path, inner).where(ok).select("doc_id", F.col("o").alias("pre")).distinct()
        return rows.join(hit, ["doc_id", "pre"], "left_semi")


def path_of(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """fn:path without namespaces: /a[1]/b[2] of elements, by joining ancestors that are numbered among their siblings."""
    numbered = nodes.where("kind = 'element'").withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "parent", "local").orderBy("pre")))
    step = numbered.select(F.col("doc_id").alias("d"), F.col("pre").alias("p"), F.col("size").alias("s"), F.concat(N.name(), F.lit("["), "k", F.lit("]")).alias("step"))
    up = of.select("doc_id", "pre").join(step, (F.col("doc_id") == F.col("d")) & (F.col("p") <= F.col("pre")) & (F.col("pre") <= F.col("p") + F.col("s")))
    return up.groupBy("doc_id", "pre").agg(F.concat(F.lit("/"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "step"))), lambda e: e.step), "/")).alias("path"))
