"""Updates: edits of the node table give a new table; the source stays as it is.

Edits are rows (doc_id, target, action, name, content, rank): insert-into, insert-first, insert-before, insert-after, replace, replace-value,
rename or delete; content is markup. They are carried out per document in the order inserts, replacements, values,
names, deletions, all targets being nodes of the old document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.nodes import ARROW, SCHEMA, Builder
from arbora.plans.parser import QueryError

ORDER = ("insert-into", "insert-first", "insert-before", "insert-after", "replace", "replace-value", "rename", "delete")


def delete(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes outside the targets' subtrees: an anti join, for tables that are only read on (pre has gaps, sizes are as before)."""
    t = targets.select(F.col("doc_id").alias("d"), F.col("pre").alias("p"), F.col("size").alias("s"))
    return nodes.join(t, (F.col("doc_id") == F.col("d")) & (F.col("pre") >= F.col("p")) & (F.col("pre") <= F.col("p") + F.col("s")), "left_anti")


def edit(action: str, targets: DataFrame, name: str | None = None, content: str | None = None) -> DataFrame:
    """Edit rows of one action on the target nodes."""
    if action not in ORDER:
        raise QueryError("XUST0001", f"unknown update {action}")
    return targets.select("doc_id", F.col("pre").alias("target"), F.lit(action).alias("action"), F.lit(name).cast("string").alias("name"), F.lit(content).cast("string").alias("content"), F.lit(ORDER.index(action)).alias("rank"))


class Tree:
    def __init__(self, row: dict | None = None):
        self.row, self.children, self.attributes = row, [], []


def trees(rows: list[dict]) -> tuple[Tree, dict[int, Tree], dict[int, Tree]]:
    by = {r["pre"]: Tree(r) for r in rows}
    above: dict[int, Tree] = {}
    for r in rows:
        if r["parent"] is not None:
            (by[r["parent"]].attributes if r["kind"] == "attribute" else by[r["parent"]].children).append(by[r["pre"]])
            above[r["pre"]] = by[r["parent"]]
    return by[0], by, above


def parsed(content: str | None) -> list[Tree]:
    from arbora.sources.readers import parse_xml

    names = ARROW.names[1:]
    rows = [dict(zip(names, r)) for r in parse_xml(f"<x>{content or ''}</x>").rows]
    return trees(rows)[0].children[0].children


def rebuild(tree: Tree) -> Builder:
    b = Builder()

    def put(t: Tree) -> None:
        r = t.row
        if r["kind"] == "element":
            n = f"{r['prefix']}:{r['local']}" if r["prefix"] else r["local"]
            b.start(n, {(f"{a.row['prefix']}:" if a.row["prefix"] else "") + a.row["local"]: a.row["value"] for a in t.attributes}, {r["prefix"] or "": r["ns"]})
            for c in t.children:
                put(c)
            b.end()
        elif r["kind"] == "text":
            b.text(r["value"])
        else:
            b.leaf(r["kind"], r["local"] or "", r["value"])

    for c in tree.children:
        put(c)
    b.close()
    return b


def apply(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """The node table after the edits, renumbered."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(left.to_pylist(), key=lambda r: r["pre"])
        if not rows:
            return ARROW.empty_table()
        if not len(right):
            return left.select(ARROW.names)
        root, by, above = trees(rows)
        for e in sorted(right.to_pylist(), key=lambda e: (e["e_rank"], e["e_target"])):
            t, action, content = by[e["e_target"]], e["e_action"], e["e_content"]
            if action == "insert-into":
                t.children += parsed(content)
            elif action == "insert-first":
                t.children[:0] = parsed(content)
            elif action == "rename":
                t.row["prefix"], _, t.row["local"] = e["e_name"].rpartition(":")
            elif action == "replace-value":
                if t.row["kind"] == "element":
                    t.children = [Tree({"kind": "text", "value": content or ""})] if content else []
                else:
                    t.row["value"] = content or ""
            else:
                up = above[e["e_target"]]
                own = up.attributes if t.row["kind"] == "attribute" else up.children
                if t not in own:  # replaced or deleted by an edit before
                    continue
                k = own.index(t)
                new = parsed(content) if action != "delete" else []
                own[k + (action == "insert-after") : k + (action != "insert-before")] = new
        return pa.Table.from_batches([Builder.batch([(rows[0]["doc_id"], *r) for r in rebuild(root).rows])])

    own = edits.select(F.col("doc_id").alias("e_doc"), *[F.col(c).alias(f"e_{c}") for c in ("target", "action", "name", "content", "rank")])
    return nodes.groupBy("doc_id").cogroup(own.groupBy("e_doc")).applyInArrow(work, SCHEMA)
