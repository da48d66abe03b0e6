"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has PLACES places, or four for each virtual node if there are many shards; each shard holds VNODES virtual nodes on places that its number decides. A row's key is
its text, so equal texts start at one place; it belongs to the first virtual node clockwise. A shard holds at most its
bound of rows. Each shard first takes the rows of its own arcs, in the ring's order; what overflows continues
clockwise to the next shards that have room. With bounds that differ by one at most, counts do, too.

Only the rows per arc (one number per virtual node, whatever the input) come to the driver, to lay out which part of
an arc goes where. Rows are numbered within (arc, salt), the salt being a hash of the id, so that one text on a third
of the rows is spread over many tasks.
"""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of the ring, virtual nodes of a shard, rows that one (arc, salt) holds at most if all rows have one text.
PLACES, VNODES, ROWS_PER_SALT, LEAST_SALTS = 4096, 64, 200_000, 64


def places(shards: int) -> int:
    """Places of the ring: a power of two with room for all virtual nodes."""
    return max(PLACES, 1 << (4 * shards * VNODES - 1).bit_length())


def ring(shards: int) -> list[tuple[int, int]]:
    """(place, shard) of the virtual nodes, in order; a place that is taken sends a node to the next free one."""
    n = places(shards)
    taken: dict[int, int] = {}
    for v in range(VNODES):
        for s in range(shards):
            at = zlib.crc32(f"shard {s} node {v}".encode()) % n
            while at in taken:
                at = (at + 1) % n
            taken[at] = s
    return sorted(taken.items())


def allocate(counts: dict[int, int], nodes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from, to, shard, first slot): where the rows of each arc go, bounds being equal but for one row."""
    n = sum(counts.values())
    room = [n // shards + (s < n % shards) for s in range(shards)]
    used = [0] * shards
    out, left = [], []
    for arc, (_, s) in enumerate(nodes):
        own = counts.get(arc, 0)
        here = min(own, room[s] - used[s])
        if here:
            out.append((arc, 0, here, s, used[s]))
            used[s] += here
        if own > here:
            left.append((arc, here, own))
    for arc, at, end in left:
        k = arc
        while at < end:
            k = (k + 1) % len(nodes)
            s = nodes[k][1]
            here = min(end - at, room[s] - used[s])
            if here:
                out.append((arc, at, at + here, s, used[s]))
                used[s] += here
                at += here
    return out


def shard(docs: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard of every row; other columns are left out whatever their names.

    The law is `rows`: counts at most one apart. size is the text's bytes plus 1; a null text has none, and the crc32
    of none. Any number of shards from 1 on. Rows with null or repeated ids and texts each get a slot of their own. An empty table gives an empty one.
    """
    text = F.col(text_column).cast("binary")
    rows = docs.select(
        F.col(id_column).alias("_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"), F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("_crc"),
        F.pmod(F.xxhash64(text), F.lit(places(shards))).cast("int").alias("_place"), F.xxhash64(F.col(id_column), F.lit("salt")).alias("_spread"),
    )
    nodes = ring(shards)
    owner, k = [], 0
    for place in range(places(shards)):
        while k < len(nodes) and nodes[k][0] < place:
            k += 1
        owner.append(k % len(nodes))
    arcs = F.from_json(F.lit(str(owner)), "array<int>")
    salts = max(LEAST_SALTS, -(-docs.count() // ROWS_PER_SALT))
    placed = rows.select("_id", "_size", "_crc", F.element_at(arcs, F.col("_place") + 1).alias("_arc"), F.pmod(F.col("_spread"), F.lit(salts)).cast("int").alias("_salt"))
    counts = placed.groupBy("_arc", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_arc", "_salt", (F.sum("_n").over(Window.partitionBy("_arc").orderBy("_salt")) - F.col("_n")).alias("_before"))
    per_arc = {r["_arc"]: r["_n"] for r in counts.groupBy("_arc").agg(F.sum("_n").alias("_n")).collect()}  # a row per virtual node at most
    plan = allocate(per_arc, nodes, shards)
    parts = F.from_json(F.lit(json.dumps([dict(zip(("_arc", "_from", "_to", "_shard", "_slot"), x)) for x in plan])), "array<struct<_arc int, _from long, _to long, _shard int, _slot long>>")
    layout = docs.sparkSession.range(1).select(F.inline(parts))
    at = F.row_number().over(Window.partitionBy("_arc", "_salt").orderBy("_id", "_crc", "_size")) - 1
    ranked = placed.withColumn("_row", at).join(offsets, ["_arc", "_salt"]).withColumn("_at", F.col("_row") + F.col("_before"))
    # The layout has at most two rows more than virtual nodes and shards together.
    got = ranked.join(F.broadcast(layout), "_arc").where((F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    slot: Column = F.col("_slot") + F.col("_at") - F.col("_from")
    return got.select(F.col("_id").alias(id_column), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
