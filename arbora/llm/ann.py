"""Nearest neighbours by inner product: multi-index hashing of learned rotated binary codes.

Inner product becomes cosine by one added component (the root of the largest squared length less one's own). Codes are
the signs of rotations that are learned on a bounded sample (FIT rows) by alternating codes and the orthogonal
Procrustes rotation to them. A code is split into substrings of a byte. A code within Hamming radius r of a query's
differs in some substring by at most r / substrings bits (pigeonhole), so the codes to check are the union of the
substrings' buckets within that distance; these are held against r in full, and only those within it are ranked by
their vectors. The radius is read off the sample: a query's k nearest of n rows are as far as its k * sample / n nearest
of the sample.

Queries and rows are dealt into blocks of a fixed size; each pair of blocks is a task with its own index. Queries with
fewer neighbours than asked for within the radius are searched again without one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import durable

#: Bits (32 substrings of 8), rows the rotations are fitted to, share of the sample's neighbours within the radius.
BITS, FIT, COVER = 256, 4096, 0.97
#: A block of rows is a few MB; each query brings its nearest from every block, so larger blocks bring fewer rows.
ROWS_BLOCK, QUERY_BLOCK, ROUNDS = 16384, 1024, 25

NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


def learn(x: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotations (dimensions x bits)."""
    mean = x.mean(axis=0)
    c = x - mean
    random = np.random.default_rng(7)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        r, _ = np.linalg.qr(random.standard_normal((x.shape[1], x.shape[1])))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(c.T @ np.where(c @ r >= 0, 1.0, -1.0))
            r = u @ v
        parts.append(r)
    return mean, np.concatenate(parts, axis=1)[:, :bits]


def codes(x: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits((x - mean) @ rotation >= 0, axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of packed codes."""
    out = np.zeros((len(a), len(b)), np.uint16)
    a8, b8 = a.view(np.uint64), b.view(np.uint64)
    for k in range(a8.shape[1]):
        out += np.bitwise_count(a8[:, k, None] ^ b8[None, :, k])
    return out


class Index:
    """A block's codes: for each substring and each of its 256 values, the rows within the probed distance, as bits."""

    def __init__(self, code: np.ndarray, radius: int):
        self.code, self.radius = code, radius
        m = code.shape[1]
        whole, more = divmod(radius, m)  # radius = m * whole + more: the first more + 1 substrings within whole, the rest within whole - 1
        self.balls = []
        for k in range(m):
            reach = whole if k <= more else whole - 1
            self.balls.append(np.packbits(NEAR[:, code[:, k]] <= reach, axis=1) if reach >= 0 else np.zeros((256, -(-len(code) // 8)), np.uint8))

    def probed(self, query: np.ndarray) -> np.ndarray:
        """The rows in the buckets that a query's code reaches, as bits."""
        rows = self.balls[0][query[0]].copy()
        for k in range(1, len(query)):
            rows |= self.balls[k][query[k]]
        return rows

    def within(self, query: np.ndarray) -> np.ndarray:
        """The rows whose codes are within the radius of a query's; only probed rows are held against it."""
        rows = np.flatnonzero(np.unpackbits(self.probed(query), count=len(self.code)))
        return rows[distances(query[None], self.code[rows])[0] <= self.radius]


def valid(column: Column) -> Column:
    """Vectors that are neither null nor zero and have neither null nor non-finite components."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(column, lambda v: v != 0), F.lit(False))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(index: Index, ids: np.ndarray, x: np.ndarray, who: int, q: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest rows (in the order of ids) that the index retrieves for one query, and their inner products."""
    rows = index.within(code)
    rows = rows[ids[rows] != who]
    s = (x[rows] * q).sum(axis=1)  # in one order for all, so that equal vectors tie
    if len(s) > k:
        some = s >= np.partition(s, -k)[-k]
        rows, s = rows[some], s[some]
    order = np.lexsort((ids[rows], -s))[:k]
    return ids[rows[order]], s[order]


def radius_of(sample: np.ndarray, base: np.ndarray, probe: np.ndarray, k: int, n: int) -> int:
    """The Hamming radius that holds COVER of the sample's neighbours, as many of them as k of n rows come to; base, probe: codes."""
    near = sample[: len(probe)] @ sample.T
    near[np.arange(len(near)), np.arange(len(near))] = -np.inf
    top = np.argsort(-near, axis=1)[:, : min(-(-k * len(sample) // n), len(sample) - 1)]
    gaps = np.take_along_axis(distances(probe, base), top, axis=1)
    return int(np.quantile(gaps, COVER)) if gaps.size else BITS


def search(vectors: DataFrame, queries: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found for each row where queries holds; all if fewer.

    Rows with an unusable vector (null, empty, zero, null or non-finite components), a null id, or another number of
    components than most usable rows (the smaller of two as frequent) take no part. Ties go to the smaller id. Rows that repeat an id are candidates each;
    a query isn't a candidate of its own id. Other columns are left out, whatever their names; an empty table gives an
    empty result.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(vector_column).alias("_v"), F.coalesce(queries, F.lit(False)).alias("_q"))
    rows = rows.where(F.col("_id").isNotNull() & valid(F.col("_v")))
    length = F.aggregate("_v", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    facts = rows.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if("_q").alias("q"), F.max(length).alias("most")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts or not facts[0]["q"]:
        return vectors.sparkSession.createDataFrame([], schema)
    facts = facts[0]
    dims, most = facts["d"], facts["most"]
    rows = rows.where(F.size("_v") == dims)

    def extended(x: np.ndarray, query: bool) -> np.ndarray:
        size = (x * x).sum(axis=1)
        if query:
            return np.concatenate([x / np.sqrt(size)[:, None], np.zeros((len(x), 1))], axis=1)
        return np.concatenate([x, np.sqrt(np.maximum(0, most - size))[:, None]], axis=1) / np.sqrt(most)

    share = min(1.0, FIT / facts["n"])
    sample = matrix(rows.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30)).orderBy("_id").limit(2 * FIT).select("_v").toArrow().column("_v")) if facts["n"] else None
    if not len(sample):
        sample = matrix(rows.orderBy("_id").limit(FIT).select("_v").toArrow().column("_v"))
    mean, rotation = learn(extended(sample, False))
    base, probe = codes(extended(sample, False), mean, rotation), codes(extended(sample[:256], True), mean, rotation)
    radius = radius_of(sample, base, probe, k, facts["n"])

    n_blocks, n_queries = -(-facts["n"] // ROWS_BLOCK), -(-facts["q"] // QUERY_BLOCK)

    def cells(data: DataFrame, q: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
        deal = lambda n, salt: F.pmod(F.xxhash64("_id", F.lit(salt)), F.lit(n)).cast("int")
        left = data.select("_id", "_v", deal(n_blocks, "row").alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_c"))
        right = q.select("_id", "_v", deal(parts, "query").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_r"))
        return left, right

    def ranked(limit: int):
        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            if len(left) and len(right):
                order = np.argsort(left.column("_id").to_numpy(), kind="stable")
                ids, x = left.column("_id").to_numpy()[order], matrix(left.column("_v"))[order]
                q = matrix(right.column("_v"))
                index = Index(codes(extended(x, False), mean, rotation), limit)
                for who, own, code in zip(right.column("_id").to_pylist(), q, codes(extended(q, True), mean, rotation)):
                    near, s = nearest(index, ids, x, who, own, code, k)
                    out.append((np.full(len(near), who), near, s))
            return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(np.concatenate(c)) for c in zip(*out)))))

        return work

    def found(data: DataFrame, q: DataFrame, parts: int, limit: int) -> DataFrame:
        left, right = cells(data, q, parts)
        return left.groupBy("_r", "_c").cogroup(right.groupBy("_r", "_c")).applyInArrow(ranked(limit), "query_id long, vec_id long, score double")

    q = rows.where("_q").dropDuplicates(["_id"])
    first = durable(found(rows, q, n_queries, radius))
    counts = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = durable(q.join(counts.where(F.col("n") >= min(k, facts["n"] - 1)).withColumnRenamed("query_id", "_id"), "_id", "left_anti"))
    few = short.count()
    got = first
    if few:
        again = found(rows, short, -(-few // QUERY_BLOCK), BITS)
        got = first.join(short.select(F.col("_id").alias("query_id")), "query_id", "left_anti").union(again)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
