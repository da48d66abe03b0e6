"""Near-duplicate vectors by spherical-cap filters: structured random product codes, list decoding, a join on filters.

The space is turned at random and cut into parts, each with its own code of random directions; a filter is one
direction of each part put together; a few such tables are independent of each other. A vector passes the filters whose direction it exceeds a threshold on; they are
listed by decoding (partial sums that can't reach the threshold any more are dropped), not by trying all. Vectors that
share a filter are compared in cells of a bounded size, by stored half floats with a proved error. What they leave in
no doubt is counted where it is found, in the first filter that both pass, so that a group of near copies sends its
rows' counts and one link for each row, not its pairs; pairs within the error of the least cosine are told and verified
exactly in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.ann import matrix, valid
from arbora.llm.common import cells, durable, runs
from arbora.llm.components import components

#: Least cosine, parts of a code, independent tables, and the chance of missing a pair at that cosine (nearer ones are
#: missed far more rarely) that the threshold is set for.
LEAST, PARTS, TABLES, MISS = 0.9, 2, 4, 1e-3
#: Half floats are off by at most 2 ** -11 of each component, so a unit vectors' product by less than this.
HALF = 2.5 * 2.0**-11
#: Rows of one filter that one task compares; more are dealt into pairs of parts.
CELL = 1024
#: Counts, links and pairs that a task holds before it tells of them, rows whose filters it remembers.
HELD, KNOWN = 1_000_000, 100_000


class Code:
    """One table: a random turn of the space and, for each part, random directions."""

    def __init__(self, dims: int, words: int, random: np.random.Generator):
        self.words = words
        self.turn, _ = np.linalg.qr(random.standard_normal((dims, dims)))
        self.cuts = np.array_split(np.arange(dims), min(PARTS, dims))
        self.codes = []
        for c in self.cuts:
            w = random.standard_normal((words, len(c)))
            self.codes.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt(len(c) / dims))

    def decode(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row exceeds; rows in order."""
        t = x @ self.turn
        p = [t[:, c] @ w.T for c, w in zip(self.cuts, self.codes)]
        rest = np.concatenate([np.cumsum([q.max(axis=1) for q in p[::-1]], axis=0)[::-1][1:], np.zeros((1, len(x)))])
        row, number, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, q in enumerate(p):
            s = total[:, None] + q[row]
            i, j = np.nonzero(s + rest[k][row][:, None] >= threshold)
            row, number, total = row[i], number[i] * self.words + j, s[i, j]
        return row, number


class Filters:
    """Several tables under one threshold: the highest at which pairs at the least cosine miss each other as rarely as MISS."""

    def __init__(self, dims: int, rows: int):
        random = np.random.default_rng(11)
        # More rows, more filters: those that two unrelated vectors share stay rare.
        words = int(np.clip(256 * (max(rows, 1) / 50_000) ** 0.25, 64, 4096))
        self.tables = [Code(dims, words, random) for _ in range(TABLES)]
        x, n = random.standard_normal((2, 800, dims))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        if dims > 1:
            n -= (n * x).sum(axis=1, keepdims=True) * x
            n /= np.linalg.norm(n, axis=1, keepdims=True)
        else:
            n = np.zeros_like(x)
        y = LEAST * x + math.sqrt(1 - LEAST**2) * n
        self.threshold = 0.6
        while self.threshold > -1:
            alone = 0.0
            for t in self.tables:
                a, b = (r * t.words ** len(t.cuts) + f for r, f in (t.decode(x, self.threshold), t.decode(y, self.threshold)))
                alone += math.log(max(1, len(x) - len(np.unique(np.intersect1d(a, b) // t.words ** len(t.cuts)))) / len(x))
            if alone <= math.log(MISS):
                break
            self.threshold -= 0.01

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, number = zip(*(t.decode(x, self.threshold) for t in self.tables))
        number = [f + k * t.words ** len(t.cuts) for k, (f, t) in enumerate(zip(number, self.tables))]
        order = np.argsort(np.concatenate(row), kind="stable")
        return np.concatenate(row)[order], np.concatenate(number)[order]


def first_shared(lists: list[np.ndarray], p: np.ndarray, q: np.ndarray, own: int) -> np.ndarray:
    """Whether rows p and q share no filter below their own; lists: each row's filters."""
    lower = [x[x < own] for x in lists]
    every, place, times = np.unique(np.concatenate(lower), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lower])
    shared = times > 1
    if not shared.any():
        return np.ones(len(p), bool)
    number = np.cumsum(shared) - 1
    keep = shared[place]
    bits = np.zeros((len(lists), -(-int(shared.sum()) // 64) * 64), bool)
    bits[row[keep], number[place[keep]]] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    out = np.empty(len(p), bool)
    some = max(1, (1 << 21) // packed.shape[1])
    for k in range(0, len(p), some):
        out[k : k + some] = ~(packed[p[k : k + some]] & packed[q[k : k + some]]).any(axis=1)
    return out


def least_reached(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest place that each of n places reaches over links p, q."""
    least = np.arange(n)
    while len(p):
        before = least.copy()
        np.minimum.at(least, p, least[q])
        np.minimum.at(least, q, least[p])
        least = least[least]
        if (least == before).all():
            break
    return least


def compared(vectors: DataFrame, dims: int, rows: int) -> DataFrame:
    """What comparing unit vectors (_id, _u, _n: rows that have it) finds: rows (a, b, n, sure).

    b null: n rows stand behind what a is surely linked with, as far as one task counted them. sure: a and b are
    connected. Else a < b may be linked, and are told of once.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(Filters(dims, rows))  # a few hundred directions

    def list_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            x = (matrix(pa.chunked_array([b.column(1)])) if len(b) else np.zeros((0, dims))).astype(np.float16)
            row, number = f.decode(x.astype(np.float64))  # of the half floats, as they are what is left later
            cut = np.searchsorted(row, np.arange(len(x) + 1))
            half = [v.tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(half, pa.binary()), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(number, pa.int64()))], ["_id", "_n", "_h", "_f"])

    listed = durable(vectors.select("_id", "_u", "_n").mapInArrow(list_filters, "_id long, _n long, _h binary, _f array<long>"))
    flat = listed.select("_id", "_n", "_h", F.explode("_f").alias("_f"))
    large = listed.select(F.explode("_f").alias("_f")).groupBy("_f").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > 1)
    dealt = cells(flat, "_f", large.withColumnRenamed("_m", "_n"), CELL)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # filters of vectors that have been near another

        def filters(x: np.ndarray) -> list[np.ndarray]:
            own = [v.tobytes() for v in x]
            new = [k for k, v in enumerate(own) if v not in known]
            if len(known) + len(new) > KNOWN:
                known.clear()
                new = list(range(len(own)))
            if new:
                row, number = shared.value.decode(x[new].astype(np.float64))
                for k, listed in zip(new, np.split(number, np.searchsorted(row, np.arange(1, len(new))))):
                    known[own[k]] = listed
            return [known[v] for v in own]

        def found(group: pa.Table) -> list[np.ndarray]:
            """Counts (id, n), connections (id, id) and doubtful pairs of a cell."""
            i, j = group.column("_i")[0].as_py(), group.column("_j")[0].as_py()
            half = np.frombuffer(b"".join(group.column("_h").to_pylist()), np.float16).reshape(len(group), -1)
            x = half.astype(np.float32)
            if i == j:
                cosine = x @ x.T
                p, q = np.nonzero(np.triu(cosine >= LEAST - HALF, 1))
                sure = cosine[p, q] >= LEAST + HALF
            else:
                part = group.column("_p").to_numpy()
                left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
                cosine = x[left] @ x[right].T
                p, q = np.nonzero(cosine >= LEAST - HALF)
                sure = cosine[p, q] >= LEAST + HALF
                p, q = left[p], right[q]
            if not len(p):
                return []
            near, at = np.unique(np.concatenate([p, q]), return_inverse=True)
            ids, n, half = group.column("_id").to_numpy()[near], group.column("_n").to_numpy()[near], half[near]
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids, n, half, at = ids[order], n[order], half[order], rank[at]
            p, q = np.minimum(*np.split(at, 2)), np.maximum(*np.split(at, 2))
            first = first_shared(filters(half), p, q, group.column("_f")[0].as_py())
            once = first & sure
            times = np.bincount(p[once], n[q[once]], len(ids)) + np.bincount(q[once], n[p[once]], len(ids))
            least = least_reached(len(ids), p[sure], q[sure])
            on, told = np.flatnonzero(times), np.flatnonzero(least < np.arange(len(ids)))
            return [np.stack([ids[on], times[on].astype(np.int64)]), np.stack([ids[least[told]], ids[told]]), np.stack([ids[p[first & ~sure]], ids[q[first & ~sure]]])]

        def told(out: list[list[np.ndarray]]) -> pa.RecordBatch:
            counts, links, doubtful = (np.concatenate(c, axis=1) for c in zip(*out))
            ids, at = np.unique(counts[0], return_inverse=True)
            n = np.bincount(at, counts[1], len(ids)).astype(np.int64)
            links = links[:, np.lexsort(links)]
            links = links[:, np.append(True, (np.diff(links, axis=1) != 0).any(axis=0))] if links.shape[1] else links
            a = np.concatenate([ids, links[0], doubtful[0]])
            b = pa.array(np.concatenate([ids, links[1], doubtful[1]]), pa.int64(), mask=np.arange(len(a)) < len(ids))
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, pa.array(np.concatenate([n, np.zeros(len(a) - len(n), np.int64)]), pa.int64()), pa.array(np.arange(len(a)) < len(ids) + links.shape[1])], ["a", "b", "n", "sure"])

        out: list[list[np.ndarray]] = []
        size = 0
        for group in runs(batches, ("_f", "_i", "_j")):
            if len(group) > 1 and (own := found(group)):
                out.append(own)
                size += sum(x.shape[1] for x in own)
                if size > HELD:
                    yield told(out)
                    out, size = [], 0
        if out:
            yield told(out)

    return dealt.select("_f", "_i", "_j", "_p", "_id", "_n", "_h").mapInArrow(compare, "a long, b long, n long, sure boolean")


def verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose vectors (_id, _v) have a cosine of at least LEAST."""
    left = vectors.select(F.col("_id").alias("a"), F.col("_v").alias("va"))
    right = vectors.select(F.col("_id").alias("b"), F.col("_v").alias("vb"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = matrix(pa.chunked_array([b.column(2)])), matrix(pa.chunked_array([b.column(3)]))
            keep = pa.array((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))) >= LEAST)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb").mapInArrow(exact, "a long, b long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one: it is compared once, and n_links counts all rows that stand behind what it links with, itself
    left out. An unusable vector (null, empty, zero, null or non-finite components, another length than most) links
    with nothing: 0 links, its own component, kept. Rows that share an id count as one vector each but share a
    component; rows without id have none and are kept. Other columns are left out whatever their names; an empty
    table gives an empty one.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("_id"), F.col(vector_column).cast("array<double>").alias("_v"))
    good = rows.where(F.col("_id").isNotNull() & valid(F.col("_v")))
    sizes = good.groupBy(F.size("_v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    dims, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    good = good.where(F.size("_v") == dims)
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, v: s + v * v))
    distinct = durable(good.groupBy("_v").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n")).withColumn("_u", F.transform("_v", lambda v: v / length)))
    found = durable(compared(distinct, dims, n))
    exact = durable(verified(found.where("b is not null and not sure").select("a", "b"), distinct))
    both = exact.union(exact.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(distinct.select(F.col("_id").alias("b"), F.col("_n").alias("n")), "b").select("a", "n").union(found.where("b is null").select("a", "n"))
    linked = counts.groupBy("a").agg(F.sum("n").alias("_links")).withColumnRenamed("a", "_id")
    roots = components(exact.union(found.where("b is not null and sure").select("a", "b"))).withColumnRenamed("node", "_id")
    told = distinct.select("_v", "_n", "_id").join(linked, "_id", "left").join(roots, "_id", "left").select(
        F.col("_v").alias("_w"), (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), F.coalesce("root", "_id").alias("_root")
    )
    usable = F.when(F.col("_id").isNotNull() & valid(F.col("_v")) & (F.size("_v") == dims), F.col("_v"))
    out = rows.withColumn("_v", usable).join(told, F.col("_v") == F.col("_w"), "left")
    root = F.coalesce("_root", "_id")
    return out.select(F.col("_id").alias(id_column), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(F.col("_id") == root, F.lit(True)).alias("kept"))
