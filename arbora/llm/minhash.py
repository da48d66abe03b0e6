"""Near-duplicate documents by ProbMinHash over weighted five-word shingles, banding and exact verification.

The similarity is the probability Jaccard of the shingles' counts: for each shared shingle, 1 over the sum of the
larger of both documents' counts relative to its own. Each shingle arrives at random times at a rate of its count and at random
registers; a register keeps its first arrival, and a shingle is given up once its next arrival is later than the
latest register. Two documents agree in a register with their similarity as probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.components import components
from arbora.llm.common import cells, durable, runs

#: Words of a shingle, least similarity, bands and rows: a pair at 0.8 shares no band with probability 3e-6.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 24, 4
REGISTERS, AT_ONCE = BANDS * ROWS, 300_000
#: Members of a group that meet in one cell come from two parts of about this size.
CELL = 128


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) > 400_000:
            self.clear()
        self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[str], known: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their counts; fewer than five words are one shingle, none none."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    if not n:
        return h, np.zeros(0, np.int64)
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out, return_counts=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The shingle in each register of each document (which must have one)."""
    e = np.concatenate([x[0] for x in sets])
    w = np.concatenate([x[1] for x in sets]).astype(np.float64)
    d = np.repeat(np.arange(len(sets)), [len(x[0]) for x in sets])
    first = np.full(len(sets) * REGISTERS, np.inf)
    out = np.zeros(len(sets) * REGISTERS, np.uint64)
    t, r = np.zeros(len(e)), 0
    while len(e):
        r += 1
        h = mixed(e + np.uint64(r * 0x9E3779B97F4A7C15 % (1 << 64)))
        t = t - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w
        k = d * REGISTERS + (mixed(h) % np.uint64(REGISTERS)).astype(np.int64)
        np.minimum.at(first, k, t)
        won = first[k] == t
        out[k[won]] = e[won]
        latest = first.reshape(len(sets), -1).max(axis=1)
        alive = t < latest[d]
        e, w, d, t = e[alive], w[alive], d[alive], t[alive]
    return out.reshape(len(sets), REGISTERS)


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of sorted shingles a, b with counts x, y."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y, sx, sy = x.astype(float), y.astype(float), float(x.sum()), float(y.sum())
    u, v = x[i], y[j]
    ratio = u / v
    order = np.argsort(ratio)
    ratio, u, v = ratio[order], u[order], v[order]
    # For shingle s: counts of x only, and of shared ones whose ratio is at least s's, relative to x_s; the rest to y_s.
    from_x = sx - np.concatenate([[0], np.cumsum(u)])[np.searchsorted(ratio, ratio, "left")]
    from_y = sy - v.sum() + np.concatenate([[0], np.cumsum(v)])[np.searchsorted(ratio, ratio, "left")]
    return float((1 / (from_x / u + from_y / v)).sum())


def sketch(docs: DataFrame) -> DataFrame:
    """(_id, digest of the words, keys: one per band) of (_id, _text); null keys if there is no word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            digests, sets, keys, at = [], [], [None] * len(b), []
            held = 0

            def flush() -> None:
                if sets:
                    s = signatures(sets).reshape(len(sets), BANDS, ROWS)
                    h = np.arange(BANDS, dtype=np.uint64)[None] + np.uint64(1)
                    for k in range(ROWS):
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
                    for i, row in zip(at, h.astype(np.int64).tolist()):
                        keys[i] = row
                sets.clear()
                at.clear()

            for i, t in enumerate(b.column(1)):
                words = (t.as_py() or "").lower().split()
                digests.append(xxhash.xxh128_digest(" ".join(words).encode("utf-8", "surrogatepass")) if words else None)
                if words:
                    at.append(i)
                    sets.append(shingles(words, known))
                    held += len(sets[-1][0])
                    if held > AT_ONCE:
                        flush()
                        held = 0
            flush()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["_id", "_digest", "_keys"])

    return docs.mapInArrow(work, "_id long, _digest binary, _keys array<long>")


def features(docs: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for b in batches:
            sets = [shingles((t.as_py() or "").lower().split(), known) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0].tobytes() for x in sets], pa.binary()), pa.array([x[1].astype(np.int32).tobytes() for x in sets], pa.binary())], ["_id", "_set", "_n"])

    return docs.mapInArrow(work, "_id long, _set binary, _n binary")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is at least so much."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [similarity(np.frombuffer(a, np.uint64), np.frombuffer(x, np.int32), np.frombuffer(c, np.uint64), np.frombuffer(y, np.int32)) for a, x, c, y in zip(*(b.column(k).to_pylist() for k in range(2, 6)))]
            keep = pa.array([x >= least - 1e-9 for x in s])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("_id").alias("a"), F.col("_set").alias("sa"), F.col("_n").alias("na"))
    right = sets.select(F.col("_id").alias("b"), F.col("_set").alias("sb"), F.col("_n").alias("nb"))
    # The same plan at every size: both sides meet by a shuffle on ids, whichever would fit into a broadcast.
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "sa", "na", "sb", "nb").mapInArrow(work, "a long, b long")


def across(dealt: DataFrame, least: float) -> DataFrame:
    """(a, b): links between members of different classes, from cells (_centre, _i, _j) of (_id, _class, _p, _set, _n).

    Each cell tells of as many links as connect what its links connect, at most one for each member.
    """

    def links(cell: pa.Table) -> list[tuple[int, int]]:
        i, j = cell.column("_i")[0].as_py(), cell.column("_j")[0].as_py()
        ids, kind, part = (cell.column(c).to_numpy() for c in ("_id", "_class", "_p"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in cell.column("_set")]
        counts = [np.frombuffer(x.as_py(), np.int32) for x in cell.column("_n")]
        size = np.array([len(x) for x in sets])
        plain = np.array([x.max(initial=1) == 1 for x in counts])
        # Shared shingles of all members: a product of presence matrices over shingles that two members have.
        every, back, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        column = np.cumsum(times > 1) - 1
        own = np.repeat(np.arange(len(sets)), size)
        keep = times[back] > 1
        here = np.zeros((len(sets), int((times > 1).sum())), np.float32)
        here[own[keep], column[back[keep]]] = 1
        left, right = (np.flatnonzero(part == i), np.flatnonzero(part == j))
        both = here[left] @ here[right].T
        differ = kind[left][:, None] != kind[right][None]
        if i == j:
            differ &= ids[left][:, None] < ids[right][None]
        exact = plain[left][:, None] & plain[right][None]
        near = both >= (least - 1e-9) * (size[left][:, None] + size[right][None] - both)
        up = {int(k): int(k) for k in kind}

        def top(k: int) -> int:
            while up[k] != k:
                k = up[k]
            return k

        out = []
        for x, y in zip(*np.nonzero(differ & ((exact & near) | (~exact & (both > 0))))):
            a, b = left[x], right[y]
            s, t = top(int(kind[a])), top(int(kind[b]))
            if s != t and (exact[x, y] or similarity(sets[a], counts[a], sets[b], counts[b]) >= least - 1e-9):
                up[max(s, t)] = min(s, t)
                out.append((int(min(ids[a], ids[b])), int(max(ids[a], ids[b]))))
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in runs(batches, ("_centre", "_i", "_j")):
            got = links(cell)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], ["a", "b"])

    return dealt.select("_centre", "_i", "_j", "_p", "_id", "_class", "_set", "_n").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = LEAST) -> DataFrame:
    """id, class_id (least id of its class), n_copies (rows with the same words) and kept (id = class_id) of every row.

    Words are lower-cased runs without white space. Rows with the same words are one text; texts are linked if
    their similarity is at least `least`, and classes are what links connect. A row without words (null, empty, blank)
    or without id links with nothing and is kept. Ids are whole numbers; rows that share an id share a class, and all
    of them are returned. Other columns are left out, whatever their names; an empty table gives an empty one.

    Texts that share a band are first compared with the band's centre (the text whose bands are fullest: copies of one
    original all share most with it), which joins nearly all of a group at a cost in proportion to it. Where a centre's
    bands then still hold several classes, all their members are compared across classes, in cells of bounded size that
    tell of links only; no pairs are formed in Spark.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text_column).alias("_text"))
    drawn = durable(sketch(rows))
    live = drawn.where("_id is not null and _digest is not null")
    # Rows with the same words have the same keys, so each task sends one row per digest, however many copies there are.
    texts = durable(live.groupBy("_digest").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_copies"), F.min("_keys").alias("_keys")))
    reps = texts.select(F.col("_rep").alias("_id"), F.explode("_keys").alias("_key"))
    shared = reps.groupBy("_key").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    buckets = durable(reps.join(shared, "_key"))
    central = buckets.groupBy("_id").agg(F.sum("_m").alias("_full"))
    centres = buckets.join(central, "_id").groupBy("_key").agg(F.max_by("_id", F.struct("_full", -F.col("_id"))).alias("_centre"))
    around = durable(buckets.join(centres, "_key").select("_centre", "_id").distinct())
    pairs = around.where("_id <> _centre").select(F.least("_id", "_centre").alias("a"), F.greatest("_id", "_centre").alias("b")).distinct()
    sets = durable(features(rows.hint("merge").join(around.select("_id").distinct(), "_id", "left_semi")))
    links = durable(verified(pairs, sets, least))
    roots = durable(components(links))
    classed = around.join(roots.withColumnRenamed("node", "_id"), "_id", "left").select("_centre", "_id", F.coalesce("root", "_id").alias("_class"))
    several = classed.groupBy("_centre").agg(F.count(F.lit(1)).alias("_n"), F.min("_class").alias("_x"), F.max("_class").alias("_y")).where("_x < _y").select("_centre", "_n")
    members = classed.join(several.select("_centre"), "_centre").join(sets, "_id")
    found = across(cells(members, "_centre", several, CELL), least)
    roots = durable(components(links.union(durable(found))))
    told = texts.drop("_keys").join(roots.select(F.col("node").alias("_rep"), "root"), "_rep", "left")
    # Digests of a thousandth of the rows or more are a thousand at most: theirs are told by broadcast, so that the
    # shuffle join has no hot key. Rows that nothing is told of aren't shuffled at all.
    many = told.where(F.col("_copies") * 1000 >= drawn.count()).where("_copies > 1")
    ids = drawn.select("_id", "_digest")
    hot = ids.where("_id is not null").join(F.broadcast(many), "_digest")
    rest = ids.where("_id is not null and _digest is not null").join(F.broadcast(many.select("_digest")), "_digest", "left_anti").join(told, "_digest", "left")
    none = ids.where("_id is null or _digest is null")
    out = hot.unionByName(rest).unionByName(none, allowMissingColumns=True)
    kind = F.coalesce("root", "_rep", "_id")
    return out.select(F.col("_id").alias(id_column), kind.alias("class_id"), F.coalesce("_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce(F.col("_id") == kind, F.lit(True)).alias("kept"))
