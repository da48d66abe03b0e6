"""Language identification: cosine of normalised TF-IDF n-gram vectors to several clustered centroids per language.

Texts are lower-cased, everything but letters becomes one blank, and code-point n-grams of one to three are hashed
into a fixed number of bins. Document frequencies come from all training rows. Centroids are spherical k-means
clusters of a bounded sample of training rows (SAMPLE per language); each language's distance limit comes from the
same sample. Whole texts are read, in slices, so that a text of any length needs bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from arbora.llm.common import give_back

#: Bins, clusters per language, labelled rows per language that the centroids are fitted to (a bound in expectation:
#: rows are taken by a hash of their id), letters read at once.
BINS, CLUSTERS, SAMPLE, SLICE = 4096, 4, 800, 1 << 20
#: A text of n letters is as similar to its centroid as the root of n / (n + SHORT) of a long one: fewer letters, fewer
#: n-grams to share. The limit is this share (MARGIN) of the similarity, made up for length, that all but FEW of the sample exceed.
SHORT, MARGIN, FEW = 40, 0.4, 0.002


def letters() -> np.ndarray:
    """Each code point, or 32 if it isn't a letter."""
    out = np.fromiter((i if chr(i).isalpha() else 32 for i in range(0x110000)), np.uint32, 0x110000)
    return out


_letters: list[np.ndarray] = []


def counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams of a whole text, and its number of letters."""
    if not _letters:
        _letters.append(letters())
    out, found, tail = np.zeros(BINS, np.int64), 0, np.array([32], np.uint32)
    for k in range(0, len(text), SLICE):
        c = _letters[0][np.frombuffer(text[k : k + SLICE].lower().encode("utf-32-le", "replace"), np.uint32)]
        found += int((c != 32).sum())
        end = [32] if k + SLICE >= len(text) else []
        c = np.concatenate([tail, c, np.array(end, np.uint32)])
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = c[keep]
        new = len(tail) if k else 0  # n-grams that end in the tail are counted already
        h1 = c * np.uint32(0x9E3779B1)
        h2 = (h1[:-1] ^ (c[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        h3 = (h2[:-1] ^ (c[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        for n, h in ((1, h1), (2, h2), (3, h3)):
            out += np.bincount(h[max(0, new - n + 1) :] >> np.uint32(20), minlength=BINS)
        tail = c[-2:]
    return out, found


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF vectors, in the place of the counts (rows of floats), so that nothing of their size is held beside them."""
    np.log1p(n, out=n)
    n *= idf
    size = np.sqrt(np.einsum("ij,ij->i", n, n))[:, None]
    n /= np.where(size == 0, 1, size)
    return n


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """Rows per language and rows per bin, over all rows of (_lang, _text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, t in zip(b.column(0), b.column(1)):
                own = sums.setdefault(lang.as_py(), np.zeros(BINS + 1, np.int64))
                own[:BINS] += counts(t.as_py())[0] > 0
                own[BINS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], ["_lang", "_df"])

    parts = docs.mapInArrow(work, "_lang string, _df array<long>")
    added = parts.select("_lang", F.posexplode("_df").alias("_bin", "_n")).groupBy("_lang", "_bin").agg(F.sum("_n").alias("_n"))
    rows = added.groupBy("_lang").agg(F.sort_array(F.collect_list(F.struct("_bin", "_n"))).alias("_df")).collect()  # a row per language
    got = {r["_lang"]: np.array([x["_n"] for x in r["_df"]]) for r in rows}
    return {k: int(v[BINS]) for k, v in sorted(got.items())}, sum((v[:BINS] for v in got.values()), np.zeros(BINS, np.int64))


def clusters(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from centres chosen farthest first, so the same rows give the same centroids."""
    centre = [v.mean(axis=0)]
    near = v @ centre[0]
    for _ in range(min(k, len(v)) - 1):
        centre.append(v[int(near.argmin())])
        near = np.maximum(near, v @ centre[-1])
    c = np.array(centre)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([v[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        size = np.linalg.norm(c, axis=1, keepdims=True)
        c = c / np.where(size == 0, 1, size)
    return c


def as_long(similarity, letters):
    """What similarity a text of so many letters would have if it were long."""
    return similarity * np.sqrt((letters + SHORT) / letters)


def fit(docs: DataFrame, id_column: str, text_column: str, lang_column: str, train: Column) -> dict:
    """The classifier: languages, idf, centroids with their languages, and each language's lowest usual similarity."""
    rows = docs.where(train & F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(
        F.col(lang_column).cast("string").alias("_lang"), F.col(text_column).alias("_text"), F.col(id_column).cast("string").alias("_id")
    )
    n, df = document_frequencies(rows.select("_lang", "_text"))
    idf = np.log((1 + sum(n.values())) / (1 + df)) + 0.05
    if not n:
        return {"langs": [], "idf": idf, "centroids": np.zeros((0, BINS)), "owner": np.zeros(0, np.int64), "floor": np.zeros(0)}
    share = F.coalesce(*[F.when(F.col("_lang") == k, min(1.0, SAMPLE / v)) for k, v in n.items()])
    taken = F.pmod(F.xxhash64("_id", F.lit("langid")), F.lit(1 << 30)) < share * (1 << 30)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [counts(t.as_py()) for t in b.column(1)]
            at = [np.flatnonzero(x[0]).astype(np.int32) for x in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x[1] for x in got], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array([x[0][i].astype(np.int32) for x, i in zip(got, at)], pa.list_(pa.int32()))], ["_lang", "_id", "_letters", "_at", "_n"])

    sample = rows.where(taken).mapInArrow(sparse, "_lang string, _id string, _letters long, _at array<int>, _n array<int>").toArrow().sort_by("_id")
    langs, cs, owner, floor = list(n), [], [], []
    for k, lang in enumerate(langs):
        own = [i for i, x in enumerate(sample.column("_lang").to_pylist()) if x == lang]
        dense = np.zeros((len(own), BINS))
        for j, i in enumerate(own):
            dense[j, sample.column("_at")[i].values.to_numpy()] = sample.column("_n")[i].values.to_numpy()
        v, size = vectors(dense, idf), np.array([sample.column("_letters")[i].as_py() for i in own])
        some = v.any(axis=1)
        if not some.all():
            v, size = v[some], size[some]
        del dense
        if not len(v):
            floor.append(0.0)
            continue
        c = clusters(v, CLUSTERS)
        cs.append(c)
        owner += [k] * len(c)
        floor.append(MARGIN * float(np.quantile(as_long((v @ c.T).max(axis=1), size), FEW)))
        del v
    del sample
    give_back(docs.sparkSession)
    return {"langs": langs, "idf": idf, "centroids": np.concatenate(cs) if cs else np.zeros((0, BINS)), "owner": np.array(owner, np.int64), "floor": np.array(floor)}


def predict(docs: DataFrame, model: dict, id_column: str, text_column: str) -> DataFrame:
    """(_id, lang_pred, score, rejected) of every row; the id may be of any type, a whole row, too."""
    model = {k: v.astype(np.float32) if k in ("idf", "centroids") else v for k, v in model.items()}
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BINS x CLUSTERS x languages numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, out = [], [], []
            for k in range(0, len(b), 128):
                part = b.column(1)[k : k + 128]
                got = [counts(t.as_py() or "") for t in part]
                near = vectors(np.array([x[0] for x in got], np.float32), m["idf"]) @ m["centroids"].T
                best = near.argmax(axis=1) if near.shape[1] else None
                for j, (_, n) in enumerate(got):
                    if not n or best is None:
                        langs.append("und")
                        scores.append(0.0)
                        out.append(True)
                        continue
                    own = m["owner"][best[j]]
                    s = float(min(1.0, max(0.0, near[j, best[j]])))
                    langs.append(m["langs"][own])
                    scores.append(s)
                    out.append(bool(as_long(s, n) < m["floor"][own]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_())], ["_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    kind = StructType([rows.schema["_id"], *(StructField(n, t) for n, t in (("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())))])
    return rows.mapInArrow(work, kind)


def identify(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """id, lang_pred, score (cosine to the nearest centroid) and rejected of every row; learns from rows where train holds.

    A null text, or one without a letter, is `und` with score 0 and is rejected, and so is every row if there is
    nothing to learn from. Ties go to the language that sorts first. Other columns, whatever their names, are left
    out; repeated rows give repeated rows, an empty table an empty one. Ids may be null and of any type. A text is
    rejected if it is, for its length, farther from every centroid than what is usual in its language.
    """
    got = predict(docs, fit(docs, id_column, text_column, lang_column, train), id_column, text_column)
    return got.withColumnRenamed("_id", id_column)


def known(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The rows of docs that `identify` doesn't reject, with all their columns; ids may be null or repeated."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(text_column).alias("_text"))
    seen = docs.withColumn("_drawn", F.xxhash64(id_column, text_column))  # null ids don't fall into the sample together
    return predict(rows, fit(seen, "_drawn", text_column, lang_column, train), "_row", "_text").where("not rejected").select("_id.*")
