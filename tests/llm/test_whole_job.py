"""Places where an operator or the pipeline once did less than its whole job."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from arbora.llm import html, lmscore, mixing  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("ba ce di fo gu ly".split()) for _ in range(r.randint(2, 4))) for _ in range(n))


def test_mix_keeps_its_share_with_a_rare_source(spark):
    import corpus_pipeline

    r = random.Random(2)
    rows = [(i, words(r, r.randint(5, 60)), r.choice(["en", "en", "fr"]), r.choice(["hot"] * 5 + ["a", "b"]), 0) for i in range(5000)]
    rows += [(5000, words(r, 20), "en", "rare", 0), (5001, words(r, 20), None, None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df, keep=0.65).select("_source", "_lang", "_n", "_p").collect()
    assert len(got) == len(rows) and all(0 < x["_p"] <= 1 for x in got)
    n, kept = sum(x["_n"] for x in got), sum(x["_n"] * x["_p"] for x in got)
    assert abs(kept / n - 0.65) < 1e-6
    assert all(x["_p"] > 0.5 for x in got if x["_source"] in ("rare", "unknown"))
    # a and b are short of their targets and kept whole; languages have theirs
    share = {v: sum(x["_n"] * x["_p"] for x in got if x["_lang"] == v) / kept for v in ("en", "fr")}
    sums = {v: sum(x["_n"] for x in got if x["_lang"] == v) for v in ("en", "fr")}
    assert abs(share["en"] / share["fr"] - (sums["en"] / sums["fr"]) ** 0.7) < 0.05
    left = corpus_pipeline.mix(spark, df, "").count()
    assert 0.6 * len(rows) < left < 0.7 * len(rows)


def test_mix_budget_is_exact_and_targets_hold(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(i, words(r, 20), "en", r.choice(["x", "x", "x", "y"]), 0) for i in range(2000)], DOCS)
    for keep in (0.1, 0.4, 1.0):
        got = mixing.mix(df, keep=keep).groupBy("_source").agg(F.sum(F.col("_n") * F.col("_p")).alias("k"), F.sum("_n").alias("n")).collect()
        assert abs(sum(x["k"] for x in got) / sum(x["n"] for x in got) - keep) < 1e-6
    fixed = {x["_source"]: x["k"] for x in mixing.mix(df, keep=0.4, targets={"_source": {"x": 0.5, "y": 0.5}}).groupBy("_source").agg(F.sum(F.col("_n") * F.col("_p")).alias("k")).collect()}
    assert abs(fixed["x"] / fixed["y"] - 1) < 1e-6
    none = {x["_source"]: x["p"] for x in mixing.mix(df, keep=0.4, targets={"_source": {"x": 1.0}}).groupBy("_source").agg(F.max("_p").alias("p")).collect()}
    assert none["y"] == 0 and none["x"] > 0.4
    assert mixing.mix(df.where("false"), keep=0.65).count() == 0


def test_pipeline_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    texts = [words(r, 60) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts[:20])] + [(None, t) for t in texts[20:40]] + [(i // 4, t) for i, t in enumerate(texts[40:])]
    rows += [(None, texts[0]), (3, texts[3]), (77, texts[25]), (None, texts[21])]  # copies
    odd = [(None, "123"), (5, ""), (None, None)]  # no letter; 5 has other rows that stay
    df = spark.createDataFrame([(*x, "en", "s", 0) for x in rows + odd], DOCS)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.language(spark, df, "")
    assert kept.schema.names == df.schema.names
    plain = lambda d: sorted(((x["doc_id"], x["text"]) for x in d.collect()), key=str)
    assert plain(kept) == sorted(rows, key=str)
    one = corpus_pipeline.near_dedup(spark, kept, "")
    want = [x for x in rows[:60] if x[1] != texts[25]] + [(77, texts[25])]
    assert plain(one) == sorted(want, key=str)
    mixed = corpus_pipeline.mix(spark, one, "")
    without = mixed.where("doc_id is null").count()
    assert 0 < without < one.where("doc_id is null").count()
    assert corpus_pipeline.encode(spark, mixed, "").count() == mixed.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-header", "layout no-comments", "page-sidebar", "related-wrapper", "main-footer-wrap"])
def test_an_article_stays_in_a_wrapper_with_such_a_name(name):
    text = "The ferry was late, and the crew told us at length why it had been held up by the tide and the wind. " * 4
    inside = f"<h1>Ferry</h1><p>{text}</p><p>{text}</p>"
    side = "<div class='sidebar'><p>Other stories that you may like to read</p></div><div class='comments'><p>First! What a long wait.</p></div>"
    for body in (inside, f"<article>{inside}</article>"):
        got = html.extract(f"<html><body><div class='{name}'>{body}{side}</div><footer>About us</footer></body></html>", None)
        assert got.split("\n") == ["Ferry", text.strip(), text.strip()]


def test_scores_tell_running_text_from_shuffled(spark):
    r = random.Random(12)
    vocabulary = words(r, 120).split()
    follows = {w: r.sample(vocabulary, 4) for w in vocabulary}

    def running(n: int) -> list[str]:
        out = [r.choice(vocabulary)]
        while len(out) < n:
            out.append(r.choice(follows[out[-1]]))
        return out

    held = [running(50) for _ in range(20)]
    rows = [(i, " ".join(running(50)), True) for i in range(300)] + [(1000 + i, " ".join(w), False) for i, w in enumerate(held)]
    rows += [(2000 + i, " ".join(r.sample(w, len(w))), False) for i, w in enumerate(held)]
    got = {x["doc_id"]: x for x in lmscore.score(spark.createDataFrame(rows, "doc_id long, text string, train boolean"), F.col("train")).collect()}
    for i in range(20):
        assert abs(got[1000 + i]["base_score"] - got[2000 + i]["base_score"]) < 1e-6
    fluent, mixed = (sum(got[k + i]["score"] for i in range(20)) for k in (1000, 2000))
    assert fluent > 0.6 * mixed and fluent > 0.6 * sum(got[1000 + i]["base_score"] for i in range(20))
    print("fluent, shuffled, unigram:", fluent, mixed, sum(got[1000 + i]["base_score"] for i in range(20)))


def test_fitting_holds_a_language_once():
    """The sample's vectors take the place of their counts: what is held beside them is small."""
    import tracemalloc

    from arbora.llm import langid

    n = np.random.default_rng(3).integers(0, 4, (800, langid.BINS)).astype(np.float64)
    idf = np.linspace(0.1, 5, langid.BINS)
    want = np.log1p(n[:5]) * idf
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    tracemalloc.start()
    got = langid.vectors(n, idf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[:5], want) and peak < 0.2 * got.nbytes


def test_the_driver_gives_memory_back(spark, monkeypatch):
    from arbora.llm import common

    assert common.give_back(spark) and not common.give_back()
    given = []
    monkeypatch.setattr(common, "give_back", lambda s: given.append(s))
    assert common.durable(spark.range(3)).count() == 3 and given == [spark]
