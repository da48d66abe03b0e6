"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import ann, bpe, capdedup, html, langid, lmscore, minhash, mixing, sharding, tokens
from arbora.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, tokens, probability, and whether it is sampled."""
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_n").alias("n_tokens"), F.round("_p", 6).alias("p"), F.col("_kept").alias("kept"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = langid.identify(docs, remainder(F.col("doc_id"), 4) != 2)
    return got.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) != 1, reach=4)


def op10_cap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Query]:
    every = (op1_token_counts, op2_nearest_neighbours, op3_main_text, op4_mix, op5_language, op6_shards, op7_near_duplicates, op8_byte_bpe, op9_lm_score, op10_cap_dedup)
    return {f.__name__: f for f in every}


def _mix_sql() -> str:
    """The same raking in SQL: one common table expression per step."""
    steps, last = [], "w0"
    for k in range(mixing.ROUNDS):
        for c in mixing.POWERS:
            own = f"w{k}{c}"
            steps.append(f"{own} as (select w.* replace (case when sum(share) over (partition by {c[1:]}) > 0 then share * want{c} / sum(share) over (partition by {c[1:]}) else 0 end as share) from {last} w)")
            last = own
    marginals = ", ".join(f"m{c} as (select {c[1:]}, pow(sum(tokens), {p!r}) / sum(pow(sum(tokens), {p!r})) over () as want{c} from cells group by {c[1:]})" for c, p in mixing.POWERS.items())
    joins = " ".join(f"join m{c} using ({c[1:]})" for c in mixing.POWERS)
    return f"""
with docs as (
  select doc_id, coalesce(source, 'unknown') as source, coalesce(lang, 'unknown') as lang, coalesce(text, '') as t,
    greatest(1, len(regexp_replace(regexp_replace(t, '[^ \\t\\n\\r]+', 'x', 'g'), '[ \\t\\n\\r]+', '', 'g'))) as n_tokens,
    case when regexp_matches(t, 'token = |[{{}};]$|def |return ') then 'code' when contains(t, ' | ') then 'table'
      when contains(t, '!!') then 'shouting' when regexp_matches(t, '%%%|&&&|[$]{{3}}') then 'noise' else 'prose' end as topic
  from documents),
cells as (select source, lang, topic, sum(n_tokens)::double as tokens from docs group by all),
{marginals},
w0 as (select cells.*, tokens / sum(tokens) over () as share, want_source, want_lang, want_topic from cells {joins}),
{", ".join(steps)},
p as (select source, lang, topic, round((share / tokens) / max(share / tokens) over (), 9) as p from {last})
select doc_id, source, lang, topic, n_tokens, round(p, 6) as p,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '{mixing.SEED}'), 1, 8))::bigint / 4294967296.0 < p as kept
from docs join p using (source, lang, topic)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mix": _mix_sql()}
