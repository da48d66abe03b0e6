"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Rows fall into cells (source, language, topic). The cells' token weights are raked in turn to the target marginals
of source, language and topic; a row's probability is its cell's raked weight over its tokens, scaled so that the
largest is 1. Kept tokens then have the raked mix in expectation, and no row has to be repeated. So scaled, the rarest
value decides how much is kept; with `keep`, a share of all tokens is kept instead: no value is given more than it has,
and what its target leaves over goes to the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Targets: a marginal's tokens to this power, made to add up to 1 (1 leaves it as it is, 0 makes its values equal).
POWERS = {"_source": 0.5, "_lang": 0.7, "_topic": 1.0}
ROUNDS, SEED, OTHER = 8, "mix", "unknown"


def topic(text: Column) -> Column:
    """A rough topic by form, from the whole text: code or secrets, tables, shouting, noise, or prose."""
    return (
        F.when(text.rlike("token = |[{};]$|def |return "), "code").when(text.contains(" | "), "table").when(text.contains("!!"), "shouting").when(text.rlike("%%%|&&&|[$]{3}"), "noise").otherwise("prose")
    )


def tokens(text: Column) -> Column:
    """Runs of other characters than blanks, tabs and line ends; a text of none has 1, so that it has a weight."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(F.regexp_replace(text, "[^ \t\n\r]+", "x"), "[ \t\n\r]+", ""))).cast("long")


def marginal(cells: DataFrame, c: str, power: float, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """(c, _sum, _raw): a marginal's values with their tokens and their targets, which needn't add up to 1."""
    if targets and c in targets:
        want = F.coalesce(*[F.when(F.col(c) == k, float(v)) for k, v in targets[c].items()], F.lit(0.0))
    else:
        want = F.pow("_sum", F.lit(float(power)))
    return cells.groupBy(c).agg(F.sum("_tokens").alias("_sum")).select(c, "_sum", want.alias("_raw"))


def rake(cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells with _share, the raked shares of all tokens; targets may fix marginals by value (those without one get 0)."""
    whole = Window.partitionBy(F.lit(1))
    out = cells.withColumn("_share", F.col("_tokens") / F.sum("_tokens").over(whole))
    for c in powers:
        m = marginal(cells, c, powers[c], targets)
        out = out.join(m.select(c, (F.col("_raw") / F.sum("_raw").over(whole)).alias(f"_want{c}")), c)
    for _ in range(rounds):
        for c in powers:
            sums = F.sum("_share").over(Window.partitionBy(c))
            out = out.withColumn("_share", F.when(sums > 0, F.col("_share") * F.col(f"_want{c}") / sums).otherwise(F.lit(0.0)))
    return out.select(*powers, "_tokens", "_share")


def fill(rows: DataFrame, want: str, have: str, budget: Column, name: str) -> DataFrame:
    """rows with `name`: the budget dealt out in proportion to `want`, to no row more than it has; the rest takes what is over."""
    whole = Window.partitionBy(F.lit(1))
    some = F.col(want) > 0
    order = whole.orderBy(F.when(some, F.col(have) / F.col(want)).asc_nulls_last())
    full = F.coalesce(F.sum(F.when(some, F.col(have))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = rows.withColumns({"_full": full, "_rest": F.sum(want).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    got = got.withColumn("_level", F.when(some, (budget - F.col("_full")) / F.col("_rest")))
    # The level at which the first row that isn't full stands is the highest of those that leave their row unfilled.
    level = F.max(F.when(F.col(have) > F.col("_level") * F.col(want), F.col("_level"))).over(whole)
    got = got.withColumn("_level", level)
    return got.withColumn(name, F.when(~some, 0.0).otherwise(F.coalesce(F.least(F.col("_level") * F.col(want), F.col(have)), F.col(have)))).drop("_full", "_rest", "_level")


def budgeted(cells: DataFrame, keep: float, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """Cells with _p, so that `keep` of all tokens are kept in expectation, less only if values with targets hold fewer.

    A value's target is capped at the tokens it has; raking goes on with full cells held at their tokens, so that what
    they can't give comes from other cells of the same values.
    """
    whole = Window.partitionBy(F.lit(1))
    out = cells.withColumns({"_k": F.col("_tokens") * F.lit(float(keep)), "_budget": F.sum("_tokens").over(whole) * F.lit(float(keep))})
    for c in powers:
        m = marginal(cells, c, powers[c], targets).withColumn("_all", F.sum("_sum").over(whole) * F.lit(float(keep)))
        out = out.join(fill(m, "_raw", "_sum", F.col("_all"), f"_want{c}").select(c, f"_want{c}"), c)
    for _ in range(rounds):
        for c in powers:
            sums = F.sum("_k").over(Window.partitionBy(c))
            out = out.withColumn("_k", F.when(sums > 0, F.least(F.col("_k") * F.col(f"_want{c}") / sums, F.col("_tokens"))).otherwise(F.lit(0.0)))
    out = fill(out, "_k", "_tokens", F.col("_budget"), "_k2")
    return out.select(*powers, F.round(F.col("_k2") / F.col("_tokens"), 9).alias("_p"))


def prepare(docs: DataFrame, id_column: str, text_column: str, source_column: str, lang_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    return docs.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(source_column).cast("string"), F.lit(OTHER)).alias("_source"), F.coalesce(F.col(lang_column).cast("string"), F.lit(OTHER)).alias("_lang"),
        topic(text).alias("_topic"), tokens(text).alias("_n"), F.struct("*").alias("_row"),
    )


def probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float | None = None) -> DataFrame:
    """(_source, _lang, _topic, _p): a row per cell."""
    from arbora.llm.common import durable

    cells = durable(rows.groupBy("_source", "_lang", "_topic").agg(F.sum("_n").alias("_tokens")))
    if keep is not None:
        return budgeted(cells, keep, targets=targets)
    raked = rake(cells, targets=targets).withColumn("_factor", F.col("_share") / F.col("_tokens"))
    return raked.select("_source", "_lang", "_topic", F.round(F.col("_factor") / F.max("_factor").over(Window.partitionBy(F.lit(1))), 9).alias("_p"))


def draw(id_column: Column) -> Column:
    """A number in [0, 1) from the id: the same row is always drawn alike."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(SEED)).cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", lang_column: str = "lang", keep: float | None = None) -> DataFrame:
    """All columns of docs as _row, with _source, _lang, _topic, _n (tokens), _p and _kept.

    A null source or language is the value `unknown`, a null or blank text one token of prose. Equal rows are drawn
    alike, null ids as the empty id. An empty table gives an empty one. Only cells are shuffled; their number is that
    of the values' combinations, and rows are joined to them as Spark finds best by their size.

    Without `keep` the largest probability is 1, and one rare value may leave little of a large table. With it, that
    share of the tokens is kept, and rows are drawn by id and text, so that null or repeated ids don't fall together.
    """
    rows = prepare(docs, id_column, text_column, source_column, lang_column)
    drawn = F.col("_id") if keep is None else F.concat_ws(" ", F.col("_id").cast("string"), F.md5(F.coalesce(F.col("_row").getField(text_column), F.lit("")).cast("binary")))
    return rows.join(probabilities(rows.drop("_row"), targets, keep), ["_source", "_lang", "_topic"]).withColumn("_kept", draw(drawn) < F.col("_p"))
