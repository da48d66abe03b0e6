"""Item windows of the language: tumbling and sliding, bounded by conditions on items, over one sequence's array.

A window over a collection needs its items together and in order; partition first (group by) to bound a sequence. For
windows over large tables whose boundary depends on neighbouring rows only, `islands` numbers them without gathering.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.functions.values import V, ebv, seq


def numbered(df: DataFrame, order: list[Column], item: Column, name: str) -> DataFrame:
    """One row with the array of all items in order."""
    rows = df.select(F.row_number().over(Window.orderBy(*order)).alias("p"), item.alias("v"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda e: e.v).alias(name))


def ranges(items: Column, starts: Callable, ends: Callable | None, sliding: bool, only: bool) -> Column:
    """The array of (s, e), the places from 0 of each window's first and last item.

    An unclosed window ends with the last item, or is dropped with `only end`. A tumbling window starts at the first
    item after the last window's end that fulfils the start; without an end condition, it ends before the next start.
    """
    n = F.size(items)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    opening = F.filter(at, lambda i: starts(items, i))
    span = "array<struct<s:int,e:int>>"
    if ends is None:
        if sliding:
            return F.transform(opening, lambda i: F.struct(i.alias("s"), (n - 1).alias("e")))
        return F.transform(opening, lambda i, k: F.struct(i.alias("s"), F.coalesce(F.get(opening, k + 1) - 1, n - 1).alias("e")))

    def closing(i: Column) -> Column:
        found = F.get(F.filter(at, lambda j: (j >= i) & ends(items, i, j)), 0)
        return found if only else F.coalesce(found, n - 1)

    every = F.filter(F.transform(opening, lambda i: F.struct(i.alias("s"), closing(i).alias("e"))), lambda w: w.e.isNotNull())
    if sliding:
        return every
    last = lambda acc: F.coalesce(F.element_at(acc, -1).getField("e"), F.lit(-1))
    return F.aggregate(every, F.array().cast(span), lambda acc, w: F.when((F.size(acc) == 0) | (w.s > F.when(F.size(acc) > 0, last(acc)).otherwise(F.lit(-1))), F.concat(acc, F.array(w).cast(span))).otherwise(acc))


def islands(df: DataFrame, partition: list[str], order: list[str], starts: Callable[[Callable[[str], Column]], Column], name: str = "window_id") -> DataFrame:
    """Numbers tumbling windows from 1 within each partition: starts gets a function that gives a column's previous value."""
    w = Window.partitionBy(*partition).orderBy(*order)
    flag = F.coalesce(starts(lambda c: F.lag(c).over(w)), F.lit(False))
    flagged = df.withColumn("#start", (flag | (F.row_number().over(w) == 1)).cast("int"))
    return flagged.withColumn(name, F.sum("#start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("#start")


def partition(v: V, f: V) -> V:
    """Runs of items for which the predicate has one value, as arrays."""
    items = seq(v)
    n = F.size(items)
    at = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    test = lambda i: ebv(f.call(v.of(F.get(items, i), many=False)))
    opening = F.filter(at, lambda i: (i == 0) | (test(i) != test(i - 1)))
    runs = F.transform(opening, lambda i, k: F.slice(items, i + 1, F.coalesce(F.get(opening, k + 1), n) - i))
    return V(runs, "array", many=True, member=v.type)
