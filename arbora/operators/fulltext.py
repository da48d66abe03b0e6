"""Full-text search: `contains text` selections as columns, an inverted index, and BM25 over it.

A text becomes the array of its tokens; words and phrases become arrays of (first, last) places, and selections and
filters combine these. Everything stays in Spark's own functions but stemming, which is a Pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.functions.library import LIBRARY
from arbora.functions.values import V, one, words
from arbora.plans.parser import QueryError

# The English stop words of the standard analyzer, and BM25's parameters.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
K1, B = 1.2, 0.75


def tokens(text: Column, stop: bool | list[str] = True, case: bool = False) -> Column:
    """Runs of letters and digits, lower-cased unless case, without stop words if stop."""
    out = F.regexp_extract_all(text if case else F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:['’][\p{L}]+)*"), F.lit(0))
    drop = STOP_WORDS if stop is True else stop or []
    return F.filter(out, lambda t: ~F.lower(t).isin(*drop)) if drop else out


#: Latin letters with marks, and the letters below the marks.
_MARKED = {chr(i): unicodedata.normalize("NFD", chr(i))[0] for i in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(i))[0].isascii()}


def without_marks(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "".join(_MARKED), "".join(_MARKED.values())), "[\u0300-\u036f]", "")


def stem(word: str) -> str:
    """The first steps of Porter's algorithm: plurals, -ed, -ing, -y."""
    has_vowel = lambda s: re.search("[aeiou]|[^aeiou]y", s) is not None
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    cut = next((x for x in ("ed", "ing") if word.endswith(x) and has_vowel(word[: -len(x)])), None)
    if cut:
        word = word[: -len(cut)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "lsz":
            word = word[:-1]
        elif re.fullmatch("[^aeiou]+[aeiouy][^aeiouwxy]", word):
            word += "e"
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return word


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(s: pd.Series) -> pd.Series:
    return s.map(lambda ws: None if ws is None else [stem(w) for w in ws])


def places(text: Column, phrase: Column) -> Column:
    """(s, e) of each place where the tokens of phrase stand in a row."""
    n = F.size(phrase)
    first = F.get(phrase, 0)

    def found(t: Column) -> Column:
        at = F.filter(F.transform(t, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
        whole = F.filter(at, lambda i: (n == 1) | (F.slice(t, i + 1, n) == phrase))
        return F.transform(whole, lambda i: F.struct(i.alias("s"), (i + n - 1).alias("e")))

    return F.get(F.transform(F.array(text), found), 0)  # the tokens are made once


def contains(text: Column, selection, compile: Callable[[object], V]) -> Column:
    """Whether a selection of the grammar matches; null text contains nothing."""
    source = F.coalesce(text, F.lit(""))

    def analyzed(c: Column, options: dict) -> Column:
        c = without_marks(c) if options.get("diacritics") == "insensitive" else c
        out = tokens(c, options.get("stop", False) if options.get("stop") else False, options.get("case") == "sensitive")
        return stemmed(out) if options.get("stemming") and str(options.get("language", "")).startswith("en") else out

    def run(node) -> Column:
        kind = node[0]
        if kind == "ftor":
            return run(node[1]) | run(node[2])
        if kind == "ftand":
            return run(node[1]) & run(node[2])
        if kind == "ftnot":
            return ~run(node[1])
        if kind == "ftmild":
            inner, outer = matches(node[1]), matches(node[2])
            return F.exists(inner, lambda p: ~F.exists(outer, lambda q: (q.s <= p.s) & (q.e >= p.e)))
        if kind == "ftfilter":
            return filtered(node)
        if not node[3].get("wildcards"):
            return plain(node)
        return F.size(matches(node)) > 0

    def plain(node) -> Column:
        """Whether words or phrases stand in the text: they are searched in its tokens joined by blanks."""
        each, own, split = phrases(node)
        joined = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
        if split:
            every = F.flatten(F.array(*each))
            test = lambda t: F.contains(joined, F.concat(F.lit(" "), t, F.lit(" ")))
            return F.forall(every, test) if node[2].startswith("all") else F.exists(every, test)
        hits = [F.contains(joined, F.concat(F.lit(" "), F.array_join(p, " "), F.lit(" "))) & (F.size(p) > 0) for p in each]
        return reduce(lambda a, b: a & b if node[2].startswith("all") else a | b, hits)

    def phrases(node) -> tuple[list[Column], Column, bool]:
        _, what, mode, options = node
        items = [compile(x) for x in (what[1] if what[0] == "sequence" else [what])]
        own = analyzed(source, options)
        each = [analyzed(words(v), options) for v in items]
        return each, own, mode in ("any words", "all words")

    def matches(node) -> Column:
        if node[0] in ("ftor", "ftand"):
            return F.concat(matches(node[1]), matches(node[2]))
        if node[0] != "ftwords":
            raise QueryError("XPST0003", "words or phrases are expected here")
        each, own, split = phrases(node)
        wild = node[3].get("wildcards")
        found = []
        for p, v in zip(each, node[1][1] if node[1][0] == "sequence" else [node[1]]):
            if wild and v[0] == "literal":
                pattern = "^" + str(v[1]).lower() + "$"
                at = F.filter(F.transform(own, lambda t, i: F.when(t.rlike(pattern), F.struct(i.alias("s"), i.alias("e")))), lambda x: x.isNotNull())
                found.append(at)
            elif split:
                found.append(F.filter(F.transform(own, lambda t, i, p=p: F.when(F.array_contains(p, t), F.struct(i.alias("s"), i.alias("e")))), lambda x: x.isNotNull()))
            else:
                found.append(places(own, p))
        if node[2].startswith("all"):
            ok = F.forall(F.array(*[F.size(x) > 0 for x in found]), lambda x: x)
            if split:
                ok = F.forall(F.flatten(F.array(*each)), lambda t: F.array_contains(own, t))
            return F.when(ok, F.concat(*found)).otherwise(F.filter(found[0], lambda x: F.lit(False)))
        return F.concat(*found)

    def leaves(node) -> list:
        return [*leaves(node[1]), *leaves(node[2])] if node[0] in ("ftand", "ftor") else [node]

    def filtered(node) -> Column:
        _, inner, options = node
        ok, own = run(inner), tokens(source, False)
        parts = [matches(x) for x in leaves(inner)]
        if inner[0] == "ftwords" and inner[2].startswith("all") and "window" in options:
            parts = [places(own, tokens(words(compile(x)), False)) for x in (inner[1][1] if inner[1][0] == "sequence" else [inner[1]])]
        if options.get("start"):
            ok = ok & F.exists(F.concat(*parts), lambda p: p.s == 0)
        if options.get("end"):
            ok = ok & F.exists(F.concat(*parts), lambda p: p.e == F.size(own) - 1)
        if options.get("entire"):
            ok = ok & F.exists(F.concat(*parts), lambda p: (p.s == 0) & (p.e == F.size(own) - 1))

        def combos(test: Callable[[list[Column]], Column], chosen: list[Column], k: int = 0) -> Column:
            return test(chosen) if k == len(parts) else F.exists(parts[k], lambda p: combos(test, [*chosen, p], k + 1))

        if len(parts) > 1:
            if options.get("ordered"):
                ok = ok & combos(lambda c: F.forall(F.array(*[a.s <= b.s for a, b in zip(c, c[1:])]), lambda x: x), [])
            if "window" in options:
                size = one(compile(options["window"]))
                ok = ok & combos(lambda c: F.greatest(*[p.e for p in c]) - F.least(*[p.s for p in c]) < size, [])
            if "distance" in options:
                how, n = options["distance"][0], one(compile(options["distance"][1]))
                gap = lambda a, b: F.greatest(a.s, b.s) - F.least(a.e, b.e) - 1
                fits = {"exactly": lambda g: g == n, "at least": lambda g: g >= n, "at most": lambda g: g <= n}[how]
                ok = ok & combos(lambda c: F.forall(F.array(*[fits(gap(a, b)) for a, b in zip(c, c[1:])]), lambda x: x), [])
        return ok

    return run(selection)


def function(name: str, args: list[V]) -> V:
    if name == "ft:tokenize":
        return V(tokens(words(args[0])), "string", many=True)
    if name == "ft:stem":
        english = len(args) > 1 and str(args[1].literal).startswith("en")
        return V(F.get(stemmed(F.array(F.lower(words(args[0])))), 0) if english else F.lower(words(args[0])), "string")
    if name == "ft:is-stop-word":
        return V(F.size(tokens(words(args[0]), stop=False)) == 0, "boolean")
    if name in LIBRARY:
        return LIBRARY[name](*args)
    raise QueryError("XPST0017", f"unknown function {name}")


def postings(docs: DataFrame, id_column: str, text_column: str, stop: bool = False) -> DataFrame:
    """The inverted index: (term, doc, tf, positions), positions from 0."""
    flat = docs.select(F.col(id_column).alias("doc"), F.posexplode(tokens(F.coalesce(F.col(text_column), F.lit("")), stop)).alias("pos", "term"))
    return flat.groupBy("term", "doc").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def bm25_of(docs: DataFrame, id_column: str, text_column: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(doc, score) of the documents that hold a term, read from their texts: nothing but a row of sums is shuffled."""
    own = tokens(F.coalesce(F.col(text_column), F.lit("")), False)
    times = lambda t, term: F.size(F.filter(t, lambda w: w == term))
    counted = F.transform(F.array(own), lambda t: F.struct(F.size(t).alias("length"), *[times(t, x).alias(f"t{i}") for i, x in enumerate(terms)]))
    rows = docs.select(F.col(id_column).alias("doc"), F.get(counted, 0).alias("c")).select("doc", "c.*").where("length > 0")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"df{i}") for i in range(len(terms))])

    def score(i: int) -> Column:
        tf, df = F.col(f"t{i}"), F.col(f"df{i}")
        return F.ln((F.col("n") - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    hits = rows.where(reduce(lambda x, y: x | y, [F.col(f"t{i}") > 0 for i in range(len(terms))]))
    return hits.crossJoin(F.broadcast(facts)).select("doc", sum((score(i) for i in range(1, len(terms))), score(0)).alias("score"))


def bm25(index: DataFrame, terms: list[str], k1: float = K1, b: float = B, documents: int | None = None) -> DataFrame:
    """(doc, score) of the documents that hold a term; documents: their number, if some are empty."""
    lengths = index.groupBy("doc").agg(F.sum("tf").alias("length"))
    facts = lengths.agg((F.lit(documents) if documents is not None else F.count(F.lit(1))).alias("n"), F.avg("length").alias("mean"))
    hits = index.where(F.col("term").isin(*terms)).select("term", "doc", "tf")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    score = F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return hits.join(df, "term").join(lengths, "doc").crossJoin(facts).groupBy("doc").agg(F.sum(score).alias("score"))
