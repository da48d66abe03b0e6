"""The function library: name to a builder of columns. Built from Spark's own functions wherever they can say it."""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Callable
from urllib.parse import quote, urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from arbora.functions.values import NUMERIC, SPARK, V, ebv, number, one, seq, text, words
from arbora.plans.parser import QueryError

LIBRARY: dict[str, Callable[..., V]] = {}
CODEPOINT = "http://www.w3.org/2005/xpath-functions/collation/codepoint"
#: Spark collations of the language's collation URIs, and named characters.
COLLATIONS = {
    CODEPOINT: "UTF8_BINARY",
    "http://www.w3.org/2005/xpath-functions/collation/html-ascii-case-insensitive": "UTF8_LCASE",
    "http://www.w3.org/2010/09/qt-fn/collation/caseblind": "UTF8_LCASE",
    "http://www.w3.org/2013/collation/UCA": "UNICODE",
    "http://www.w3.org/2013/collation/UCA?strength=primary": "UNICODE_CI_AI",
    "http://www.w3.org/2013/collation/UCA?strength=secondary": "UNICODE_CI",
}
CHARACTERS = {"tab": "\t", "newline": "\n", "return": "\r", "space": " ", "nbsp": "\xa0", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "euro": "€", "pound": "£", "hellip": "…", "mdash": "—", "ndash": "–"}


def fn(*names: str):
    def put(f):
        for name in names:
            LIBRARY[name if ":" in name else f"fn:{name}"] = f
        return f

    return put


def string(c: Column) -> V:
    return V(c, "string")


def integer(c: Column) -> V:
    return V(c.cast("bigint"), "integer")


def boolean(c: Column) -> V:
    return V(c, "boolean")


def fixed(v: V, what: str):
    if v.literal is None:
        raise QueryError("XPST0017", f"{what} has to be a literal")
    return v.literal


def collated(c: Column, collation: V | None) -> Column:
    if collation is None:
        return c
    uri = str(fixed(collation, "a collation"))
    if uri not in COLLATIONS:
        raise QueryError("FOCH0002", f"unknown collation {uri}")
    return F.collate(c, COLLATIONS[uri])


def items(v: V, c: Column, kind: str | None = None) -> V:
    return V(c, kind or v.type, many=True, fields=v.fields, member=v.member)


def each(f: V, v: V) -> Callable[[Column], Column]:
    """A function item as a lambda over one item of v."""
    return lambda c: one(f.call(V(c, v.type, fields=v.fields and {k: x.of(c.getField(k)) for k, x in v.fields.items()}, member=v.member)))


def result(f: V, *args: V) -> V:
    return f.call(*[V(F.lit(None).cast(SPARK.get(a.type, "string")), a.type, fields=a.fields, member=a.member) for a in args])


def single(v: V) -> V:
    return V(None, v.type, fields=v.fields, member=v.member)


def half_up(c: Column) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(c + F.lit(0.5))


def guard(c: Column, bad: Column, code: str, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(f"[{code}] {message}"))).otherwise(c)


# strings ------------------------------------------------------------------------------------------------------
fn("string")(lambda v: string(words(v)))
fn("string-length")(lambda v: integer(F.char_length(words(v))))
fn("upper-case")(lambda v: string(F.upper(words(v))))
fn("lower-case")(lambda v: string(F.lower(words(v))))
fn("concat")(lambda *v: string(F.concat(*map(words, v))))
fn("contains")(lambda a, b, c=None: boolean(F.contains(collated(words(a), c), collated(words(b), c))))
fn("starts-with")(lambda a, b, c=None: boolean(F.startswith(collated(words(a), c), collated(words(b), c))))
fn("ends-with")(lambda a, b, c=None: boolean(F.endswith(collated(words(a), c), collated(words(b), c))))
fn("normalize-space")(lambda v: string(F.trim(F.regexp_replace(words(v), "[ \t\r\n]+", " "))))
fn("translate")(lambda a, b, c: string(F.call_function("translate", words(a), words(b), words(c))))
fn("substring-before")(lambda a, b: string(F.when((F.length(words(b)) > 0) & F.contains(words(a), words(b)), F.left(words(a), F.position(words(b), words(a)) - 1)).otherwise("")))
fn("substring-after")(lambda a, b: string(F.when(F.contains(words(a), words(b)), F.substr(words(a), F.position(words(b), words(a)) + F.char_length(words(b)))).otherwise("")))
fn("codepoint-equal")(lambda a, b: boolean(text(a) == text(b)))
fn("default-collation")(lambda: V(F.lit(CODEPOINT), "string", literal=CODEPOINT))
fn("default-language")(lambda: V(F.lit("en"), "string", literal="en"))
fn("string-to-codepoints")(lambda v: items(v, F.transform(F.filter(F.split(words(v), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")), "integer"))
fn("characters")(lambda v: items(v, F.filter(F.split(words(v), ""), lambda c: c != ""), "string"))
fn("codepoint")(lambda v: integer(guard(F.ascii(words(v)), words(v) == "", "FOCH0004", "empty string")))
fn("encode-for-uri")(lambda v: string(F.replace(F.replace(F.replace(F.url_encode(words(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))))


@fn("string-join")
def string_join(v: V, sep: V | None = None) -> V:
    return string(F.array_join(F.transform(seq(v), lambda c: words(V(c, v.type))), words(sep) if sep and sep.literal is None else (sep.literal if sep else "")))


@fn("compare")
def compare(a: V, b: V, c: V | None = None) -> V:
    x, y = collated(text(a), c), collated(text(b), c)
    return integer(F.when(x < y, -1).when(x == y, 0).when(x > y, 1))


@fn("substring")
def substring(v: V, start: V, length: V | None = None) -> V:
    s = half_up(number(start))
    first = F.greatest(s, F.lit(1))
    if length is None:
        return string(F.when(F.isnan(number(start)), "").otherwise(F.substr(words(v), first.cast("int"))))
    n = s + half_up(number(length)) - first
    return string(F.when(F.isnan(number(start)) | F.isnan(number(length)) | (n <= 0), "").otherwise(F.substr(words(v), first.cast("int"), n.cast("int"))))


def pattern(p: V, flags: V | None = None) -> str:
    """A literal pattern in Java's syntax."""
    out, f = str(fixed(p, "a pattern")), str(fixed(flags, "flags")) if flags else ""
    if set(f) - set("smixq"):
        raise QueryError("FORX0001", f"invalid flags {f!r}")
    if "q" in f:
        return ("(?i)" if "i" in f else "") + re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", out)
    out = re.sub(r"\[([^\]\[]*)-\[([^\]\[]*)\]\]", r"[\1&&[^\2]]", out)  # class subtraction
    out = out.replace(r"\i", r"[\p{L}_:]").replace(r"\c", r"[\p{L}\p{N}._:\-]")
    return "".join(f"(?{x})" for x in "smix" if x in f) + out


def no_empty_match(p: str) -> str:
    try:
        if re.match(re.sub(r"\\p\{[^}]*\}", "x", p).replace("&&", "") + r"\Z", ""):
            raise QueryError("FORX0003", "the pattern matches the empty string")
    except re.error:
        pass
    return p


fn("matches")(lambda v, p, f=None: boolean(F.rlike(words(v), F.lit(pattern(p, f)))))


@fn("replace")
def replace_(v: V, p: V, r: V, flags: V | None = None) -> V:
    own = str(fixed(r, "a replacement"))
    if flags is not None and "q" in str(flags.literal):
        own = own.replace("\\", "\\\\").replace("$", "\\$")
    return string(F.regexp_replace(words(v), F.lit(no_empty_match(pattern(p, flags))), F.lit(own)))


@fn("tokenize")
def tokenize(v: V, p: V | None = None, flags: V | None = None) -> V:
    if p is None:
        s = F.trim(F.regexp_replace(words(v), "[ \t\r\n]+", " "))
        return items(v, F.filter(F.split(s, " "), lambda c: c != ""), "string")
    out = F.split(words(v), no_empty_match(pattern(p, flags)), -1)
    return items(v, F.when(words(v) == "", F.array().cast("array<string>")).otherwise(out), "string")


@fn("contains-token")
def contains_token(v: V, t: V, c: V | None = None) -> V:
    own = F.trim(words(t))
    return boolean((own != "") & F.exists(seq(v), lambda s: F.exists(F.split(F.trim(s), "[ \t\r\n]+"), lambda x: collated(x, c) == own)))


def mapped(f: Callable[[str], object], kind: str = "string"):
    """A function that Spark has no counterpart of, over Arrow batches."""

    @F.pandas_udf(kind)
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    return udf


@fn("iri-to-uri")
def iri_to_uri(v: V) -> V:
    return string(mapped(lambda s: "".join(c if 0x20 < ord(c) < 0x7F and c not in '<>"{}|\\^`' else quote(c, safe="") for c in s))(words(v)))


@fn("escape-html-uri")
def escape_html_uri(v: V) -> V:
    return string(mapped(lambda s: "".join(c if 0x20 <= ord(c) < 0x7F else quote(c, safe="") for c in s))(words(v)))


@fn("normalize-unicode")
def normalize_unicode(v: V, form: V | None = None) -> V:
    own = str(form.literal).strip().upper() if form else "NFC"
    if own not in ("", "NFC", "NFD", "NFKC", "NFKD"):
        raise QueryError("FOCH0003", f"unsupported form {own}")
    return string(mapped(lambda s: unicodedata.normalize(own, s) if own else s)(words(v)))


@fn("graphemes")
def graphemes(v: V) -> V:
    return items(v, mapped(lambda s: re.findall(r".(?:[\u0300-\u036f\u200d\ufe0f]|(?<=\u200d).)*", s, re.S), "array<string>")(words(v)), "string")


@fn("codepoints-to-string")
def codepoints_to_string(v: V) -> V:
    @F.pandas_udf("string")
    def join(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(map(chr, x)))

    return string(join(seq(v)))


@fn("char")
def char(v: V) -> V:
    name = str(fixed(v, "a character's name"))
    if re.fullmatch("[0-9A-Fa-f]+", name):
        return string(F.lit(chr(int(name, 16))))
    if name.lower() not in CHARACTERS:
        raise QueryError("FOCH0005", f"no character {name}")
    return string(F.lit(CHARACTERS[name.lower()]))


@fn("collation-key")
def collation_key(v: V, c: V | None = None) -> V:
    s = words(v) if c is None or COLLATIONS.get(str(c.literal)) == "UTF8_BINARY" else F.lower(words(v))
    return V(F.encode(s, "UTF-32"), "base64Binary")


# numbers ------------------------------------------------------------------------------------------------------
def numeric(v: V) -> V:
    return v if v.type in NUMERIC and not v.many else V(number(v) if v.type not in NUMERIC else one(v), v.type if v.type in NUMERIC else "double")


fn("abs")(lambda v: V(F.abs(numeric(v).col), numeric(v).type))
fn("ceiling")(lambda v: V(F.ceil(numeric(v).col).cast(SPARK[numeric(v).type]), numeric(v).type))
fn("floor")(lambda v: V(F.floor(numeric(v).col).cast(SPARK[numeric(v).type]), numeric(v).type))
fn("number")(lambda v: V(F.coalesce(number(v), F.lit(float("nan"))), "double"))
fn("is-NaN")(lambda v: boolean(F.isnan(one(v))))
fn("divide-decimals")(lambda a, b, s: V(F.round(guard(one(a).cast("decimal(38,18)"), one(b) == 0, "FOAR0002", "division by zero") / one(b).cast("decimal(38,18)"), int(fixed(s, "a scale"))).cast(SPARK["decimal"]), "decimal"))


@fn("round")
def round_(v: V, p: V | None = None) -> V:
    n = numeric(v)
    if n.type == "integer" and p is None:
        return n
    places = int(fixed(p, "a precision")) if p else 0
    if n.type in ("double", "float"):
        scale = F.lit(10.0**places)
        c = F.floor(n.col * scale + 0.5).cast("double") / scale
        return V(F.when(F.isnan(n.col) | (F.abs(n.col) == float("inf")) | (F.abs(n.col) > 1e15), n.col).otherwise(c).cast(SPARK[n.type]), n.type)
    c = n.col.cast("decimal(38,18)")
    c = F.round(c, places) + F.when((c < 0) & (F.round(c, places) - c == F.lit(-0.5).cast("decimal(38,18)") * F.lit(10**-places if places > 0 else 10 ** abs(places)).cast("decimal(38,18)")), F.lit(10**-places if places > 0 else 10 ** abs(places)).cast("decimal(38,18)")).otherwise(0)
    return V(c.cast(SPARK[n.type]), n.type)


@fn("round-half-to-even")
def round_half_to_even(v: V, p: V | None = None) -> V:
    n = numeric(v)
    return V(F.bround(n.col, int(fixed(p, "a precision")) if p else 0).cast(SPARK[n.type]), n.type)


def scalar(f: Callable[..., Column]):
    return lambda *v: V(f(*[number(x) for x in v]), "double")


def log_of(f: Callable[[Column], Column]):
    return lambda c: F.when(c == 0, F.lit(-math.inf)).when(c < 0, F.lit(math.nan)).otherwise(f(c))


for name, f in {
    "pi": lambda: F.pi(), "e": lambda: F.e(), "exp": F.exp, "exp10": lambda c: F.pow(F.lit(10.0), c), "log": log_of(F.ln), "log10": log_of(F.log10), "pow": F.pow, "sqrt": F.sqrt,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2,
}.items():
    fn(f"math:{name}")(scalar(f))


@fn("count")
def count(v: V) -> V:
    return integer(F.size(seq(v)))


def total(v: V) -> Column:
    kind = v.type if v.type in NUMERIC else "double"
    return F.aggregate(F.transform(seq(v), lambda c: number(V(c, v.type)) if v.type not in NUMERIC else c.cast(SPARK[kind])), F.lit(0).cast(SPARK[kind]), lambda a, x: (a + x).cast(SPARK[kind]))


@fn("sum")
def sum_(v: V, zero: V | None = None) -> V:
    kind = v.type if v.type in NUMERIC else "double"
    out = total(v)
    return V(out if zero is None else F.when(F.size(seq(v)) == 0, one(zero)).otherwise(out), kind)


@fn("avg")
def avg(v: V) -> V:
    kind = "decimal" if v.type in ("integer", "decimal") else "double"
    c = total(v)
    return V(F.when(F.size(seq(v)) > 0, (c.cast("decimal(28,8)") / F.size(seq(v)).cast("decimal(28,8)")).cast("decimal(38,18)") if kind == "decimal" else c / F.size(seq(v))), kind)


@fn("min")
def min_(v: V, c: V | None = None) -> V:
    out = F.array_min(seq(v)) if c is None else F.reduce(seq(v), F.get(seq(v), 0), lambda a, x: F.when(collated(x, c) < collated(a, c), x).otherwise(a))
    return V(F.when(F.exists(seq(v), F.isnan), F.lit(math.nan)).otherwise(out) if v.type == "double" else out, v.type)


@fn("max")
def max_(v: V, c: V | None = None) -> V:
    return V(F.array_max(seq(v)) if c is None else F.reduce(seq(v), F.get(seq(v), 0), lambda a, x: F.when(collated(x, c) > collated(a, c), x).otherwise(a)), v.type)


# booleans -----------------------------------------------------------------------------------------------------
fn("true")(lambda: V(F.lit(True), "boolean", literal=True))
fn("false")(lambda: V(F.lit(False), "boolean", literal=False))
fn("not")(lambda v: boolean(~ebv(v)))
fn("boolean")(lambda v: boolean(ebv(v)))

# sequences ----------------------------------------------------------------------------------------------------
fn("empty")(lambda v: boolean(F.size(seq(v)) == 0))
fn("exists")(lambda v: boolean(F.size(seq(v)) > 0))
fn("head")(lambda v: v.of(F.get(seq(v), 0), many=False))
fn("foot")(lambda v: v.of(F.try_element_at(seq(v), F.lit(-1)), many=False))
fn("tail")(lambda v: items(v, F.slice(seq(v), F.lit(2), F.greatest(F.size(seq(v)) - 1, F.lit(0)))))
fn("trunk")(lambda v: items(v, F.slice(seq(v), F.lit(1), F.greatest(F.size(seq(v)) - 1, F.lit(0)))))
fn("reverse")(lambda v: items(v, F.reverse(seq(v))))
fn("distinct-values")(lambda v, c=None: items(v, F.array_distinct(seq(v)) if c is None else F.filter(seq(v), lambda x, i: ~F.exists(F.slice(seq(v), F.lit(1), i), lambda y: collated(y, c) == collated(x, c)))))
fn("distinct-ordered")(lambda v: items(v, F.array_distinct(seq(v))))
fn("identity", "unordered", "pin", "trace")(lambda v, *rest: v)
fn("void")(lambda v=None: V(F.array().cast("array<string>"), "string", many=True))
fn("zero-or-one")(lambda v: v.of(guard(F.get(seq(v), 0), F.size(seq(v)) > 1, "FORG0003", "more than one item"), many=False))
fn("exactly-one")(lambda v: v.of(guard(F.get(seq(v), 0), F.size(seq(v)) != 1, "FORG0005", "not exactly one item"), many=False))
fn("one-or-more")(lambda v: items(v, guard(seq(v), F.size(seq(v)) == 0, "FORG0004", "no item")))
fn("remove")(lambda v, p: items(v, F.filter(seq(v), lambda x, i: i + 1 != one(p))))
fn("replicate")(lambda v, n: items(v, F.flatten(F.array_repeat(seq(v), one(n).cast("int")))))
fn("all-equal", "uniform")(lambda v: boolean(F.size(F.array_distinct(F.transform(seq(v), lambda c: text(V(c, v.type))))) <= 1))
fn("all-different")(lambda v: boolean(F.size(F.array_distinct(F.transform(seq(v), lambda c: text(V(c, v.type))))) == F.size(seq(v))))
fn("deep-equal")(lambda a, b, c=None: boolean(F.coalesce(seq(a).eqNullSafe(seq(b)), F.lit(False))))
fn("atomic-equal")(lambda a, b: boolean(F.lit(a.type == b.type) & one(a).eqNullSafe(one(b))))
fn("starts-with-subsequence")(lambda a, b: boolean((F.size(seq(b)) == 0) | (F.slice(seq(a), F.lit(1), F.size(seq(b))) == seq(b))))
fn("ends-with-subsequence")(lambda a, b: boolean((F.size(seq(b)) == 0) | (F.slice(F.reverse(seq(a)), F.lit(1), F.size(seq(b))) == F.reverse(seq(b)))))
fn("contains-subsequence")(lambda a, b: boolean((F.size(seq(b)) == 0) | F.exists(F.sequence(F.lit(1), F.greatest(F.size(seq(a)), F.lit(1))), lambda i: F.slice(seq(a), i, F.size(seq(b))) == seq(b))))


@fn("insert-before")
def insert_before(v: V, p: V, more: V) -> V:
    at = F.least(F.greatest(one(p).cast("int"), F.lit(1)), F.size(seq(v)) + 1)
    return items(v, F.concat(F.slice(seq(v), F.lit(1), at - 1), seq(more), F.slice(seq(v), at, F.size(seq(v)))))


@fn("subsequence")
def subsequence(v: V, start: V, length: V | None = None) -> V:
    s = half_up(number(start))
    end = F.lit(math.inf) if length is None else s + half_up(number(length))
    return items(v, F.filter(seq(v), lambda x, i: (i + 1 >= s) & (i + 1 < end) & ~F.isnan(number(start))))


def positions(v: V, test: Callable[[Column], Column]) -> V:
    at = F.transform(seq(v), lambda x, i: F.when(test(x), (i + 1).cast("bigint")))
    return V(F.filter(at, lambda x: x.isNotNull()), "integer", many=True)


@fn("index-of")
def index_of(v: V, what: V, c: V | None = None) -> V:
    if (v.type in NUMERIC) != (what.type in NUMERIC):
        return V(F.array().cast("array<bigint>"), "integer", many=True)
    return positions(v, lambda x: (collated(x, c) == one(what)) & (~F.isnan(x) if v.type in ("double", "float") else F.lit(True)))


fn("index-where")(lambda v, f: positions(v, lambda x: ebv(f.call(single(v).of(x)))))
fn("items-at")(lambda v, p: items(v, F.filter(F.transform(seq(p), lambda i: F.get(seq(v), (i - 1).cast("int"))), lambda x: x.isNotNull())))
fn("duplicate-values")(lambda v: items(v, F.filter(seq(v), lambda x, i: F.size(F.filter(F.slice(seq(v), F.lit(1), i + 1), lambda y: y == x)) == 2)))
fn("insert-separator")(lambda v, s: items(v, F.flatten(F.transform(seq(v), lambda x, i: F.when(i == 0, F.array(x)).otherwise(F.concat(seq(s), F.array(x)))))))
fn("intersperse")(LIBRARY["fn:insert-separator"])


@fn("slice")
def slice_(v: V, start: V | None = None, end: V | None = None, step: V | None = None) -> V:
    n = F.size(seq(v))
    by = F.coalesce(one(step), F.lit(1)).cast("int") if step and step.col is not None else F.lit(1)

    def place(x: V | None, default: Column) -> Column:
        if x is None or x.col is None:
            return default
        c = F.coalesce(one(x).cast("int"), default)
        return F.when(c < 0, n + 1 + c).when(c == 0, default).otherwise(c)

    a, b = place(start, F.when(by < 0, n).otherwise(F.lit(1))), place(end, F.when(by < 0, F.lit(1)).otherwise(n))
    at = F.when((n == 0) | ((b - a) * by < 0), F.array().cast("array<int>")).otherwise(F.sequence(a, b, by))
    return items(v, F.filter(F.transform(at, lambda i: F.when((i >= 1) & (i <= n), F.get(seq(v), i - 1))), lambda x: x.isNotNull()))


# functions of functions ---------------------------------------------------------------------------------------
@fn("for-each")
def for_each(v: V, f: V) -> V:
    kind = result(f, single(v))
    if kind.many:
        return items(kind, F.flatten(F.transform(seq(v), lambda c: f.call(single(v).of(c)).col)))
    return V(F.filter(F.transform(seq(v), each(f, v)), lambda x: x.isNotNull()), kind.type, many=True, fields=kind.fields, member=kind.member)


fn("filter")(lambda v, f: items(v, F.filter(seq(v), lambda c: ebv(f.call(single(v).of(c))))))
fn("some")(lambda v, f=None: boolean(F.exists(seq(v), lambda c: ebv(f.call(single(v).of(c)) if f else single(v).of(c)))))
fn("every")(lambda v, f=None: boolean(F.forall(seq(v), lambda c: ebv(f.call(single(v).of(c)) if f else single(v).of(c)))))


def fold(v: Column, item: V, zero: V, f: Callable[[V, V], V]) -> V:
    kind = f(V(F.lit(None).cast(SPARK.get(zero.type, "string")), zero.type, many=zero.many), V(F.lit(None).cast(SPARK.get(item.type, "string")), item.type))
    final = kind.type
    if kind.many or zero.many:
        target = f"array<{SPARK.get(final, 'string')}>"
        return V(F.aggregate(v, seq(zero).cast(target), lambda a, x: seq(f(V(a, final, many=True), V(x, item.type))).cast(target)), final, many=True)
    target = SPARK.get(final, "string")
    return V(F.aggregate(v, one(zero).cast(target), lambda a, x: one(f(V(a, final), V(x, item.type))).cast(target)), final)


fn("fold-left")(lambda v, z, f: fold(seq(v), single(v), z, lambda a, x: f.call(a, x)))
fn("fold-right")(lambda v, z, f: fold(F.reverse(seq(v)), single(v), z, lambda a, x: f.call(x, a)))


@fn("scan-left")
def scan_left(v: V, z: V, f: V) -> V:
    kind = f.call(z, single(v).of(F.lit(None).cast(SPARK.get(v.type, "string")))).type
    target = SPARK[kind]
    return V(F.aggregate(seq(v), F.array(one(z).cast(target)), lambda a, x: F.concat(a, F.array(one(f.call(V(F.element_at(a, -1), kind), V(x, v.type))).cast(target)))), kind, many=True)


@fn("scan-right")
def scan_right(v: V, z: V, f: V) -> V:
    turned = V(None, "function", call=lambda a, x: f.call(x, a), arity=2)
    return items(scan_left(items(v, F.reverse(seq(v))), z, turned), F.reverse(scan_left(items(v, F.reverse(seq(v))), z, turned).col))


@fn("for-each-pair")
def for_each_pair(a: V, b: V, f: V) -> V:
    n = F.least(F.size(seq(a)), F.size(seq(b)))
    kind = result(f, single(a), single(b))
    return V(F.zip_with(F.slice(seq(a), F.lit(1), n), F.slice(seq(b), F.lit(1), n), lambda x, y: one(f.call(single(a).of(x), single(b).of(y)))), kind.type, many=True)


def ordered(v: V, key: Callable[[Column], Column], down: bool = False) -> Column:
    """A stable sort: absent first, then NaN, then values."""
    entry = F.transform(seq(v), lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v")))

    def rank(c: Column) -> Column:
        return F.when(c.isNull(), 0).when(c.cast("string") == "NaN", 1).otherwise(2)

    def less(a: Column, b: Column) -> Column:
        x, y = (b.k, a.k) if down else (a.k, b.k)
        return F.when(rank(x) < rank(y), -1).when(rank(x) > rank(y), 1).when((rank(x) == 2) & (x < y), -1).when((rank(x) == 2) & (x > y), 1).when(a.i < b.i, -1).when(a.i > b.i, 1).otherwise(0)

    return F.transform(F.array_sort(entry, less), lambda e: e.v)


@fn("sort")
def sort(v: V, c: V | None = None, f: V | None = None) -> V:
    if f is None and c is not None and c.call is not None:
        c, f = None, c
    return items(v, ordered(v, (lambda x: collated(each(f, v)(x), c if c is not None and c.literal else None)) if f else (lambda x: collated(x, c if c is not None and c.literal else None))))


fn("sort-by")(lambda v, f: items(v, ordered(v, lambda x: text(f.call(single(v).of(x))))))
fn("sort-with")(lambda v, f: items(v, F.array_sort(seq(v), lambda a, b: one(f.call(single(v).of(a), single(v).of(b))).cast("int"))))


def extreme(best: Callable[[Column], Column]):
    def run(v: V, c: V | None = None, f: V | None = None) -> V:
        if f is None and c is not None and c.call is not None:
            f = c
        key = (lambda x: number(f.call(single(v).of(x)))) if f else (lambda x: number(single(v).of(x)))
        top = best(F.transform(seq(v), key))
        return items(v, F.filter(seq(v), lambda x: key(x) == top))

    return run


fn("highest")(extreme(F.array_max))
fn("lowest")(extreme(F.array_min))
fn("apply")(lambda f, a: f.call(*[V(F.get(a.col, i), a.member) for i in range(f.arity or 0)]))
fn("function-arity")(lambda f: V(F.lit(f.arity), "integer", literal=f.arity))
fn("function-name")(lambda f: V(F.lit(f.name), "string", literal=f.name))

# nodes: a row's columns tell all that these ask for -----------------------------------------------------------------
def node(v: V, field: str) -> Column:
    if v.type != "node":
        raise QueryError("XPTY0004", "a node is expected")
    return v.fields[field].col


def node_name(v: V) -> Column:
    return F.when(F.coalesce(F.length(node(v, "prefix")), F.lit(0)) > 0, F.concat(node(v, "prefix"), F.lit(":"), node(v, "local"))).otherwise(F.coalesce(node(v, "local"), F.lit("")))


fn("name", "node-name")(lambda v: string(node_name(v)))
fn("local-name")(lambda v: string(F.coalesce(node(v, "local"), F.lit(""))))
fn("namespace-uri")(lambda v: V(F.coalesce(node(v, "ns"), F.lit("")), "anyURI"))
fn("generate-id")(lambda v: string(F.concat(F.lit("d"), node(v, "doc_id"), F.lit("n"), node(v, "pre"))))
fn("has-children")(lambda v: boolean(node(v, "size") > 0))
fn("root")(lambda v: V(F.concat(F.lit("d"), node(v, "doc_id"), F.lit("n0")), "string"))
fn("document-uri")(lambda v: V(node(v, "doc_id").cast("string"), "anyURI"))
fn("base-uri")(lambda v: V(node(v, "doc_id").cast("string"), "anyURI"))
fn("nilled")(lambda v: boolean(F.when(node(v, "kind") == "element", F.lit(False))))

# times are strings of hours, minutes and seconds ---------------------------------------------------------------------
fn("current-time")(lambda: string(F.date_format(F.current_timestamp(), "HH:mm:ss")))
fn("hours-from-time")(lambda v: integer(F.split_part(text(v), F.lit(":"), F.lit(1))))
fn("minutes-from-time")(lambda v: integer(F.split_part(text(v), F.lit(":"), F.lit(2))))
fn("seconds-from-time")(lambda v: V(F.split_part(text(v), F.lit(":"), F.lit(3)).cast("decimal(38,18)"), "decimal"))
fn("timezone-from-time")(lambda v: V(F.lit(None).cast(SPARK["dayTimeDuration"]), "dayTimeDuration"))
fn("type")(lambda v: V(F.struct(F.lit("sequence" if v.many else "item").alias("kind"), F.lit(v.type).alias("name")), "record", fields={"kind": V(F.lit("sequence" if v.many else "item"), "string"), "name": V(F.lit(v.type), "string")}))
fn("random-number-generator")(lambda seed=None: V(F.struct(F.rand(int(seed.literal) if seed else 0).alias("number")), "record", fields={"number": V(F.rand(int(seed.literal) if seed else 0), "double")}))
fn("map:find")(lambda m, k: V(F.filter(F.array(F.try_element_at(m.col, one(k))), lambda x: x.isNotNull()) if m.type == "map" else F.array(m.fields[k.literal].col) if k.literal in m.fields else F.array().cast("array<string>"), "array", member=m.member))

# maps and arrays ----------------------------------------------------------------------------------------------
fn("map:size")(lambda m: integer(F.lit(len(m.fields)) if m.type == "record" else F.size(m.col)))
fn("map:keys")(lambda m: V(F.array(*map(F.lit, m.fields)) if m.type == "record" else F.map_keys(m.col), "string", many=True))
fn("map:contains")(lambda m, k: boolean(F.lit(k.literal in m.fields) if m.type == "record" else F.map_contains_key(m.col, one(k))))
fn("map:remove")(lambda m, k: m.of(F.map_filter(m.col, lambda a, b: ~F.array_contains(seq(k), a))))
fn("map:put")(lambda m, k, v: m.of(F.map_concat(F.map_filter(m.col, lambda a, b: a != one(k)), F.create_map(one(k), one(v)))))
fn("map:entry", "map:pair")(lambda k, v: V(F.create_map(one(k), one(v)), "map", member=v.type))
fn("map:filter")(lambda m, f: m.of(F.map_filter(m.col, lambda a, b: ebv(f.call(V(a, "string"), V(b, m.member))))))
fn("map:keys-where")(lambda m, f: V(F.map_keys(F.map_filter(m.col, lambda a, b: ebv(f.call(V(b, m.member))))), "string", many=True))
fn("map:for-each")(lambda m, f: V(F.transform(F.map_entries(m.col), lambda e: one(f.call(V(e.key, "string"), V(e.value, m.member)))), f.call(V(F.lit(""), "string"), V(F.lit(None).cast(SPARK.get(m.member, "string")), m.member)).type, many=True))
fn("map:replace")(lambda m, k, v: m.of(F.transform_values(m.col, lambda a, b: F.when(a == one(k), one(v)).otherwise(b))))
fn("map:entries")(lambda m: V(F.map_entries(m.col), "record", many=True))
fn("map:items")(lambda m: V(F.transform(F.map_entries(m.col), lambda e: F.array(e.key, e.value.cast("string"))), "array", many=True))
fn("map:empty")(lambda: V(F.create_map(), "map"))


@fn("map:get")
def map_get(m: V, k: V) -> V:
    if m.type == "record":
        return m.fields.get(k.literal, V(F.lit(None), "string"))
    return V(F.try_element_at(m.col, one(k)), m.member)


@fn("map:merge")
def map_merge(m: V, options: V | None = None) -> V:
    """Equal keys: the first wins, unless the options say use-last."""
    last = options is not None and options.fields and options.fields.get("duplicates") and options.fields["duplicates"].literal == "use-last"
    every = seq(m) if m.many else F.array(m.col)
    flat = F.flatten(F.transform(every, F.map_entries))
    flat = F.reverse(flat) if last else flat
    first = F.filter(flat, lambda e, i: ~F.exists(F.slice(flat, F.lit(1), i), lambda d: d.key == e.key))
    return V(F.map_from_entries(F.reverse(first) if last else first), "map", member=m.member)


@fn("map:of-pairs")
def map_of_pairs(m: V) -> V:
    every = F.reverse(F.flatten(F.transform(seq(m), F.map_entries)))
    first = F.filter(every, lambda e, i: ~F.exists(F.slice(every, F.lit(1), i), lambda d: d.key == e.key))
    return V(F.map_from_entries(F.reverse(first)), "map", member=m.member)


@fn("map:build")
def map_build(v: V, key: V | None = None, value: V | None = None) -> V:
    entries = F.reverse(F.transform(seq(v), lambda x: F.struct((each(key, v)(x) if key else x).alias("key"), (each(value, v)(x) if value else x).alias("value"))))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda d: d.key == e.key))
    return V(F.map_from_entries(F.reverse(first)), "map", member=result(value, single(v)).type if value else v.type)


@fn("map:group-by")
def map_group_by(v: V, key: V) -> V:
    k = each(key, v)
    keys = F.array_distinct(F.transform(seq(v), k))
    return V(F.map_from_arrays(keys, F.transform(keys, lambda a: F.filter(seq(v), lambda x: k(x) == a))), "map", member=v.type)


def array(a: V, c: Column) -> V:
    return V(c, "array", member=a.member)


def within(a: V, p: Column, c: Column, room: int = 0) -> Column:
    return guard(c, (p < 1) | (p > F.size(a.col) + room), "FOAY0001", "array index out of bounds")


fn("array:size")(lambda a: integer(F.size(a.col)))
fn("array:get")(lambda a, p: V(within(a, one(p), F.get(a.col, (one(p) - 1).cast("int"))), a.member))
fn("array:put")(lambda a, p, v: array(a, within(a, one(p), F.transform(a.col, lambda x, i: F.when(i + 1 == one(p), one(v)).otherwise(x)))))
fn("array:append")(lambda a, v: array(a, F.array_append(a.col, one(v))))
fn("array:subarray")(lambda a, s, n=None: array(a, within(a, one(s), F.slice(a.col, one(s).cast("int"), one(n).cast("int") if n else F.size(a.col)), 1)))
fn("array:remove")(lambda a, p: array(a, F.filter(a.col, lambda x, i: ~F.array_contains(seq(p), (i + 1).cast("bigint")))))
fn("array:insert-before")(lambda a, p, v: array(a, within(a, one(p), F.concat(F.slice(a.col, F.lit(1), (one(p) - 1).cast("int")), F.array(one(v)), F.slice(a.col, one(p).cast("int"), F.size(a.col))), 1)))
fn("array:head")(lambda a: V(guard(F.get(a.col, 0), F.size(a.col) == 0, "FOAY0001", "empty array"), a.member))
fn("array:tail")(lambda a: array(a, guard(F.slice(a.col, F.lit(2), F.greatest(F.size(a.col) - 1, F.lit(0))), F.size(a.col) == 0, "FOAY0001", "empty array")))
fn("array:foot")(lambda a: V(F.try_element_at(a.col, F.lit(-1)), a.member))
fn("array:trunk")(lambda a: array(a, F.slice(a.col, F.lit(1), F.greatest(F.size(a.col) - 1, F.lit(0)))))
fn("array:reverse")(lambda a: array(a, F.reverse(a.col)))
fn("array:join")(lambda *a: array(a[0], F.flatten(a[0].col) if a[0].many else F.concat(*[x.col for x in a])))
fn("array:for-each")(lambda a, f: V(F.transform(a.col, lambda c: one(f.call(V(c, a.member)))), "array", member=result(f, V(None, a.member)).type))
fn("array:filter")(lambda a, f: array(a, F.filter(a.col, lambda c: ebv(f.call(V(c, a.member))))))
fn("array:fold-left")(lambda a, z, f: fold(a.col, V(None, a.member), z, lambda s, x: f.call(s, x)))
fn("array:fold-right")(lambda a, z, f: fold(F.reverse(a.col), V(None, a.member), z, lambda s, x: f.call(x, s)))
fn("array:for-each-pair")(lambda a, b, f: V(for_each_pair(V(a.col, a.member, many=True), V(b.col, b.member, many=True), f).col, "array", member=result(f, V(None, a.member), V(None, b.member)).type))
fn("array:sort")(lambda a, c=None, f=None: array(a, sort(V(a.col, a.member, many=True), c, f).col))
fn("array:sort-by")(lambda a, f: array(a, ordered(V(a.col, a.member, many=True), lambda x: text(f.call(V(x, a.member))))))
fn("array:sort-with")(lambda a, f: array(a, F.array_sort(a.col, lambda x, y: one(f.call(V(x, a.member), V(y, a.member))).cast("int"))))
fn("array:flatten", "array:items")(lambda a: V(a.col, a.member, many=True) if a.type == "array" else a)
fn("array:members")(lambda a: V(F.transform(a.col, lambda x: F.array(x)), "array", many=True, member=a.member))
fn("array:of-members")(lambda v: V(F.flatten(v.col) if v.type == "array" else seq(v), "array", member=v.member if v.type == "array" else v.type))
fn("array:empty")(lambda: V(F.array().cast("array<string>"), "array", member="string"))
fn("array:build")(lambda v, f=None: V(F.transform(seq(v), each(f, v)) if f else seq(v), "array", member=result(f, single(v)).type if f else v.type))
fn("array:index-of")(lambda a, v: positions(V(a.col, a.member, many=True), lambda x: x.cast("string") == one(v).cast("string")))
fn("array:index-where")(lambda a, f: positions(V(a.col, a.member, many=True), lambda x: ebv(f.call(V(x, a.member)))))
fn("array:slice")(lambda a, s=None, e=None, by=None: array(a, slice_(V(a.col, a.member, many=True), s, e, by).col))
fn("array:split")(lambda a, n: V(F.when((one(n) > 0) & (F.size(a.col) > 0), F.transform(F.sequence(F.lit(1), F.greatest(F.size(a.col), F.lit(1)), F.greatest(one(n), F.lit(1)).cast("int")), lambda i: F.slice(a.col, i, one(n).cast("int")))).otherwise(F.filter(F.array(a.col), lambda x: F.lit(False))), "array", member="array"))

# dates and times ----------------------------------------------------------------------------------------------
for kind in ("date", "dateTime"):
    fn(f"year-from-{kind}")(lambda v: integer(F.year(one(v))))
    fn(f"month-from-{kind}")(lambda v: integer(F.month(one(v))))
    fn(f"day-from-{kind}")(lambda v: integer(F.dayofmonth(one(v))))
fn("hours-from-dateTime")(lambda v: integer(F.hour(one(v))))
fn("minutes-from-dateTime")(lambda v: integer(F.minute(one(v))))
fn("seconds-from-dateTime")(lambda v: V(F.extract(F.lit("SECOND"), one(v)).cast("decimal(38,18)"), "decimal"))
for part, unit, kind in (("years", "YEAR", "yearMonthDuration"), ("months", "MONTH", "yearMonthDuration"), ("days", "DAY", "dayTimeDuration"), ("hours", "HOUR", "dayTimeDuration"), ("minutes", "MINUTE", "dayTimeDuration"), ("seconds", "SECOND", "dayTimeDuration")):
    fn(f"{part}-from-duration")(lambda v, unit=unit, kind=kind: V(F.extract(F.lit(unit), one(v)).cast("decimal(38,18)" if unit == "SECOND" else "bigint"), "decimal" if unit == "SECOND" else "integer") if v.type == kind else V(F.lit(0), "integer"))
fn("current-dateTime")(lambda: V(F.current_timestamp().cast("timestamp_ntz"), "dateTime"))
fn("current-date")(lambda: V(F.current_date(), "date"))
fn("implicit-timezone")(lambda: V(F.make_dt_interval(), "dayTimeDuration"))
fn("timezone-from-dateTime", "timezone-from-date")(lambda v: V(F.lit(None).cast(SPARK["dayTimeDuration"]), "dayTimeDuration"))
fn("dateTime")(lambda d, t: V(F.to_timestamp_ntz(F.concat_ws(" ", one(d).cast("string"), words(t))), "dateTime"))
#: Picture components and their Java patterns.
PICTURE = {"Y": "yyyy", "Y0001": "yyyy", "Y01": "yy", "M": "M", "M01": "MM", "MNn": "MMMM", "MNn,*-3": "MMM", "D": "d", "D01": "dd", "d": "D", "FNn": "EEEE", "FNn,*-3": "EEE", "H": "H", "H01": "HH", "h": "h", "h01": "hh", "m": "mm", "m01": "mm", "s": "ss", "s01": "ss", "f001": "SSS", "P": "a", "PN": "a"}


@fn("format-date", "format-dateTime")
def format_date(v: V, picture: V, *rest: V) -> V:
    own, out, at = str(fixed(picture, "a picture")), "", 0
    for m in re.finditer(r"\[([^\]]*)\]|([^\[]+)", own):
        if m[1] is not None:
            part = re.sub(r"\s", "", m[1])
            if part not in PICTURE:
                raise QueryError("FOFD1340", f"unsupported component [{part}]")
            out += PICTURE[part]
        else:
            out += "'" + m[2].replace("'", "''") + "'"
    return string(F.date_format(one(v), out))


@fn("format-integer")
def format_integer(v: V, picture: V, lang: V | None = None) -> V:
    own = str(fixed(picture, "a picture"))
    c = one(v)
    if own in ("A", "a"):
        out = F.when(c > 0, mapped(lambda n: _letters(int(n)), "string")(c))
        return string(F.lower(out) if own == "a" else out)
    if own in ("I", "i"):
        out = mapped(lambda n: _roman(int(n)), "string")(c)
        return string(F.lower(out) if own == "i" else out)
    if re.fullmatch(r"[#0-9]+", own):
        digits = F.lpad(F.abs(c).cast("string"), F.greatest(F.length(F.abs(c).cast("string")), F.lit(own.count("0") + own.count("1"))), F.lit("0"))
        return string(F.when(c.isNull(), "").otherwise(F.concat(F.when(c < 0, "-").otherwise(""), digits)))
    if re.fullmatch(r"#?,?[#0]*(,[#0]{3})*", own):
        return string(F.regexp_replace(F.format_number(c, 0), ",", ","))
    raise QueryError("FODF1310", f"unsupported picture {own}")


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out += sign * (n // value)
        n %= value
    return out


@fn("format-number")
def format_number(v: V, picture: V, *rest: V) -> V:
    own = str(fixed(picture, "a picture"))
    m = re.fullmatch(r"([^#0,.]*)([#0,]*)(?:\.([#0]*))?(%?)([^#0,.%]*)", own)
    if not m:
        raise QueryError("FODF1310", f"unsupported picture {own}")
    whole, part = m[2], m[3] or ""
    c = number(v) * (100 if m[4] else 1)
    out = F.format_number(F.bround(c, len(part)), len(part))
    out = out if "," in whole else F.replace(out, F.lit(","), F.lit(""))
    least = whole.count("0")
    if least > 1 and "," not in whole:
        width = least + (len(part) + 1 if part else 0)
        out = F.lpad(out, F.greatest(F.length(out), F.lit(width)), F.lit("0"))
    optional = len(part) - len(part.rstrip("#"))
    if optional:
        out = F.regexp_replace(out, r"0{1,%d}$" % optional, "")
        out = F.regexp_replace(out, r"\.$", "")
    if least == 0 and part:
        out = F.regexp_replace(out, r"^0\.", ".")
    return string(F.concat(F.lit(m[1]), F.when(F.isnan(c), "NaN").otherwise(out), F.lit(m[4] + m[5])))


# JSON, URIs, errors, environment -------------------------------------------------------------------------------
fn("parse-json")(lambda v, o=None: V(F.parse_json(one(v)), "variant"))
fn("json-path")(lambda v, p, k=None: string(F.get_json_object(one(v), "$." + str(fixed(p, "a path")))))
fn("serialize")(lambda v, p=None: string(v.col) if v.type in ("element", "markup") and not v.many else string(text(v) if v.type in SPARK and not v.many else F.to_json(v.col)))
@fn("resolve-uri")
def resolve_uri(relative: V, base: V) -> V:
    if relative.literal is not None and base.literal is not None:
        return string(F.lit(urljoin(base.literal, relative.literal)))

    @F.pandas_udf("string")
    def joined(r: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else urljoin(y or "", x) for x, y in zip(r, b)], dtype=object)

    return string(joined(one(relative), one(base)))
fn("environment-variable")(lambda v: string(F.lit(None).cast("string")))
fn("available-environment-variables")(lambda: V(F.array().cast("array<string>"), "string", many=True))
fn("static-base-uri")(lambda: V(F.lit(None).cast("string"), "anyURI"))
fn("error")(lambda c=None, d=None, *o: V(F.raise_error(F.concat(F.lit("["), F.coalesce(F.nullif(words(c), F.lit("")), F.lit("FOER0000")) if c and c.col is not None else F.lit("FOER0000"), F.lit("] "), words(d) if d else F.lit(""))).cast("string"), "string"))
fn("data")(lambda v: V(v.col, v.member, many=True) if v.type == "array" else v)
fn("QName")(lambda u, n: V(F.struct(words(u).alias("uri"), F.element_at(F.split(words(n), ":"), -1).alias("local"), F.when(F.contains(words(n), F.lit(":")), F.split_part(words(n), F.lit(":"), F.lit(1))).otherwise("").alias("prefix")), "QName"))
fn("local-name-from-QName")(lambda q: string(q.col.local))
fn("namespace-uri-from-QName")(lambda q: V(q.col.uri, "anyURI"))
fn("prefix-from-QName")(lambda q: string(F.nullif(q.col.prefix, F.lit(""))))
fn("parse-uri")(lambda v: V(F.create_map(*[x for part in ("PROTOCOL", "HOST", "PATH", "QUERY", "REF") for x in (F.lit({"PROTOCOL": "scheme", "REF": "fragment"}.get(part, part.lower())), F.try_parse_url(words(v), F.lit(part)))]), "map", member="string"))
fn("build-uri")(lambda m: string(F.concat(F.coalesce(F.concat(F.try_element_at(m.col, F.lit("scheme")), F.lit("://")), F.lit("")), F.coalesce(F.try_element_at(m.col, F.lit("host")), F.lit("")), F.coalesce(F.try_element_at(m.col, F.lit("path")), F.lit("")), F.coalesce(F.concat(F.lit("?"), F.try_element_at(m.col, F.lit("query"))), F.lit("")), F.coalesce(F.concat(F.lit("#"), F.try_element_at(m.col, F.lit("fragment"))), F.lit("")))))

#: A fixed value: the namespace of JSON's XML form.
JSON_XML = "http://www.w3.org/2005/xpath-functions"


def _marked(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


class _Number(str):
    pass


def _json_as_xml(value, key: str | None = None, top: bool = False) -> str:
    own = (f' xmlns="{JSON_XML}"' if top else "") + (f' key="{_marked(key)}"' if key is not None else "")
    if value is None:
        return f"<null{own}/>"
    if isinstance(value, bool):
        return f"<boolean{own}>{str(value).lower()}</boolean>"
    name = "map" if isinstance(value, dict) else "array" if isinstance(value, list) else "number" if isinstance(value, _Number) else "string"
    inside = "".join(_json_as_xml(v, k) for k, v in value.items()) if name == "map" else "".join(map(_json_as_xml, value)) if name == "array" else _marked(value)
    return f"<{name}{own}>{inside}</{name}>" if inside else f"<{name}{own}/>"


def _xml_as_json(e) -> str:
    name, inside = e.tag.removeprefix(f"{{{JSON_XML}}}"), "".join(e.itertext())
    if name == "map":
        return "{" + ",".join(f"{json.dumps(x.get('key'), ensure_ascii=False)}:{_xml_as_json(x)}" for x in e) + "}"
    if name == "array":
        return "[" + ",".join(map(_xml_as_json, e)) + "]"
    if name == "string":
        return json.dumps(inside, ensure_ascii=False)
    if name in ("number", "boolean", "null"):
        return "null" if name == "null" else inside.strip()
    raise ValueError(f"[FOJS0006] no JSON form of {name}")


@fn("json-to-xml")
def json_to_xml(v: V, options: V | None = None) -> V:
    return V(mapped(lambda s: _json_as_xml(json.loads(s, parse_int=_Number, parse_float=_Number), top=True))(text(v)), "element")


@fn("xml-to-json")
def xml_to_json(v: V, options: V | None = None) -> V:
    return string(mapped(lambda s: _xml_as_json(ElementTree.fromstring(s)))(v.col if v.type == "element" else text(v)))


def _well_formed(s: str, fragment: bool) -> str:
    inside = re.sub(r"^\s*<\?xml[^>]*\?>\s*", "", s)
    ElementTree.fromstring(f"<x>{inside}</x>" if fragment else inside)
    return inside if fragment else inside.strip()


fn("parse-xml")(lambda v: V(mapped(lambda s: _well_formed(s, False))(text(v)), "element"))
fn("parse-xml-fragment")(lambda v: V(mapped(lambda s: _well_formed(s, True))(text(v)), "element"))


@fn("analyze-string")
def analyze_string(v: V, p: V, flags: V | None = None) -> V:
    """The matches of a pattern and what stands between them, as records of kind (match, non-match) and value."""
    own = re.compile(pattern(p, flags).replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))

    def cut(s: str) -> list[dict[str, str]]:
        out, at = [], 0
        for m in own.finditer(s):
            if m.start() > at:
                out.append({"kind": "non-match", "value": s[at : m.start()]})
            out.append({"kind": "match", "value": m[0]})
            at = m.end()
        return out + [{"kind": "non-match", "value": s[at:]}] * (at < len(s))

    empty = V(F.lit(None).cast("string"), "string")
    return V(mapped(cut, "array<struct<kind:string,value:string>>")(words(v)), "record", many=True, fields={"kind": empty, "value": empty})


#: The forms of dates in headers of messages.
IETF = ("d MMM yyyy HH:mm:ss", "d-MMM-yy HH:mm:ss", "MMM d HH:mm:ss yyyy", "d MMM yyyy HH:mm")


@fn("parse-ietf-date")
def parse_ietf_date(v: V) -> V:
    zone = F.regexp_extract(words(v), r"([+-])(\d\d)(\d\d)(?:\s*\([^)]*\))?$", 0)
    hours = lambda k: F.coalesce(F.nullif(F.regexp_extract(words(v), r"([+-])(\d\d):?(\d\d)(?:\s*\([^)]*\))?$", k), F.lit("")), F.lit("0")).cast("int")
    ahead = F.make_dt_interval(F.lit(0), hours(2), hours(3)) * F.when(zone.startswith("-"), -1).otherwise(1)
    s = F.regexp_replace(words(v), r"\s*(GMT|UTC|UT|Z|[+-]\d{4})(\s*\([^)]*\))?$", "")
    s = F.regexp_replace(F.trim(s), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+", "")
    return V(F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in IETF]).cast("timestamp_ntz") - ahead, "dateTime")  # kept in UTC


@fn("adjust-dateTime-to-timezone", "adjust-date-to-timezone", "adjust-time-to-timezone")
def adjust(v: V, tz: V | None = None) -> V:
    """Values are kept in UTC and without a zone: taking the zone off changes nothing, another one can't be put on."""
    if tz is not None and not (tz.many and tz.col is not None and tz.literal is None and tz.type == "string"):
        raise QueryError("FODT0003", "a value can't carry a time zone here; add its offset as a duration")
    return v


#: Each of these types is a list of the other's values.
for name in ("NMTOKENS", "IDREFS", "ENTITIES"):
    LIBRARY[f"xs:{name}"] = tokenize
LIBRARY["xs:QName"] = lambda v: LIBRARY["fn:QName"](literal_string(""), v)
LIBRARY["xs:numeric"] = lambda v: v if v.type in NUMERIC else V(number(v), "double")
LIBRARY["xs:error"] = lambda v: V(F.when(one(v).isNotNull(), F.raise_error(F.lit("[FORG0001] nothing can be cast to xs:error"))), "string")


def literal_string(s: str) -> V:
    return V(F.lit(s), "string", literal=s)


@fn("xs:time")
def time_(v: V) -> V:
    """Times are strings of hours, minutes, seconds and a zone, in the form that all of them have."""
    c = F.trim(text(v))
    ok = c.rlike(r"^(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00)(Z|[+-](0\d|1[0-4]):[0-5]\d)?$")
    return string(F.when(c.isNull() | ok, F.replace(c, F.lit("24:00:00"), F.lit("00:00:00"))).otherwise(F.raise_error(F.concat(F.lit("[FORG0001] cannot cast to xs:time: "), c)).cast("string")))


@fn("iterate-while")
def iterate_while(v: V, step: V, test: V) -> V:
    """Steps while the test holds, 10,000 times at most: a hundred rounds of a hundred, of which a finished one does nothing."""
    if v.many:
        raise QueryError("XPTY0004", "iterate-while starts from one item")
    kind = result(step, v).type
    target = SPARK[kind]
    own = lambda c: V(c, kind)
    goes = lambda c: ebv(test.call(own(c)))
    hundred = F.sequence(F.lit(1), F.lit(100))
    inner = lambda a: F.aggregate(F.when(goes(a), hundred).otherwise(F.array().cast("array<int>")), a, lambda b, _: F.when(goes(b), one(step.call(own(b))).cast(target)).otherwise(b))
    return V(F.aggregate(hundred, one(v).cast(target), lambda a, _: inner(a)), kind)


# The headwords of the built-in thesaurus and their synonyms.
THESAURUS = {
    "big": "large huge enormous vast",
    "small": "little tiny minute compact",
    "fast": "quick rapid swift speedy",
    "slow": "gradual unhurried leisurely",
    "good": "excellent fine great superior",
    "bad": "poor inferior terrible awful",
    "happy": "glad joyful pleased content",
    "sad": "unhappy sorrowful melancholy gloomy",
    "begin": "start commence initiate",
    "end": "finish conclude terminate complete",
    "create": "make build construct produce",
    "delete": "remove erase destroy eliminate",
    "find": "search locate discover detect",
    "change": "modify alter adjust transform",
}


@fn("ft:thesaurus-lookup")
def thesaurus_lookup(v: V, relationship: V | None = None) -> V:
    """A headword's synonyms; of a synonym its first headword and that one's other synonyms; else nothing."""
    known = {w: own.split() for w, own in THESAURUS.items()}
    for head, own in list(known.items()):
        for w in own:
            known.setdefault(w, [head, *(x for x in own if x != w)])
    table = F.create_map(*[x for w, own in known.items() for x in (F.lit(w), F.array(*map(F.lit, own)))])
    return V(F.coalesce(F.try_element_at(table, F.lower(words(v))), F.array().cast("array<string>")), "string", many=True)


# constructors -------------------------------------------------------------------------------------------------
INTEGERS = ("integer", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")
STRINGS = ("string", "normalizedString", "token", "language", "Name", "NCName", "NMTOKEN", "ID", "IDREF", "ENTITY", "anyURI", "untypedAtomic", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay")
BOUNDS = {"long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "unsignedLong": (0, None), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 65535), "unsignedByte": (0, 255)}


def cast(v: V, target: str, soft: bool = False) -> V:
    """xs:target(v): absent stays absent; a value outside the type raises, or is null if soft."""
    name = target.removeprefix("xs:").rstrip("?*+")
    c = one(v)
    raw = F.trim(c.cast("string")) if v.type in ("string", "untypedAtomic", "anyURI", "item") else c

    def strict(out: Column, bad: Column | None = None) -> Column:
        wrong = c.isNotNull() & out.isNull() if bad is None else c.isNotNull() & (out.isNull() | bad)
        return F.when(~wrong, out) if soft else F.when(wrong, F.raise_error(F.concat(F.lit("[FORG0001] cannot cast to xs:" + name + ": "), c.cast("string")))).otherwise(out)

    if name in INTEGERS:
        if v.type in ("string", "untypedAtomic", "anyURI", "item"):
            out = F.when(raw.rlike(r"^[+-]?\d+$"), raw.try_cast("bigint"))
        elif v.type in ("double", "float"):
            out = F.when(~F.isnan(raw) & (F.abs(raw) != math.inf), raw.try_cast("bigint"))
        else:
            out = raw.try_cast("bigint")
        low, high = BOUNDS.get(name, (None, None))
        bad = F.lit(False)
        bad = bad | (out < F.lit(low)) if low is not None and low >= -(2**63) else bad
        bad = bad | (out > F.lit(high)) if high is not None and high < 2**63 else bad
        return V(strict(out, bad), "integer")
    if name == "decimal":
        out = F.when(raw.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)$"), raw.try_cast(SPARK["decimal"])) if v.type in ("string", "untypedAtomic", "anyURI", "item") else raw.try_cast(SPARK["decimal"])
        return V(strict(out), "decimal")
    if name in ("double", "float"):
        if v.type in ("string", "untypedAtomic", "anyURI", "item"):
            out = F.when(raw == "INF", F.lit(math.inf)).when(raw == "-INF", F.lit(-math.inf)).when(raw == "NaN", F.lit(math.nan)).when(raw.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), raw.try_cast("double"))
        else:
            out = raw.cast("double")
        return V(strict(out).cast(name), name)
    if name == "boolean":
        if v.type in NUMERIC:
            return V(ebv(v), "boolean")
        return V(strict(F.when(raw.cast("string").isin("true", "1"), True).when(raw.cast("string").isin("false", "0"), False)), "boolean")
    if name in STRINGS:
        out = text(v)
        if name == "token":
            out = F.trim(F.regexp_replace(out, r"\s+", " "))
        return V(out, name if name in SPARK else "string")
    if name in ("date", "dateTime"):
        plain = F.replace(raw.cast("string"), F.lit("T"), F.lit(" "))
        zoned = F.to_utc_timestamp(plain.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz")  # values are kept in UTC
        out = raw.try_cast(SPARK[name]) if v.type in ("date", "dateTime") else F.when(plain.rlike(r"(Z|[+-]\d\d:\d\d)$"), zoned).otherwise(plain.try_cast(SPARK[name])) if name == "dateTime" else F.when(raw.rlike(r"^-?\d{4,}-\d\d-\d\d$"), raw.try_cast("date"))
        return V(strict(out), name)
    if name == "dayTimeDuration":
        part = lambda unit, pre="": F.coalesce(F.nullif(F.regexp_extract(raw, r"^(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?$", unit), F.lit("")), F.lit("0"))
        out = F.make_dt_interval(part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("decimal(18,6)"))
        return V(strict(F.when(raw.rlike(r"^-?P(?=\d|T\d)(\d+D)?(T(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"), F.when(raw.startswith("-"), -out).otherwise(out))) if v.type != name else c, name)
    if name == "yearMonthDuration":
        part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(raw, r"^(-?)P(?:(\d+)Y)?(?:(\d+)M)?$", unit), F.lit("")), F.lit("0"))
        out = F.make_ym_interval(part(2).cast("int"), part(3).cast("int"))
        return V(strict(F.when(raw.rlike(r"^-?P(?=\d)(\d+Y)?(\d+M)?$"), F.when(raw.startswith("-"), -out).otherwise(out))) if v.type != name else c, name)
    if name in ("hexBinary", "base64Binary"):
        out = (F.unhex(raw) if name == "hexBinary" else F.unbase64(raw)) if v.type not in ("hexBinary", "base64Binary") else c
        return V(strict(out), name)
    raise QueryError("XPST0051", f"unknown type {target}")


for name in (*INTEGERS, *STRINGS, "decimal", "double", "float", "boolean", "date", "dateTime", "dayTimeDuration", "yearMonthDuration", "hexBinary", "base64Binary"):
    LIBRARY[f"xs:{name}"] = lambda v, name=name: cast(v, name)
