"""Compile-time values: a Spark column with the static type that the language gives it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.plans.parser import QueryError

SPARK = {
    "integer": "bigint", "decimal": "decimal(38,18)", "double": "double", "float": "float", "string": "string", "boolean": "boolean", "date": "date", "dateTime": "timestamp_ntz",
    "dayTimeDuration": "interval day to second", "yearMonthDuration": "interval year to month", "anyURI": "string", "untypedAtomic": "string", "hexBinary": "binary", "base64Binary": "binary",
}
NUMERIC = ("integer", "decimal", "float", "double")


@dataclass(frozen=True)
class V:
    """many: the column is an array that stands for a sequence. An XDM array has the type `array` and a member type."""

    col: Column | None
    type: str = "item"
    many: bool = False
    fields: dict[str, V] | None = None
    member: str = "item"
    call: Callable[..., V] | None = None
    arity: int | None = None
    literal: object = None
    name: str | None = None
    grouped: bool = False

    def of(self, col: Column, type: str | None = None, many: bool | None = None) -> V:
        return replace(self, col=col, type=type or self.type, many=self.many if many is None else many, literal=None, name=None)


def from_type(col: Column, kind: T.DataType) -> V:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return V(col, "integer")
    if isinstance(kind, T.DoubleType):
        return V(col, "double")
    if isinstance(kind, T.FloatType):
        return V(col, "float")
    if isinstance(kind, T.DecimalType):
        return V(col, "integer" if kind.scale == 0 else "decimal")
    if isinstance(kind, T.BooleanType):
        return V(col, "boolean")
    if isinstance(kind, T.DateType):
        return V(col, "date")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return V(col, "dateTime")
    if isinstance(kind, T.ArrayType):
        return V(col, "array", member=from_type(col, kind.elementType).type)
    if isinstance(kind, T.StructType):
        return V(col, "record", fields={f.name: from_type(col.getField(f.name), f.dataType) for f in kind.fields})
    if isinstance(kind, T.MapType):
        return V(col, "map", member=from_type(col, kind.valueType).type)
    return V(col, "string")


def literal(value, kind: str) -> V:
    if kind == "decimal":
        d = Decimal(value)
        return V(F.lit(d), "decimal", literal=d)
    return V(F.lit(value).cast(SPARK[kind]) if kind in ("integer", "double") else F.lit(value), kind, literal=value)


def seq(v: V) -> Column:
    """The array of a sequence; an absent single item is the empty one."""
    if v.col is None:
        return F.array()
    return v.col if v.many else F.when(v.col.isNull(), F.array().cast(f"array<{SPARK[v.type]}>") if v.type in SPARK else F.filter(F.array(v.col), lambda x: x.isNotNull())).otherwise(F.array(v.col))


def one(v: V) -> Column:
    """A single item; of a longer sequence, where the language would raise, its first."""
    return F.get(v.col, 0) if v.many else v.col


def ebv(v: V) -> Column:
    """Effective boolean value: never null."""
    if v.col is None:
        return F.lit(False)
    if v.many:
        first = F.get(v.col, 0)
        if v.type not in ("boolean", "string", *NUMERIC, "untypedAtomic", "anyURI"):
            return F.size(v.col) > 0
        many = F.raise_error(F.lit("[FORG0006] effective boolean value of several atomic items")).cast("boolean")
        return F.when(F.size(v.col) == 0, F.lit(False)).when(F.size(v.col) == 1, ebv(V(first, v.type))).otherwise(many)
    if v.type == "boolean":
        return v.col if v.literal is not None else F.coalesce(v.col, F.lit(False))
    if v.type in ("string", "anyURI", "untypedAtomic"):
        return F.coalesce(F.length(v.col) > 0, F.lit(False))
    if v.type in NUMERIC:
        ok = v.col != 0
        return F.coalesce(ok & ~F.isnan(v.col) if v.type in ("double", "float") else ok, F.lit(False))
    if v.type in ("map", "array"):
        raise QueryError("FORG0006", f"a {v.type} has no effective boolean value")
    return v.col.isNotNull()


def text(v: V) -> Column:
    """xs:string of an item, by the language's lexical rules."""
    if v.type == "node":
        return v.fields["string_value"].col
    c = one(v)
    if v.type == "double" or v.type == "float":
        whole = (F.abs(c) < 1e6) & (c == F.floor(c))
        plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
        far = F.regexp_replace(c.cast("string"), r"\.0(?=E|$)", "")
        return F.when(c.isNull(), F.lit(None)).when(F.isnan(c), "NaN").when(c == float("inf"), "INF").when(c == -float("inf"), "-INF").when(whole, F.when(c == 0, F.when(c.cast("string").startswith("-"), "-0").otherwise("0")).otherwise(c.cast("bigint").cast("string"))).when((F.abs(c) >= 1e-6) & (F.abs(c) < 1e6), plain).otherwise(far)
    if v.type == "decimal":
        return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    if v.type == "dateTime":
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(c, ".SSSSSS"), r"\.?0+$", ""))
    if v.type == "hexBinary":
        return F.hex(c)
    if v.type == "base64Binary":
        return F.base64(c)
    if v.type in ("dayTimeDuration", "yearMonthDuration"):
        units = [("DAY", "D"), ("HOUR", "H"), ("MINUTE", "M"), ("SECOND", "S")] if v.type[0] == "d" else [("YEAR", "Y"), ("MONTH", "M")]
        n = {u: F.abs(F.extract(F.lit(u), c)) for u, _ in units}
        part = {u: F.when(x != 0, F.concat(F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""), F.lit(sign))).otherwise("") for (u, sign), x in zip(units, n.values())}
        whole = F.concat(*[part[u] for u, _ in units if u in ("DAY", "YEAR") or v.type[0] == "y"])
        if v.type[0] == "d":
            time = F.concat(part["HOUR"], part["MINUTE"], part["SECOND"])
            whole = F.concat(whole, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
        negative = F.least(*[F.extract(F.lit(u), c).cast("double") for u, _ in units]) < 0
        return F.when(c.isNull(), F.lit(None)).otherwise(F.concat(F.when(negative, "-").otherwise(""), F.lit("P"), F.when(whole == "", "T0S" if v.type[0] == "d" else "0M").otherwise(whole)))
    if v.type == "element":
        return unescaped(F.regexp_replace(c, "<[^>]*>", ""))
    if v.type in ("record", "map", "array", "function"):
        raise QueryError("FOTY0013" if v.type != "array" else "XPTY0004", f"a {v.type} has no string value")
    return c.cast("string")


def escaped(c: Column, attribute: bool = False) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if attribute else [])):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def unescaped(c: Column) -> Column:
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def words(v: V) -> Column:
    """A string argument: absent is empty."""
    return F.coalesce(text(v), F.lit("")) if v.literal is None else v.col


def number(v: V) -> Column:
    return one(v).cast("double") if v.type in NUMERIC else F.expr("null").cast("double") if v.col is None else F.when(F.lower(F.trim(one(v).cast("string"))).isin("infinity", "+infinity", "inf", "+inf") & ~F.trim(one(v).cast("string")).isin("INF", "+INF"), F.lit(float("nan"))).otherwise(F.coalesce(one(v).cast("string").try_cast("double"), F.lit(float("nan"))))


def wider(a: V, b: V) -> str:
    """The type that numeric promotion gives."""
    kinds = ["double" if x.type in ("untypedAtomic", "item", "string") else x.type for x in (a, b)]
    return NUMERIC[max(NUMERIC.index(k) if k in NUMERIC else 3 for k in kinds)]
