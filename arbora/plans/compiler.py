"""Compiler of the query language to DataFrames.

A FLWOR expression is a pipeline over one DataFrame whose columns are the bound variables: `for` over a collection is
a join (a condition on both sides becomes its condition), over a nested sequence an explode; `where` is a filter, or a
semi or anti join for quantifiers over collections; `group by` is an aggregation whose aggregates are found in the
clauses behind it, so nothing is collected unless a group's items are asked for themselves. Expressions become
columns, with types inferred on the way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.functions.library import LIBRARY, cast, collated
from arbora.functions.values import NUMERIC, SPARK, V, ebv, escaped, from_type, literal, number, one, seq, text, wider, words
from arbora.operators import fulltext, sequences, updates, windows
from arbora.operators.paths import COLUMNS, Paths
from arbora.plans.parser import QueryError, parse
from arbora.sources import readers

AGGREGATES = ("count", "sum", "avg", "min", "max", "string-join", "distinct-values")


def replaced(tree, old, new):
    """A tree with one of its parts replaced wherever it stands."""
    if tree == old:
        return new
    if isinstance(tree, (tuple, list)):
        return type(tree)(replaced(x, old, new) for x in tree)
    return tree


def markup(node) -> str:
    """The markup that a constructor or a literal without any expression stands for."""
    sign = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    if isinstance(node, str):
        return sign(node)
    if node[0] == "literal":
        return sign(str(node[1]))
    if node[0] == "element":
        own = "".join(f' {k}="{"".join(map(markup, v))}"' for k, v in node[2])
        return f"<{node[1]}{own}>{''.join(map(markup, node[3]))}</{node[1]}>"
    if node[0] == "sequence":
        return "".join(map(markup, node[1]))
    raise QueryError("XUST0001", "what an update puts in has to be a literal or a constructor without expressions")


@dataclass
class Rows:
    """A sequence as a DataFrame: item describes its items in df's columns; order: the keys it is sorted by."""

    df: DataFrame
    item: V
    order: list[Column] = field(default_factory=list)


@dataclass
class Stream:
    """The tuple stream of a FLWOR expression."""

    df: DataFrame | None = None
    env: dict[str, object] = field(default_factory=dict)
    keys: list[tuple[str, Column]] | None = None
    sums: dict[str, Column] = field(default_factory=dict)
    later: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    sorted: bool = False
    joined: bool = False  # since it was sorted: a join needn't keep the order

    def apply(self, f: Callable[[DataFrame], DataFrame]) -> None:
        if self.keys is None:
            self.df = f(self.df)
        else:
            self.later.append(f)

    def flush(self) -> None:
        """Carries out a pending group by, now that its aggregates are known."""
        if self.keys is not None:
            names = [n for n, _ in self.keys]
            self.df = self.df.groupBy(*names).agg(*[c.alias(n) for n, c in self.sums.items()]) if self.sums else self.df.select(*names).distinct()
            for f in self.later:
                self.df = f(self.df)
            self.keys, self.sums, self.later = None, {}, []
            self.env = {k: v for k, v in self.env.items() if not (isinstance(v, V) and v.grouped)}


class Compiler:
    def __init__(self, spark: SparkSession, collections: Callable[[str], DataFrame], variables: dict[str, object] | None = None, documents: Callable[[str], DataFrame] | None = None):
        self.documents, self.origins = documents, {}
        self.spark, self.collections, self.external, self.functions, self.number = spark, collections, variables or {}, {}, 0
        self.stream: Stream | None = None

    def fresh(self, name: str) -> str:
        self.number += 1
        return f"{name}__{self.number}"

    # whole queries --------------------------------------------------------------------------------------------
    def query(self, source: str) -> DataFrame:
        _, prolog, body = parse(source)
        env: dict[str, object] = {}
        for d in prolog:
            if d[0] == "function":
                self.functions[d[1].removeprefix("local:"), len(d[2])] = d
            elif d[1] in self.external:
                env[d[1]] = self.constant(self.external[d[1]])
            elif d[2] is None:
                raise QueryError("XPDY0002", f"no value for external variable {d[1]}")
            else:
                env[d[1]] = ("lazy", d[2], dict(env))
        return self.finish(self.rows(body, env))

    def constant(self, value: object) -> V:
        if isinstance(value, DataFrame):
            raise QueryError("XPTY0004", "register a DataFrame as a collection")
        if isinstance(value, (list, tuple)):
            parts = [self.constant(x) for x in value]
            return V(F.array(*[p.col for p in parts]), parts[0].type if parts else "string", many=True)
        for python, kind in ((bool, "boolean"), (int, "integer"), (float, "double"), (str, "string"), (Decimal, "decimal")):
            if isinstance(value, python):
                return literal(value, kind)
        return from_type(F.lit(value), self.spark.range(1).select(F.lit(value).alias("x")).schema["x"].dataType)

    def finish(self, rows: Rows) -> DataFrame:
        """A column for each field of a record, or one called item."""
        v = rows.item
        if v.type == "record" and not v.many and v.fields is not None:
            return rows.df.select(*[(x.col if x.col is not None else F.lit(None)).alias(k) for k, x in v.fields.items()])
        if v.type == "node":
            v = V(text(v), "string")
        c = v.col if v.col is not None else F.lit(None).cast("string")
        return rows.df.select((F.explode(c) if v.many else c).alias("item")) if v.many else rows.df.where(c.isNotNull()).select(c.alias("item"))

    # sequences of rows ----------------------------------------------------------------------------------------
    def table(self, node, env) -> bool:
        """Whether an expression ranges over a collection, so that it is a DataFrame and not a column."""
        kind = node[0]
        if kind == "transform":
            return True
        if kind == "call":
            name = node[1].removeprefix("fn:")
            if name in ("collection", "doc", "unparsed-text", "unparsed-text-lines", "json-doc"):
                return True
            return name in ("subsequence", "head", "distinct-values", "reverse", "sort", "filter", "unordered", "for-each", "highest", "lowest") and bool(node[2]) and self.table(node[2][0], env)
        if kind == "flwor":
            return any(c[0] in ("for", "window") and self.table(c[2] if c[0] == "for" else c[3], env) for c in node[1])
        if kind in ("filter", "map", "lookup", "step"):
            return self.table(node[1], env)
        if kind == "binary" and node[1] in ("union", "|", "intersect", "except", "otherwise"):
            return self.table(node[2], env)
        if kind == "sequence":
            return any(self.table(x, env) for x in node[1])
        if kind == "var":
            own = env.get(node[1])
            return isinstance(own, tuple) and own[0] == "lazy" and self.table(own[1], own[2])
        return False

    def rows(self, node, env) -> Rows:
        kind = node[0]
        if kind == "flwor" and (self.table(node, env) or not env.get("#inner")):
            return self.flwor(node, env)
        if not self.table(node, env):
            outer, self.stream = self.stream, Stream(self.spark.range(1), dict(env))
            v = self.expr(node, env)
            df = self.stream.df
            self.stream = outer
            if v.many:
                name = self.fresh("item")
                df = df.select(F.explode(v.col).alias(name))
                v = replace(v.of(F.col(name), many=False), fields=v.fields)
            return Rows(df, v)
        if kind == "transform":
            return self.transform(node, env)
        if kind == "var":
            return self.rows(env[node[1]][1], env[node[1]][2])
        if kind == "step":
            name = self.start(node)
            nodes = self.documents(name)
            return self.node_rows(Paths(nodes).run(node, nodes.where("pre = 0").select(*COLUMNS).withColumn("o", F.lit(0).cast("long")), root=True).dropDuplicates(["doc_id", "pre"]), name)
        if kind == "filter":
            return self.filtered(self.rows(node[1], env), node[2], env)
        if kind == "lookup":
            return self.rows(("map", node[1], ("lookup", ("context",), node[2])), env)
        if kind == "map":
            rows = self.rows(node[1], env)
            return Rows(rows.df, self.on(rows, node[2], env), rows.order)
        if kind == "sequence":
            parts = [self.finish(self.rows(x, env)) for x in node[1]]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            return self.reread(df)
        if kind == "binary":
            left, right = (self.rows(x, env) for x in node[2:])
            if left.item.type == right.item.type == "node" and node[1] != "otherwise":
                return self.node_sets(node[1], left, right)
            left, right = self.finish(left), self.finish(right)
            if node[1] == "otherwise":
                return self.reread(left.unionByName(right.join(left.limit(1).select(F.lit(1).alias("#some")), how="left_anti")))
            how = {"union": lambda a, b: a.unionByName(b).distinct(), "|": lambda a, b: a.unionByName(b).distinct(), "intersect": lambda a, b: a.intersect(b), "except": lambda a, b: a.subtract(b)}
            return self.reread(how[node[1]](left, right))
        name, args = node[1].removeprefix("fn:"), node[2]
        if name == "collection":
            return self.collection(str(args[0][1]))
        if name == "doc":
            return self.node_rows(self.documents(str(args[0][1])).where("pre = 0"), str(args[0][1]))
        if name in ("unparsed-text", "unparsed-text-lines", "json-doc"):
            place = str(args[0][1])
            read = {"unparsed-text": lambda: readers.unparsed_text(self.spark, place).select(F.col("text").alias("item")), "unparsed-text-lines": lambda: readers.unparsed_lines(self.spark, place), "json-doc": lambda: readers.json_doc(self.spark, place)}
            return self.reread(read[name]())
        rows = self.rows(args[0], env)
        if name == "unordered":
            return Rows(rows.df, rows.item)
        if name == "distinct-values":
            return self.reread(self.finish(rows).distinct())
        if name == "filter":
            call = self.expr(args[1], env)
            return Rows(rows.df.where(ebv(call.call(rows.item))), rows.item, rows.order)
        if name == "for-each":
            return Rows(rows.df, self.expr(args[1], env).call(rows.item), rows.order)
        if name == "sort":
            key = self.expr(args[-1], env).call(rows.item) if len(args) > 1 and args[-1][0] in ("inline", "reference") else rows.item
            order = self.sort_keys([(key, False, False)])
            return Rows(rows.df.orderBy(*order), rows.item, order)
        if name in ("highest", "lowest"):
            key = number(self.expr(args[-1], env).call(rows.item)) if len(args) > 1 else number(rows.item)
            best = rows.df.agg((F.max if name == "highest" else F.min)(key).alias("#best"))
            return Rows(rows.df.crossJoin(best).where(key == F.col("#best")), rows.item)
        if name == "head":
            return Rows(rows.df.limit(1), rows.item, rows.order)
        if name == "subsequence":
            start, n = (int(float(a[1])) for a in (args[1], args[2])) if len(args) > 2 else (int(float(args[1][1])), None)
            df = rows.df.offset(start - 1) if start > 1 else rows.df
            return Rows(df if n is None else df.limit(max(0, n + min(0, start - 1))), rows.item, rows.order)
        if name == "reverse":
            raise QueryError("XPTY0004", "reverse a sorted collection by its order by")
        raise QueryError("XPST0017", f"unknown function {name}")

    def transform(self, node, env) -> Rows:
        """copy ... modify ... return: the edits, found by paths in the old documents, give new documents, which the rest reads."""
        _, name, source, edits, body = node
        if not (source[0] == "call" and source[1].removeprefix("fn:") == "doc"):
            raise QueryError("XUTY0013", "copy takes doc()")
        old, new = str(source[2][0][1]), self.fresh("copy")
        nodes, known = sequences.durable(self.documents(old)), self.documents
        rows = None
        for action, target, what in edits:
            found = self.rows(replaced(target, ("var", name), source), env)
            at = found.df.select(*[found.item.fields[c].col.alias(c) for c in ("doc_id", "pre")])
            own = updates.edit(action, at, **({} if what is None else {"name": str(what[1])} if action == "rename" else {"content": markup(what)}))
            rows = own if rows is None else rows.unionByName(own)
        after = sequences.durable(updates.apply(nodes, rows))
        self.documents = lambda x: after if x == new else known(x)
        return self.rows(replaced(body, ("var", name), ("call", "doc", [("literal", new, "string")])), env)

    def node_sets(self, how: str, left: Rows, right: Rows) -> Rows:
        """Sets of nodes go by identity, not by value, and come in document order."""
        if left.item.member != right.item.member:
            raise QueryError("XPTY0004", "the nodes are of different documents")
        a, b = (x.df.select(*[x.item.fields[c].col.alias(c) for c in COLUMNS]) for x in (left, right))
        key = ["doc_id", "pre"]
        if how in ("union", "|"):
            a = a.unionByName(b)
        else:
            a = a.join(b.select(*key), key, "left_semi" if how == "intersect" else "left_anti")
        return self.node_rows(a.dropDuplicates(key), left.item.member)

    def start(self, node) -> str | None:
        """The name of the documents that a path starts from, or the variable that it does, as $name."""
        while node[0] == "step":
            node = node[1]
        if node[0] == "call" and node[1].removeprefix("fn:") == "doc":
            return str(node[2][0][1])
        return f"${node[1]}" if node[0] == "var" else None

    def node_rows(self, df: DataFrame, documents: str) -> Rows:
        """Nodes as items: their columns are fields, and in document order they are sorted by."""
        names = {c: self.fresh(c) for c in COLUMNS}
        types = {"doc_id": "integer", "pre": "integer", "size": "integer", "level": "integer", "parent": "integer"}
        item = V(F.col(names["string_value"]), "node", fields={c: V(F.col(n), types.get(c, "string")) for c, n in names.items()}, member=documents)
        return Rows(df.select(*[F.col(c).alias(n) for c, n in names.items()]), item, [F.col(names["doc_id"]), F.col(names["pre"])])

    def stepped(self, node, env) -> tuple[DataFrame, V]:
        """Rows (*COLUMNS, o) of a path from a node variable; o is the node it started from."""
        own = env[self.start(node)[1:]]
        if not (isinstance(own, V) and own.type == "node"):
            raise QueryError("XPTY0019", f"{self.start(node)} is no node")
        self.stream.flush()
        nodes = self.documents(own.member)
        context = self.stream.df.select(*[own.fields[c].col.alias(c) for c in COLUMNS]).dropDuplicates(["doc_id", "pre"]).withColumn("o", F.col("pre"))

        def rooted(n):
            return ("step", rooted(n[1]), *n[2:]) if n[0] == "step" else ("context",)

        return Paths(nodes).run(rooted(node), context), own

    def reread(self, df: DataFrame) -> Rows:
        names = {f.name: self.fresh(f.name) for f in df.schema.fields}
        df2 = df.select(*[F.col(f"`{k}`").alias(v) for k, v in names.items()])
        fields = {f.name: from_type(F.col(names[f.name]), f.dataType) for f in df.schema.fields}
        return Rows(df2, fields["item"] if list(fields) == ["item"] else V(F.struct(*[F.col(v).alias(k) for k, v in names.items()]), "record", fields=fields))

    def collection(self, name: str) -> Rows:
        return self.reread(self.collections(name))

    def on(self, rows: Rows, node, env) -> V:
        outer, self.stream = self.stream, Stream(rows.df, dict(env))
        v = self.expr(node, {**env, ".": rows.item})
        rows.df, self.stream = self.stream.df, outer
        return v

    def filtered(self, rows: Rows, predicate, env) -> Rows:
        if predicate[0] == "literal" and predicate[2] == "integer":
            df = rows.df.offset(predicate[1] - 1) if predicate[1] > 1 else rows.df
            return Rows(df.limit(1), rows.item, rows.order)
        if predicate[0] == "value" and predicate[2] == ("call", "position", []) and predicate[1] in ("le", "lt") and predicate[3][0] == "literal":
            return Rows(rows.df.limit(predicate[3][1] - (predicate[1] == "lt")), rows.item, rows.order)
        outer, self.stream = self.stream, Stream(rows.df, dict(env))
        test = self.test(predicate, {**env, ".": rows.item})
        rows.df, self.stream = self.stream.df, outer
        return Rows(rows.df.where(test), rows.item, rows.order)

    def correlated(self, node, env) -> tuple[Rows, Column | None]:
        """Rows of an expression over a collection whose filters may look at the stream; those conditions apart."""
        if node[0] == "lookup":
            node = ("map", node[1], ("lookup", ("context",), node[2]))
        if node[0] == "filter" and self.depends(node[2], env):
            rows, cond = self.correlated(node[1], env)
            test = self.test(node[2], {**env, ".": rows.item})
            return rows, test if cond is None else cond & test
        if node[0] == "var":
            return self.correlated(env[node[1]][1], env[node[1]][2] | {k: v for k, v in env.items() if isinstance(v, V)})
        if node[0] == "map":
            rows, cond = self.correlated(node[1], env)
            return Rows(rows.df, self.expr(node[2], {**env, ".": rows.item})), cond
        if node[0] == "flwor" and len(node[1]) and all(c[0] in ("for", "where") for c in node[1]) and sum(c[0] == "for" for c in node[1]) == 1 and any(c[0] == "where" and self.mentions(c[1], env) for c in node[1]):
            rows, cond = self.correlated(node[1][0][2], env)
            inner = {**env, node[1][0][1]: rows.item}
            for c in node[1][1:]:
                test = self.test(c[1], inner)
                cond = test if cond is None else cond & test
            return Rows(rows.df, self.expr(node[2], inner)), cond
        return self.rows(node, {**env, "#inner": True}), None

    def mentions(self, node, env) -> bool:
        """Whether an expression uses a variable bound to the stream."""
        if isinstance(node, tuple) and len(node) == 2 and node[0] == "var":
            own = env.get(node[1])
            return isinstance(own, V) and own.literal is None and own.call is None
        return isinstance(node, (tuple, list)) and any(self.mentions(x, env) for x in node if isinstance(x, (tuple, list)))

    # FLWOR ----------------------------------------------------------------------------------------------------
    def flwor(self, node, env) -> Rows:
        _, clauses, body, other = node
        outer, self.stream = self.stream, Stream(None, {k: v for k, v in env.items() if k != "#inner"})
        s = self.stream
        for c in clauses:
            if s.df is None and c[0] not in ("for", "window"):
                s.df = self.spark.range(1).select()
            getattr(self, f"clause_{c[0]}")(c, s)
        item = self.expr(body, s.env)
        keep = s.order
        s.flush()
        if s.sorted and s.joined:
            s.df = s.df.orderBy(*s.order)
        out = Rows(s.df, item, keep)
        self.stream = outer
        if item.many:
            name = self.fresh("item")
            out = Rows(s.df.select(F.explode(item.col).alias(name)), item.of(F.col(name), many=False), [])
        elif item.type != "record":
            name = self.fresh("item")
            out = Rows(s.df.select((item.col if item.col is not None else F.lit(None).cast("string")).alias(name)), item.of(F.col(name)), [])
        else:
            names = {k: self.fresh(k) for k in item.fields}
            df = s.df.select(*[(v.col if v.col is not None else F.lit(None)).alias(names[k]) for k, v in item.fields.items()])
            fields = {k: v.of(F.col(names[k])) for k, v in item.fields.items()}
            out = Rows(df, V(F.struct(*[F.col(n).alias(k) for k, n in names.items()]), "record", fields=fields), [])
        if other is not None:
            left, right = self.finish(out), self.finish(self.rows(other, env))
            out = self.reread(left.unionByName(right.join(left.limit(1).select(F.lit(1).alias("#some")), how="left_anti")))
        return out

    def clause_for(self, c, s: Stream) -> None:
        _, name, source, at, empty, member = c
        s.flush()
        if source[0] == "step" and (self.start(source) or "").startswith("$"):
            found, own = self.stepped(source, s.env)
            origin = self.fresh("o")
            rows = self.node_rows(found.withColumnRenamed("o", origin), own.member)
            df = found.select(*[F.col(c).alias(n) for c, n in zip(COLUMNS, rows.df.columns)], F.col("o").alias(origin))
            on = (own.fields["doc_id"].col == rows.item.fields["doc_id"].col) & (own.fields["pre"].col == F.col(origin))
            s.df = s.df.join(df, on, "left" if empty else "inner").drop(origin)
            s.env[name] = rows.item
            if at:
                number_ = self.fresh(at)
                s.df = s.df.withColumn(number_, F.row_number().over(Window.partitionBy(own.fields["doc_id"].col, own.fields["pre"].col).orderBy(rows.item.fields["pre"].col)).cast("bigint"))
                s.env[at] = V(F.col(number_), "integer")
            return
        if self.table(source, s.env):
            if s.df is None:
                rows = self.rows(source, s.env)
                s.df = rows.df
            else:
                rows, cond = self.correlated(source, s.env)
                s.df = s.df.join(rows.df, cond if cond is not None else F.lit(True), "left") if empty else s.df.crossJoin(rows.df) if cond is None else s.df.join(rows.df, cond)
            s.env[name] = rows.item
            if at:
                own = self.fresh(at)
                s.df = sequences.numbered(s.df, rows.order, own)
                s.env[at] = V(F.col(own), "integer")
            return
        if s.df is None:
            s.df = self.spark.range(1).select()
        v = self.expr(source, s.env)
        own, number_ = self.fresh(name), self.fresh(at or "at")
        array = v.col if member and v.type == "array" else seq(v)
        exploded = (F.posexplode_outer if empty else F.posexplode)(array).alias(number_, own)
        s.df = s.df.select("*", exploded)
        kind = v.member if member else v.type
        s.env[name] = replace(v.of(F.col(own), kind, many=False), fields={k: x.of(F.col(own).getField(k)) for k, x in v.fields.items()} if v.fields else None)
        if at:
            s.env[at] = V(F.col(number_).cast("bigint") + 1, "integer")
        s.order = [*s.order, F.col(number_)]

    def test(self, node, env) -> Column:
        """A condition for a filter or a join, where null counts as false: bare comparisons, which Spark can push down and join by."""
        if node[:2] in (("binary", "and"), ("binary", "or")):
            a, b = self.test(node[2], env), self.test(node[3], env)
            return a & b if node[1] == "and" else a | b
        if node[0] in ("value", "general"):
            a, b = self.expr(node[2], env), self.expr(node[3], env)
            if not a.many and not b.many:
                return self.compared(node[1], a, b)
            return ebv(self.expr(node, env))
        v = self.expr(node, env)
        return v.col if v.type == "boolean" and not v.many else ebv(v)

    def clause_let(self, c, s: Stream) -> None:
        _, name, source = c
        if self.table(source, s.env):
            s.env[name] = ("lazy", source, dict(s.env))
            return
        s.env[name] = self.expr(source, s.env)

    def clause_where(self, c, s: Stream) -> None:
        for part in self.conjuncts(c[1]):
            found = self.membership(part, s.env)
            if found is not None:
                source, test, anti = found
                s.flush()
                if isinstance(test, str):
                    rows, cond = self.correlated(source, s.env)
                else:
                    rows, cond = self.correlated(source, s.env)
                    more = self.test(test[1], {**s.env, test[0]: rows.item})
                    cond = more if cond is None else cond & more
                s.df = s.df.join(rows.df, cond if cond is not None else F.lit(True), "left_anti" if anti else "left_semi")
            else:
                test = self.test(part, s.env)
                s.apply(lambda df, test=test: df.where(test))

    def conjuncts(self, node) -> list:
        return [*self.conjuncts(node[2]), *self.conjuncts(node[3])] if node[:2] == ("binary", "and") else [node]

    def membership(self, node, env):
        """(source, (variable, test) or 'any', anti) of a quantifier or an existence test over a collection."""
        if node[0] == "call" and node[1].removeprefix("fn:") == "not" and len(node[2]) == 1:
            inner = self.membership(node[2][0], env)
            return None if inner is None else (inner[0], inner[1], not inner[2])
        if node[0] == "call" and node[1].removeprefix("fn:") in ("exists", "empty") and self.table(node[2][0], env):
            return node[2][0], "any", node[1].removeprefix("fn:") == "empty"
        if node[0] == "quantified" and len(node[2]) == 1 and self.table(node[2][0][1], env):
            name, source = node[2][0]
            if node[1] == "some":
                return source, (name, node[3]), False
            return source, (name, ("call", "not", [node[3]])), True
        if node[0] == "general" and node[1] == "eq" and self.table(node[3], env):
            return node[3], ("#x", ("general", "eq", node[2], ("var", "#x"))), False
        return None

    def clause_group(self, c, s: Stream) -> None:
        keys = []
        for name, source, collation in c[1]:
            v = self.expr(source, s.env) if source is not None else s.env[name]
            if collation:
                v = V(collated(text(v), literal(collation, "string")), "string")
            keys.append((name, v, self.fresh(name)))
        s.flush()
        for _, v, own in keys:
            s.df = s.df.withColumn(own, one(v) if v.type != "untypedAtomic" else text(v))
        s.env = {k: replace(v, grouped=True) if isinstance(v, V) and v.call is None and v.literal is None else v for k, v in s.env.items()}
        for name, v, own in keys:
            s.env[name] = replace(v.of(F.col(own), many=False), fields=None)
        s.sorted = False
        s.keys, s.order = [(own, F.col(own)) for _, _, own in keys], []

    def sort_keys(self, keys) -> list[Column]:
        out = []
        for v, down, greatest, *collation in keys:
            c = collated(text(v), literal(collation[0], "string")) if collation and collation[0] else one(v)
            out.append(c.desc_nulls_first() if down and greatest else c.desc_nulls_last() if down else c.asc_nulls_last() if greatest else c.asc_nulls_first())
        return out

    def clause_order(self, c, s: Stream) -> None:
        order = self.sort_keys([(self.expr(k, s.env), down, greatest, collation) for k, down, greatest, collation in c[1]])
        s.apply(lambda df: df.orderBy(*order))
        s.order, s.sorted, s.joined = order, True, False

    def clause_count(self, c, s: Stream) -> None:
        own, order = self.fresh(c[1]), s.order
        s.apply(lambda df: sequences.numbered(df, order, own))
        s.env[c[1]] = V(F.col(own), "integer")
        s.order = [F.col(own)]

    def clause_while(self, c, s: Stream) -> None:
        """Tuples up to the first that fails: none behind its place is kept."""
        test, place, order = ebv(self.expr(c[1], s.env)), self.fresh("while"), s.order

        def kept(df: DataFrame) -> DataFrame:
            rows = sequences.numbered(df, order, place)
            first = rows.where(~test).agg(F.min(place).alias("#first"))
            return rows.crossJoin(F.broadcast(first)).where(F.col("#first").isNull() | (F.col(place) < F.col("#first"))).drop("#first")  # one row

        s.apply(kept)
        s.order = [F.col(place)]

    def clause_window(self, c, s: Stream) -> None:
        _, kind, name, source, start, end, only = c
        s.flush()
        if self.table(source, s.env):
            rows = self.rows(source, s.env)
            if not rows.order:
                raise QueryError("XPTY0004", "a window over a collection needs an order: sort its source")
            own = self.fresh("w")
            s.df = windows.numbered(rows.df, rows.order, rows.item.col, own)
            v = V(F.col(own), rows.item.type, many=True, fields=rows.item.fields)
        else:
            if s.df is None:
                s.df = self.spark.range(1).select()
            v = self.expr(source, s.env)
        bound = lambda names, roles: {names[r]: x for r, x in roles.items() if r in names}
        element = lambda col: replace(v.of(col, many=False), fields={k: x.of(col.getField(k)) for k, x in v.fields.items()} if v.fields else None)

        def roles(names, a: Column, i: Column) -> dict[str, V]:
            return bound(names, {"item": element(F.get(a, i)), "at": V((i + 1).cast("bigint"), "integer"), "previous": element(F.get(a, i - 1)), "next": element(F.get(a, i + 1))})

        starts = lambda a, i: ebv(self.expr(start[1], {**s.env, **roles(start[0], a, i)}))
        ends = None if end is None else lambda a, i, j: ebv(self.expr(end[1], {**s.env, **roles(start[0], a, i), **roles(end[0], a, j)}))
        own = self.fresh(name)
        ranges = windows.ranges(seq(v), starts, ends, kind == "sliding", only)
        array, span = self.fresh("a"), self.fresh("r")
        s.df = s.df.select("*", seq(v).alias(array), F.explode(ranges).alias(span))
        a, i, j = F.col(array), F.col(span).getField("s"), F.col(span).getField("e")
        s.df = s.df.withColumn(own, F.slice(a, i + 1, j - i + 1))
        s.env |= {**roles(start[0], a, i), **(roles(end[0], a, j) if end else {}), name: V(F.col(own), v.type, many=True, fields=v.fields, member=v.member)}
        s.order = [*s.order, F.col(span).getField("s")]

    # expressions ----------------------------------------------------------------------------------------------
    def expr(self, node, env) -> V:
        return getattr(self, "e_" + node[0].replace("-", "_"))(node, env)

    def e_literal(self, node, env) -> V:
        return literal(node[1], node[2])

    def e_var(self, node, env) -> V:
        if node[1] not in env:
            raise QueryError("XPST0008", f"undeclared variable ${node[1]}")
        v = env[node[1]]
        if isinstance(v, tuple):
            return self.attached(node, env) if self.table(v[1], v[2]) else self.expr(v[1], v[2])
        if v.grouped and self.stream is not None and self.stream.keys is not None and not env.get("#aggregate"):
            return self.summed(F.collect_list(v.col), v, many=True)
        return v

    def e_context(self, node, env) -> V:
        if "." not in env:
            raise QueryError("XPDY0002", "no context item")
        return env["."]

    def e_sequence(self, node, env) -> V:
        parts = [self.expr(x, env) for x in node[1]]
        if not parts:
            return V(F.array().cast("array<string>"), "string", many=True)
        kind = parts[0].type
        if any(p.type != kind for p in parts):
            kind = NUMERIC[max(NUMERIC.index(p.type) for p in parts)] if all(p.type in NUMERIC for p in parts) else "string"
            parts = [p.of(seq(p).cast(f"array<{SPARK[kind]}>"), kind, many=True) for p in parts]
        return V(F.concat(*map(seq, parts)), kind, many=True, fields=parts[0].fields, member=parts[0].member)

    def e_binary(self, node, env) -> V:
        _, op, a, b = node
        if op in ("and", "or"):
            x, y = ebv(self.expr(a, env)), ebv(self.expr(b, env))
            return V(x & y if op == "and" else x | y, "boolean")
        x, y = self.expr(a, env), self.expr(b, env)
        if op == "||":
            return V(F.concat(words(x), words(y)), "string")
        if op == "to":
            s, e = one(x).cast("bigint"), one(y).cast("bigint")
            return V(F.when(s <= e, F.sequence(s, F.greatest(s, e))).otherwise(F.array().cast("array<bigint>")), "integer", many=True)
        if op == "otherwise":
            if not x.many and not y.many:
                return V(F.coalesce(x.col, y.col), y.type if x.col is None else x.type, fields=x.fields, member=x.member)
            return V(F.when(F.size(seq(x)) > 0, seq(x)).otherwise(seq(y)), x.type, many=True)
        if op in ("union", "|", "intersect", "except"):
            how = {"intersect": F.array_intersect, "except": F.array_except}.get(op, F.array_union)
            return V(how(seq(x), seq(y)), x.type, many=True)
        return self.arithmetic(op, x, y)

    def arithmetic(self, op: str, x: V, y: V) -> V:
        if op in "+-*" and type(x.literal) is int and type(y.literal) is int:
            return literal({"+": x.literal + y.literal, "-": x.literal - y.literal, "*": x.literal * y.literal}[op], "integer")
        a, b = one(x), one(y)
        dates, spans = ("date", "dateTime"), ("dayTimeDuration", "yearMonthDuration")
        if x.type in dates or y.type in dates or x.type in spans or y.type in spans:
            if op == "-" and x.type in dates and y.type in dates:
                return V((a.cast("timestamp_ntz") - b.cast("timestamp_ntz")).cast(SPARK["dayTimeDuration"]), "dayTimeDuration")
            if op in "+-" and x.type in dates:
                return V((a + b if op == "+" else a - b).cast(SPARK[x.type]), x.type)
            if op == "+" and y.type in dates:
                return V((b + a).cast(SPARK[y.type]), y.type)
            kind = x.type if x.type in spans else y.type
            return V({"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "div": lambda: a / b}[op]().cast(SPARK[kind]), kind)
        kind = wider(x, y)
        if kind in ("double", "float"):
            a, b = (number(x), number(y)) if kind == "double" else (a.cast("float"), b.cast("float"))
        zero = lambda c, code: F.when(b == 0, F.raise_error(F.lit(f"[{code}] division by zero"))).otherwise(c)
        if op == "div":
            if kind in ("integer", "decimal"):
                return V(zero((a.cast("decimal(28,10)") / F.nullif(b.cast("decimal(28,10)"), F.lit(0).cast("decimal(28,10)"))).cast(SPARK["decimal"]), "FOAR0001"), "decimal")
            sign = F.when(a == 0, F.lit(float("nan"))).when(F.isnan(a), a).otherwise(F.signum(a) * F.lit(float("inf")))
            return V(F.when(b == 0, sign).otherwise(a / F.nullif(b, F.lit(0.0))), kind)
        if op == "idiv":
            return V(zero((a / F.nullif(b, F.lit(0).cast(SPARK[kind]))).cast("bigint") if kind != "integer" else F.try_divide(a - a % F.nullif(b, F.lit(0)), b).cast("bigint"), "FOAR0001"), "integer")
        if op == "mod":
            if kind in ("double", "float"):
                return V(F.when(b == 0, F.lit(float("nan"))).otherwise(a % F.nullif(b, F.lit(0.0))), kind)
            return V(zero(a % F.nullif(b, F.lit(0).cast(SPARK[kind])), "FOAR0001"), kind)
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}[op]()
        return V(out if kind in ("integer", "double", "float") else out.cast(SPARK[kind]), kind)

    def compared(self, op: str, a: V, b: V) -> Column:
        x, y = a.col, b.col
        numeric = a.type in NUMERIC or b.type in NUMERIC
        if numeric and (a.type in NUMERIC) != (b.type in NUMERIC):
            if a.type == "boolean" or b.type == "boolean":
                raise QueryError("XPTY0004", f"cannot compare {a.type} with {b.type}")
            x, y = (number(a), y) if a.type not in NUMERIC else (x, number(b))
        elif not numeric and a.type != b.type:
            if a.type in ("date", "dateTime") and b.type in ("string", "untypedAtomic"):
                y = cast(b, a.type).col
            elif b.type in ("date", "dateTime") and a.type in ("string", "untypedAtomic"):
                x = cast(a, b.type).col
        out = {"eq": lambda: x == y, "ne": lambda: x != y, "lt": lambda: x < y, "le": lambda: x <= y, "gt": lambda: x > y, "ge": lambda: x >= y}[op]()
        for v, c in ((a, x), (b, y)):  # NaN compares with nothing
            if v.type in ("double", "float") and v.literal is None:
                out = out & ~F.isnan(c) if op != "ne" else out | F.isnan(c)
        return out

    def e_value(self, node, env) -> V:
        a, b = self.expr(node[2], env), self.expr(node[3], env)
        a, b = (v.of(one(v), many=False) if v.many else v for v in (a, b))
        if type(a.literal) is int and type(b.literal) is int:
            return literal({"eq": a.literal == b.literal, "ne": a.literal != b.literal, "lt": a.literal < b.literal, "le": a.literal <= b.literal, "gt": a.literal > b.literal, "ge": a.literal >= b.literal}[node[1]], "boolean")
        return V(self.compared(node[1], a, b), "boolean")

    def e_general(self, node, env) -> V:
        a, b = self.expr(node[2], env), self.expr(node[3], env)
        if not a.many and not b.many:
            return V(F.coalesce(self.compared(node[1], a, b), F.lit(False)), "boolean")
        each = lambda x, y: F.coalesce(self.compared(node[1], a.of(x, many=False), b.of(y, many=False)), F.lit(False))
        return V(F.exists(seq(a), lambda x: F.exists(seq(b), lambda y: each(x, y))), "boolean")

    def e_minus(self, node, env) -> V:
        v = self.expr(node[1], env)
        v = v if v.type in NUMERIC or "Duration" in v.type else V(number(v), "double")
        return V(-one(v), v.type, literal=-v.literal if v.literal is not None else None)

    def e_if(self, node, env) -> V:
        test = self.expr(node[1], env)
        if type(test.literal) is bool:
            return self.expr(node[2] if test.literal else node[3], env)
        a, b = self.expr(node[2], env), self.expr(node[3], env)
        if a.many or b.many:
            empty = lambda v: v.many and v.type == "string" and v.literal is None
            if not a.many and empty(b):
                return a.of(F.when(ebv(test), a.col))
            kind = b.type if empty(a) else a.type
            target = f"array<{SPARK.get(kind, 'string')}>"
            return V(F.when(ebv(test), seq(a).cast(target)).otherwise(seq(b).cast(target)), kind, many=True)
        if a.type == "record" and a.fields and b.fields and set(a.fields) == set(b.fields):
            pick = {k: V(F.when(ebv(test), a.fields[k].col).otherwise(b.fields[k].col), a.fields[k].type) for k in a.fields}
            return V(F.struct(*[v.col.alias(k) for k, v in pick.items()]), "record", fields=pick)
        kind = a.type if a.type == b.type or a.type not in NUMERIC or b.type not in NUMERIC else wider(a, b)
        return V(F.when(ebv(test), a.col).otherwise(b.col), kind, member=a.member)

    def e_switch(self, node, env) -> V:
        value, out, kind = self.expr(node[1], env), None, None
        for keys, then in node[2]:
            test = None
            for k in keys:
                own = self.expr(k, env)
                same = F.coalesce(self.compared("eq", value, own), F.lit(False)) if not own.many else value.col.isNull()
                test = same if test is None else test | same
            v = self.expr(then, env)
            kind, out = kind or v, (F if out is None else out).when(test, v.col)
        return kind.of(out.otherwise(self.expr(node[3], env).col))

    def e_try(self, node, env) -> V:
        a, b = self.attempted(node[1], env), self.expr(node[2], env)
        if a.col is None or a.many or b.many:  # nothing in it that could fail
            return a
        failed = self.fails(node[1], env)
        return a if failed is None else a.of(F.when(failed, b.col).otherwise(a.col))

    def fails(self, node, env) -> Column | None:
        """When what attempted() tries raises an error: an empty operand gives an empty result, and that is none."""
        if node[0] == "cast" or node[0] == "call" and node[1].startswith("xs:"):
            own = node[1] if node[0] == "cast" else node[2][0]
            return self.attempted(node, env).col.isNull() & one(self.expr(own, env)).isNotNull()
        if node[0] == "binary" and node[1] in ("div", "idiv", "mod"):
            x, y = self.expr(node[2], env), self.expr(node[3], env)
            return F.coalesce((one(y) == 0) & one(x).isNotNull() & F.lit(not (node[1] == "div" and "double" in (x.type, y.type))), F.lit(False))
        if node[0] == "call" and node[1].removeprefix("fn:") == "error":
            return F.lit(True)
        return None

    def e_typeswitch(self, node, env) -> V:
        """Types are known before the query runs, numbers of items are not: cases that can't fit fall away."""
        v = self.expr(node[1], env)
        name, other = node[3]
        out = self.expr(other, {**env, **({name: v} if name else {})})
        for own, types, then in reversed(node[2]):
            test = None
            for t in types:
                fits = self.fits(v, t)
                test = fits if test is None else test | fits
            if not any(self.may_fit(v, t) for t in types):
                continue
            got = self.expr(then, {**env, **({own: v} if own else {})})
            if got.many or out.many:
                target = f"array<{SPARK.get(got.type, 'string')}>"
                out = V(F.when(test, seq(got).cast(target)).otherwise(seq(out).cast(target)), got.type, many=True)
            else:
                if got.type != out.type and not (got.type in NUMERIC and out.type in NUMERIC):
                    got, out = (V(text(x), "string") for x in (got, out))
                kind = got.type if got.type == out.type else wider(got, out)
                out = V(F.when(test, got.col).otherwise(out.col), kind, member=got.member)
        return out

    def attempted(self, node, env) -> V:
        """An expression whose errors give null: casts and divisions, the ones that Spark can try."""
        if node[0] == "cast" or node[0] == "call" and node[1].startswith("xs:"):
            return cast(self.expr(node[1] if node[0] == "cast" else node[2][0], env), node[2] if node[0] == "cast" else node[1], soft=True)
        if node[0] == "binary" and node[1] in ("div", "idiv", "mod"):
            x, y = self.expr(node[2], env), self.expr(node[3], env)
            safe = y.of(F.nullif(one(y), F.lit(0).cast(SPARK[y.type])))
            return self.arithmetic(node[1], x, safe)
        if node[0] == "call" and node[1].removeprefix("fn:") == "error":
            return V(F.lit(None).cast("string"), "string")
        return self.expr(node, env)

    def e_quantified(self, node, env) -> V:
        _, kind, binds, test = node

        def run(k: int, own) -> Column:
            if k == len(binds):
                return ebv(self.expr(test, own))
            v = self.expr(binds[k][1], own)
            inside = lambda c: run(k + 1, {**own, binds[k][0]: replace(v.of(c, many=False), fields={n: x.of(c.getField(n)) for n, x in v.fields.items()} if v.fields else None)})
            return (F.exists if kind == "some" else F.forall)(seq(v), inside)

        return V(F.coalesce(run(0, env), F.lit(False)), "boolean")

    def e_cast(self, node, env) -> V:
        return cast(self.expr(node[1], env), node[2])

    def e_castable(self, node, env) -> V:
        v = self.expr(node[1], env)
        return V(cast(v, node[2], soft=True).col.isNotNull() | (one(v).isNull() & F.lit(node[2].endswith("?"))), "boolean")

    def e_treat(self, node, env) -> V:
        return self.expr(node[1], env)

    def e_instance(self, node, env) -> V:
        return V(self.fits(self.expr(node[1], env), node[2]), "boolean")

    def may_fit(self, v: V, want: str) -> bool:
        name = want.rstrip("?*+").removeprefix("xs:")
        return name in ("item", v.type, "anyAtomicType") or name == "decimal" and v.type == "integer" or name == "map" and v.type == "record" or name == "numeric" and v.type in NUMERIC

    def fits(self, v: V, want: str) -> Column:
        mark, fits = want[-1] if want[-1] in "?*+" else "", self.may_fit(v, want)
        n = F.size(seq(v))
        size = {"": n == 1, "?": n <= 1, "*": F.lit(True), "+": n >= 1}[mark]
        return (size & F.lit(fits)) | ((n == 0) & F.lit(mark in "?*" and mark != ""))

    # constructors: an element is its own serialization, so that rows of them need no node table ------------------
    def content(self, part, env) -> Column:
        """What stands in an element for a text, an enclosed expression or a constructor: atomic items are joined by blanks."""
        if isinstance(part, str):
            return F.lit(part.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        v = self.expr(part, env)
        if v.type in ("element", "markup"):
            return F.array_join(v.col, "") if v.many else F.coalesce(v.col, F.lit(""))
        if v.col is None:
            return F.lit("")
        if v.many:
            return escaped(F.array_join(F.transform(seq(v), lambda c: text(V(c, v.type))), " "))
        return escaped(words(v))

    def attribute(self, name: Column, value: Column) -> Column:
        return F.concat(F.lit(" "), name, F.lit('="'), value, F.lit('"'))

    def made(self, name: Column, attributes: list[Column], content: list[Column]) -> V:
        inside = F.concat(*content) if content else F.lit("")
        start = F.concat(F.lit("<"), name, *attributes)
        return V(F.when(inside == "", F.concat(start, F.lit("/>"))).otherwise(F.concat(start, F.lit(">"), inside, F.lit("</"), name, F.lit(">"))), "element")

    def e_element(self, node, env) -> V:
        _, name, attributes, parts = node
        value = lambda x: F.lit(x.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")) if isinstance(x, str) else self.attribute_value(self.expr(x, env))
        own = [self.attribute(F.lit(k), F.concat(*map(value, v)) if v else F.lit("")) for k, v in attributes]
        return self.made(F.lit(name), own, [self.content(p, env) for p in parts])

    def attribute_value(self, v: V) -> Column:
        joined = F.array_join(F.transform(seq(v), lambda c: text(V(c, v.type))), " ") if v.many else words(v)
        return escaped(joined, attribute=True)

    def e_computed_element(self, node, env) -> V:
        """Attributes that lead the content of a computed element become its own."""
        name, body = words(self.expr(node[1], env)), node[2]
        parts = body[1] if body[0] == "sequence" else [body]
        own = [p for p in parts if p[0] == "computed-attribute"]
        if parts[: len(own)] != own:
            raise QueryError("XQTY0024", "an attribute stands behind other content")
        made = [self.attribute(words(self.expr(p[1], env)), self.attribute_value(self.expr(p[2], env))) for p in own]
        return self.made(name, made, [self.content(p, env) for p in parts[len(own) :]])

    def e_computed_text(self, node, env) -> V:
        return V(self.content(node[1], env), "markup")

    def e_computed_comment(self, node, env) -> V:
        return V(F.concat(F.lit("<!--"), words(self.expr(node[1], env)), F.lit("-->")), "markup")

    def e_computed_document(self, node, env) -> V:
        return V(self.content(node[1], env), "element")

    def e_comment(self, node, env) -> V:
        return V(F.lit(f"<!--{node[1]}-->"), "markup")

    def e_instruction(self, node, env) -> V:
        return V(F.lit(f"<?{node[1]} {node[2]}?>"), "markup")

    def e_template(self, node, env) -> V:
        """A string constructor: its expressions' items are joined by blanks."""
        value = lambda p: F.lit(p) if isinstance(p, str) else self.joined(self.expr(p, env))
        return V(F.concat(F.lit(""), *map(value, node[1])), "string")

    def joined(self, v: V) -> Column:
        return F.array_join(F.transform(seq(v), lambda c: text(V(c, v.type))), " ") if v.many else words(v)

    def e_filter(self, node, env) -> V:
        if self.table(node, env):
            return self.attached(node, env)
        v, p = self.expr(node[1], env), node[2]
        array = seq(v)
        element = lambda c: replace(v.of(c, many=False), fields={k: x.of(c.getField(k)) for k, x in v.fields.items()} if v.fields else None)
        probe = {**env, ".": element(F.get(array, 0)), "#last": F.size(array), "#position": F.lit(1)}
        kind = self.expr(p, probe)
        if kind.type in NUMERIC and not kind.many:
            at = self.expr(p, {**env, "#last": F.size(array), "#position": F.lit(1), ".": element(F.get(array, 0))}).col
            return element(F.when(at >= 1, F.get(array, (at - 1).cast("int"))))
        test = lambda c, i: ebv(self.expr(p, {**env, ".": element(c), "#last": F.size(array), "#position": (i + 1).cast("bigint")}))
        return replace(v.of(F.filter(array, test), many=True), fields=v.fields)

    def e_map(self, node, env) -> V:
        if self.table(node, env):
            return self.attached(node, env)
        v = self.expr(node[1], env)
        element = lambda c: replace(v.of(c, many=False), fields={k: x.of(c.getField(k)) for k, x in v.fields.items()} if v.fields else None)
        if not v.many:
            return self.expr(node[2], {**env, ".": v})
        kind = self.expr(node[2], {**env, ".": element(F.get(v.col, 0))})
        inside = lambda c: self.expr(node[2], {**env, ".": element(c)})
        if kind.many:
            return kind.of(F.flatten(F.transform(v.col, lambda c: inside(c).col)), many=True)
        return kind.of(F.filter(F.transform(v.col, lambda c: inside(c).col), lambda x: x.isNotNull()), many=True)

    def e_lookup(self, node, env) -> V:
        if self.table(node, env):
            return self.attached(node, env)
        v, key = self.expr(node[1], env), node[2]
        if v.many and v.type in ("record", "map", "array"):
            inner = lambda c: self.looked(replace(v, col=c, many=False, fields={k: x.of(c.getField(k)) for k, x in v.fields.items()} if v.fields else None), key, env)
            kind = inner(F.get(v.col, 0))
            return kind.of(F.transform(v.col, lambda c: inner(c).col), many=True)
        return self.looked(v, key, env)

    def looked(self, v: V, key, env) -> V:
        if v.type == "record":
            if key == ("all",):
                parts = list(v.fields.values())
                return V(F.array(*[p.col for p in parts]), parts[0].type, many=True)
            k = self.expr(key, env)
            got = v.fields.get(str(k.literal))
            if got is None:
                return V(F.lit(None).cast("string"), "string")
            if v.grouped and not env.get("#aggregate") and self.stream.keys is not None:
                return self.summed(F.collect_list(got.col), got, many=True)
            return got
        if v.type == "array":
            if key == ("all",):
                return V(v.col, v.member, many=True)
            return LIBRARY["array:get"](v, self.expr(key, env))
        if v.type == "map":
            return V(F.map_values(v.col), v.member, many=True) if key == ("all",) else LIBRARY["map:get"](v, self.expr(key, env))
        if v.type == "variant":
            return V(F.try_variant_get(v.col, F.lit(f"$.{self.expr(key, env).literal}"), "string"), "untypedAtomic")
        if v.type in ("string", "item", "untypedAtomic"):  # JSON text: a field is read without parsing the rest
            return V(F.get_json_object(v.col, f"$.{self.expr(key, env).literal}"), "untypedAtomic")
        raise QueryError("XPTY0004", f"no lookup in {v.type}")

    def e_array(self, node, env) -> V:
        parts = [self.expr(x, env) for x in node[1]]
        if not parts:
            return V(F.array().cast("array<string>"), "array", member="string")
        kind = parts[0].type if len({p.type for p in parts}) == 1 else "double" if all(p.type in NUMERIC for p in parts) else "string"
        return V(F.array(*[p.col.cast(SPARK[kind]) if kind in SPARK else p.col for p in parts]), "array", member=kind)

    def e_array_of(self, node, env) -> V:
        v = self.expr(node[1], env)
        return V(seq(v), "array", member=v.type)

    def e_map_of(self, node, env) -> V:
        parts = [(self.expr(k, env), self.expr(v, env)) for k, v in node[1]]
        if all(k.literal is not None and k.type == "string" for k, _ in parts):
            fields = {str(k.literal): v for k, v in parts}
            if len(fields) < len(parts):
                raise QueryError("XQDY0137", "a map constructor repeats a key")
            return V(F.struct(*[(v.col if v.col is not None else F.lit(None)).alias(k) for k, v in fields.items()]), "record", fields=fields)
        return V(F.create_map(*[c for k, v in parts for c in (one(k), v.col)]), "map", member=parts[0][1].type)

    def e_inline(self, node, env) -> V:
        params = node[1]

        def call(*args: V) -> V:
            if params is None:
                return self.expr(node[2], {**env, ".": args[0]})
            if len(args) != len(params):
                raise QueryError("XPTY0004", f"a function of {len(params)} arguments got {len(args)}")
            return self.expr(node[2], {**env, **dict(zip(params, args))})

        return V(None, "function", call=call, arity=1 if params is None else len(params))

    def e_reference(self, node, env) -> V:
        return V(None, "function", call=lambda *args: self.apply(node[1], list(args), env), arity=node[2], name=node[1])

    def e_dynamic(self, node, env) -> V:
        f = self.expr(node[1], env)
        if f.call is None:
            if f.type == "array":
                return LIBRARY["array:get"](f, self.expr(node[2][0], env))
            return LIBRARY["map:get"](f, self.expr(node[2][0], env))
        return self.partial(lambda args: f.call(*args), node[2], env)

    def partial(self, run, args, env) -> V:
        if ("hole",) not in args:
            return run([self.expr(a, env) for a in args])

        def call(*given: V) -> V:
            more = iter(given)
            return run([next(more) if a == ("hole",) else self.expr(a, env) for a in args])

        return V(None, "function", call=call, arity=args.count(("hole",)))

    def e_call(self, node, env) -> V:
        name, args = node[1].removeprefix("fn:"), node[2]
        if name == "position" and not args:
            if "#position" not in env:
                raise QueryError("XPDY0002", "no context position")
            return V(env["#position"].cast("bigint"), "integer")
        if name == "last" and not args:
            return V(env["#last"].cast("bigint"), "integer")
        if name in AGGREGATES and args:
            if self.table(args[0], env):
                return self.attached(node, env)
            if self.stream is not None and self.stream.keys is not None and not env.get("#aggregate") and self.groups(args[0], env):
                return self.aggregate(name, args, env)
        if name in ("exists", "empty") and self.table(args[0], env):
            n = self.attached(("call", "count", [args[0]]), env)
            return V(n.col > 0 if name == "exists" else n.col == 0, "boolean")
        if not args and f"fn:{name}" in LIBRARY and name in ("string", "string-length", "normalize-space", "number", "data"):
            args = [("context",)]
        if name == "partition" and len(args) == 2:
            return windows.partition(self.expr(args[0], env), self.expr(args[1], env))
        if name == "transitive-closure":
            raise QueryError("XPST0017", f"{name} over rows: see arbora.operators.sequences")
        if name == "function-lookup":
            return self.e_reference(("reference", str(args[0][2][-1][1] if args[0][0] == "call" else args[0][1]), int(args[1][1])), env)
        if name == "doc-available" and args[0][0] == "literal":
            try:
                self.documents(str(args[0][1]))
            except QueryError:
                return V(F.lit(False), "boolean")
            return V(F.lit(True), "boolean")
        if name == "unparsed-text-available" and args[0][0] == "literal":
            return V(F.lit(readers.available(self.spark, str(args[0][1]))), "boolean")
        if name.startswith("ft:"):
            return fulltext.function(name, [self.expr(a, env) for a in args])
        return self.partial(lambda own: self.apply(node[1], own, env), args, env)

    def e_hole(self, node, env) -> V:
        raise QueryError("XPST0003", "a placeholder stands only for an argument")

    def e_keyword(self, node, env) -> V:
        return self.expr(node[2], env)

    def e_fulltext(self, node, env) -> V:
        return V(fulltext.contains(text(self.expr(node[1], env)), node[2], lambda n: self.expr(n, env)), "boolean")

    def e_flwor(self, node, env) -> V:
        if self.table(node, env):
            return self.attached(node, env)
        return self.nested(node[1], node[2], env)

    def nested(self, clauses, body, env) -> V:
        """A FLWOR over sequences of one row: for is a transform, where a filter, order by a sort of the source."""
        if not clauses:
            return self.expr(body, env)
        c, rest = clauses[0], clauses[1:]
        if c[0] == "let":
            return self.nested(rest, body, {**env, c[1]: self.expr(c[2], env)})
        if c[0] == "where":
            v = self.nested(rest, body, env)
            return v.of(F.when(ebv(self.expr(c[1], env)), seq(v)).otherwise(F.filter(seq(v), lambda x: F.lit(False))), many=True)
        if c[0] == "for":
            v = self.expr(c[2], env)
            element = lambda col: replace(v.of(col, v.member if c[5] else v.type, many=False), fields={k: x.of(col.getField(k)) for k, x in v.fields.items()} if v.fields else None)
            source = v.col if c[5] else seq(v)
            inside = lambda col, i: self.nested(rest, body, {**env, c[1]: element(col), **({c[3]: V((i + 1).cast("bigint"), "integer")} if c[3] else {})})
            kind = inside(F.get(source, 0), F.lit(0))
            return kind.of(F.flatten(F.transform(source, lambda col, i: seq(inside(col, i)))), many=True)
        if c[0] == "order":
            raise QueryError("XPST0003", "order by in a nested expression: use fn:sort with a key")
        raise QueryError("XPST0003", f"{c[0]} in an expression over one row")

    def e_step(self, node, env) -> V:
        """A path from a node variable, as the sequence of its nodes' string values, joined to the stream."""
        if not (self.start(node) or "").startswith("$"):
            raise QueryError("XPST0003", "a path starts from doc() or a node variable")
        found, own = self.stepped(node, env)
        name, d, o = self.fresh("path"), self.fresh("d"), self.fresh("o")
        values = found.groupBy(F.col("doc_id").alias(d), F.col("o").alias(o)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "string_value"))), lambda e: e.string_value).alias(name))
        self.stream.joined = True
        self.stream.df = self.stream.df.join(values, (own.fields["doc_id"].col == F.col(d)) & (own.fields["pre"].col == F.col(o)), "left").drop(d, o)
        return V(F.coalesce(F.col(name), F.array().cast("array<string>")), "untypedAtomic", many=True)

    def e_node(self, node, env) -> V:
        a, b = self.expr(node[2], env), self.expr(node[3], env)
        x, y = (F.struct(v.fields["doc_id"].col.alias("d"), v.fields["pre"].col.alias("p")) for v in (a, b))
        return V({"is": x == y, "<<": x < y, ">>": x > y}[node[1]], "boolean")

    e_root = e_step

    def apply(self, name: str, args: list[V], env) -> V:
        own = self.functions.get((name.removeprefix("local:"), len(args)))
        if own is not None:
            depth = env.get("#depth", 0) + 1
            if depth > 60:
                raise QueryError("FOER0000", "recursion that no constant argument ends can't be planned")
            return self.expr(own[3], {"#depth": depth, **{k: v for k, v in env.items() if isinstance(v, tuple)}, **dict(zip(own[2], args))})
        full = name if ":" in name else f"fn:{name}"
        if full not in LIBRARY:
            raise QueryError("XPST0017", f"unknown function {name}")
        try:
            return LIBRARY[full](*args)
        except TypeError as e:
            raise QueryError("XPST0017", f"{name} doesn't take {len(args)} arguments: {e}") from e

    # aggregates -----------------------------------------------------------------------------------------------
    def groups(self, node, env) -> bool:
        if isinstance(node, tuple) and len(node) == 2 and node[0] == "var":
            own = env.get(node[1])
            return isinstance(own, V) and own.grouped
        return isinstance(node, (tuple, list)) and any(self.groups(x, env) for x in node if isinstance(x, (tuple, list)))

    def summed(self, c: Column, v: V, kind: str | None = None, many: bool = False) -> V:
        name = self.fresh("agg")
        self.stream.sums[name] = c
        return replace(v.of(F.col(name), kind, many=many), grouped=False)

    def aggregated(self, name: str, v: V, args, env) -> tuple[Column, str]:
        """The Spark aggregate of a function over items, and its type."""
        c = v.col
        kind = v.type if v.type in NUMERIC else "double"
        if name == "count":
            return F.count(F.lit(1) if v.type in ("record", "map", "array") or c is None else c), "integer"
        if name == "sum":
            return F.coalesce(F.sum(c if v.type in NUMERIC else number(v)), F.lit(0).cast(SPARK[kind])).cast(SPARK[kind]), kind
        if name == "avg":
            if v.type in ("integer", "decimal"):
                return F.avg(c.cast("decimal(28,8)")).cast(SPARK["decimal"]), "decimal"
            return F.avg(c if v.type in NUMERIC else number(v)), "double"
        if name == "min" and v.type in ("double", "float"):
            return F.when(F.max(F.isnan(c)), F.lit(float("nan"))).otherwise(F.min(c)), v.type
        if name in ("min", "max"):
            return (F.min if name == "min" else F.max)(c), v.type
        if name == "string-join":
            sep = str(self.expr(args[1], env).literal) if len(args) > 1 else ""
            return F.coalesce(F.array_join(F.array_sort(F.collect_list(text(v))), sep), F.lit("")), "string"
        raise QueryError("XPST0017", name)

    def aggregate(self, name: str, args, env) -> V:
        inner = {**env, "#aggregate": True}
        if name == "count" and args[0][0] == "call" and args[0][1].removeprefix("fn:") == "distinct-values":
            v = self.expr(args[0][2][0], inner)
            return self.summed(F.count_distinct(v.col), V(None, "integer"), "integer")
        v = self.expr(args[0], inner)
        if name == "distinct-values":
            return self.summed(F.array_sort(F.collect_set(v.col)), v, many=True)
        if v.many:
            raise QueryError("XPTY0004", "an aggregate over sequences within a group")
        c, kind = self.aggregated(name, v, args, env)
        return self.summed(c, V(None, kind), kind)

    def attached(self, node, env) -> V:
        """An aggregate over a collection as a column of the stream: joined by its conditions' equalities, or crossed."""
        if node[0] != "call" or node[1].removeprefix("fn:") not in AGGREGATES:
            raise QueryError("XPTY0004", "a collection within a row has to be aggregated, filtered or bound by for")
        name, args = node[1].removeprefix("fn:"), node[2]
        s = self.stream
        s.flush()
        source, distinct = args[0], False
        if name == "count" and source[0] == "call" and source[1].removeprefix("fn:") == "distinct-values":
            source, distinct = source[2][0], True
        if s.df is None:
            s.df = self.spark.range(1).select()
        if not (source[0] in ("filter", "map", "lookup", "flwor", "var") and self.depends(source, env)):
            rows = self.rows(source, {**env, "#inner": True})
            c, kind = (F.count_distinct(rows.item.col), "integer") if distinct else self.aggregated(name, rows.item, args, env)
            own = self.fresh("agg")
            s.joined = True
            s.df = s.df.crossJoin(rows.df.agg(c.alias(own)))
            return V(F.col(own), kind)
        rows, cond = self.correlated(source, env)
        keys = [self.fresh("key") for _ in s.df.columns]
        c, kind = (F.count_distinct(rows.item.col), "integer") if distinct else self.aggregated(name, rows.item, args, env)
        own = self.fresh("agg")
        pairs = self.equalities(source, env, rows)
        if pairs is None:
            raise QueryError("XPTY0004", "an aggregate over a collection may depend on the row by equalities only")
        inner = rows.df.groupBy(*[b.alias(k) for (_, b), k in zip(pairs, keys)]).agg(c.alias(own))
        test = F.lit(True)
        for (a, _), k in zip(pairs, keys):
            test = test & (a == F.col(k))
        s.joined = True
        s.df = s.df.join(inner, test, "left")
        return V(F.coalesce(F.col(own), F.lit(0)) if name == "count" else F.coalesce(F.col(own), F.lit(0).cast(SPARK[kind])) if name == "sum" else F.col(own), kind)

    def depends(self, node, env) -> bool:
        if node[0] == "var" and len(node) == 2 and isinstance(env.get(node[1]), tuple):
            return self.depends(env[node[1]][1], env)
        return self.mentions(node, env) or any(self.depends(x, env) for x in node if isinstance(x, tuple) and x and isinstance(x[0], str))

    def equalities(self, node, env, rows: Rows) -> list[tuple[Column, Column]] | None:
        """(row's side, collection's side) of the equalities that tie a collection's filter to the row."""
        if node[0] == "var":
            return self.equalities(env[node[1]][1], env[node[1]][2] | {k: v for k, v in env.items() if isinstance(v, V)}, rows)
        if node[0] in ("map", "lookup"):
            return self.equalities(node[1], env, rows)
        if node[0] == "flwor":
            parts = [p for c in node[1] if c[0] == "where" for p in self.conjuncts(c[1])]
            inner = {**env, node[1][0][1]: self.base(rows)}
        elif node[0] == "filter":
            parts, inner = self.conjuncts(node[2]), {**env, ".": self.base(rows)}
        else:
            return None
        out = []
        for p in parts:
            if p[0] not in ("value", "general") or p[1] != "eq":
                return None
            a, b = p[2], p[3]
            if self.mentions(b, env):
                a, b = b, a
            if not self.mentions(a, env) or self.mentions(b, env):
                return None
            out.append((self.expr(a, env).col, self.expr(b, inner).col))
        return out

    def base(self, rows: Rows) -> V:
        names = rows.df.columns
        return V(None, "record", fields={n.rpartition("__")[0]: from_type(F.col(n), rows.df.schema[n].dataType) for n in names})
