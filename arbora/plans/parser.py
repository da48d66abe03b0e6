"""Parser of the query language: text to a tree of tuples (kind, ...)."""

from __future__ import annotations

import re


class QueryError(Exception):
    """An error with a W3C code, such as XPST0003."""

    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code = code


TOKEN = re.compile(
    r"""\s+|(?P<open>\(:)|(?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)|(?P<string>"(?:[^"]|"")*"|'(?:[^']|'')*')
    |(?P<var>\$\s*[\w.:-]*[\w.-])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?)|(?P<op>:=|=>|->|=!>|!=|<=|>=|<<|>>|\|\||//|::|\.\.|[-+*/=<>()\[\]{},;?!|@.:\#%])""",
    re.X,
)
AXES = ("child", "descendant", "descendant-or-self", "attribute", "self", "parent", "ancestor", "ancestor-or-self", "following-sibling", "preceding-sibling", "following", "preceding", "namespace")
VALUE, GENERAL = ("eq", "ne", "lt", "le", "gt", "ge"), {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
TESTS = ("node", "text", "comment", "element", "attribute", "document-node", "processing-instruction")


#: Behind these a < can't be a comparison: no operand stands before it.
OPERATORS = frozenset("return then else in and or eq ne lt le gt ge div idiv mod to union intersect except otherwise satisfies default case where is with".split())
NAME = re.compile(r"[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?")
REFERENCES = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = scan(text, 0, None)
    return out


def referenced(text: str) -> str:
    """Text with its character references and doubled braces replaced."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return m[0][0]
        if m[1].startswith("#"):
            return chr(int(m[1][2:], 16) if m[1][1] == "x" else int(m[1][1:]))
        if m[1] not in REFERENCES:
            raise QueryError("XPST0003", f"unknown reference &{m[1]};")
        return REFERENCES[m[1]]

    return re.sub(r"&(#x[0-9A-Fa-f]+|#\d+|\w+);|\{\{|\}\}", one, text)


def enclosed(text: str, at: int) -> tuple[tuple, int]:
    """The expression in braces whose first is before at, and where what follows begins."""
    tokens, at = scan(text, at, "}")
    p = Parser.of(tokens)
    inside = ("sequence", []) if p.tokens[0][0] == "end" else p.whole()
    return inside, at


def parts(text: str, at: int, stop: re.Pattern) -> tuple[list, int]:
    """Strings and enclosed expressions up to a match of stop."""
    out, start = [], at
    while True:
        m = stop.match(text, at)
        if m or at >= len(text):
            if not m:
                raise QueryError("XPST0003", "unclosed constructor")
            if at > start:
                out.append(referenced(text[start:at]))
            return out, at
        if text.startswith(("{{", "}}"), at):
            at += 2
        elif text[at] == "{":
            if at > start:
                out.append(referenced(text[start:at]))
            inside, at = enclosed(text, at + 1)
            out.append(inside)
            start = at
        else:
            at += 1


def element(text: str, at: int) -> tuple[tuple, int]:
    """The direct constructor that begins at a <, and where what follows begins."""
    special = re.compile(r"<!--(.*?)-->|<\?(\S+)\s*(.*?)\?>", re.S).match(text, at)
    if special:
        return (("comment", special[1]) if special[1] is not None else ("instruction", special[2], special[3])), special.end()
    name = NAME.match(text, at + 1)
    if not name:
        raise QueryError("XPST0003", "a constructor's name is expected")
    at, attributes = name.end(), []
    space = re.compile(r"\s*")
    while True:
        at = space.match(text, at).end()
        if text.startswith("/>", at):
            return ("element", name[0], attributes, []), at + 2
        if text.startswith(">", at):
            at += 1
            break
        own = re.compile(r"([\w.:-]+)\s*=\s*([\"'])").match(text, at)
        if not own:
            raise QueryError("XPST0003", f"unexpected {text[at:at + 1]!r} in a constructor")
        value, at = parts(text, own.end(), re.compile(own[2]))
        at += 1
        attributes.append((own[1], value))
    content = []
    while True:
        some, at = parts(text, at, re.compile("<"))
        # Blank text between tags and expressions is left out.
        content += [x for x in some if not isinstance(x, str) or x.strip() or "&" in x]
        if text.startswith("</", at):
            end = re.compile(r"</([\w.:-]+)\s*>").match(text, at)
            if not end or end[1] != name[0]:
                raise QueryError("XQST0118", f"<{name[0]}> isn't closed by its own name")
            return ("element", name[0], attributes, content), end.end()
        if text.startswith("<![CDATA[", at):
            end = text.index("]]>", at)
            content.append(text[at + 9 : end])
            at = end + 3
        else:
            inside, at = element(text, at)
            content.append(inside)


def scan(text: str, at: int, until: str | None) -> tuple[list[tuple[str, str]], int]:
    """Tokens up to the end, or to the closing brace that no token opens."""
    out, level = [], 0
    while at < len(text):
        if text.startswith("``[", at):
            pieces, at = [], at + 3
            while not text.startswith("]``", at):
                mark = min((k for k in (text.find("`{", at), text.find("]``", at)) if k >= 0), default=-1)
                if mark < 0:
                    raise QueryError("XPST0003", "unclosed string constructor")
                if mark > at:
                    pieces.append(text[at:mark])
                at = mark
                if text.startswith("`{", at):
                    inside, at = enclosed(text, at + 2)
                    pieces.append(inside)
                    at += 1  # the backtick behind the brace
            at += 3
            out.append(("tree", ("template", pieces)))
            continue
        before, word = out[-1] if out else ("op", "(")
        operand = before in ("number", "string", "var", "tree") or before == "name" and word not in OPERATORS or before == "op" and word in (")", "]", "}", ".", "?")
        operand = operand and not (word in ("node", "nodes") and len(out) > 1 and out[-2] == ("name", "insert"))
        if text[at] == "<" and not operand and re.match(r"<[A-Za-z_!?]", text[at : at + 2]):
            tree, at = element(text, at)
            out.append(("tree", tree))
            continue
        m = TOKEN.match(text, at)
        if m and m.lastgroup == "op" and until is not None:
            if m[0] == "}" and not level:
                return [*out, ("end", "")], m.end()
            level += (m[0] == "{") - (m[0] == "}")
        if not m:
            raise QueryError("XPST0003", f"unexpected {text[at]!r} at {at}")
        if m.lastgroup == "open":
            depth, at = 1, m.end()
            while depth:
                n = re.compile(r"\(:|:\)").search(text, at)
                if not n:
                    raise QueryError("XPST0003", "unclosed comment")
                depth, at = depth + (1 if n[0] == "(:" else -1), n.end()
            continue
        if m.lastgroup:
            out.append((m.lastgroup, re.sub(r"\s", "", m[0]) if m.lastgroup == "var" else m[0]))
        at = m.end()
    if until is not None:
        raise QueryError("XPST0003", "an enclosed expression isn't closed")
    return [*out, ("end", "")], at


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @classmethod
    def of(cls, tokens: list[tuple[str, str]]) -> Parser:
        out = cls("")
        out.tokens = tokens
        return out

    def whole(self):
        out = self.expression()
        if self.tokens[self.at][0] != "end":
            raise QueryError("XPST0003", f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def peek(self, *words: str, ahead: int = 0) -> bool:
        kind, word = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return kind in ("op", "name") and word in words

    def take(self, *words: str) -> str | None:
        if self.peek(*words):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *words: str) -> str:
        got = self.take(*words)
        if got is None:
            raise QueryError("XPST0003", f"expected {' or '.join(words)}, found {self.tokens[self.at][1]!r}")
        return got

    def kind(self, kind: str) -> str:
        if self.tokens[self.at][0] != kind:
            raise QueryError("XPST0003", f"expected a {kind}, found {self.tokens[self.at][1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def variable(self) -> str:
        return self.kind("var")[1:]

    # module ---------------------------------------------------------------------------------------------------
    def module(self):
        prolog = []
        while self.peek("declare") and self.tokens[self.at + 1][0] == "name":
            self.at += 1
            if self.take("variable"):
                name = self.variable()
                self.type_declaration()
                external = bool(self.take("external"))
                prolog.append(("variable", name, None if external and not self.take(":=") else (external or self.need(":=")) and self.single()))
            elif self.take("function"):
                name = self.kind("name")
                params = self.parameters()
                if self.take("as"):
                    self.sequence_type()
                prolog.append(("function", name, params, self.braced()))
            else:
                while not self.peek(";"):
                    self.at += 1
            self.need(";")
        body = self.expression()
        if self.tokens[self.at][0] != "end":
            raise QueryError("XPST0003", f"unexpected {self.tokens[self.at][1]!r}")
        return ("module", prolog, body)

    def parameters(self) -> list[str]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.variable())
            self.type_declaration()
            self.take(",")
        return out

    def type_declaration(self) -> str | None:
        return self.sequence_type() if self.take("as") else None

    def sequence_type(self) -> str:
        if self.take("("):
            out = self.sequence_type()
            self.need(")")
        else:
            out = self.kind("name")
            if self.take("("):
                depth = 1
                while depth:
                    depth += 1 if self.peek("(") else -1 if self.peek(")") else 0
                    self.at += 1
        return out + (self.take("?", "*", "+") or "")

    def braced(self):
        self.need("{")
        out = ("sequence", []) if self.peek("}") else self.expression()
        self.need("}")
        return out

    def expression(self):
        items = [self.single()]
        while self.take(","):
            items.append(self.single())
        return items[0] if len(items) == 1 else ("sequence", items)

    def transform(self):
        self.need("copy")
        name = self.variable()
        self.need(":=")
        source = self.single()
        self.need("modify")
        edits = []
        if self.peek("(") and self.peek("delete", "insert", "replace", "rename", ahead=1):
            self.need("(")
            edits.append(self.update())
            while self.take(","):
                edits.append(self.update())
            self.need(")")
        else:
            edits.append(self.update())
        self.need("return")
        return ("transform", name, source, edits, self.single())

    def update(self):
        """(action, target, new name or content)."""
        what = self.need("delete", "insert", "replace", "rename")
        if what == "replace" and self.take("value"):
            self.need("of")
            what = "replace-value"
        self.need("node", "nodes")
        if what == "delete":
            return (what, self.path(), None)
        if what == "insert":
            content = self.single()
            place = self.need("into", "before", "after", "as")
            if place == "as":
                place = "first" if self.need("first", "last") == "first" else "into"
                self.need("into")
            return (f"insert-{place}", self.path(), content)
        target = self.path()
        self.need("as" if what == "rename" else "with")
        return (what, target, self.single())

    def single(self):
        if self.peek("copy") and self.tokens[self.at + 1][0] == "var":
            return self.transform()
        if self.peek("for", "let") and (self.tokens[self.at + 1][0] == "var" or self.peek("tumbling", "sliding", "member", ahead=1)):
            return self.flwor()
        if self.peek("if") and self.peek("(", ahead=1):
            self.at += 2
            test = self.expression()
            self.need(")")
            if self.peek("{"):
                then = self.braced()
                other = ("sequence", [])
                if self.take("else"):
                    other = self.single() if self.peek("if") else self.braced()
                return ("if", test, then, other)
            self.need("then")
            then = self.single()
            self.need("else")
            return ("if", test, then, self.single())
        if self.peek("some", "every") and self.tokens[self.at + 1][0] == "var":
            kind, binds = self.take("some", "every"), []
            while True:
                name = self.variable()
                self.type_declaration()
                self.need("in")
                binds.append((name, self.single()))
                if not self.take(","):
                    break
            self.need("satisfies")
            return ("quantified", kind, binds, self.single())
        if self.peek("switch") and self.peek("(", ahead=1):
            self.at += 2
            value = self.expression()
            self.need(")")
            braces, cases = self.take("{"), []
            while self.take("case"):
                keys = [self.single()]
                while self.take("case"):
                    keys.append(self.single())
                self.need("return")
                cases.append((keys, self.single()))
            self.need("default")
            self.need("return")
            default = self.single()
            if braces:
                self.need("}")
            return ("switch", value, cases, default)
        if self.peek("try") and self.peek("{", ahead=1):
            self.at += 1
            body = self.braced()
            self.need("catch")
            while not self.peek("{"):
                self.at += 1
            return ("try", body, self.braced())
        return self.binary(0)

    # FLWOR ----------------------------------------------------------------------------------------------------
    def flwor(self):
        clauses = []
        while True:
            if self.take("for"):
                if self.peek("tumbling", "sliding"):
                    clauses.append(self.window())
                    continue
                while True:
                    member = bool(self.take("member"))
                    name = self.variable()
                    self.type_declaration()
                    empty = bool(self.take("allowing") and self.need("empty"))
                    at = self.variable() if self.take("at") else None
                    self.need("in")
                    clauses.append(("for", name, self.single(), at, empty, member))
                    if not self.take(","):
                        break
            elif self.take("let"):
                while True:
                    name = self.variable()
                    self.type_declaration()
                    self.need(":=")
                    clauses.append(("let", name, self.single()))
                    if not self.take(","):
                        break
            elif self.take("where"):
                clauses.append(("where", self.single()))
            elif self.take("while"):
                clauses.append(("while", self.single()))
            elif self.peek("stable") or self.peek("order"):
                self.take("stable")
                self.need("order")
                self.need("by")
                clauses.append(("order", self.order_keys()))
            elif self.take("group"):
                self.need("by")
                keys = []
                while True:
                    name = self.variable()
                    self.type_declaration()
                    keys.append((name, self.single() if self.take(":=") else None))
                    if self.take("collation"):
                        keys[-1] = (*keys[-1], self.kind("string")[1:-1])
                    if not self.take(","):
                        break
                clauses.append(("group", [(*k, None)[:3] for k in keys]))
            elif self.take("count"):
                clauses.append(("count", self.variable()))
            else:
                break
        self.need("return")
        body, other = self.single(), None
        if body[:2] == ("binary", "otherwise"):  # it belongs to the whole expression: what follows stands for an empty result
            body, other = body[2], body[3]
        return ("flwor", clauses, body, other)

    def order_keys(self):
        keys = []
        while True:
            key, down, greatest = self.single(), False, False
            if self.take("ascending", "descending") == "descending":
                down = True
            if self.take("empty"):
                greatest = self.need("greatest", "least") == "greatest"
            collation = self.kind("string")[1:-1] if self.take("collation") else None
            keys.append((key, down, greatest, collation))
            if not self.take(","):
                return keys

    def window(self):
        kind = self.need("tumbling", "sliding")
        self.need("window")
        name = self.variable()
        self.type_declaration()
        self.need("in")
        source = self.single()
        start = self.boundary("start")
        only = bool(self.take("only"))
        end = self.boundary("end") if self.peek("end") else None
        return ("window", kind, name, source, start, end, only)

    def boundary(self, word: str):
        self.need(word)
        names: dict[str, str] = {}
        if self.tokens[self.at][0] == "var":
            names["item"] = self.variable()
        for role in ("at", "previous", "next"):
            if self.take(role):
                names[role] = self.variable()
        test = self.single() if self.take("when") else ("call", "true", [])
        return (names, test)

    # operators ------------------------------------------------------------------------------------------------
    LEVELS = (("otherwise",), ("or",), ("and",), ("compare",), ("contains",), ("||",), ("to",), ("+", "-"), ("*", "div", "idiv", "mod"), ("union", "|"), ("intersect", "except"), ("types",))

    def binary(self, level: int):
        words = self.LEVELS[level]
        if words == ("types",):
            return self.unary()
        left = self.binary(level + 1)
        if words == ("compare",):
            if self.peek(*VALUE):
                return ("value", self.take(*VALUE), left, self.binary(level + 1))
            if self.peek(*GENERAL):
                return ("general", GENERAL[self.take(*GENERAL)], left, self.binary(level + 1))
            if self.peek("is", "<<", ">>"):
                return ("node", self.take("is", "<<", ">>"), left, self.binary(level + 1))
            return left
        if words == ("contains",):
            if self.peek("contains") and self.peek("text", ahead=1):
                self.at += 2
                return ("fulltext", left, self.selection())
            return left
        while self.peek(*words):
            op = self.take(*words)
            right = self.binary(level + 1)
            left = ("binary", op, left, right)
        return left

    def types(self):
        left = self.arrow()
        while True:
            if self.peek("instance") and self.peek("of", ahead=1):
                self.at += 2
                left = ("instance", left, self.sequence_type())
            elif self.peek("treat", "cast", "castable") and self.peek("as", ahead=1):
                kind = self.take("treat", "cast", "castable")
                self.at += 1
                left = (kind, left, self.sequence_type())
            else:
                return left

    def arrow(self):
        left = self.bang()
        while self.peek("=>", "->", "=!>"):
            op = self.take("=>", "->", "=!>")
            if self.tokens[self.at][0] == "var":
                target = ("var", self.variable())
                call = ("dynamic", target, [left, *self.arguments()])
            else:
                name = self.kind("name")
                call = ("call", name, [left if op == "=>" else ("context",), *self.arguments()])
                if op != "=>":
                    call = ("map", left, call)
            left = call
        return left

    def bang(self):
        left = self.path()
        while self.take("!"):
            left = ("map", left, self.path())
        return left

    def unary(self):
        if self.take("-"):
            return ("minus", self.unary())
        if self.take("+"):
            return self.unary()
        return self.types()

    # paths and primaries --------------------------------------------------------------------------------------
    def path(self):
        if self.peek("/", "//"):
            op = self.take("/", "//")
            left = ("root",)
            if op == "//":
                left = ("step", left, "descendant-or-self", ("kind", "node"), [])
            elif self.tokens[self.at][0] == "end" or self.peek(")", ",", "]", "}"):
                return left
            left = self.step(left)
        else:
            left = self.step(None)
        while self.peek("/", "//"):
            if self.take("/", "//") == "//":
                left = ("step", left, "descendant-or-self", ("kind", "node"), [])
            left = self.step(left)
        return left

    def step(self, left):
        axis = None
        if self.take("@"):
            axis = "attribute"
        elif self.take(".."):
            return ("step", left or ("context",), "parent", ("kind", "node"), self.predicates())
        elif self.peek(*AXES) and self.peek("::", ahead=1):
            axis = self.take(*AXES)
            self.need("::")
        here = self.tokens[self.at]
        test = axis is not None or self.peek("*") or here[0] == "name" and (self.peek(*TESTS) and self.peek("(", ahead=1) or not self.peek("(", "{", "#", ahead=1) and not (self.peek("map", "array", "function", "record") and self.peek("{", ahead=1)))
        test = test and not (axis is None and self.peek("element", "attribute") and self.tokens[min(self.at + 1, len(self.tokens) - 1)][0] == "name" and self.peek("{", ahead=2))
        if not test:
            right = self.postfix()
            return right if left is None else ("map", left, right)
        if self.peek(*TESTS) and self.peek("(", ahead=1):
            kind = self.kind("name")
            self.need("(")
            name = None if self.peek(")") else self.take("*") or self.kind("name")
            self.need(")")
            what = ("kind", kind, name)
        else:
            what = ("name", self.take("*") or self.kind("name"))
        return ("step", left or ("context",), axis or ("attribute" if what[:2] == ("kind", "attribute") else "child"), what, self.predicates())

    def predicates(self):
        out = []
        while self.take("["):
            out.append(self.expression())
            self.need("]")
        return out

    def arguments(self):
        self.need("(")
        out = []
        while not self.take(")"):
            if self.peek("?") and self.peek(",", ")", ahead=1):
                self.at += 1
                out.append(("hole",))
            elif self.tokens[self.at][0] == "name" and self.peek(":=", ahead=1):
                name = self.kind("name")
                self.need(":=")
                out.append(("keyword", name, self.single()))
            else:
                out.append(self.single())
            if not self.peek(")"):
                self.need(",")
        return out

    def postfix(self):
        left = self.primary()
        while True:
            if self.peek("["):
                self.at += 1
                left = ("filter", left, self.expression())
                self.need("]")
            elif self.peek("("):
                left = ("dynamic", left, self.arguments())
            elif self.peek("?"):
                self.at += 1
                left = ("lookup", left, self.key())
            else:
                return left

    def key(self):
        kind, word = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            return ("literal", int(word), "integer")
        if self.take("*"):
            return ("all",)
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if kind == "var":
            return ("var", self.variable())
        if kind == "string":
            return self.primary()
        return ("literal", self.kind("name"), "string")

    def primary(self):
        kind, word = self.tokens[self.at]
        if kind == "number":
            self.at += 1
            if "e" in word.lower():
                return ("literal", float(word), "double")
            return ("literal", word, "decimal") if "." in word else ("literal", int(word), "integer")
        if kind == "string":
            self.at += 1
            text = word[1:-1].replace(word[0] * 2, word[0])
            for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
                text = text.replace(k, v)
            return ("literal", text, "string")
        if kind == "var":
            return ("var", self.variable())
        if kind == "tree":
            self.at += 1
            return word
        if self.peek("element", "attribute") and (self.peek("{", ahead=1) or self.tokens[self.at + 1][0] == "name" and self.peek("{", ahead=2)):
            what = self.take("element", "attribute")
            name = ("literal", self.kind("name"), "string") if not self.peek("{") else self.braced()
            return (f"computed-{what}", name, self.braced())
        if self.peek("text", "comment", "document") and self.peek("{", ahead=1):
            return (f"computed-{self.take('text', 'comment', 'document')}", self.braced())
        if self.peek("typeswitch") and self.peek("(", ahead=1):
            self.at += 1
            self.need("(")
            value, cases = self.expression(), []
            self.need(")")
            while self.take("case"):
                name = self.variable() if self.tokens[self.at][0] == "var" else None
                if name is not None:
                    self.need("as")
                types = [self.sequence_type()]
                while self.take("|"):
                    types.append(self.sequence_type())
                self.need("return")
                cases.append((name, types, self.single()))
            self.need("default")
            name = self.variable() if self.tokens[self.at][0] == "var" else None
            self.need("return")
            return ("typeswitch", value, cases, (name, self.single()))
        if self.take("("):
            if self.take(")"):
                return ("sequence", [])
            out = self.expression()
            self.need(")")
            return out
        if self.take("."):
            return ("context",)
        if self.take("?"):
            return ("lookup", ("context",), self.key())
        if self.take("["):
            out = []
            while not self.take("]"):
                out.append(self.single())
                if not self.peek("]"):
                    self.need(",")
            return ("array", out)
        if self.peek("array") and self.peek("{", ahead=1):
            self.at += 1
            return ("array-of", self.braced())
        if self.peek("map", "record") and self.peek("{", ahead=1) or self.peek("{"):
            self.take("map", "record")
            self.need("{")
            out = []
            while not self.take("}"):
                key = self.single()
                self.need(":")
                out.append((key, self.single()))
                if not self.peek("}"):
                    self.need(",")
            return ("map-of", out)
        if self.peek("function", "fn") and self.peek("(", "{", ahead=1):
            self.at += 1
            params = self.parameters() if self.peek("(") else None
            self.type_declaration()
            return ("inline", params, self.braced())
        if kind == "name":
            self.at += 1
            if self.take("#"):
                return ("reference", word, int(self.kind("number")))
            if self.peek("("):
                return ("call", word, self.arguments())
        raise QueryError("XPST0003", f"unexpected {word!r}")

    # full text ------------------------------------------------------------------------------------------------
    def selection(self):
        left = self.ft_and()
        while self.take("ftor"):
            left = ("ftor", left, self.ft_and())
        options: dict[str, object] = {}
        while True:
            if self.take("ordered"):
                options["ordered"] = True
            elif self.take("window"):
                options["window"] = self.binary(6)
                self.need("words")
            elif self.take("distance"):
                how = self.need("exactly", "at", "from")
                how += " " + self.need("least", "most") if how == "at" else ""
                options["distance"] = (how, self.binary(7))
                self.need("words")
            elif self.peek("at") and self.peek("start", "end", ahead=1):
                self.at += 1
                options[self.need("start", "end")] = True
            elif self.peek("entire") and self.peek("content", ahead=1):
                self.at += 2
                options["entire"] = True
            else:
                return ("ftfilter", left, options) if options else left

    def ft_and(self):
        left = self.ft_not()
        while self.peek("ftand") or self.peek("not") and self.peek("in", ahead=1):
            if self.take("ftand"):
                left = ("ftand", left, self.ft_not())
            else:
                self.at += 2
                left = ("ftmild", left, self.ft_not())
        return left

    def ft_not(self):
        if self.take("ftnot"):
            return ("ftnot", self.ft_not())
        if self.take("("):
            out = self.selection()
            self.need(")")
            return out
        words = self.braced() if self.peek("{") else self.primary()
        mode = self.take("any", "all", "phrase") or "any"
        if mode in ("any", "all"):
            mode += " words" if self.take("word", "words") else ""
        options: dict[str, object] = {}
        while self.take("using"):
            if self.take("no"):
                options[self.kind("name")] = False
            elif self.take("language"):
                options["language"] = self.kind("string")[1:-1]
            elif self.take("case"):
                options["case"] = self.kind("name")
            elif self.take("diacritics"):
                options["diacritics"] = self.kind("name")
            elif self.take("stop"):
                self.need("words")
                options["stop"] = True
                if self.take("default") is None and self.take("("):
                    options["stop"] = []
                    while not self.take(")"):
                        options["stop"].append(self.kind("string")[1:-1])
                        self.take(",")
            else:
                options[self.kind("name")] = True
        return ("ftwords", words, mode, options)


def parse(text: str):
    return Parser(text).module()
