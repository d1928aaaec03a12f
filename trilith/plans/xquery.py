"""XQuery as Spark SQL over node tables.

A FLWOR expression's tuples are rows: `for` over a path joins the node table, `for` over a sequence explodes it, and
every path from a variable is one grouped join on the node's identity, added as a column before it is used.
Sequences inside expressions are arrays.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any, NamedTuple

from pyspark.sql import DataFrame

from ..sources.xml import COLUMNS
from .lexer import QueryError, block_end
from .sql import literal, name

if TYPE_CHECKING:
    from ..engine import Engine

_NAME = re.compile(r"[A-Za-z_][\w-]*(?::[A-Za-z_][\w-]*)?")
AXES = ("child", "descendant", "attribute", "self", "descendant-or-self", "following-sibling", "following", "parent", "ancestor", "preceding-sibling", "preceding", "ancestor-or-self")


class Seq(NamedTuple):
    """Spark SQL of an array, and what its items are: nodes, num, str, bool or xml (serialised new nodes).

    over: for what a group gathers, the group's number and the part of each of its rows.
    """

    sql: str
    kind: str
    over: tuple[int, Any] | None = None


class Step(NamedTuple):
    axis: str
    test: str
    predicates: list[Any]


class Path(NamedTuple):
    head: str
    steps: list[Step]


class XQuery:
    def __init__(self, engine: Engine, text: str, params: dict[str, Any]) -> None:
        self.engine, self.text, self.i, self.params = engine, re.sub(r"\(:.*?:\)", " ", text, flags=re.S), 0, params
        self.n = 0
        #: Variables: a Seq of a column, a node column (kind node), or a Path that stands for itself.
        self.scope: dict[str, Any] = {}
        self.rows = ""
        self.ordered: list[str] = []
        self.ways: list[str] = []
        self.outer_order: list[tuple[str, str]] = []
        #: Aggregates that are wanted of each group, by their SQL; their columns stand for marks in the text of the rows.
        self.groups: list[dict[str, str]] = []

    # scanning

    def space(self) -> None:
        while self.i < len(self.text) and self.text[self.i].isspace():
            self.i += 1

    def at(self, *options: str) -> str | None:
        self.space()
        for o in options:
            if self.text.startswith(o, self.i):
                end = self.i + len(o)
                if not o[-1].isalnum() or not re.match(r"[\w-]", self.text[end : end + 1]):
                    return o
        return None

    def take(self, *options: str) -> str | None:
        o = self.at(*options)
        if o:
            self.i += len(o)
        return o

    def need(self, o: str) -> None:
        if not self.take(o):
            raise QueryError(f"expected {o!r} at {self.text[self.i : self.i + 20]!r}")

    def word(self) -> str:
        self.space()
        m = _NAME.match(self.text, self.i)
        if not m:
            raise QueryError(f"expected a name at {self.text[self.i : self.i + 20]!r}")
        self.i = m.end()
        return m[0]

    def variable(self) -> str:
        self.need("$")
        return self.word()

    def fresh(self) -> str:
        self.n += 1
        return f"__x{self.n}"

    # statements

    def run(self) -> DataFrame:
        self.rows = "SELECT 1 AS __one"
        # names are matched by their prefixes, so namespace declarations change nothing
        m = re.match(r"\s*(?:xquery\s+version\s+[^;]*;|declare\s+(?:default\s+element\s+)?namespace\s[^;]*;|\s)*", self.text)
        self.i = m.end()
        out = self.top()
        self.space()
        if self.i < len(self.text) and self.text[self.i :].strip(" ;\n"):
            raise QueryError(f"unexpected {self.text[self.i : self.i + 20]!r}")
        for g in range(len(self.groups)):
            out = out.replace(self.mark(g), "".join(f", {x} AS {c}" for x, c in self.groups[g].items()))
        return self.engine.spark.sql(out)

    def top(self) -> str:
        if self.at("for", "let") and re.match(r"\s*(?:for|let)\s+\$", self.text[self.i :]):
            value = self.flwor()
        else:
            value = self.expr()
        value = self.items(value)
        item = {"nodes": "v.xml", "num": "v", "str": "v", "bool": "v", "xml": "v"}[value.kind]
        keys = ", ".join(f"{k} AS __k{i}" for i, k in enumerate(self.ordered))
        inner = f"SELECT {keys + ', ' if keys else ''}posexplode({value.sql}) AS (__p, v) FROM ({self.rows})"
        return f"SELECT {item} AS value FROM ({inner})" + (f" ORDER BY {', '.join(f'__k{i} {w}' for i, w in enumerate(self.ways))}, __p" if keys else "")

    def flwor(self) -> Any:
        while True:
            if self.take("for"):
                while True:
                    self.for_()
                    if not self.take(","):
                        break
            elif self.take("let"):
                while True:
                    v = self.variable()
                    self.need(":=")
                    self.bind(v, self.single())
                    if not self.take(","):
                        break
            elif self.take("where"):
                test = self.truth(self.single())
                self.rows = f"SELECT * FROM ({self.rows}) WHERE {test}"
            elif self.take("group"):
                self.need("by")
                self.group()
            elif self.at("order", "stable"):
                self.take("stable")
                self.need("order")
                self.need("by")
                self.order()
            elif self.take("count"):
                v = self.variable()
                by = ", ".join(f"{k} {w}" for k, w in zip(self.ordered, self.ways)) or ", ".join(self.document_order()) or "1"
                self.rows = f"SELECT *, row_number() OVER (ORDER BY {by}) AS {name('v_' + v)} FROM ({self.rows})"
                self.scope[v] = Seq(f"array({name('v_' + v)})", "num")
            elif self.take("return"):
                if self.at("for", "let") and re.match(r"(?:for|let)\s+\$", self.text[self.i :]):
                    # what an inner expression adds comes within the order so far
                    self.outer_order = list(zip(self.ordered, self.ways)) or [(k, "ASC") for k in self.document_order()]
                    self.ordered, self.ways = [], []
                    continue
                if self.outer_order:
                    mine = list(zip(self.ordered, self.ways)) or [(k, "ASC") for k in self.document_order()]
                    both = [*self.outer_order, *(o for o in mine if o not in self.outer_order)]
                    self.ordered, self.ways = [k for k, _ in both], [w for _, w in both]
                if not self.ordered:
                    self.ordered, self.ways = self.document_order(), ["ASC"] * len(self.document_order())
                return self.single()
            else:
                raise QueryError(f"unexpected {self.text[self.i : self.i + 20]!r}")

    def document_order(self) -> list[str]:
        return [k for v in self.scope.values() if isinstance(v, Seq) and v.kind == "node" for k in (f"{v.sql}.doc", f"{v.sql}.pre")]

    def column(self, x: str) -> str:
        """A new column of the rows."""
        c = self.fresh()
        self.rows = f"SELECT *, {x} AS {c} FROM ({self.rows})"
        return c

    def bind(self, v: str, value: Any) -> None:
        self.scope[v] = value if isinstance(value, Path) else self.items(value)._replace(sql=self.column(self.items(value).sql))

    def for_(self) -> None:
        v = self.variable()
        empty = bool(self.take("allowing")) and not self.need("empty")
        at = self.variable() if self.take("at") else None
        self.need("in")
        self.space()
        if not at and not empty and re.match(r"\(\s*LANG\b", self.text[self.i :]):
            begin = self.i
            self.need("(")
            view, col, kind = self.foreign(")")
            plain = not self.at("[", "/", "!", "=")
            if not plain:
                self.i = begin
        else:
            plain = False
        if plain:
            # the block's rows are the tuples
            c = self.fresh()
            self.rows = f"SELECT r.*, q.{col} AS {c} FROM ({self.rows}) AS r CROSS JOIN {view} AS q"
            self.scope[v] = Seq(f"array({c})", kind)
            return
        value = self.single()
        c = self.fresh()
        if isinstance(value, Path) and value.head.startswith("doc:") and not at:
            # rows of a document are the node table itself
            self.rows = f"SELECT r.*, n AS {c} FROM ({self.rows}) AS r {'LEFT' if empty else 'CROSS'} JOIN ({self.nodes(value)}) AS q{' ON TRUE' if empty else ''}"
            self.scope[v] = Seq(c, "node")
            return
        seq = self.items(value)
        p = self.fresh()
        self.rows = f"SELECT * FROM ({self.rows}) LATERAL VIEW {'OUTER ' * empty}posexplode({seq.sql}) __t AS {p}, {c}"
        self.scope[v] = Seq(c, "node") if seq.kind == "nodes" else Seq(f"CASE WHEN {p} IS NULL THEN array() ELSE array({c}) END" if empty else f"array({c})", seq.kind)
        if at:
            self.scope[at] = Seq(f"array(coalesce({p} + 1, 0))", "num")

    def group(self) -> None:
        keys = []
        while True:
            v = self.variable()
            if self.take(":="):
                value = self.atomic(self.single())
            else:
                value = self.atomic(self.scope[v])
            keys.append((v, self.column(f"get({value.sql}, 0)"), value.kind))
            if not self.take(","):
                break
        rest = {v: s for v, s in self.scope.items() if v not in [k for k, _, _ in keys] and isinstance(s, Seq)}
        order = ", ".join(self.document_order()) or "1"
        by = "CASE WHEN a.o < b.o THEN -1 WHEN a.o > b.o THEN 1 ELSE 0 END"

        def gathered(v: str, s: Seq) -> str:
            return f"transform(filter(array_sort(collect_list(struct(struct({order}) AS o, {s.sql} AS v)), (a, b) -> {by}), x -> x.v IS NOT NULL), x -> x.v) AS {name('g_' + v)}"

        # what is gathered but not used Spark drops: then aggregates alone are left
        g = len(self.groups)
        self.groups.append({})
        cols = ", ".join([*(c for _, c, _ in keys), *(gathered(v, s) for v, s in rest.items())])
        self.rows = f"SELECT {cols}{self.mark(g)} FROM ({self.rows}) GROUP BY {', '.join(c for _, c, _ in keys)}"
        for v, s in rest.items():
            self.scope[v] = Seq(name("g_" + v), "nodes", (g, s)) if s.kind == "node" else Seq(f"flatten({name('g_' + v)})", s.kind, (g, s))
        for v, c, kind in keys:
            self.scope[v] = Seq(f"array({c})", kind)
        self.ordered, self.ways = [c for _, c, _ in keys], ["ASC"] * len(keys)

    @staticmethod
    def mark(g: int) -> str:
        return f"/*group {g}*/"

    def of_group(self, g: int, x: str) -> str:
        """The column of an aggregate over a group's rows."""
        return self.groups[g].setdefault(x, f"__a{g}_{len(self.groups[g])}")

    def counted(self, x: Any) -> str:
        """How many items, without gathering what a group has."""
        s = x if isinstance(x, Seq) and x.kind == "node" else self.items(x)
        if s.over:
            return self.of_group(s.over[0], f"cast(sum({self.counted(s.over[1])}) AS INT)")
        return f"if({s.sql}.pre IS NULL, 0, 1)" if s.kind == "node" else f"size({s.sql})"

    def over_group(self, fn: str, s: Seq) -> Seq:
        """sum, avg, min or max of what a group has, from those of its rows."""
        g, part = s.over
        part = self.atomic(part if part.kind != "node" else Seq(f"filter(array({part.sql}), x -> x IS NOT NULL)", "nodes"))
        if part.over:
            part = part._replace(over=None)
        n = self.numbers(part)
        if fn in ("sum", "avg"):
            each = f"aggregate({n}, 0D, (x, y) -> x + y)"
            total = self.of_group(g, f"CASE WHEN count({each}) = count(1) THEN sum({each}) END")
            return Seq(f"array({total})", "num") if fn == "sum" else Seq(f"filter(array(try_divide({total}, {self.counted(s)})), x -> x IS NOT NULL)", "num")
        best = self.of_group(g, f"{fn}(array_{fn}({n}))")
        if part.kind != "num":
            text = self.strings(part)
            words = self.of_group(g, f"{fn}(array_{fn}({text}))")
            best = f"CASE WHEN {self.of_group(g, f'bool_or(exists({text}, x -> try_cast(x AS DOUBLE) IS NULL))')} THEN {words} ELSE {self.text_of(best, 'num')} END"
        return Seq(f"filter(array({best}), x -> x IS NOT NULL)", "num" if part.kind == "num" else "str")

    def order(self) -> None:
        self.ordered, self.ways = [], []
        while True:
            value = self.atomic(self.single())
            way = "DESC" if self.take("descending") else "ASC" if self.take("ascending") or True else ""
            nulls = "FIRST" if way == "ASC" else "LAST"
            if self.take("empty"):
                least = self.take("least", "greatest") == "least"
                nulls = "FIRST" if least == (way == "ASC") else "LAST"
            self.ordered.append(self.column(f"get({value.sql}, 0)"))
            self.ways.append(f"{way} NULLS {nulls}")
            if not self.take(","):
                return

    # values

    def items(self, x: Any) -> Seq:
        if isinstance(x, Path):
            return self.walk(x)
        return Seq(f"array({x.sql})", "nodes") if x.kind == "node" else x

    def atomic(self, x: Any) -> Seq:
        s = self.items(x)
        return Seq(f"transform({s.sql}, x -> x.value)", "str", s.over) if s.kind == "nodes" else s

    def numbers(self, x: Any) -> str:
        s = self.atomic(x)
        return s.sql if s.kind == "num" else f"transform({s.sql}, x -> try_cast(x AS DOUBLE))"

    def strings(self, x: Any) -> str:
        s = self.atomic(x)
        return s.sql if s.kind in ("str", "xml") else f"transform({s.sql}, x -> {self.text_of('x', s.kind)})"

    @staticmethod
    def text_of(x: str, kind: str) -> str:
        return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e15 THEN cast(cast({x} AS BIGINT) AS STRING) ELSE cast({x} AS STRING) END)" if kind == "num" else f"cast({x} AS STRING)"

    def truth(self, x: Any) -> str:
        s = self.items(x)
        if s.kind == "bool":
            return f"coalesce(get({s.sql}, 0), FALSE)"
        if s.kind in ("nodes", "xml"):
            return f"({self.counted(s)} > 0)"
        test = "<> 0" if s.kind == "num" else "<> ''"
        return f"coalesce(get({s.sql}, 0) {test}, FALSE)"

    def one(self, x: Any) -> str:
        return f"get({self.numbers(x)}, 0)"

    # expressions

    def expr(self) -> Any:
        parts = [self.single()]
        while self.take(","):
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else self.sequence(parts)

    def sequence(self, parts: list[Any]) -> Seq:
        seqs = [self.items(p) for p in parts]
        seqs = [s for s in seqs if s.sql != "array()"] or [Seq("array()", "str")]
        if len({s.kind for s in seqs}) == 1:
            return Seq(f"concat({', '.join(s.sql for s in seqs)})", seqs[0].kind)
        return Seq(f"concat({', '.join(self.serialised(s) for s in seqs)})", "xml")

    def serialised(self, s: Seq) -> str:
        if s.kind == "nodes":
            return f"transform({s.sql}, x -> x.xml)"
        return s.sql if s.kind == "xml" else f"transform({self.strings(s)}, x -> {self.escaped('x')})"

    @staticmethod
    def escaped(x: str) -> str:
        return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"

    def single(self) -> Any:
        if self.at("if") and re.match(r"if\s*\(", self.text[self.i :]):
            self.take("if")
            self.need("(")
            test = self.truth(self.expr())
            self.need(")")
            self.need("then")
            a = self.items(self.single())
            self.need("else")
            b = self.items(self.single())
            if a.kind != b.kind and "array()" not in (a.sql, b.sql):
                a, b = Seq(self.serialised(a), "xml"), Seq(self.serialised(b), "xml")
            return Seq(f"(CASE WHEN {test} THEN {a.sql} ELSE {b.sql} END)", a.kind if a.sql != "array()" else b.kind)
        if self.at("switch") and re.match(r"switch\s*\(", self.text[self.i :]):
            return self.switch()
        if self.at("some", "every") and re.match(r"(?:some|every)\s+\$", self.text[self.i :]):
            return self.quantified()
        return self.or_()

    def switch(self) -> Seq:
        self.take("switch")
        self.need("(")
        x = self.strings(self.expr())
        self.need(")")
        branches: list[tuple[str, Seq]] = []
        while self.take("case"):
            tests = [f"get({x}, 0) <=> get({self.strings(self.single())}, 0)"]
            while self.take("case"):
                tests.append(f"get({x}, 0) <=> get({self.strings(self.single())}, 0)")
            self.need("return")
            branches.append((" OR ".join(tests), self.items(self.single())))
        self.need("default")
        self.need("return")
        other = self.items(self.single())
        if len({s.kind for _, s in branches} | {other.kind}) > 1:
            branches, other = [(t, Seq(self.serialised(s), "xml")) for t, s in branches], Seq(self.serialised(other), "xml")
        cases = " ".join(f"WHEN {t} THEN {s.sql}" for t, s in branches)
        return Seq(f"(CASE {cases} ELSE {other.sql} END)", other.kind)

    def quantified(self) -> Seq:
        how = self.take("some", "every")
        v = self.variable()
        self.need("in")
        s = self.atomic(self.single())
        self.need("satisfies")
        saved = self.scope.get(v)
        x = self.fresh()
        self.scope[v] = Seq(f"array({x})", s.kind)
        test = self.truth(self.single())
        if saved is None:
            del self.scope[v]
        else:
            self.scope[v] = saved
        return Seq(f"array({'exists' if how == 'some' else 'forall'}({s.sql}, {x} -> {test}))", "bool")

    def or_(self) -> Any:
        out = self.and_()
        while self.take("or"):
            out = Seq(f"array({self.truth(out)} OR {self.truth(self.and_())})", "bool")
        return out

    def and_(self) -> Any:
        out = self.compare()
        while self.take("and"):
            out = Seq(f"array({self.truth(out)} AND {self.truth(self.compare())})", "bool")
        return out

    def compare(self) -> Any:
        out = self.concat()
        if (op := self.take("<<", ">>", "<=", ">=", "!=", "=", "<", ">", "eq", "ne", "lt", "le", "gt", "ge", "is")) is None:
            return out
        right = self.concat()
        if op in ("<<", ">>", "is"):
            a, b = (f"get({self.items(x).sql}, 0)" for x in (out, right))
            return Seq(f"array({a}.doc = {b}.doc AND {a}.pre {({'<<': '<', '>>': '>', 'is': '='})[op]} {b}.pre)", "bool")
        general = op in ("=", "!=", "<", "<=", ">", ">=")
        sign = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "!=": "<>"}.get(op, op)
        a, b = self.atomic(out), self.atomic(right)
        numeric = "num" in (a.kind, b.kind)
        x, y = (self.numbers(a), self.numbers(b)) if numeric else (self.strings(a) if a.kind != b.kind else a.sql, self.strings(b) if a.kind != b.kind else b.sql)
        if general:
            return Seq(f"array(exists({x}, _a -> exists({y}, _b -> _a {sign} _b)))", "bool")
        return Seq(f"filter(array(get({x}, 0) {sign} get({y}, 0)), _a -> _a IS NOT NULL)", "bool")

    def concat(self) -> Any:
        out = self.range_()
        while self.take("||"):
            right = self.range_()
            out = Seq(f"array(concat(coalesce(get({self.strings(out)}, 0), ''), coalesce(get({self.strings(right)}, 0), '')))", "str")
        return out

    def range_(self) -> Any:
        out = self.add()
        if self.take("to"):
            a, b = self.one(out), self.one(self.add())
            return Seq(f"(CASE WHEN {a} <= {b} THEN sequence(cast({a} AS INT), cast({b} AS INT)) ELSE array() END)", "num")
        return out

    def add(self) -> Any:
        out = self.multiply()
        while self.at("+", "-"):
            op = self.take("+", "-")
            out = self.arithmetic(out, op, self.multiply())
        return out

    def multiply(self) -> Any:
        out = self.union()
        while (op := self.take("*", "div", "idiv", "mod")) is not None:
            out = self.arithmetic(out, op, self.union())
        return out

    def union(self) -> Any:
        out = self.intersect()
        while self.take("union") or (self.at("|") and not self.at("||") and self.take("|")):
            out = self.combined("union", out, self.intersect())
        return out

    def intersect(self) -> Any:
        out = self.unary()
        while (op := self.take("intersect", "except")) is not None:
            out = self.combined(op, out, self.unary())
        return out

    def combined(self, op: str, left: Any, right: Any) -> Seq:
        """Nodes by identity, in document order; values by equality, each once."""
        a, b = self.items(left), self.items(right)
        if a.kind != "nodes" and b.kind != "nodes":
            x, y = (a.sql, b.sql) if a.kind == b.kind else (self.strings(a), self.strings(b))
            return Seq(f"array_{op}({x}, {y})", a.kind if a.kind == b.kind else "str")
        a, b = (Seq(self.nothing(False), "nodes") if s.sql == "array()" else s for s in (a, b))
        if (a.kind, b.kind) != ("nodes", "nodes"):
            raise QueryError(f"{op} of nodes and values")
        in_ = lambda sql: f"exists({sql}, _b -> _b.doc = _a.doc AND _b.pre = _a.pre)"
        if op == "union":
            both = f"concat({a.sql}, filter({b.sql}, _a -> NOT {in_(a.sql)}))"
        else:
            both = f"filter({a.sql}, _a -> {'NOT ' * (op == 'except')}{in_(b.sql)})"
        return Seq(f"array_sort({both}, (_a, _b) -> CASE WHEN _a.doc < _b.doc OR _a.doc = _b.doc AND _a.pre < _b.pre THEN -1 WHEN _a.doc = _b.doc AND _a.pre = _b.pre THEN 0 ELSE 1 END)", "nodes")

    def arithmetic(self, a: Any, op: str, b: Any) -> Seq:
        x, y = self.one(a), self.one(b)
        value = {"+": f"{x} + {y}", "-": f"{x} - {y}", "*": f"{x} * {y}", "div": f"try_divide({x}, {y})", "idiv": f"cast(try_divide({x}, {y}) AS BIGINT)", "mod": f"try_mod({x}, {y})"}[op]
        return Seq(f"filter(array({value}), _a -> _a IS NOT NULL)", "num")

    def unary(self) -> Any:
        if self.at("-") and not self.at("->"):
            self.take("-")
            return Seq(f"array(-({self.one(self.unary())}))", "num")
        out = self.path()
        if self.at("cast") and re.match(r"cast\s+as\s+", self.text[self.i :]):
            self.take("cast")
            self.need("as")
            to = self.word().removeprefix("xs:")
            self.take("?")
            if to in ("date", "dateTime"):
                return Seq(f"filter(array(try_cast(get({self.strings(out)}, 0) AS TIMESTAMP_NTZ)), x -> x IS NOT NULL)", "str")
            return self.function(to, [out])
        while self.at("!") and not self.at("!="):
            self.take("!")
            s = self.atomic(out)
            x, saved = self.fresh(), self.scope.get(".")
            self.scope["."] = Seq(f"array({x})", s.kind)
            inner = self.items(self.path())
            self.scope["."] = saved
            out = Seq(f"flatten(transform({s.sql}, {x} -> {inner.sql}))", inner.kind)
        return out

    # paths

    def path(self) -> Any:
        head = self.primary()
        steps: list[Step] = []
        while True:
            if self.take("//"):
                step = self.step()
                if step.axis == "child" and all(how == "cond" for how, _ in step.predicates):
                    # the same nodes, without a row for every node on the way
                    steps.append(step._replace(axis="descendant"))
                else:
                    steps += [Step("descendant-or-self", "node()", []), step]
            elif self.at("/"):
                self.take("/")
                steps.append(self.step())
            elif not steps and self.at("[") and not (isinstance(head, Path) and not head.steps):
                head = self.filtered(head)
            else:
                break
        if not steps:
            return head
        if isinstance(head, Path):
            return Path(head.head, [*head.steps, *steps])
        if head.kind == "node":
            return Path(head.sql, steps)
        if head.kind != "nodes":
            raise QueryError("a path needs nodes to start from")
        if len(steps) == 1 and steps[0].axis == "attribute" and steps[0].test != "*":
            return self.attribute(head, steps[0].test)
        return self.from_sequence(head, steps)

    def attribute(self, s: Seq, key: str) -> Seq:
        """An attribute of each node, of a group's from its rows."""
        if s.kind == "node":
            return Seq(f"filter(array({s.sql}.attrs[{literal(key)}]), x -> x IS NOT NULL)", "str")
        return Seq(f"filter(transform({s.sql}, x -> x.attrs[{literal(key)}]), x -> x IS NOT NULL)", "str", s.over and (s.over[0], self.attribute(s.over[1], key)))

    def from_sequence(self, s: Seq, steps: list[Step]) -> Seq:
        """A path from each node of a sequence: one join for all rows, then each row gathers what its nodes lead to."""
        attribute = steps[-1].axis == "attribute"
        seq, c = self.column(s.sql), self.fresh()
        row = self.column("monotonically_increasing_id()")
        each = f"SELECT r, x FROM (SELECT struct(*) AS r FROM ({self.rows})) LATERAL VIEW OUTER explode(r.{seq}) __t AS x"
        start = self.origins("x", f"SELECT x FROM ({each}) WHERE x IS NOT NULL", steps)
        item, value = ("struct(doc AS d, pre AS p, v AS v)", "x.v") if attribute else ("struct(n.doc AS d, n.pre AS p, to_json(n) AS v)", f"from_json(x.v, '{self.ddl()}')")
        lists = f"SELECT o, collect_list({item}) AS l FROM ({self.steps_from(start, steps, self.every_document())}) GROUP BY o"
        self.rows = f"SELECT r.*, {c} FROM (SELECT first(e.r) AS r, transform(array_sort(array_distinct(flatten(collect_list(q.l)))), x -> {value}) AS {c} FROM ({each}) AS e LEFT JOIN ({lists}) AS q ON q.o.doc = e.x.doc AND q.o.pre = e.x.pre GROUP BY e.r.{row})"
        return Seq(c, "str" if attribute else "nodes")

    @staticmethod
    def origins(x: str, rows: str, steps: list[Step]) -> str:
        """Where paths of the nodes in a column start, each node once; attributes only for a step that takes them."""
        fields = [f"{x}.{k} AS {k}" for k in ("doc", "pre", "post", "parent")]
        start = "SELECT DISTINCT struct({0}.doc AS doc, {0}.pre AS pre) AS o, struct({1}) AS c FROM ({2})"
        if steps[0].axis != "attribute":
            return start.format(x, ", ".join(fields), rows)
        start = start.format(x, ", ".join([*fields, f"map_entries({x}.attrs) AS attrs"]), rows)
        return f"SELECT o, struct(c.doc AS doc, c.pre AS pre, c.post AS post, c.parent AS parent, map_from_entries(c.attrs) AS attrs) AS c FROM ({start})"

    def every_document(self) -> str:
        return f"({' UNION ALL '.join(f'SELECT * FROM `{d}__xml`' for d in self.engine.documents)})"

    def step(self) -> Step:
        if self.take("@"):
            axis = "attribute"
        elif self.take(".."):
            return Step("parent", "node()", [])
        else:
            axis = "child"
            for a in sorted(AXES, key=len, reverse=True):
                if self.at(a + "::"):
                    self.take(a + "::")
                    axis = a
                    break
        self.space()
        m = re.match(r"\*|(?:text|node|comment|element|processing-instruction)\(\)|[\w:-]+", self.text[self.i :])
        if not m:
            raise QueryError(f"expected a step at {self.text[self.i : self.i + 20]!r}")
        self.i += m.end()
        predicates = []
        while self.take("["):
            predicates.append(self.predicate())
            self.need("]")
        return Step(axis, m[0], predicates)

    def predicate(self) -> tuple[str, str]:
        """(position or condition, SQL over n, pos and last)."""
        self.space()
        m = re.match(r"\d+(?=\s*\])", self.text[self.i :])
        if m:
            self.i += m.end()
            return "pos", f"pos = {m[0]}"
        m = re.match(r"last\(\)(?=\s*\])", self.text[self.i :])
        if m:
            self.i += m.end()
            return "pos", "pos = last"
        tests = [self.condition()]
        while (word := self.take("and", "or")) is not None:
            tests += [word.upper(), self.condition()]
        return ("pos" if any("pos " in t for t in tests) else "cond"), " ".join(tests)

    def condition(self) -> str:
        if self.take("position()"):
            op = self.take("<=", ">=", "!=", "=", "<", ">")
            right = "last" if self.take("last()") else str(int(re.match(r"\s*(\d+)", self.text[self.i :])[1]))
            if right != "last":
                self.space()
                self.i += len(right)
            return f"pos {'<>' if op == '!=' else op} {right}"
        no = ""
        if self.at("not") and re.match(r"not\s*\(", self.text[self.i :]):
            self.take("not")
            self.need("(")
            inner = self.condition()
            self.need(")")
            return f"(NOT {inner})"
        if self.take("@"):
            value = f"n.attrs[{literal(self.word())}]"
        elif self.take("."):
            value = "n.value"
        elif self.take("text()"):
            value = "n.value"
        else:
            value = f"child:{self.word()}"
        op = self.take("<=", ">=", "!=", "=", "<", ">", "eq", "ne", "lt", "le", "gt", "ge")
        sign = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "!=": "<>"}.get(op, op)
        if op and self.take("@"):
            r = f"n.attrs[{literal(self.word())}]"
            # as numbers where both are, else as text
            test = lambda v: f"coalesce(try_cast({v} AS DOUBLE) {sign} try_cast({r} AS DOUBLE), {v} {sign} {r})"
        elif op:
            right = self.primary()
            if not isinstance(right, Seq) or right.kind not in ("num", "str"):
                raise QueryError("a predicate compares with a literal, a parameter or an attribute")
            r = f"get({right.sql}, 0)"
            test = (lambda v: f"try_cast({v} AS DOUBLE) {sign} {r}") if right.kind == "num" else (lambda v: f"{v} {sign} {r}")
        else:
            test = lambda v: f"{v} IS NOT NULL"
        if value.startswith("child:"):
            return f"EXISTS (SELECT 1 FROM {{nodes}} AS m WHERE m.doc = n.doc AND m.parent = n.pre AND m.name = {literal(value[6:])} AND {test('m.value')})"
        return f"{no}coalesce({test(value)}, FALSE)"

    JOINS = {
        "child": "n.doc = c.doc AND n.parent = c.pre",
        "parent": "n.doc = c.doc AND n.pre = c.parent",
        "self": "n.doc = c.doc AND n.pre = c.pre",
        "descendant": "n.doc = c.doc AND n.pre > c.pre AND n.post < c.post",
        "descendant-or-self": "n.doc = c.doc AND n.pre >= c.pre AND n.post <= c.post",
        "ancestor": "n.doc = c.doc AND n.pre < c.pre AND n.post > c.post",
        "ancestor-or-self": "n.doc = c.doc AND n.pre <= c.pre AND n.post >= c.post",
        "following": "n.doc = c.doc AND n.pre > c.post",
        "preceding": "n.doc = c.doc AND n.post < c.pre",
        "following-sibling": "n.doc = c.doc AND n.parent = c.parent AND n.pre > c.pre",
        "preceding-sibling": "n.doc = c.doc AND n.parent = c.parent AND n.pre < c.pre",
    }

    def steps_from(self, start: str, steps: list[Step], view: str) -> str:
        """start: rows with a node c and its origin o -> rows (o, n) or (o, v) of an attribute step."""
        rows = start
        for i, st in enumerate(steps):
            if st.axis == "attribute":
                pick = "explode(map_values(c.attrs))" if st.test == "*" else f"c.attrs[{literal(st.test)}]"
                return f"SELECT o, c.doc AS doc, c.pre AS pre, v FROM (SELECT o, c, {pick} AS v FROM ({rows})) WHERE v IS NOT NULL"
            kind = {"*": "n.kind = 'element'", "node()": "TRUE", "element()": "n.kind = 'element'"}.get(st.test)
            if kind is None:
                kind = f"n.kind = '{st.test[:-2]}'" if st.test.endswith("()") else f"n.kind = 'element' AND lower(n.name) = {literal(st.test.lower())}"
            back = st.axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent")
            rows = f"SELECT s.o AS o, s.c AS c, struct(n.*) AS n FROM ({rows}) AS s JOIN {view} AS n ON {self.JOINS[st.axis].replace('c.', 's.c.')} AND {kind}"
            for how, test in st.predicates:
                test = test.replace("{nodes}", view)
                if how == "pos":
                    over = "PARTITION BY o, c.doc, c.pre"
                    rows = f"SELECT *, row_number() OVER ({over} ORDER BY n.pre{' DESC' * back}) AS pos, count(1) OVER ({over}) AS last FROM ({rows})"
                rows = f"SELECT o, c, n FROM ({rows}) WHERE {test}"
            # a node that several contexts reach counts once; column by column, so that Spark drops those that nothing reads
            rest = ", ".join(f"first(n.{k}) AS {k}" for k in COLUMNS[2:])
            rows = f"SELECT o, struct(n.doc AS doc, n.pre AS pre, {rest}) AS c FROM ({rows}) GROUP BY o, n.doc, n.pre"
        return f"SELECT o, c AS n FROM ({rows})"

    def view_of(self, head: str) -> str:
        return f"`{head[4:]}__xml`"

    def nodes(self, p: Path) -> str:
        """Rows n of an absolute path."""
        view = self.view_of(p.head)
        start = f"SELECT 1 AS o, struct(*) AS c FROM {view} WHERE kind = 'document'"
        if p.steps and p.steps[-1].axis == "attribute":
            return f"SELECT v AS n FROM ({self.steps_from(start, p.steps, view)})"
        return f"SELECT n FROM ({self.steps_from(start, p.steps, view)})"

    def walk(self, p: Path) -> Seq:
        """A path as a column of the rows."""
        attribute = bool(p.steps) and p.steps[-1].axis == "attribute"
        c = self.fresh()
        if p.head.startswith("doc:"):
            view = self.view_of(p.head)
            start = f"SELECT 1 AS o, struct(*) AS c FROM {view} WHERE kind = 'document'"
            found = self.steps_from(start, p.steps, view)
            value = "transform(sort_array(collect_list(struct(doc, pre, v))), x -> x.v)" if attribute else "transform(sort_array(collect_list(struct(n.doc AS d, n.pre AS p, to_json(n) AS v))), x -> from_json(x.v, '{}'))".format(self.ddl())
            self.rows = f"SELECT r.*, coalesce(q.{c}, {self.nothing(attribute)}) AS {c} FROM ({self.rows}) AS r CROSS JOIN (SELECT {value} AS {c} FROM ({found})) AS q"
            return Seq(c, "str" if attribute else "nodes")
        if attribute and len(p.steps) == 1 and p.steps[0].test != "*":
            return Seq(self.column(self.attribute(Seq(p.head, "node"), p.steps[0].test).sql), "str")
        view = self.every_document()
        start = self.origins(p.head, self.rows, p.steps)
        found = self.steps_from(start, p.steps, view)
        value = "transform(sort_array(collect_list(struct(doc, pre, v))), x -> x.v)" if attribute else "transform(sort_array(collect_list(struct(n.doc AS d, n.pre AS p, to_json(n) AS v))), x -> from_json(x.v, '{}'))".format(self.ddl())
        self.rows = f"SELECT r.*, coalesce(q.{c}, {self.nothing(attribute)}) AS {c} FROM ({self.rows}) AS r LEFT JOIN (SELECT o, {value} AS {c} FROM ({found}) GROUP BY o) AS q ON q.o.doc = r.{p.head}.doc AND q.o.pre = r.{p.head}.pre"
        return Seq(c, "str" if attribute else "nodes")

    @staticmethod
    def ddl() -> str:
        from ..sources.xml import NODE_DDL

        return NODE_DDL

    def nothing(self, attribute: bool) -> str:
        return "cast(array() AS array<string>)" if attribute else f"cast(array() AS array<struct<{self.ddl().replace(' string', ':string').replace(' int', ':int').replace(' map', ':map').replace(', ', ',')}>>)"

    def filtered(self, head: Any) -> Seq:
        self.need("[")
        s = self.items(head)
        self.space()
        m = re.match(r"(\d+)\s*\]|(last\(\))\s*\]", self.text[self.i :])
        if m:
            self.i += m.end()
            at = f"{m[1]} - 1" if m[1] else f"size({s.sql}) - 1"
            return Seq(f"filter(array(get({s.sql}, {at})), x -> x IS NOT NULL)", s.kind)
        x, i, saved = self.fresh(), self.fresh(), (self.scope.get("."), self.scope.get("position()"))
        self.scope["."], self.scope["position()"] = Seq(f"array({x}.value)", "str") if s.kind == "nodes" else Seq(f"array({x})", s.kind), Seq(f"array({i} + 1)", "num")
        self.scope["last()"] = Seq(f"array(size({s.sql}))", "num")
        test = self.truth(self.expr())
        self.scope["."], self.scope["position()"] = saved
        self.need("]")
        return Seq(f"filter({s.sql}, ({x}, {i}) -> {test})", s.kind)

    # primaries

    def primary(self) -> Any:
        self.space()
        rest = self.text[self.i :]
        m = re.match(r"\d+(?:\.\d+)?(?:[eE][+-]?\d+)?", rest)
        if m:
            self.i += m.end()
            return Seq(f"array({m[0]}{'D' * bool(re.search('[.eE]', m[0]))})", "num")
        m = re.match(r"""'((?:[^']|'')*)'|"((?:[^"]|"")*)\"""", rest)
        if m:
            self.i += m.end()
            return Seq(f"array({literal(m[1].replace(chr(39) * 2, chr(39)) if m[1] is not None else m[2].replace(chr(34) * 2, chr(34)))})", "str")
        if rest.startswith("$"):
            v = self.variable()
            if v in self.scope:
                return self.scope[v]
            if v in self.engine.documents:
                return Path(f"doc:{v}", [])
            if v in self.params:
                value = self.params[v]
                return Seq(f"array({literal(value)})", "num" if isinstance(value, (int, float)) and not isinstance(value, bool) else "str")
            raise QueryError(f"unknown variable ${v}")
        m = re.match(r"<!--.*?-->|<\?.*?\?>", rest, re.S)
        if m:
            self.i += m.end()
            return Seq(f"array({literal(m[0])})", "xml")
        if re.match(r"<[A-Za-z_]", rest):
            return Seq(f"array({self.constructor()})", "xml")
        if self.take("("):
            if self.take(")"):
                return Seq("array()", "str")
            if self.at("LANG"):
                return self.block(")")
            out = self.expr()
            self.need(")")
            return out
        if self.at(".") and self.scope.get(".") and not re.match(r"\.\d", rest):
            self.take(".")
            return self.scope["."]
        m = re.match(r"([A-Za-z_][\w-]*(?::[A-Za-z_][\w-]*)?)\s*\(", rest)
        if m:
            self.i += m.end()
            args = []
            while not self.at(")"):
                args.append(self.single())
                self.take(",")
            self.need(")")
            return self.function(m[1].removeprefix("fn:").removeprefix("xs:"), args)
        m = re.match(r"(element|attribute|processing-instruction|text|comment|document)(?:\s+([\w-]+))?\s*\{", rest)
        if m:
            self.i += m.end()
            if m[1] == "attribute":
                value = f"array_join({self.strings(self.expr())}, ' ')"
                self.need("}")
                # marked, so that the element around finds it
                text = f"concat({literal(chr(1) + ' ' + m[2] + '=' + chr(34))}, replace({self.escaped(value)}, '{chr(34)}', '&quot;'), {literal(chr(34) + chr(2))})"
                return Seq(f"array({text})", "xml")
            inner = "''" if self.at("}") else self.content(self.expr())
            self.need("}")
            made = {"element": lambda: self.element(m[2], [], [inner]), "processing-instruction": lambda: f"concat({literal(f'<?{m[2]} ')}, {inner}, '?>')", "comment": lambda: f"concat('<!--', {inner}, '-->')"}
            return Seq(f"array({made.get(m[1], lambda: inner)()})", "xml")
        raise QueryError(f"unexpected {rest[:20]!r}")

    def foreign(self, end: str) -> tuple[str, str, str]:
        """A LANG block as a view, its first column and the kind of its values."""
        self.need("LANG")
        language = self.word()
        end_at = block_end(self.text, self.i)
        text, self.i = self.text[self.i : end_at], end_at
        m = re.match(r"LANG\s+EXIT\s*", self.text[self.i :], re.I)
        self.i += m.end() if m else 0
        self.need(end)
        df = self.engine.evaluate(text, language.lower(), self.params)
        kind = df.schema[df.columns[0]].dataType.typeName()
        return self.engine.view(df, "lang"), name(df.columns[0]), "num" if kind in ("integer", "long", "double", "float", "decimal", "short") else "bool" if kind == "boolean" else "str"

    def block(self, end: str) -> Seq:
        view, col, kind = self.foreign(end)
        c = self.fresh()
        self.rows = f"SELECT r.*, q.{c} FROM ({self.rows}) AS r CROSS JOIN (SELECT transform(collect_list(struct({col} AS v)), x -> x.v) AS {c} FROM {view}) AS q"
        return Seq(c, kind)

    def function(self, fn: str, args: list[Any]) -> Any:
        a = args[0] if args else None
        if fn in ("position", "last"):
            return self.scope[f"{fn}()"]
        if fn in ("true", "false"):
            return Seq(f"array({fn.upper()})", "bool")
        if fn in ("count", "exists", "empty", "sum", "avg") and isinstance(a, Path) and a.head.startswith("doc:"):
            return self.over_rows(fn, a)
        if fn == "not":
            return Seq(f"array(NOT {self.truth(a)})", "bool")
        if fn == "count":
            return Seq(f"array({self.counted(a)})", "num")
        if fn in ("exists", "empty"):
            return Seq(f"array({self.counted(a)} {'>' if fn == 'exists' else '='} 0)", "bool")
        if fn in ("sum", "avg", "min", "max") and isinstance(a, Seq) and a.over:
            return self.over_group(fn, a)
        if fn == "data":
            return self.atomic(a)
        if fn == "sum":
            return Seq(f"array(aggregate({self.numbers(a)}, 0D, (x, y) -> x + y))", "num")
        if fn == "avg":
            n = self.numbers(a)
            return Seq(f"filter(array(try_divide(aggregate({n}, 0D, (x, y) -> x + y), size({n}))), x -> x IS NOT NULL)", "num")
        if fn in ("min", "max"):
            s = self.atomic(a)
            if s.kind == "num":
                return Seq(f"filter(array(array_{fn}({s.sql})), x -> x IS NOT NULL)", "num")
            # numbers if all are, else text
            text = self.strings(s)
            best = f"CASE WHEN exists({text}, x -> try_cast(x AS DOUBLE) IS NULL) THEN array_{fn}({text}) ELSE {self.text_of(f'array_{fn}({self.numbers(s)})', 'num')} END"
            return Seq(f"filter(array({best}), x -> x IS NOT NULL)", "str")
        if fn == "string":
            return Seq(f"array(coalesce(get({self.strings(a)}, 0), ''))", "str")
        if fn in ("number", "double", "integer", "decimal"):
            return Seq(f"filter(array(get({self.numbers(a)}, 0)), x -> x IS NOT NULL)", "num")
        if fn == "boolean":
            return Seq(f"array({self.truth(a)})", "bool")
        if fn in self.engine.registry.builders("xquery"):
            built = self.engine.registry.builders("xquery")[fn](*(f"get({self.atomic(x).sql}, 0)" for x in args))
            return Seq(f"array({built})", "str")
        raise QueryError(f"unknown function {fn}")

    def over_rows(self, fn: str, p: Path) -> Seq:
        """An aggregate over a document's path without gathering its nodes."""
        v = "n" if p.steps and p.steps[-1].axis == "attribute" else "n.value"
        value = {"count": "count(1)", "exists": "count(1) > 0", "empty": "count(1) = 0", "sum": f"coalesce(sum(try_cast({v} AS DOUBLE)), 0D)", "avg": f"avg(try_cast({v} AS DOUBLE))"}[fn]
        c = self.fresh()
        self.rows = f"SELECT r.*, q.{c} FROM ({self.rows}) AS r CROSS JOIN (SELECT {value} AS {c} FROM ({self.nodes(p)})) AS q"
        return Seq(f"filter(array({c}), x -> x IS NOT NULL)", "bool" if fn in ("exists", "empty") else "num")

    def content(self, x: Any) -> str:
        """Content of an element: nodes as they are, atomic values with a space between."""
        s = self.items(x)
        return f"array_join({self.serialised(s)}, '{'' if s.kind in ('nodes', 'xml') else ' '}')"

    @staticmethod
    def element(tag: str, attrs: list[str], parts: list[str]) -> str:
        inner = f"concat({', '.join(parts)})" if parts else "''"
        if chr(1) in inner:
            attrs = [*attrs, f"array_join(regexp_extract_all({inner}, '{chr(1)}([^{chr(2)}]*){chr(2)}', 1), '')"]
            inner = f"regexp_replace({inner}, '{chr(1)}[^{chr(2)}]*{chr(2)}', '')"
        start = f"concat({', '.join([literal('<' + tag), *attrs])})"
        return f"CASE WHEN {inner} = '' THEN concat({start}, '/>') ELSE concat({start}, '>', {inner}, {literal(f'</{tag}>')}) END" if parts else f"concat({start}, '/>')"

    def constructor(self) -> str:
        self.need("<")
        tag, attrs, parts = self.word(), [], []
        while not self.at(">", "/>"):
            key = self.word()
            self.need("=")
            self.space()
            quote = self.text[self.i]
            self.i += 1
            value = [literal(f' {key}="')]
            while self.text[self.i] != quote:
                if self.text[self.i] == "{":
                    self.i += 1
                    value.append(f"replace({self.escaped(f'array_join({self.strings(self.expr())}, {literal(chr(32))})')}, '\"', '&quot;')")
                    self.need("}")
                else:
                    m = re.compile(rf"[^{{{quote}]+").match(self.text, self.i)
                    value.append(literal(m[0]))
                    self.i = m.end()
            self.i += 1
            attrs.append(f"concat({', '.join([*value, literal(chr(34))])})")
        if self.take("/>"):
            return self.element(tag, attrs, [])
        self.need(">")
        while not self.text.startswith("</", self.i):
            ch = self.text[self.i]
            if ch == "{":
                self.i += 1
                self.space()
                parts.append(self.content(self.block("}") if self.at("LANG") else self.expr()))
                self.take("}")
            elif self.text.startswith(("<!--", "<?"), self.i):
                parts.append(f"get({self.primary().sql}, 0)")
            elif ch == "<":
                parts.append(self.constructor())
            else:
                m = re.compile(r"[^{<]+").match(self.text, self.i)
                if m[0].strip():
                    parts.append(literal(m[0]))
                self.i = m.end()
        self.i += 2
        if self.word() != tag:
            raise QueryError(f"</{tag}> expected")
        self.need(">")
        return self.element(tag, attrs, parts)
