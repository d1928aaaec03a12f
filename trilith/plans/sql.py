"""The SQL dialect as Spark SQL text.

The parser keeps the structure of a query and rewrites only what Spark reads otherwise: names, literals, casts, NULL
order, DISTINCT ON, quantified comparisons, NULL-keeping and ordered collections, subscripts, and LANG blocks. What
is left to Catalyst is everything else.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from typing import Any

from ..functions import datetime as dt
from .lexer import Cursor, QueryError, Token, unquote

#: Names that can't be an alias without AS.
RESERVED = set("SELECT FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AS WITH WINDOW LANG AND OR NOT IN IS LIKE ILIKE BETWEEN CASE WHEN THEN ELSE END FILTER ASC DESC NULLS LATERAL FETCH VALUES".split())
#: What a condition in parentheses stands before.
CONDITION_END = set("AND OR GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT JOIN INNER LEFT RIGHT FULL CROSS".split()) | {")", ",", ";"}
COMPARE = {"=", "<>", "!=", "<", "<=", ">", ">="}


def name(text: str) -> str:
    return f"`{text.replace('`', '``')}`"


def literal(value: Any) -> str:
    """A Python value as Spark SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D" if value == value and abs(value) != float("inf") else f"double('{value}')"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    if isinstance(value, dict):
        return f"named_struct({', '.join(f'{literal(k)}, {literal(v)}' for k, v in value.items())})"
    if hasattr(value, "isoformat"):
        return f"timestamp_ntz'{value.isoformat(sep=' ')}'" if hasattr(value, "hour") else f"date'{value.isoformat()}'"
    return str(value)


def cast(x: str, to: str) -> str:
    """The casts of the dialect: text that doesn't fit becomes NULL."""
    kind = to.lower()
    if kind.endswith("[]"):
        return f"transform({x}, _x -> {cast('_x', to[:-2])})"
    if kind in ("number", "float", "real", "numeric"):
        return f"try_cast({x} AS DOUBLE)"
    if kind in ("text", "string", "varchar"):
        return f"cast({x} AS STRING)"
    if kind == "json":
        return f"try_parse_json({x})"
    if kind == "date":
        return f"try_cast({x} AS TIMESTAMP_NTZ)"
    if kind == "interval":
        raise QueryError("use interval('...')")
    if kind == "boolean":
        return f"coalesce(cast({x} AS STRING) NOT IN ('', 'false', '0', '0.0', 'NaN'), FALSE)"
    return f"try_cast({x} AS {to.upper()})"


class Sql:
    """Parses one statement. resolve(language, text of the block) gives a relation, its columns and whether it is correlated, for LANG blocks."""

    def __init__(self, text: str, params: dict[str, Any] | None = None, lang: Callable[[str, str], tuple[str, list[str], bool]] | None = None, functions: dict[str, Callable[..., str]] | None = None, operators: dict[str, Callable[[str, str], str]] | None = None, aggregates: dict[str, str] | None = None) -> None:
        self.c = Cursor(text)
        self.params, self.lang = params or {}, lang
        self.functions, self.operators, self.aggregates = functions or {}, operators or {}, aggregates or {}
        self.casts: dict[str, Callable[[str], str]] = {}
        self.n = 0
        #: CTEs that are evaluated before the query: (view, columns, first part, step of a recursion that drops repeated rows).
        self.loops: list[tuple[str, list[str] | None, str, str | None]] = []
        #: CTEs that go by the name of a view of their own.
        self.renamed: dict[str, str] = {}
        self.last_union: tuple[str, str, bool] | None = None
        #: Names of the FROM clauses around.
        self.tables: list[set[str]] = []
        #: Whether NULL counts as FALSE where the parser is, and whether NOT IN may be rewritten there.
        self.positive, self.rewrite = False, True

    def fresh(self) -> str:
        self.n += 1
        return f"__{self.n}"

    # statements

    def statement(self) -> str:
        out = self.query(top=True)
        self.c.take(";")
        if self.c.tok.kind != "end":
            raise QueryError(f"unexpected {self.c.tok.text!r} at {self.c.tok.start}")
        return out

    def query(self, top: bool = False) -> str:
        ctes, outer = "", dict(self.renamed)
        if self.c.take("WITH"):
            ctes = self.ctes()
        out = ctes + self.set_operation(top)
        self.renamed = outer
        return out

    def ctes(self) -> str:
        self.c.take("RECURSIVE")
        parts, recursive = [], ""
        while True:
            cte = self.identifier()
            cols = self.name_list() if self.c.is_("(") else None
            self.c.need("AS")
            materialized = not self.c.all_("NOT", "MATERIALIZED") and bool(self.c.take("MATERIALIZED"))
            self.c.need("(")
            itself = self.mentions(cte, self.c.i, self.closing(self.c.i))
            view = f"{cte}_{uuid.uuid4().hex[:12]}" if itself or materialized else cte
            if itself:
                self.renamed[cte] = view
            self.last_union = None
            body = self.query()
            self.c.need(")")
            if self.c.is_("SEARCH", "CYCLE"):
                raise QueryError(f"{self.c.tok.text} is not supported")
            before = f"WITH {recursive}{', '.join(parts)} " if parts else ""
            if itself and not self.last_union:
                raise QueryError(f"recursive {cte} is not a UNION of two parts")
            if itself and self.last_union[2]:
                self.loops.append((view, cols, before + self.last_union[0], before + self.last_union[1]))
            elif materialized and not itself:
                self.loops.append((view, cols, before + body, None))
            else:
                recursive = recursive or "RECURSIVE " * itself
                parts.append(f"{name(view)}{self.columns(cols)} AS ({body})")
            self.renamed[cte] = view
            if not self.c.take(","):
                break
        return f"WITH {recursive}{', '.join(parts)} " if parts else ""

    def closing(self, at: int) -> int:
        """Where the parenthesis that was opened before a token closes."""
        depth = 0
        while self.c.toks[at].kind != "end":
            depth += (self.c.toks[at].text == "(") - (self.c.toks[at].text == ")")
            if depth < 0:
                break
            at += 1
        return at

    def mentions(self, cte: str, start: int, end: int) -> bool:
        toks = self.c.toks
        return any(t.kind in ("name", "quoted") and t.text.strip('"`') == cte and toks[i - 1].text.upper() in ("FROM", "JOIN", ",") for i, t in enumerate(toks[start:end], start))

    @staticmethod
    def columns(cols: list[str] | None) -> str:
        return f"({', '.join(map(name, cols))})" if cols else ""

    def set_operation(self, top: bool = False) -> str:
        parts: list[tuple[str, str, bool]] = [("", *self.operand(top))]
        while (op := self.c.take("UNION", "INTERSECT", "EXCEPT")) is not None:
            every = bool(self.c.take("ALL")) or (bool(self.c.take("DISTINCT")) and False)
            parts.append((f"{op} ALL" if every else op, *self.operand(False, True)))
        if len(parts) == 1:
            return parts[0][1] + self.tail("" if parts[0][2] else None)
        if len(parts) == 2:
            self.last_union = (parts[0][1], parts[1][1], parts[1][0] == "UNION")
        out = parts[0][1]
        for op, text, _ in parts[1:]:
            out += f" {op} {text}"
        return out + self.tail("")

    def operand(self, top: bool, later: bool = False) -> tuple[str, bool]:
        """A SELECT, VALUES or a query in parentheses; whether ORDER BY may still follow. later: an ORDER BY at its end is the set operation's."""
        if self.c.take("("):
            inner = self.query(top)
            self.c.need(")")
            return f"({inner})", True
        if self.c.is_("VALUES"):
            return self.values(None), True
        return self.select(top, later), False

    def tail(self, after: str | None) -> str:
        """ORDER BY, LIMIT and OFFSET of a set operation; a SELECT has read its own."""
        return "" if after is None else self.order_limit()

    def order_limit(self, orders: list[str] | None = None) -> str:
        out = ""
        if orders is None and self.c.all_("ORDER", "BY"):
            orders = self.orders()
        if orders:
            out += " ORDER BY " + ", ".join(orders)
        limit = offset = None
        while (word := self.c.take("LIMIT", "OFFSET")) is not None:
            if word == "LIMIT":
                limit = None if self.c.take("ALL") else self.expr()
            else:
                offset = self.expr()
        return out + (f" LIMIT {limit}" if limit else "") + (f" OFFSET {offset}" if offset else "")

    def orders(self) -> list[str]:
        out = []
        while True:
            x = self.expr()
            way = self.c.take("ASC", "DESC") or "ASC"
            nulls = self.c.need("FIRST", "LAST") if self.c.take("NULLS") else "LAST" if way == "ASC" else "FIRST"
            out.append(f"{x} {way} NULLS {nulls}")
            if not self.c.take(","):
                return out

    def select(self, top: bool, later: bool = False) -> str:
        c = self.c
        c.need("SELECT")
        distinct, keys = False, None
        if c.take("DISTINCT"):
            distinct = True
            if c.take("ON"):
                c.need("(")
                keys = [self.expr()]
                while c.take(","):
                    keys.append(self.expr())
                c.need(")")
        else:
            c.take("ALL")
        items: list[tuple[str, str | None]] = []
        while True:
            start = c.i
            x = self.star() or self.expr()
            alias = None
            if c.take("AS") or (c.tok.kind in ("name", "quoted") and (c.tok.kind == "quoted" or c.tok.text.upper() not in RESERVED)):
                alias = self.identifier()
            elif top and not x.endswith("*"):
                toks = c.toks[start : c.i]
                alias = self.plain_name(toks)
            items.append((x, alias))
            if not c.take(","):
                break
        rest = ""
        if c.take("FROM"):
            self.tables.append(set())
            rest += " FROM " + self.from_list()
            self.tables.pop()
        if c.take("WHERE"):
            rest += " WHERE " + self.filter()
        if c.all_("GROUP", "BY"):
            rest += " GROUP BY " + self.groups()
        having = bool(c.take("HAVING"))
        if having:
            rest += " HAVING " + self.expr()
        orders = self.orders() if c.all_("ORDER", "BY") else []
        listed = ", ".join(x + (f" AS {name(a)}" if a else "") for x, a in items)
        if keys is None and having and not distinct and any("(" in o for o in orders) and not any(x.endswith("*") for x, _ in items):
            # Spark finds no aggregate of ORDER BY below HAVING: they become hidden columns
            aliases = [a or self.plain_alias(x) for x, a in items]
            sorts = [o.rsplit(" ", 3) for o in orders]
            inner = f"SELECT {', '.join(f'{x} AS {name(a)}' for (x, _), a in zip(items, aliases))}, {', '.join(f'{o[0]} AS __o{i}' for i, o in enumerate(sorts))}{rest}"
            return self.hiding(f"SELECT {', '.join(map(name, aliases))}", inner, [f"__o{i} {' '.join(o[1:])}" for i, o in enumerate(sorts)], later)
        if keys is None and orders and not (distinct or top or later) and c.is_("LIMIT", "OFFSET"):
            sorts = [(self.unaliased(o.rsplit(" ", 3)[0], items), " ".join(o.rsplit(" ", 3)[1:])) for o in orders]
            hidden = {x: f"__o{i}" for i, (x, _) in enumerate(sorts) if not x.isdigit()}
            if hidden:
                inner = f"SELECT {listed}, {', '.join(f'{x} AS {o}' for x, o in hidden.items())}{rest}"
                return self.hiding(f"SELECT * EXCEPT ({', '.join(hidden.values())})", inner, [f"{hidden.get(x, x)} {way}" for x, way in sorts])
        if keys is None:
            return f"SELECT {'DISTINCT ' * distinct}{listed}{rest}" + (self.order_limit(orders) if orders or c.is_("LIMIT", "OFFSET") else "")
        # DISTINCT ON: the first row of each key in the order asked for
        aliases = [a or self.plain_alias(x) for x, a in items]
        by_alias = {name(a): x for (x, a) in items if a} | {a: x for (x, a) in items if a}
        known = [(by_alias.get(o.rsplit(" ", 3)[0], o.rsplit(" ", 3)[0]), " ".join(o.rsplit(" ", 3)[1:])) for o in orders]
        over = ", ".join(f"{x} {way}" for x, way in known) or "1"
        hidden = "".join(f", {x} AS __o{i}" for i, (x, _) in enumerate(known))
        inner = f"SELECT {', '.join(f'{x} AS {name(a)}' for (x, _), a in zip(items, aliases))}{hidden}, row_number() OVER (PARTITION BY {', '.join(keys)} ORDER BY {over}) AS __n{rest}"
        return self.hiding(f"SELECT {', '.join(name(a) for a in aliases)}", f"SELECT * FROM ({inner}) WHERE __n = 1", [f"__o{i} {way}" for i, (_, way) in enumerate(known)], later)

    def hiding(self, outer: str, inner: str, orders: list[str], later: bool = False) -> str:
        """ORDER BY columns that the result hides. In a correlated query Spark limits each outer row's rows in their order
        only if LIMIT stands right over ORDER BY, so the columns are dropped after it."""
        within = self.c.is_("LIMIT", "OFFSET") and not later
        return f"{outer} FROM ({inner}{self.order_limit(orders)})" if within else f"{outer} FROM ({inner})" + self.order_limit(orders)

    @staticmethod
    def unaliased(x: str, items: list[tuple[str, str | None]]) -> str:
        """An expression of ORDER BY with what the aliases stand for, as ORDER BY knows them and the list of columns doesn't."""
        known = {name(a).lower(): y if re.fullmatch(r"[\w.`]+", y) else f"({y})" for y, a in items if a}
        return re.sub(r"'(?:[^'\\]|\\.)*'|(?<!\.)`(?:[^`]|``)+`(?!\s*[.(])", lambda m: known.get(m[0].lower(), m[0]), x)

    @staticmethod
    def plain_alias(x: str) -> str:
        return x.split(".")[-1].strip("`")

    @staticmethod
    def plain_name(toks: list[Token]) -> str:
        """The name of an unaliased column: its text, names without their quotes."""
        out = ""
        for i, t in enumerate(toks):
            text = t.text.strip('"`') if t.kind == "quoted" else t.text
            glue = i == 0 or t.text in (".", ",", ")", "(", "::", "[", "]") or toks[i - 1].text in (".", "(", "::", "[")
            out += ("" if glue else " ") + text
        return out

    def groups(self) -> str:
        out = []
        while True:
            if self.c.is_("ROLLUP", "CUBE") or self.c.are("GROUPING", "SETS"):
                word = self.c.next().text.upper() + (" SETS" if self.c.take("SETS") else "")
                out.append(f"{word} ({self.balanced()})")
            else:
                out.append(self.expr())
            if not self.c.take(","):
                return ", ".join(out)

    def balanced(self) -> str:
        self.c.need("(")
        parts = []
        while not self.c.is_(")"):
            if self.c.is_("("):
                parts.append(f"({self.balanced()})")
            elif not self.c.take(","):
                parts.append(self.expr())
        self.c.need(")")
        return ", ".join(parts)

    def star(self) -> str | None:
        c = self.c
        if c.take("*"):
            return "*"
        if c.tok.kind in ("name", "quoted") and c.ahead().text == "." and c.ahead(2).text == "*":
            table = self.identifier()
            c.i += 2
            return f"{name(table)}.*"
        return None

    # FROM

    def from_list(self) -> str:
        out = self.table(True)
        while True:
            c = self.c
            if c.take(","):
                # no condition yet: WHERE turns the product into a join
                out += f" CROSS JOIN {self.table()}"
                continue
            how = None
            if c.all_("CROSS", "JOIN"):
                out += f" CROSS JOIN {self.table()}"
                continue
            if c.is_("NATURAL"):
                raise QueryError("NATURAL JOIN is not supported")
            if c.is_("JOIN", "INNER"):
                c.take("INNER")
                how = "JOIN"
            elif (side := c.take("LEFT", "RIGHT", "FULL")) is not None:
                c.take("OUTER")
                how = f"{side} JOIN"
            if how is None:
                return out
            c.need("JOIN")
            right = self.table()
            if c.take("ON"):
                out += f" {how} {right} ON {self.expr()}"
            elif c.is_("USING"):
                c.next()
                out += f" {how} {right} USING ({', '.join(map(name, self.name_list()))})"
            elif right.startswith("LATERAL"):
                out += f" {how} {right}"
            else:
                raise QueryError(f"{how} needs ON or USING at {c.tok.text or 'the end'!r} ({c.tok.start})")

    def alias(self, plain: str | None = None) -> tuple[str | None, list[str] | None]:
        """The alias of a table and of its columns; a table without one goes by its plain name."""
        c, table, names = self.c, None, None
        if c.take("AS") or c.tok.kind == "quoted" or (c.tok.kind == "name" and c.tok.text.upper() not in RESERVED):
            table = self.identifier()
            names = self.name_list() if c.is_("(") else None
        known = (table or plain or "").lower()
        if known and self.tables:
            if known in self.tables[-1]:
                raise QueryError(f"duplicate table alias {table or plain}")
            self.tables[-1].add(known)
        return table, names

    def table(self, first: bool = False) -> str:
        c = self.c
        lateral = "LATERAL " if c.take("LATERAL") else ""
        if c.is_("(") and c.ahead().text.upper() == "LANG" or c.is_("LANG"):
            view, cols, correlated = self.block()
            table, names = self.alias()
            return f"{'LATERAL ' * (correlated and not first)}{view} AS {name(table or self.fresh())}{self.columns(names)}"
        if c.take("("):
            if c.is_("VALUES"):
                c.next()
                c.i -= 1
                body = self.values(None)
                c.need(")")
                table, names = self.alias()
                return f"({body}) AS {name(table or self.fresh())}{self.columns(names)}"
            if c.is_("SELECT", "WITH", "("):
                body = self.query()
                c.need(")")
                table, names = self.alias()
                return f"{lateral}({body}) AS {name(table or self.fresh())}{self.columns(names)}"
            inner = self.from_list()
            c.need(")")
            return f"({inner})"
        if c.is_("VALUES"):
            body = self.values(None)
            table, names = self.alias()
            return f"({body}) AS {name(table or self.fresh())}{self.columns(names)}"
        parts = [self.identifier()]
        while c.take("."):
            parts.append(self.identifier())
        if c.is_("("):
            return self.table_function(parts)
        table, names = self.alias(parts[-1])
        view = self.renamed.get(parts[0], parts[0]) if len(parts) == 1 else "__".join(parts)
        if not table and view != parts[-1]:
            table = parts[-1]
        return name(view) + (f" AS {name(table)}{self.columns(names)}" if table else "")

    def table_function(self, parts: list[str]) -> str:
        self.c.need("(")
        args = []
        while not self.c.is_(")"):
            args.append(self.expr())
            self.c.take(",")
        self.c.need(")")
        ordinal = self.c.all_("WITH", "ORDINALITY")
        table, names = self.alias()
        fn = ".".join(parts).lower()
        if fn != "unwind":
            return f"LATERAL {fn}({', '.join(args)})" + (f" AS {name(table)}{self.columns(names)}" if table else "")
        table = table or self.fresh()
        if ordinal:
            first, second = (names or ["value", "ordinality"])[:2]
            return f"LATERAL (SELECT col AS {name(first)}, pos + 1 AS {name(second)} FROM posexplode({args[0]})) AS {name(table)}"
        return f"LATERAL (SELECT col AS {name((names or ['value'])[0])} FROM explode({args[0]})) AS {name(table)}"

    def values(self, names: list[str] | None) -> str:
        self.c.need("VALUES")
        rows = []
        while True:
            rows.append(f"({self.balanced()})")
            if not self.c.take(","):
                break
        width = self.width(rows[0])
        cols = names or [f"col{i}" for i in range(width)]
        return f"SELECT * FROM VALUES {', '.join(rows)} AS __v{self.columns(cols)}"

    @staticmethod
    def width(row: str) -> int:
        depth, n, quoted = 0, 1, False
        for i, ch in enumerate(row[1:-1]):
            if ch == "'" and row[i] != "\\":
                quoted = not quoted
            if not quoted:
                depth += (ch in "([{") - (ch in ")]}")
                n += ch == "," and depth == 0
        return n

    def block(self) -> tuple[str, list[str], bool]:
        """A LANG block, in parentheses or up to LANG EXIT or the end of what encloses it."""
        c = self.c
        closing = bool(c.take("("))
        c.need("LANG")
        language = c.next().text.lower()
        text = c.next().text
        c.all_("LANG", "EXIT")
        if closing:
            c.need(")")
        if not self.lang:
            raise QueryError("LANG blocks need an engine")
        return self.lang(language, text)

    # expressions

    def identifier(self) -> str:
        t = self.c.next()
        if t.kind == "quoted":
            return t.text[1:-1].replace(t.text[0] * 2, t.text[0])
        if t.kind != "name":
            raise QueryError(f"expected a name at {t.text!r} ({t.start})")
        return t.text

    def name_list(self) -> list[str]:
        self.c.need("(")
        out = [self.identifier()]
        while self.c.take(","):
            out.append(self.identifier())
        self.c.need(")")
        return out

    def expr(self) -> str:
        out = self.conjunction()
        while self.c.take("OR"):
            out = f"({out} OR {self.conjunction()})"
        return out

    def conjunction(self) -> str:
        out = self.negation()
        while self.c.take("AND"):
            out = f"({out} AND {self.negation()})"
        return out

    def negation(self) -> str:
        if not self.c.take("NOT"):
            return self.comparison()
        positive, self.positive = self.positive, False
        out = f"(NOT {self.negation()})"
        self.positive = positive
        return out

    def filter(self) -> str:
        """An expression that keeps rows where it is TRUE."""
        positive, self.positive = self.positive, self.rewrite
        out = self.expr()
        self.positive = positive
        return out

    def is_condition(self) -> bool:
        """Whether what stands in parentheses here is a condition by itself, not an operand."""
        after = self.c.toks[min(self.closing(self.c.i + 1) + 1, len(self.c.toks) - 1)]
        return self.c.is_("(") and (after.kind == "end" or after.text.upper() in CONDITION_END)

    def comparison(self) -> str:
        c, positive = self.c, self.positive
        self.positive = positive and self.is_condition()
        out = self.concat()
        self.positive = False
        out = self.compared(out, positive)
        self.positive = positive
        return out

    def compared(self, out: str, positive: bool) -> str:
        c = self.c
        while True:
            if c.tok.text in COMPARE and c.tok.kind == "op":
                op = c.next().text
                if (how := c.take("ALL", "ANY", "SOME")) is not None:
                    out = self.quantified(out, op, "ALL" if how == "ALL" else "ANY", positive)
                else:
                    out = f"({out} {op} {self.concat()})"
            elif c.take("IS"):
                no = bool(c.take("NOT"))
                if c.all_("DISTINCT", "FROM"):
                    out = f"({'' if no else 'NOT '}({out} <=> {self.concat()}))"
                elif (word := c.take("NULL", "TRUE", "FALSE")) is not None:
                    out = f"({out} IS {'NOT ' * no}{word})"
                else:
                    out = f"({'NOT ' * no}({out} <=> {self.concat()}))"
            else:
                no = "NOT " if c.is_("NOT") and c.ahead().text.upper() in ("IN", "LIKE", "ILIKE", "BETWEEN") else ""
                if no:
                    c.next()
                if c.take("IN"):
                    out = self.member(out, self.in_list(), bool(no), positive)
                elif (word := c.take("LIKE", "ILIKE")) is not None:
                    out = f"({out} {no}{word} {self.concat()})"
                elif c.take("BETWEEN"):
                    low = self.concat()
                    c.need("AND")
                    out = f"({out} {no}BETWEEN {low} AND {self.concat()})"
                else:
                    return out

    def in_list(self) -> str:
        c = self.c
        if c.is_("(") and c.ahead().text.upper() == "LANG":
            view, cols, _ = self.block()
            return f"(SELECT {name(cols[0])} FROM {view})"
        c.need("(")
        if c.is_("SELECT", "WITH", "VALUES"):
            out = self.query()
        else:
            out = self.expr()
            while c.take(","):
                out += f", {self.expr()}"
        c.need(")")
        return f"({out})"

    def member(self, x: str, listed: str, no: bool, positive: bool) -> str:
        """x [NOT] IN a list or query. Spark has a semi join for IN; what it has for the rest is broadcast, or takes NULL for FALSE."""
        plain = f"({x} {'NOT ' * no}IN {listed})"
        if not self.rewrite or not listed.startswith(("(SELECT", "(WITH")) or self.width(x) > 1 or (positive and not no):
            return plain
        q, v = self.fresh(), self.fresh()
        of = f"FROM {listed} AS {q}({v})"
        match, nulls, rows = f"EXISTS (SELECT 1 {of} WHERE {q}.{v} = {x})", f"(SELECT count(1) - count({v}) {of})", f"(SELECT count(1) {of})"
        if positive:
            return f"(NOT {match} AND {nulls} = 0 AND ({x} IS NOT NULL OR {rows} = 0))"
        return f"CASE WHEN {match} THEN {str(not no).upper()} WHEN {rows} > 0 AND ({x} IS NULL OR {nulls} > 0) THEN NULL ELSE {str(no).upper()} END"

    def quantified(self, x: str, op: str, how: str, positive: bool = False) -> str:
        """x op ALL/ANY (query) by the least and greatest of the query's values; NULLs as the standard has them."""
        inner = self.in_list()[1:-1]
        if (op, how) == ("=", "ANY"):
            return self.member(x, f"({inner})", False, positive)
        if (op, how) in (("<>", "ALL"), ("!=", "ALL")):
            return self.member(x, f"({inner})", True, positive)
        q = f"(SELECT named_struct('n', count(1), 'c', count(v), 'lo', min(v), 'hi', max(v)) FROM ({inner}) AS __q(v))"
        if op in (">", ">=", "<", "<="):
            test = f"{x} {op} {q}.{'hi' if (op[0] == '>') == (how == 'ALL') else 'lo'}"
        elif op == "=":
            test = f"({x} = {q}.lo AND {x} = {q}.hi)"
        else:
            test = f"({x} <> {q}.lo OR {x} <> {q}.hi)"
        # equal subqueries run once
        if how == "ALL":
            return f"CASE WHEN {q}.n = 0 THEN TRUE WHEN NOT ({test}) THEN FALSE WHEN {q}.c < {q}.n THEN NULL ELSE {test} END"
        return f"CASE WHEN {q}.n = 0 THEN FALSE WHEN {test} THEN TRUE WHEN {q}.c < {q}.n THEN NULL ELSE {test} END"

    def concat(self) -> str:
        out, c = self.sum(), self.c
        while c.tok.kind == "op" and c.tok.text in ("||", "->", "@>") or c.is_("OPERATOR"):
            if c.take("OPERATOR"):
                c.need("(")
                op = ""
                while not c.is_(")"):
                    op += c.next().text
                c.need(")")
            else:
                op = c.next().text
            right = self.sum()
            if op in self.operators:
                out = self.operators[op](out, right)
            elif op == "||":
                out = f"concat({out}, {right})"
            elif op == "@>":
                out = self.contains(out, right)
            elif op == "->":
                out = self.access(out, right)
            else:
                raise QueryError(f"unknown operator {op}")
        return out

    @staticmethod
    def access(x: str, key: str) -> str:
        text = key[1:-1] if key.startswith("'") else None
        m = re.fullmatch(r"try_variant_get\((.*), '(\$.*)', 'variant'\)", x)
        if m or x.startswith("try_parse_json("):
            base, path = (m[1], m[2]) if m else (x, "$")
            return f"try_variant_get({base}, '{path}{f'.{text}' if text else f'[{key}]'}', 'variant')"
        return f"{x}.{name(text)}" if text else f"get({x}, {key})"

    def contains(self, x: str, y: str) -> str:
        m = re.fullmatch(r"named_struct\((.*)\)", y)
        if m:
            parts = re.findall(r"'(\w+)', ((?:[^,(]|\([^)]*\))+)", m[1])
            return "(" + " AND ".join(f"{x}.{name(k)} = {v.strip()}" for k, v in parts) + ")"
        return f"forall({y}, _y -> exists({x}, _x -> _x <=> _y))"

    def sum(self) -> str:
        out = self.product()
        while self.c.tok.kind == "op" and self.c.tok.text in ("+", "-"):
            op, right = self.c.next().text, self.product()
            text = op == "+" and (out.startswith("'") or right.startswith("'") or out.startswith("concat("))
            out = f"concat({out}, {right})" if text else f"({out} {op} {right})"
        return out

    def product(self) -> str:
        out = self.power()
        while self.c.tok.kind == "op" and self.c.tok.text in ("*", "/", "//", "%"):
            op, right = self.c.next().text, self.power()
            out = {"*": f"({out} * {right})", "/": f"try_divide({out}, {right})", "//": f"floor(try_divide({out}, {right}))", "%": f"try_mod({out}, {right})"}[op]
        return out

    def power(self) -> str:
        out = self.unary()
        while self.c.take("^"):
            out = f"power({out}, {self.unary()})"
        return out

    def unary(self) -> str:
        if (op := self.c.take("-", "+")) is not None:
            return f"({op}{self.unary()})"
        return self.postfix(self.primary())

    def postfix(self, x: str) -> str:
        c = self.c
        while True:
            if c.take("::"):
                x = self.cast(x, self.type_name())
            elif c.take("["):
                if c.take(":"):
                    start, end = "0", None if c.is_("]") else self.expr()
                    x = self.slice(x, start, end)
                else:
                    start = self.expr()
                    if c.take(":"):
                        x = self.slice(x, start, None if c.is_("]") else self.expr())
                    else:
                        x = f"get({x}, cast({start} AS INT))"
                c.need("]")
            elif c.is_(".") and not x.endswith("*"):
                c.next()
                x += f".{name(self.identifier())}"
            else:
                return x

    def cast(self, x: str, to: str) -> str:
        return self.casts[to.lower()](x) if to.lower() in self.casts else cast(x, to)

    @staticmethod
    def slice(x: str, start: str, end: str | None) -> str:
        size = f"greatest(0, {end} - {start})" if end else f"greatest(0, size({x}) - {start})"
        return f"slice({x}, {start} + 1, {size})"

    def type_name(self) -> str:
        out = self.identifier()
        if self.c.is_("("):
            out += f"({self.balanced()})"
        while self.c.is_("[") and self.c.ahead().text == "]":
            self.c.i += 2
            out += "[]"
        return out

    def primary(self) -> str:
        c, t = self.c, self.c.tok
        if t.kind == "string":
            c.next()
            return literal(unquote(t.text))
        if t.kind == "number":
            c.next()
            if re.match(r"0[xXbBoO]", t.text):
                return str(int(t.text, 0))
            return t.text + "D" if re.search(r"[.eE]", t.text) else t.text
        if t.kind == "param":
            c.next()
            if t.text[1:] not in self.params:
                raise QueryError(f"no value for parameter {t.text}")
            return literal(self.params[t.text[1:]])
        if c.is_("(") and c.ahead().text.upper() == "LANG":
            view, cols, _ = self.block()
            return f"(SELECT {name(cols[0])} FROM {view})"
        if c.take("("):
            if c.is_("SELECT", "WITH", "VALUES"):
                out = self.query()
            else:
                out = self.expr()
                if c.is_(","):
                    while c.take(","):
                        out += f", {self.expr()}"
            c.need(")")
            return f"({out})"
        if t.kind == "quoted":
            return name(self.identifier())
        word = t.text.upper()
        if t.kind != "name":
            raise QueryError(f"unexpected {t.text or 'end'!r} at {t.start}")
        if word in ("NULL", "TRUE", "FALSE"):
            c.next()
            return word
        if word == "CASE":
            return self.case()
        if word == "CAST":
            c.next()
            c.need("(")
            x = self.expr()
            c.need("AS")
            to = self.type_name()
            c.need(")")
            return self.cast(x, to)
        if word == "EXISTS" and c.ahead().text == "(":
            c.next()
            if c.ahead().text.upper() == "LANG":
                view, _, _ = self.block()
                return f"EXISTS (SELECT 1 FROM {view})"
            return f"EXISTS {self.in_list()}"
        if word == "ARRAY":
            c.next()
            if c.take("["):
                items = []
                while not c.is_("]"):
                    items.append(self.expr())
                    c.take(",")
                c.need("]")
                return f"array({', '.join(items)})"
            return self.array_query()
        if word == "ROW" and c.ahead().text == "(":
            return self.row()
        if c.ahead().kind == "string" and word in ("DATE", "TIMESTAMP", "NUMBER", "TEXT", "BOOLEAN", "JSON", "INTERVAL"):
            c.next()
            value = unquote(c.next().text)
            return dt.interval(value) if word == "INTERVAL" else cast(literal(value), t.text)
        if word in ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "JOIN", "ON", "AS", "THEN", "WHEN", "ELSE", "END"):
            raise QueryError(f"unexpected {t.text!r} at {t.start}")
        first = self.identifier()
        if first.lower() == "date" and c.is_(".") and c.ahead(2).text == "(":
            c.next()
            return self.call(f"date.{self.identifier().lower()}")
        if c.is_(".") and c.ahead(2).text == "(" and f"{first}.{c.ahead().text}".lower() in self.functions:
            c.next()
            return self.call(f"{first}.{self.identifier()}")
        if c.is_("("):
            return self.call(first)
        return name(first)

    def case(self) -> str:
        c = self.c
        c.need("CASE")
        out = "CASE" + ("" if c.is_("WHEN") else f" {self.expr()}")
        while c.take("WHEN"):
            cond = self.expr()
            c.need("THEN")
            out += f" WHEN {cond} THEN {self.expr()}"
        if c.take("ELSE"):
            out += f" ELSE {self.expr()}"
        c.need("END")
        return out + " END"

    def row(self) -> str:
        c = self.c
        c.next()
        c.need("(")
        parts = []
        while not c.is_(")"):
            start = c.i
            x = self.expr()
            key = self.identifier() if c.take("AS") else self.plain_alias(self.plain_name(c.toks[start : c.i])) or f"col{len(parts)}"
            parts.append(f"{literal(key)}, {x}")
            c.take(",")
        c.need(")")
        return f"named_struct({', '.join(parts)})"

    def array_query(self) -> str:
        if self.c.is_("(") and self.c.ahead().text.upper() == "LANG":
            view, cols, _ = self.block()
            return f"(SELECT transform(collect_list(struct({name(cols[0])} AS v)), _x -> _x.v) FROM {view})"
        inner = self.in_list()[1:-1]
        v = "transform(collect_list(struct(v)), _x -> _x.v)"
        m = re.match(r"SELECT ((?:[^()]|\((?:[^()]|\([^()]*\))*\))*?)(?: AS `[^`]*`)?( FROM (?:(?! ORDER BY | GROUP BY | LIMIT | UNION ).)*)$", inner, re.S)
        if m and "," not in re.sub(r"\([^()]*(?:\([^()]*\)[^()]*)*\)", "", m[1]) and not m[1].startswith("DISTINCT"):
            return f"(SELECT {v.replace('struct(v)', f'struct({m[1]} AS v)')}{m[2]})"
        return f"(SELECT {v} FROM ({inner}) AS __a(v))"

    def call(self, fn: str) -> str:
        c, low = self.c, fn.lower()
        c.need("(")
        distinct = bool(c.take("DISTINCT"))
        if not distinct:
            c.take("ALL")
        args: list[str] = []
        orders: list[str] = []
        if c.take("*"):
            args.append("*")
        while not c.is_(")"):
            if c.all_("ORDER", "BY"):
                orders = self.orders()
            else:
                args.append(self.expr())
                c.take(",")
        c.need(")")
        where = ""
        if c.is_("FILTER") and c.ahead().text == "(":
            c.i += 2
            c.need("WHERE")
            where = f" FILTER (WHERE {self.expr()})"
            c.need(")")
        if low == "collect":
            out = self.collect(args[0], orders, where)
            return f"array_distinct({out})" if distinct else out
        if low in self.functions:
            return self.functions[low](*args)
        out = self.scalar(low, args)
        if out is None:
            out = f"{self.aggregates.get(low, low)}({'DISTINCT ' * distinct}{', '.join(args)}){where}"
        if c.is_("OVER"):
            raise QueryError("window functions are not supported")
        return out

    @staticmethod
    def collect(x: str, orders: list[str], where: str) -> str:
        """All values in the order asked for, NULLs among them."""
        if not orders:
            return f"transform(collect_list(struct({x} AS v)){where}, _x -> _x.v)"
        keys = [o.rsplit(" ", 3) for o in orders]
        listed = f"collect_list(struct({', '.join(f'{k[0]} AS k{i}' for i, k in enumerate(keys))}, {x} AS v)){where}"
        test = "0"
        for i, (_, way, _, nulls) in reversed(list(enumerate(keys))):
            first, less = ("-1", "1") if nulls == "FIRST" else ("1", "-1"), ("-1", "1") if way == "ASC" else ("1", "-1")
            a, b = f"a.k{i}", f"b.k{i}"
            test = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN {test} WHEN {a} IS NULL THEN {first[0]} WHEN {b} IS NULL THEN {first[1]} WHEN {a} < {b} THEN {less[0]} WHEN {a} > {b} THEN {less[1]} ELSE {test} END"
        return f"transform(array_sort({listed}, (a, b) -> {test}), _x -> _x.v)"

    @staticmethod
    def scalar(fn: str, args: list[str]) -> str | None:
        if fn == "now":
            return "current_timestamp()"
        if fn == "substr":
            return f"substring({', '.join(args)})"
        if fn == "slice" and len(args) in (2, 3):
            x, start, end = args[0], args[1], args[2] if len(args) == 3 else f"length({args[0]})"
            at = lambda i: f"(CASE WHEN {i} < 0 THEN greatest(0, length({x}) + {i}) ELSE {i} END)"
            return f"substring({x}, {at(start)} + 1, greatest(0, {at(end)} - {at(start)}))"
        if fn == "interval":
            return dt.interval(args[0][1:-1])
        if fn in ("date.add", "date.sub"):
            return f"({args[0]} {'+' if fn[5:] == 'add' else '-'} {args[1]})"
        if fn == "date.extract":
            return f"extract({args[1][1:-1]} FROM {args[0]})"
        return None
