"""Cypher as Spark SQL over the node and edge frames.

The table between clauses has a column for each variable: nodes and edges are structs, paths are arrays. A pattern
becomes equi-joins of edges with nodes on their ids; Catalyst reads only the fields that are used. Paths of variable
length are grown by a loop of joins whose result is one more view.
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING, Any, NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..operators.recursion import paths
from .lexer import Cursor, QueryError
from .sql import RESERVED, Sql, literal, name

if TYPE_CHECKING:
    from ..engine import Engine

AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "ORDER", "SKIP", "LIMIT", "UNION", "CALL", "FROM", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "CONTAINS", "STARTS", "ENDS", "XOR"} | RESERVED


class Node(NamedTuple):
    var: str | None
    labels: list[str]
    props: dict[str, str]


class Rel(NamedTuple):
    var: str | None
    types: list[str]
    props: dict[str, str]
    way: str  # out, in, any
    least: int | None  # of variable length
    most: int | None


class Joined:
    """A pattern as a FROM clause under construction."""

    def __init__(self) -> None:
        self.tables: list[str] = []
        self.where: list[str] = []
        self.bound: dict[str, str] = {}
        self.rels: list[tuple[str, bool]] = []
        #: Tables of nodes by variable, and a column that is never null in a match.
        self.alias: dict[str, str] = {}
        self.mark: str | None = None


class Cypher(Sql):
    def __init__(self, engine: Engine, text: str, params: dict[str, Any]) -> None:
        super().__init__("", params, engine.block(params), engine.registry.builders("cypher"), engine.registry.operators("cypher"), engine.registry.aggregates("cypher"))
        self.c = Cursor(text, cypher=True)
        self.engine, self.graph = engine, engine.default_graph
        self.vars: list[str] = []
        self.current = ""
        self.aggregated = False
        #: Names that nothing here binds: columns of a query around this one.
        self.free: set[str] = set()
        self.local: set[str] = set()

    # clauses

    def text(self) -> str:
        out = self.single()
        while self.c.take("UNION"):
            every = bool(self.c.take("ALL"))
            self.vars, self.current = [], ""
            right = self.single()
            out = f"({out}) UNION {'ALL ' * every}({right})"
        self.c.take(";")
        if self.c.tok.kind != "end":
            raise QueryError(f"unexpected {self.c.tok.text!r} at {self.c.tok.start}")
        return out

    def single(self) -> str:
        c = self.c
        while True:
            if c.take("FROM"):
                self.graph = self.identifier()
            elif c.all_("OPTIONAL", "MATCH"):
                self.match(True)
            elif c.take("MATCH"):
                self.match(False)
            elif c.take("UNWIND"):
                self.unwind()
            elif c.take("CALL"):
                self.call_procedure()
            elif c.take("WITH"):
                self.current = self.project(False)
            elif c.take("RETURN"):
                return self.project(True)
            elif c.is_("CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH"):
                raise QueryError(f"{c.tok.text.upper()}: queries are read-only")
            else:
                raise QueryError(f"unexpected {c.tok.text or 'end'!r} at {c.tok.start}")

    def source(self) -> str:
        return f"({self.current}) AS p" if self.current else "(SELECT 1 AS __one) AS p"

    def columns_of(self, new: dict[str, str]) -> str:
        kept = [f"p.{name(v)}" for v in self.vars if v not in new]
        return ", ".join([*kept, *(f"{x} AS {name(v)}" for v, x in new.items())]) or "1 AS __one"

    def match(self, optional: bool) -> None:
        patterns = [self.pattern()]
        while self.c.take(","):
            patterns.append(self.pattern())
        before = list(self.vars)
        j = Joined()
        for path_var, nodes, rels in patterns:
            self.join_pattern(j, path_var, nodes, rels)
        for i, (a, many) in enumerate(j.rels):
            for b, other in j.rels[:i]:
                if not many and not other:
                    j.where.append(f"{a}.id <> {b}.id")
                elif many and other:
                    j.where.append(f"NOT arrays_overlap(transform({a}, _x -> _x.id), transform({b}, _x -> _x.id))")
                else:
                    one, all_ = (b, a) if many else (a, b)
                    j.where.append(f"NOT exists({all_}, _x -> _x.id = {one}.id)")
        new = {v: x for v, x in j.bound.items() if v not in before}
        self.vars += list(new)
        condition = None
        if self.c.take("WHERE"):
            condition = self.expr()
        if not optional:
            tables = [self.source(), *j.tables] if self.current or not j.tables else j.tables
            inner = f"SELECT {self.columns_of(new)} FROM {' CROSS JOIN '.join(tables)}{self.where(j.where)}"
            self.current = f"SELECT * FROM ({inner}){self.where([condition] if condition else [])}"
            return
        if j.mark and (on := self.on(condition, before, j)) is not None:
            picked = ", ".join([*(f"p.{name(v)}" for v in before), *(f"CASE WHEN {j.mark} IS NOT NULL THEN {x} END AS {name(v)}" for v, x in new.items())]) or "1 AS __one"
            self.current = f"SELECT {picked} FROM {self.source()} LEFT JOIN ({' CROSS JOIN '.join(j.tables)}) ON {' AND '.join([*j.where, *on]) or 'TRUE'}"
            return
        # the condition belongs to the match: what the outer row gives is reached through p
        fields = ", ".join(f"{x} AS {name(v)}" for v, x in new.items()) or "1 AS __m"
        inner = f"SELECT {fields} FROM {' CROSS JOIN '.join(j.tables) or '(SELECT 1 AS __one)'}{self.where(j.where)}"
        if condition:
            for v in before:
                condition = re.sub(rf"(?<![.\w`]){re.escape(name(v))}", f"p.{name(v)}", condition)
            inner = f"SELECT * FROM ({inner}){self.where([condition])}"
        picked = ", ".join([*(f"p.{name(v)}" for v in before), *(f"m.{name(v)}" for v in new)]) or "1 AS __one"
        self.current = f"SELECT {picked} FROM {self.source()} LEFT JOIN LATERAL ({inner}) AS m"

    def on(self, condition: str | None, before: list[str], j: Joined) -> list[str] | None:
        """The condition of an OPTIONAL MATCH over the joined tables themselves; None if it needs whole nodes or a subquery."""
        if not condition:
            return []
        for v, x in j.bound.items():
            if v in before:
                continue
            if v in j.alias:
                condition = re.sub(rf"(?<![.\w`]){re.escape(name(v))}(?=\.)", j.alias[v], condition)
            elif not x.startswith("named_struct"):
                condition = re.sub(rf"(?<![.\w`]){re.escape(name(v))}", x, condition)
            if re.search(rf"(?<![.\w`]){re.escape(name(v))}", condition):
                return None
        for v in before:
            condition = re.sub(rf"(?<![.\w`]){re.escape(name(v))}", f"p.{name(v)}", condition)
        return None if "SELECT" in condition else [condition]

    @staticmethod
    def where(conditions: list[str]) -> str:
        return f" WHERE {' AND '.join(conditions)}" if conditions else ""

    def unwind(self) -> None:
        if self.c.is_("(") and self.c.ahead().text.upper() == "LANG" or self.c.is_("LANG"):
            view, cols, _ = self.block()
            self.c.need("AS")
            v = self.identifier()
            value = name(cols[0]) if len(cols) == 1 else "struct(*)"
            self.current = f"SELECT {self.columns_of({v: 'u.v'})} FROM {self.source()} CROSS JOIN (SELECT {value} AS v FROM {view}) AS u"
        else:
            x = self.outer(self.expr())
            self.c.need("AS")
            v = self.identifier()
            self.current = f"SELECT {self.columns_of({v: 'u.v'})} FROM {self.source()}, LATERAL (SELECT col AS v FROM explode({x})) AS u"
        self.vars = [x for x in self.vars if x != v] + [v]

    def outer(self, x: str) -> str:
        for v in self.vars:
            x = re.sub(rf"(?<![.\w`]){re.escape(name(v))}", f"p.{name(v)}", x)
        return x

    def call_procedure(self) -> None:
        fn = self.identifier()
        while self.c.take("."):
            fn += "_" + self.identifier()
        self.c.need("(")
        args = []
        while not self.c.is_(")"):
            args.append(self.outer(self.expr()))
            self.c.take(",")
        self.c.need(")")
        new = {}
        if self.c.take("YIELD"):
            while True:
                col = self.identifier()
                alias = self.identifier() if self.c.take("AS") else col
                new[alias] = f"u.{name(col)}"
                if not self.c.take(","):
                    break
        self.current = f"SELECT {self.columns_of(new)} FROM {self.source()}, LATERAL {fn}({', '.join(args)}) AS u"
        self.vars += list(new)

    def project(self, last: bool) -> str:
        c = self.c
        distinct = bool(c.take("DISTINCT"))
        items: list[tuple[str, str, bool]] = []
        if c.take("*"):
            items = [(name(v), v, False) for v in self.vars]
            c.take(",")
        while not (c.tok.kind == "end" or c.is_("ORDER", "SKIP", "LIMIT", "WHERE", "UNION", ";", ")", "}") or (c.is_("MATCH", "OPTIONAL", "WITH", "RETURN", "UNWIND"))):
            start, self.aggregated = c.i, False
            x = self.expr()
            alias = self.identifier() if c.take("AS") else self.plain_name(c.toks[start : c.i])
            items.append((x, alias, self.aggregated))
            if not c.take(","):
                break
        grouped = any(a for _, _, a in items)
        listed = ", ".join(f"{x} AS {name(a)}" for x, a, _ in items)
        out = f"SELECT {'DISTINCT ' * distinct}{listed} FROM ({self.current or 'SELECT 1 AS __one'})"
        keys = [x for x, _, a in items if not a]
        if grouped and keys:
            out += f" GROUP BY {', '.join(keys)}"
        self.vars = [a for _, a, _ in items]
        drop = ""
        if c.all_("ORDER", "BY"):
            texts = {x: name(a) for x, a, _ in items}
            orders = []
            while True:
                x = self.expr()
                way = "DESC" if c.take("DESC", "DESCENDING") else "ASC" if c.take("ASC", "ASCENDING") or True else ""
                orders.append((texts.get(x, x), way))
                if not c.take(","):
                    break
            hidden = [x for x, _ in orders if x not in texts.values() and not grouped and not distinct]
            if hidden:
                extra = ", ".join(f"{x} AS __o{i}" for i, (x, _) in enumerate(orders))
                # limited before the columns are dropped, else a correlated block would not limit in this order
                drop = f"SELECT {', '.join(name(v) for v in self.vars)} FROM ("
                out = f"SELECT {listed}, {extra} FROM ({self.current})"
                out += " ORDER BY " + ", ".join(f"__o{i} {w} NULLS LAST" for i, (_, w) in enumerate(orders))
            else:
                out = f"SELECT * FROM ({out}) ORDER BY " + ", ".join(f"{x} {w} NULLS LAST" for x, w in orders)
        skip = self.expr() if c.take("SKIP") else None
        limit = self.expr() if c.take("LIMIT") else None
        out += (f" LIMIT {limit}" if limit else "") + (f" OFFSET {skip}" if skip else "")
        out = f"{drop}{out})" if drop else out
        if not last and c.take("WHERE"):
            out = f"SELECT * FROM ({out}) WHERE {self.expr()}"
        return out

    # patterns

    def pattern(self) -> tuple[str | None, list[Node], list[Rel]]:
        var = None
        if self.c.tok.kind in ("name", "quoted") and self.c.ahead().text == "=":
            var = self.identifier()
            self.c.next()
        nodes, rels = [self.node()], []
        while self.c.tok.text in ("-", "<-", "->"):
            rels.append(self.rel())
            nodes.append(self.node())
        return var, nodes, rels

    def node(self) -> Node:
        c = self.c
        c.need("(")
        var = self.identifier() if c.tok.kind in ("name", "quoted") else None
        if var:
            self.local.add(var)
        labels = []
        while c.take(":"):
            labels.append(self.identifier())
        props = self.props()
        c.need(")")
        return Node(var, labels, props)

    def props(self) -> dict[str, str]:
        c, out = self.c, {}
        if c.tok.kind == "param":
            return {k: literal(v) for k, v in self.params[c.next().text[1:]].items()}
        if c.take("{"):
            while not c.is_("}"):
                key = self.identifier()
                c.need(":")
                out[key] = self.expr()
                c.take(",")
            c.need("}")
        return out

    def rel(self) -> Rel:
        c = self.c
        left = c.next().text  # - or <-
        var, types, props, least, most = None, [], {}, None, None
        if c.take("["):
            var = self.identifier() if c.tok.kind in ("name", "quoted") else None
            if var:
                self.local.add(var)
            if c.take(":"):
                types.append(self.identifier())
                while c.take("|"):
                    c.take(":")
                    types.append(self.identifier())
            if c.take("*"):
                least, most = 1, None
                if c.tok.kind == "number":
                    least = most = int(c.next().text)
                if c.take(".."):
                    most = int(c.next().text) if c.tok.kind == "number" else None
            props = self.props()
            c.need("]")
        right = c.need("-", "->")
        way = "in" if left == "<-" and right == "-" else "out" if left == "-" and right == "->" else "any"
        return Rel(var, types, props, way, least, most)

    def node_conditions(self, x: str, n: Node) -> list[str]:
        return [*(f"array_contains({x}.labels, {literal(v)})" for v in n.labels), *(f"{x}.{name(k)} = {v}" for k, v in n.props.items())]

    def edges(self, r: Rel) -> str:
        """Edges with their ends in the direction of travel: _from, _to, and themselves as e."""
        kind = f" WHERE type IN ({', '.join(map(literal, r.types))})" if r.types else ""
        of = f"`{self.graph}__edges`"
        out = f"SELECT src AS _from, dst AS _to, struct(*) AS e FROM {of}{kind}"
        back = f"SELECT dst AS _from, src AS _to, struct(*) AS e FROM {of}{kind}"
        return out if r.way == "out" else back if r.way == "in" else f"{out} UNION ALL {back}{' AND' if kind else ' WHERE'} src <> dst"

    def join_pattern(self, j: Joined, path_var: str | None, nodes: list[Node], rels: list[Rel]) -> None:
        if not self.graph:
            raise QueryError("no graph is registered")
        ids: list[str] = []
        path: list[str] = []
        for i, n in enumerate(nodes):
            if n.var and (n.var in j.bound or n.var in self.vars):
                x = j.bound.get(n.var, f"p.{name(n.var)}")
                at = x
            else:
                t = self.fresh()
                j.tables.append(f"`{self.graph}__nodes` AS {t}")
                at, x = t, f"struct({t}.*)"
                j.mark = f"{t}.id"
                if n.var:
                    j.bound[n.var], j.alias[n.var] = x, t
            j.where += self.node_conditions(at, n)
            if i:
                r = rels[i - 1]
                if r.least is None:
                    e = self.fresh()
                    if r.var and (r.var in j.bound or r.var in self.vars):
                        known = j.bound.get(r.var, f"p.{name(r.var)}")
                        j.tables.append(f"({self.edges(r)}) AS {e}")
                        j.where.append(f"{e}.e.id = {known}.id")
                    else:
                        j.tables.append(f"({self.edges(r)}) AS {e}")
                        j.rels.append((f"{e}.e", False))
                        if r.var:
                            j.bound[r.var] = f"{e}.e"
                    j.where += [f"{e}._from = {ids[-1]}", f"{e}._to = {at}.id"] + [f"{e}.e.{name(k)} = {v}" for k, v in r.props.items()]
                    path.append(f"{e}.e")
                    j.mark = f"{e}._from"
                else:
                    v = self.path_view(r, nodes[i - 1], n, bool(r.var or path_var))
                    e = self.fresh()
                    j.tables.append(f"{v} AS {e}")
                    j.where += [f"{e}._start = {ids[-1]}", f"{e}._end = {at}.id"]
                    j.rels.append((f"{e}._edges", True))
                    if r.var:
                        j.bound[r.var] = f"{e}._edges"
                    path.append(f"{e}._edges")
                    j.mark = f"{e}._start"
            ids.append(f"{at}.id")
            path.append(x)
        if path_var:
            # nodes and edges have other fields: a path is a struct of both lists
            single = [f"array({x})" if not x.endswith("._edges") else x for x in path[1::2]]
            j.bound[path_var] = f"named_struct('nodes', array({', '.join(path[0::2])}), 'edges', {f'concat({chr(44).join(single)})' if single else 'array()'})"

    def ids_of(self, n: Node, needs: bool) -> DataFrame | None:
        """The ids of what a node pattern can be before anything is joined; None where they are needed and nothing tells."""
        nodes = f"SELECT n.id FROM `{self.graph}__nodes` AS n"
        try:
            if n.var not in self.vars:
                return self.engine.spark.sql(nodes + self.where(self.node_conditions("n", n)))
        except AnalysisException:  # properties of other variables
            pass
        return None if needs else self.engine.spark.sql(nodes)

    def path_view(self, r: Rel, start: Node, end: Node, whole: bool) -> str:
        e = self.engine.spark.sql(f"SELECT _from, _to, e.* FROM ({self.edges(r)})")
        for k, v in r.props.items():
            e = e.where(F.expr(f"{name(k)} = {v}"))
        if "src" not in e.columns:
            raise QueryError("edges need src and dst")
        if not whole:  # nothing asks for the edges of the path
            e = e.select("_from", "_to", "id")
        # an end that properties single out is worth searching from
        ends = self.ids_of(end, True) if end.props and r.most is not None else None
        return self.engine.view(paths(e, self.ids_of(start, False), r.least, r.most, ends), "paths")

    def pattern_query(self) -> tuple[str, Joined]:
        """A pattern inside an expression, with the outer variables bound: a FROM and WHERE."""
        path_var, nodes, rels = self.pattern()
        j = Joined()
        saved = self.vars
        for n in nodes:
            if n.var in saved:
                j.bound[n.var] = name(n.var)
        self.join_pattern(j, path_var, nodes, rels)
        return f"FROM {' CROSS JOIN '.join(j.tables) or '(SELECT 1)'}{self.where(j.where)}", j

    # expressions

    def expr(self) -> str:
        out = self.xor()
        while self.c.take("OR"):
            out = f"({out} OR {self.xor()})"
        return out

    def xor(self) -> str:
        out = self.conjunction()
        while self.c.take("XOR"):
            out = f"({out} <> {self.conjunction()})"
        return out

    def comparison(self) -> str:
        out, c = self.sum(), self.c
        chain: list[str] = []
        while True:
            if c.tok.kind == "op" and c.tok.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                op, right = c.next().text, self.sum()
                chain.append(f"({out} {op} {right})")
                out = right
            elif c.all_("STARTS", "WITH"):
                out = f"startswith({out}, {self.sum()})"
            elif c.all_("ENDS", "WITH"):
                out = f"endswith({out}, {self.sum()})"
            elif c.take("CONTAINS"):
                out = f"contains({out}, {self.sum()})"
            elif c.take("IN"):
                out = f"array_contains({self.sum()}, {out})"
            elif c.take("IS"):
                out = f"({out} IS {'NOT ' if c.take('NOT') else ''}{c.need('NULL')})"
            elif c.is_(":") and c.ahead().kind == "name" and out.startswith("`"):
                c.next()
                out = f"array_contains({out}.labels, {literal(self.identifier())})"
            else:
                break
        return out if not chain else chain[0] if len(chain) == 1 else f"({' AND '.join(chain)})"

    def slice(self, x: str, start: str, end: str | None) -> str:
        return Sql.slice(x, start, end)

    def postfix(self, x: str) -> str:
        c = self.c
        while True:
            if c.take("["):
                start = "0" if c.is_("..") else self.expr()
                if c.take(".."):
                    x = self.slice(x, start, None if c.is_("]") else self.expr())
                else:
                    x = f"get({x}, cast(CASE WHEN {start} < 0 THEN size({x}) + {start} ELSE {start} END AS INT))"
                c.need("]")
            elif c.is_(".") and c.ahead().kind in ("name", "quoted"):
                c.next()
                x += f".{name(self.identifier())}"
            else:
                return x

    def is_pattern(self) -> bool:
        """Whether a parenthesis opens a node pattern that a relationship follows."""
        toks, i, depth = self.c.toks, self.c.i, 0
        while i < len(toks) and toks[i].kind != "end":
            depth += (toks[i].text in ("(", "{")) - (toks[i].text in (")", "}"))
            i += 1
            if depth == 0:
                break
        inside = toks[self.c.i + 1 : i - 1]
        shape = not inside or inside[0].text in (":", "{") or (inside[0].kind in ("name", "quoted") and (len(inside) == 1 or inside[1].text in (":", "{")))
        after = [t.text for t in toks[i : i + 2]]
        return shape and (after[:1] == ["<-"] or after[:2] in (["-", "["], ["-", "->"], ["-", "-"]))

    def primary(self) -> str:
        c, word = self.c, self.c.tok.text.upper()
        if c.is_("(") and c.ahead().text.upper() != "LANG":
            if self.is_pattern():
                text, _ = self.pattern_query()
                return f"EXISTS (SELECT 1 {text})"
        if c.tok.kind == "param":
            return super().primary()
        if c.take("["):
            return self.list_()
        if c.is_("{"):
            parts = [f"{literal(k)}, {v}" for k, v in self.props().items()]
            return f"named_struct({', '.join(parts)})"
        if word in ("ALL", "ANY", "NONE", "SINGLE") and c.ahead().text == "(" and c.ahead(3).text.upper() == "IN":
            c.i += 2
            v = self.identifier()
            self.local.add(v)
            c.next()
            x = self.expr()
            c.need("WHERE")
            test = f"{name(v)} -> {self.expr()}"
            c.need(")")
            return {"ALL": f"forall({x}, {test})", "ANY": f"exists({x}, {test})", "NONE": f"(NOT exists({x}, {test}))", "SINGLE": f"(size(filter({x}, {test})) = 1)"}[word]
        if word == "EXISTS" and c.ahead().text == "{":
            c.i += 2
            if c.is_("LANG"):
                view, _, _ = self.block()
                c.need("}")
                return f"EXISTS (SELECT 1 FROM {view})"
            c.take("MATCH")
            text, j = self.pattern_query()
            if c.take("WHERE"):
                saved, self.vars = self.vars, [*self.vars, *j.bound]
                condition = self.expr()
                self.vars = saved
                for v, x in j.bound.items():
                    if x != name(v):
                        condition = re.sub(rf"(?<![.\w`]){re.escape(name(v))}", x.replace("\\", r"\\"), condition)
                text += (" AND " if " WHERE " in text else " WHERE ") + condition
            c.need("}")
            return f"EXISTS (SELECT 1 {text})"
        if word == "CASE":
            return self.case()
        if c.tok.kind in ("name", "quoted") and c.ahead().text == "{" and c.tok.text.strip('"`') in {*self.vars, *self.local}:
            return self.map_projection()
        if c.tok.kind in ("name", "quoted") and c.ahead().text != "(" and word not in ("NULL", "TRUE", "FALSE"):
            known = c.tok.text.strip('"`')
            if known not in self.vars and known not in self.local:
                self.free.add(known)
        return super().primary()

    def map_projection(self) -> str:
        """n {.name, other: expr, variable}"""
        c = self.c
        of, parts = name(self.identifier()), []
        c.need("{")
        while not c.is_("}"):
            if c.take("."):
                key = self.identifier()
                parts.append(f"{literal(key)}, {of}.{name(key)}")
            else:
                key = self.identifier()
                parts.append(f"{literal(key)}, {self.expr() if c.take(':') else name(key)}")
            c.take(",")
        c.need("}")
        return f"named_struct({', '.join(parts)})"

    def list_(self) -> str:
        c = self.c
        if c.tok.kind in ("name", "quoted") and c.ahead().text.upper() == "IN":
            v = self.identifier()
            self.local.add(v)
            c.next()
            x = self.expr()
            if c.take("WHERE"):
                x = f"filter({x}, {name(v)} -> {self.expr()})"
            if c.take("|"):
                x = f"transform({x}, {name(v)} -> {self.expr()})"
            c.need("]")
            return x
        if c.is_("(") and self.is_pattern():
            text, j = self.pattern_query()
            extra = f"{' AND' if ' WHERE ' in text else ' WHERE'} {self.bound_expr(j)}" if c.take("WHERE") else ""
            c.need("|")
            value = self.bound_expr(j)
            c.need("]")
            return f"(SELECT collect_list({value}) {text}{extra})"
        items = []
        while not c.is_("]"):
            items.append(self.expr())
            c.take(",")
        c.need("]")
        return f"array({', '.join(items)})"

    def bound_expr(self, j: Joined) -> str:
        """An expression over a pattern's own variables."""
        x = self.expr()
        for v, real in j.bound.items():
            if real != name(v):
                x = re.sub(rf"(?<![.\w`]){re.escape(name(v))}", lambda _, real=real: real, x)
        return x

    def sum(self) -> str:
        out = self.product()
        while self.c.tok.kind == "op" and self.c.tok.text in ("+", "-") and not (self.c.tok.text == "-" and self.c.ahead().text in ("[", "->")):
            op, right = self.c.next().text, self.product()
            joins = op == "+" and any(x.startswith(("'", "concat(", "array(", "transform(", "filter(")) or self.is_list(x) for x in (out, right))
            out = f"concat({out}, {right})" if joins else f"({out} {op} {right})"
        return out

    def is_list(self, x: str) -> bool:
        """Whether a column of the rows so far is a list."""
        if not x.startswith("`"):
            return False
        try:
            return isinstance(self.engine.spark.sql(f"SELECT {x} AS v FROM ({self.current or 'SELECT 1'})").schema[0].dataType, ArrayType)
        except AnalysisException:
            return False

    def call(self, fn: str) -> str:
        low = fn.lower()
        if low in AGGREGATES or low in self.aggregates:
            out = super().call(fn)
            self.aggregated = True
            return out
        if low in ("startnode", "endnode", "labels", "type", "id", "size", "length", "nodes", "relationships", "string", "number", "boolean", "date", "json"):
            self.c.need("(")
            x = self.expr()
            self.c.need(")")
            from .sql import cast

            end = "src" if low == "startnode" else "dst"
            return {
                "startnode": f"(SELECT first(struct(_n.*)) FROM `{self.graph}__nodes` AS _n WHERE _n.id = {x}.{end})",
                "endnode": f"(SELECT first(struct(_n.*)) FROM `{self.graph}__nodes` AS _n WHERE _n.id = {x}.{end})",
                "labels": f"{x}.labels",
                "type": f"{x}.type",
                "id": f"{x}.id",
                "length": f"size({x}.edges)",
                "nodes": f"{x}.nodes",
                "relationships": f"{x}.edges",
                "size": f"size({x})",
            }.get(low) or cast(x, low)
        return super().call(fn)
