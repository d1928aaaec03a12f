"""The engine: sources by name, and queries in any of the languages."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession

from .functions.registry import Registry
from .operators.recursion import checkpointed, fixpoint, shared_folder
from .plans.cypher import Cypher
from .plans.lexer import QueryError, tokens
from .plans.sql import Sql
from .plans.xquery import XQuery
from .sources.graph import Graph
from .sources.xml import node_table


class Engine:
    """Tables, graphs and XML documents under names, and queries over them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.registry = spark, Registry(spark)
        self.graphs: dict[str, Graph] = {}
        self.documents: dict[str, DataFrame] = {}
        self.default_graph: str | None = None
        self.rules: list[Callable[[DataFrame], DataFrame]] = []
        self.languages: dict[str, Callable[[Engine, str, dict[str, Any]], DataFrame]] = {}
        # recursion goes as deep as the data, not as Spark's defaults
        spark.conf.set("spark.sql.cteRecursionLevelLimit", "-1")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")

    def register_table(self, name: str | tuple[str, ...], df: DataFrame) -> None:
        df.createOrReplaceTempView(name if isinstance(name, str) else "__".join(name))

    def register_tables(self, folder: str, names: list[str]) -> Engine:
        for n in names:
            self.register_table(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def register_graph(self, name: str, nodes: DataFrame, edges: DataFrame) -> None:
        """nodes(id, labels array<string>, ...), edges(id, src, dst, type, ...); the first graph is the default one."""
        self.graphs[name] = Graph(name, nodes, edges)
        self.register_table((name, "nodes"), nodes)
        self.register_table((name, "edges"), edges)
        self.default_graph = self.default_graph or name

    def register_objects(self, name: str, objects: list[Any], schema: str, row: Callable[[Any], tuple] | None = None) -> None:
        """Python objects as a table: row tells an object's columns, where it isn't a dictionary or a tuple itself."""
        self.register_table(name, self.spark.createDataFrame([row(x) for x in objects] if row else objects, schema))

    def create_index(self, table: str, *keys: str) -> None:
        """A copy of a table in the order of its keys takes its place: a condition on them reads only the files and row groups that hold such keys."""
        path = f"{shared_folder(self.spark)}/index-{uuid.uuid4().hex}"
        self.spark.table(f"`{table}`").repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(path)
        self.register_table(table, self.spark.read.parquet(path))

    def register_language(self, name: str, compile: Callable[[Engine, str, dict[str, Any]], DataFrame]) -> None:
        """A further language for query() and LANG blocks."""
        self.languages[name.lower()] = compile

    def register_rule(self, rule: Callable[[DataFrame], DataFrame]) -> None:
        """What is done to every result before it is returned, in the order of registration: hints, another partitioning, a rewritten plan."""
        self.rules.append(rule)

    def register_xml(self, name: str, documents: DataFrame) -> None:
        """documents(doc, xml); $name stands for all of them in XQuery. They are parsed once, into a table in the shared folder."""
        nodes = checkpointed(node_table(documents))
        self.documents[name] = nodes
        self.register_table((name, "xml"), nodes)

    def query(self, text: str, lang: str = "sql", params: dict[str, Any] | None = None) -> DataFrame:
        """The result of the last of the statements."""
        out = self.evaluate(text, lang, params)
        for rule in self.rules:
            out = rule(out)
        return out

    def evaluate(self, text: str, lang: str, params: dict[str, Any] | None) -> DataFrame:
        m = re.match(r"\s*LANG\s+(\w+)\b", text, re.I)
        if m:
            lang, text = m[1].lower(), re.sub(r"\s*LANG\s+EXIT\s*;?\s*$", "", text[m.end() :], flags=re.I)
        lang = lang.lower()
        if lang == "sql":
            for part in self.statements(text):
                out = self.sql(part, params or {})
            return out
        if lang == "cypher":
            return self.spark.sql(Cypher(self, text, params or {}).text())
        if lang == "xquery":
            return XQuery(self, text, params or {}).run()
        if lang in self.languages:
            return self.languages[lang](self, text, params or {})
        raise QueryError(f"unknown language {lang}")

    def explain(self, text: str, lang: str = "sql", params: dict[str, Any] | None = None, mode: str = "formatted") -> None:
        self.query(text, lang, params).explain(mode)

    def rows(self, text: str, lang: str = "sql", params: dict[str, Any] | None = None, serialise: Callable[[Row], Any] = lambda r: r.asDict(recursive=True)) -> Iterator[Any]:
        """Rows as they come, as dictionaries or what serialise makes of them; the driver holds one partition at a time."""
        return map(serialise, self.query(text, lang, params).toLocalIterator())

    @staticmethod
    def statements(text: str) -> list[str]:
        cuts = [t.start for t in tokens(text) if t.kind == "op" and t.text == ";"]
        parts = [text[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]
        return [p for p in parts if p.strip()] or [text]

    def view(self, df: DataFrame, prefix: str = "v") -> str:
        name = f"{prefix}_{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        return name

    def block(self, params: dict[str, Any]) -> Callable[[str, str], tuple[str, list[str], bool]]:
        """What a LANG block stands for: a relation, its columns, and whether it reads the outer query's columns.

        Cypher is spliced in as text, so what its patterns don't bind are columns of the query around it.
        """

        def resolve(language: str, text: str) -> tuple[str, list[str], bool]:
            if language == "cypher":
                inner = Cypher(self, text, params)
                out = inner.text()
                return f"({out})", inner.vars, bool(inner.free)
            df = self.evaluate(text, language, params)
            return self.view(df, f"lang_{language}"), df.columns, False

        return resolve

    def sql_text(self, text: str, params: dict[str, Any] | None = None, rewrite: bool = True) -> tuple[str, Sql]:
        """A statement as Spark SQL."""
        parser = Sql(text, params, self.block(params or {}), self.registry.builders("sql"), self.registry.operators("sql"), self.registry.aggregates("sql"))
        parser.rewrite, parser.casts = rewrite, self.registry.casts("sql")
        return parser.statement(), parser

    def sql(self, text: str, params: dict[str, Any], rewrite: bool = True) -> DataFrame:
        out, parser = self.sql_text(text, params, rewrite)
        for view, cols, first, step in parser.loops:
            start = self.spark.sql(first)
            start = start.toDF(*cols) if cols else start

            def again(new: DataFrame, view: str = view, step: str | None = step) -> DataFrame:
                new.createOrReplaceTempView(view)
                return self.spark.sql(step)

            (fixpoint(start, again) if step else checkpointed(start)).createOrReplaceTempView(view)
        try:
            return self.spark.sql(out)
        except AnalysisException:
            if not rewrite:
                raise
        # what NOT IN became can't be planned everywhere
        return self.sql(text, params, False)
