"""User functions, aggregates, table functions, casts and operators, by language, schema and name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

GLOBAL = "*"


class Registry:
    """What a language sees: its own names before global ones, an exact name before one in lower case."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._found: dict[tuple[str, str], dict[str, Any]] = {}

    def _put(self, kind: str, lang: str, name: str, value: Any) -> None:
        self._found.setdefault((kind, lang), {})[name] = value

    def _of(self, kind: str, lang: str) -> dict[str, Any]:
        return {**self._found.get((kind, GLOBAL), {}), **self._found.get((kind, lang), {})}

    def builder(self, name: str, build: Callable[..., str], lang: str = GLOBAL, schema: str | None = None) -> None:
        """A function as Spark SQL text of its arguments' texts: stays in generated code."""
        self._put("builder", lang, f"{schema}.{name}".lower() if schema else name.lower(), build)

    def function(self, name: str, udf: Any, lang: str = GLOBAL) -> None:
        """A Python or pandas UDF, for what expressions can't say."""
        self.spark.udf.register(f"trilith_{name}", udf)
        self._put("builder", lang, name.lower(), lambda *a: f"trilith_{name}({', '.join(a)})")

    def aggregate(self, name: str, udaf: Any, lang: str = GLOBAL) -> None:
        """A grouped-aggregate pandas UDF."""
        self.spark.udf.register(f"trilith_{name}", udaf)
        self._put("aggregate", lang, name.lower(), f"trilith_{name}")

    def fold(self, name: str, init: str, step: Callable[..., str], result: Callable[[str], str] = lambda acc: acc, lang: str = GLOBAL) -> None:
        """An aggregate of any number of arguments by a first state, a step and a result, as Spark SQL text: no Python runs on rows."""

        def build(*args: str) -> str:
            rows = f"collect_list(struct({', '.join(f'{a} AS a{i}' for i, a in enumerate(args))}))"
            return f"aggregate({rows}, {init}, (_s, _r) -> {step('_s', *(f'_r.a{i}' for i in range(len(args))))}, _s -> {result('_s')})"

        self._put("builder", lang, name.lower(), build)
        self._put("fold", lang, name.lower(), build)

    def cast(self, name: str, build: Callable[[str], str], lang: str = GLOBAL) -> None:
        """A type for CAST and :: as Spark SQL text."""
        self._put("cast", lang, name.lower(), build)

    def bundle(self, parts: dict[str, dict[str, Any]], lang: str = GLOBAL) -> None:
        """Several registrations at once: the method's name, then names and what they stand for."""
        for kind, named in parts.items():
            for name, value in named.items():
                args = value if isinstance(value, tuple) else (value,)
                getattr(self, kind)(name, *args, **({} if kind == "table_function" else {"lang": lang}))

    def table_function(self, name: str, udtf: Any) -> None:
        self.spark.udtf.register(name, udtf)

    def operator(self, symbol: str, build: Callable[[str, str], str], lang: str = GLOBAL) -> None:
        self._put("operator", lang, symbol, build)

    def builders(self, lang: str) -> dict[str, Callable[..., str]]:
        return self._of("builder", lang)

    def aggregates(self, lang: str) -> dict[str, str]:
        return self._of("aggregate", lang)

    def casts(self, lang: str) -> dict[str, Callable[[str], str]]:
        return self._of("cast", lang)

    def folds(self, lang: str) -> dict[str, Callable[..., str]]:
        return self._of("fold", lang)

    def operators(self, lang: str) -> dict[str, Callable[[str, str], str]]:
        return self._of("operator", lang)
