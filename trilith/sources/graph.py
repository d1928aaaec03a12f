"""Property graphs as two frames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Graph:
    """nodes(id, labels, ...), edges(id, src, dst, type, ...)."""

    name: str
    nodes: DataFrame
    edges: DataFrame


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A serialised graph: {nodes: [{key, attributes}], edges: [{key, source, target, attributes}]}."""
    whole = spark.read.option("multiLine", True).json(path)
    n = whole.select(F.explode("nodes").alias("n")).select(F.col("n.key").alias("id"), "n.attributes.*")
    e = whole.select(F.explode("edges").alias("e")).select(F.col("e.key").alias("id"), F.col("e.source").alias("src"), F.col("e.target").alias("dst"), "e.attributes.*")
    return n, e


def as_json(graph: Graph) -> DataFrame:
    """A graph as read_json reads it, NULL attributes left out: a row for each node and edge, part telling which list it belongs to."""

    def part(df: DataFrame, which: str, *fixed: tuple[str, str]) -> DataFrame:
        rest = F.struct(*(F.col(c) for c in df.columns if c not in [b for _, b in fixed]))
        return df.select(F.lit(which).alias("part"), F.to_json(F.struct(*(F.col(b).alias(a) for a, b in fixed), rest.alias("attributes"))).alias("json"))

    return part(graph.nodes, "nodes", ("key", "id")).union(part(graph.edges, "edges", ("key", "id"), ("source", "src"), ("target", "dst")))


def write_json(graph: Graph, path: str) -> None:
    """The whole graph as one JSON document, written by one task: for graphs that are to be exchanged, not for large ones."""
    rows = as_json(graph).groupBy().agg(*(F.array_join(F.collect_list(F.when(F.col("part") == p, F.col("json"))), ",").alias(p) for p in ("nodes", "edges")))
    rows.select(F.concat(F.lit('{"nodes":['), "nodes", F.lit('],"edges":['), "edges", F.lit("]}")).alias("value")).coalesce(1).write.text(path)


def edges_of_csv(spark: SparkSession, path: str, kind: str | None = None, sep: str = "|") -> DataFrame:
    """A CSV whose first two columns are the ends; further ones are properties. Without a kind the file's name is the type."""
    df = spark.read.csv(path, sep=sep, header=True)
    a, b, *rest = df.columns
    file = F.regexp_extract("_metadata.file_name", r"^([^.]*)", 1)
    return df.select(F.sha2(F.concat_ws("|", *df.columns), 256).alias("id"), F.col(a).alias("src"), F.col(b).alias("dst"), (F.lit(kind) if kind else file).alias("type"), *rest)
