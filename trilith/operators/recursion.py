"""Fixpoints: recursion that drops repeated rows, and paths of edges."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see; in local mode one is made where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trilith-")
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not (df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()):
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rounds after which what a fixpoint found becomes one table again.
COMPACT = 8


def fixpoint(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of first, and of step over the rows that were new the time before, each once."""
    new = checkpointed(first.distinct())
    found, rounds = new, 0
    while not new.isEmpty():
        # EXCEPT compares NULLs as equal and plans as an anti join
        new = checkpointed(step(new).toDF(*found.columns).subtract(found))
        found, rounds = found.union(new), rounds + 1
        if rounds % COMPACT == 0:
            found = checkpointed(found)
    return found


def paths(edges: DataFrame, starts: DataFrame, least: int, most: int | None, ends: DataFrame | None = None) -> DataFrame:
    """edges(_from, _to, id, ...), starts(id) -> _start, _end, _edges (array of edge structs): no edge twice in a path.

    All paths of least to most edges, a path of none for least 0. Levels are checkpointed; without `most` it ends when
    no path can grow. With ends(id) only paths to these: then paths grow from both sides, half the length each, and
    meet in the middle, so that few of those that lead nowhere are made.
    """
    edge = F.struct(*(F.col(c) for c in edges.columns))
    e = edges.select(F.col("_from").alias("_at"), F.col("_to").alias("_next"), F.col("id").alias("_id"), edge.alias("_edge"))
    kind = f"array<{e.schema['_edge'].dataType.simpleString()}>"
    none = lambda ids: ids.select(F.col("id").alias("_start"), F.col("id").alias("_end"), F.expr(f"cast(array() AS {kind})").alias("_edges"))
    fresh = ~F.exists("_edges", lambda x: x["id"] == F.col("_id"))

    def longer(level: DataFrame, forward: bool) -> DataFrame:
        if forward:
            grown = level.join(e, level["_end"] == e["_at"]).where(fresh)
            return checkpointed(grown.select("_start", F.col("_next").alias("_end"), F.concat("_edges", F.array("_edge")).alias("_edges")))
        grown = level.join(e, level["_start"] == e["_next"]).where(fresh)
        return checkpointed(grown.select(F.col("_at").alias("_start"), "_end", F.concat(F.array("_edge"), "_edges").alias("_edges")))

    if ends is not None and most is not None:
        heads, tails = [none(starts)], [none(ends)]
        for n in range(1, most + 1):
            side, forward = (heads, True) if n % 2 else (tails, False)
            side.append(longer(side[-1], forward))
        out = heads[0].limit(0)
        for n in range(least, most + 1):
            a, b = heads[n - n // 2].alias("a"), tails[n // 2].alias("b")
            apart = ~F.arrays_overlap(F.transform("a._edges", lambda x: x["id"]), F.transform("b._edges", lambda x: x["id"]))
            out = out.union(a.join(b, F.col("a._end") == F.col("b._start")).where(apart).select("a._start", "b._end", F.concat("a._edges", "b._edges").alias("_edges")))
        return out
    level = none(starts)
    out, depth = level if least == 0 else level.limit(0), 0
    while most is None or depth < most:
        depth += 1
        level = longer(level, True)
        if level.isEmpty():
            break
        if depth >= least:
            out = out.union(level)
    return out
