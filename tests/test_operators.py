"""Operators on frames, sources, and the driver's contract."""

import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from trilith.operators.frames import collect, dependent_join, distinct_on, with_index
from trilith.operators.recursion import fixpoint, paths
from trilith.sources import files, graph

ROOT = Path(__file__).resolve().parent.parent


def test_frames(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, 5), ("b", 3, 7)], "k string, n int, v int")
    assert sorted(map(tuple, distinct_on(df, ["k"], [F.asc("n")]).collect())) == [("a", 1, 5), ("b", 3, 7)]
    assert df.groupBy("k").agg(collect(F.col("v"), F.col("n")).alias("v")).orderBy("k").collect()[0].v == [5, None]
    assert df.agg(F.size(collect(F.col("v"))).alias("v")).first().v == 3
    many = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    assert all(r.i == r.x + 1 for r in with_index(many, "i", F.col("x")).collect())
    other = spark.createDataFrame([("a", 10), ("a", 20)], "kk string, w int")
    joined = dependent_join(df.alias("d"), other.where(F.col("kk") == F.col("d.k").outer()).select("w"), outer=True)
    assert joined.count() == 5


def test_recursion(spark):
    first = spark.createDataFrame([(3,)], "a long")
    assert {r.a for r in fixpoint(first, lambda new: new.selectExpr("(a * 2) % 11 AS a")).collect()} == set(range(1, 11))
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 11), (3, 1, 12), (3, 4, 13)], "_from long, _to long, id long")
    starts = spark.createDataFrame([(1,)], "id long")
    got = sorted((r._end, len(r._edges)) for r in paths(edges, starts, 0, None).collect())
    assert got == [(1, 0), (1, 3), (2, 1), (3, 2), (4, 3)]
    both = lambda a, b, ends: sorted((r._start, r._end, [e.id for e in r._edges]) for r in paths(edges, starts, a, b, ends).collect())
    ends = spark.createDataFrame([(1,), (4,)], "id long")
    assert both(0, 5, ends) == [r for r in both(0, 5, None) if r[1] in (1, 4)] and len(both(0, 5, ends)) == 3


def test_a_fixpoint_over_many_rounds_and_nulls(spark):
    first = spark.createDataFrame([(0, None)], "a long, b string")
    assert sorted(r.a for r in fixpoint(first, lambda new: new.selectExpr("a + 1 AS a", "b").where("a <= 20")).collect()) == list(range(21))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from trilith.operators.recursion import shared_folder

    fake = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert shared_folder(fake("spark://h:7077", "/shared")) == "/shared" and shared_folder(fake("local[2]", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake("spark://h:7077", None))


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x|y\n1|p\n2|q\n3|r\n")
    assert files.csv(spark, str(tmp_path / "a.csv"), "x int, y string").count() == 3
    (tmp_path / "a.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.ndjson(spark, str(tmp_path / "a.json")).agg(F.sum("a")).first()[0] == 3
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("one.txt", "l1\nl2\n")
        z.writestr("two.csv", "n\n")
    assert sorted(r.line for r in files.zip_members(spark, str(tmp_path / "z.zip"), ".txt").collect()) == ["l1", "l2"]
    (tmp_path / "d.xml").write_text("<r><i k='1'>a</i><i k='2'>b</i></r>")
    assert files.xml_rows(spark, str(tmp_path / "d.xml"), "i").count() == 2
    assert files.xml_documents(spark, str(tmp_path / "d.xml")).first().xml.startswith("<r>")
    (tmp_path / "g.json").write_text('{"nodes": [{"key": "a", "attributes": {"labels": ["X"]}}], "edges": [{"key": "e", "source": "a", "target": "a", "attributes": {"type": "T"}}]}')
    n, e = graph.read_json(spark, str(tmp_path / "g.json"))
    assert n.columns == ["id", "labels"] and e.columns == ["id", "src", "dst", "type"]
    assert graph.edges_of_csv(spark, str(tmp_path / "a.csv"), "K").count() == 3
    assert {r.type for r in graph.edges_of_csv(spark, str(tmp_path / "a.csv")).collect()} == {"a"}
    graph.write_json(graph.Graph("g", n, e), str(tmp_path / "out"))
    again = graph.read_json(spark, str(tmp_path / "out"))
    assert [f.collect() for f in again] == [n.collect(), e.collect()]


@pytest.mark.parametrize("without", [False, True])
def test_entry_imports_with_and_without_the_subpackage(tmp_path, without):
    """The library never needs the llm subpackage."""
    import shutil

    shutil.copytree(ROOT / "trilith", tmp_path / "trilith", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if without else [])))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / f).exists() and not (without and f.startswith("corpus")):
            shutil.copy(ROOT / f, tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(k[:2] == 'op' for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 80 and int(said[1]) > 80 and (int(said[2]) == 0 or not without)
