"""Readers of the file formats that the workloads use; all of them give plain frames."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = "|", header: bool = True) -> DataFrame:
    """Delimited text. With a schema nothing is inferred and no second pass is made."""
    reader = spark.read.option("sep", sep).option("header", header).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def xml_rows(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    """A row for each element of that name."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema else reader).load(path)


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc (the path) and xml (the whole text): the input of a node table."""
    return spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path AS doc", "value AS xml")


def zip_members(spark: SparkSession, path: str, pattern: str = "") -> DataFrame:
    """Lines of the members of zip archives whose names contain the pattern: archive, member, line_no, line.

    Archives are read by the executors, one in a task, through Spark's own file system.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if pattern in member and not member.endswith("/"):
                            with z.open(member) as f:
                                lines = io.TextIOWrapper(f, encoding="utf-8")
                                at = 0
                                while part := lines.readlines(1 << 20):
                                    yield pd.DataFrame({"archive": archive, "member": member, "line_no": range(at, at + len(part)), "line": [x.rstrip("\r\n") for x in part]})
                                    at += len(part)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, member string, line_no long, line string")
