"""Column expressions for texts: places of pattern matches, without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scan(sizes: Column, of: Callable[[Column], Column]) -> Column:
    """A struct of the sum of sizes, and the sums before each."""
    first = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("at"))
    return F.aggregate(sizes, first, lambda s, x: F.struct((s["sum"] + of(x)).alias("sum"), F.concat(s["at"], F.array(s["sum"])).alias("at")))


def offsets(sizes: Column) -> Column:
    """array<int> -> array<bigint>: the sum of the entries before each, in blocks, so that long arrays cost little more than their length."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))), lambda j: _scan(F.slice(sizes, j * BLOCK + 1, F.lit(BLOCK)), lambda x: x.cast("long")))
    return let(cut, lambda c: F.flatten(F.zip_with(c, _scan(c, lambda x: x["sum"])["at"], lambda b, o: F.transform(b["at"], lambda x: x + o))))


MATCHES = "array<struct<start:bigint,end:bigint,hit:string,i:int>>"


def matches(text: Column, pattern: str | Column) -> Column:
    """The leftmost non-overlapping matches, none empty: start and end (exclusive) in code points, and the text."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    both = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, pattern, 0).alias("h"))

    def placed(s: Column) -> Column:
        sizes = F.zip_with(s["g"], s["h"], lambda g, h: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(h), F.lit(0)))
        return let(offsets(sizes), lambda o: F.transform(s["h"], lambda h, i: let(F.get(o, i) + F.length(F.get(s["g"], i)), lambda at: F.struct(at.alias("start"), (at + F.length(h)).alias("end"), h.alias("hit"), i.alias("i")))))

    return let(both, placed)


def matches_if(gate: Column, text: Column, pattern: str) -> Column:
    """matches() where the gate is true, else none: a cheap test spares most texts the expensive pattern."""
    return F.when(gate, matches(text, pattern)).otherwise(F.array().cast(MATCHES))
