"""Regular-expression matches with their places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def find_all(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, raw>>``: non-overlapping matches, offsets in code points, end exclusive."""

    def pair(gaps: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda raw, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), raw.alias("raw")))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,raw:string>>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.length(x["raw"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["raw"].alias("raw")))).alias("out"))

        return F.aggregate(found, empty, step, lambda acc: acc["out"])

    return let(F.split(text, pattern, -1), pair)


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null where the pattern does not match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, n))
