"""Joins of points with spans and of spans with spans, without pairing what lies apart.

A span of whole numbers is cut into the fewest aligned bins that fill it exactly: bins of size 2**level, at most two a level.
A point is in a span just when the bin it falls into, on some level, is one of the span's. So the join is an equi-join on
(file, level, bin): rows before it are points times levels in use and spans times their bins (twice the logarithm of their
length at most), rows after it are the answer, and no bounds are left to test. Where only the best span of a point is
asked for, bins keep their best before the join, so a point meets one row a level however many spans lie around it.

Ends count as inside. A span with a null end, or whose end lies before its start, holds nothing; a null point or file is in
no span. Numbers lie within 62 bits. Hot files are dealt by bins like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_LEVELS = "cast(floor(log2(greatest(_e - _s + 1, 1L))) + 1 as int)"
_LO, _HI = "-shiftright(-_s, _level)", "shiftright(_e + 1, _level)"


def binned(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """spans with _level and _bin, one row a bin that the span is cut into.

    A level is a row before its bins are worked out: that is compiled code, where functions over arrays are interpreted.
    """
    s = spans.where(F.col(start) <= F.col(end)).withColumn("_s", F.col(start).cast("long")).withColumn("_e", F.col(end).cast("long"))
    s = s.withColumn("_level", F.explode(F.sequence(F.lit(0), F.least(F.expr(_LEVELS), F.lit(62)))))
    s = s.withColumn("_lo", F.expr(_LO)).withColumn("_hi", F.expr(_HI)).where("_lo < _hi")
    ends = F.array(F.when(F.col("_lo") % 2 != 0, F.col("_lo")), F.when(F.col("_hi") % 2 != 0, F.col("_hi") - 1))
    return s.select(*spans.columns, "_level", F.explode(ends).alias("_bin")).where("_bin is not null")


def levels_of(bins: DataFrame) -> list[int]:
    """The levels in use, 63 at most."""
    return sorted(r["_level"] for r in bins.select("_level").distinct().collect())


def placed(points: DataFrame, levels: list[int], at: str = "offset") -> DataFrame:
    """points with _level and _bin, one row a level."""
    p = points.where(F.col(at).isNotNull()).withColumn("_at", F.col(at).cast("long"))
    return p.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>"))).withColumn("_bin", F.expr("shiftright(_at, _level)")).drop("_at")


def inside(points: DataFrame, spans: DataFrame, by: str = "file_id", at: str = "offset", start: str = "start", end: str = "end") -> DataFrame:
    """Each point with each span of its file around it: columns of points, then those of spans but `by`."""
    b = binned(spans.select(F.col(by).alias("_by"), *[c for c in spans.columns if c != by]), start, end)
    return placed(points, levels_of(b), at).withColumn("_by", F.col(by)).join(b, ["_by", "_level", "_bin"]).drop("_by", "_level", "_bin")


def best_inside(points: DataFrame, spans: DataFrame, best: Column, by: str = "file_id", at: str = "offset", start: str = "start", end: str = "end") -> DataFrame:
    """Points with `_best`: an aggregate over the spans around each that can be taken in steps (min, max, bool_or), null
    without any. It is taken a bin before the join."""
    b = binned(spans.select(F.col(by).alias("_by"), *[c for c in spans.columns if c != by]), start, end)
    b = b.groupBy("_by", "_level", "_bin").agg(best.alias("_best"))
    return placed(points, levels_of(b), at).withColumn("_by", F.col(by)).join(b, ["_by", "_level", "_bin"]).drop("_by", "_level", "_bin")


def overlapping(a: DataFrame, b: DataFrame, by: str = "file_id", start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of spans of a and b of one file that share a number: columns of a with a_, of b with b_.

    Either b begins within a, or a begins within b and after b's start: two point joins that give no pair twice.
    """
    named = lambda df, p: df.where(F.col(start) <= F.col(end)).select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    x, y = named(a, "a"), named(b, "b")
    keyed = lambda df, p: df.withColumn(by, F.col(f"{p}_{by}"))
    first = inside(keyed(y, "b"), keyed(x, "a"), by, f"b_{start}", f"a_{start}", f"a_{end}")
    second = inside(keyed(x, "a"), keyed(y, "b"), by, f"a_{start}", f"b_{start}", f"b_{end}").where(F.col(f"a_{start}") > F.col(f"b_{start}"))
    return first.drop(by).unionByName(second.drop(by))
