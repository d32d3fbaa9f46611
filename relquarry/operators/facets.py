"""Facet counts, filters and sorting over typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


@dataclass(frozen=True)
class Range:
    """start <= value < end."""

    start: object
    end: object


@dataclass(frozen=True)
class Distance:
    """A point's distance from a base, start <= distance < end."""

    base: tuple[float, float]
    start: float
    end: float
    unit: str = "Kilometers"


@dataclass(frozen=True)
class FacetFilter:
    """Values (any of them), a Range, or a Distance. Conditions on other fields are all required."""

    field: str
    values: tuple = ()
    range: Range | None = None
    distance: Distance | None = None


@dataclass(frozen=True)
class QueryFacet:
    """What to count: values (prefix, length; 0 turns it off) or ranges (label, lower bound), of numbers or of distances."""

    field: str
    prefix: str = ""
    length: int = 10
    ranges: tuple[tuple[str, object], ...] = ()
    range_type: str = "CountWithinRange"
    base: tuple[float, float] | None = None
    unit: str = "Kilometers"


@dataclass(frozen=True)
class ResultSort:
    """A facet field, or _score or _id; for points, by distance from a base."""

    field: str
    order: str = "ascending"
    base: tuple[float, float] | None = None
    unit: str = "Kilometers"


def _is_array(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name].startswith("array")


def condition(df: DataFrame, f: FacetFilter) -> Column:
    c = F.col(f"`{f.field}`")
    if f.distance:
        d = f.distance
        return geo.within(c["lat"], c["lon"], d.base, d.start, d.end, d.unit)
    if f.range:
        return (c >= F.lit(f.range.start)) & (c < F.lit(f.range.end))
    if _is_array(df, f.field):
        values = list(f.values)
        # a set's key joins its sorted values by "_"
        return F.arrays_overlap(c, F.array(*map(F.lit, values))) | F.array_join(F.array_sort(c), "_").isin(values)
    return c.isin(list(f.values))


def filtered(df: DataFrame, filters) -> DataFrame:
    for f in filters:
        if f.field in df.columns:
            df = df.where(condition(df, f))
    return df


def string_facet(df: DataFrame, name: str, prefix: str = "", length: int = 0) -> DataFrame:
    """value, count of a string or string-set column, the most frequent first; ties by value."""
    c = F.col(f"`{name}`")
    values = df.select((F.explode(F.array_distinct(c)) if _is_array(df, name) else c).alias("value")).where("value is not null")
    if prefix:
        values = values.where(F.col("value").startswith(prefix))
    out = values.groupBy("value").agg(F.count("*").alias("count"))
    return out.orderBy(F.col("count").desc(), "value").limit(length) if length else out


def bucket(value: Column, ranges) -> Column:
    """Index of the last range whose lower bound isn't above the value; null below the first."""
    out = F.lit(None).cast("int")
    for i, (_, low) in enumerate(ranges):
        out = F.when(value >= F.lit(low), F.lit(i)).otherwise(out)
    return out


def range_facet(df: DataFrame, value: Column, ranges, range_type: str = "CountWithinRange") -> DataFrame:
    """label, count in the order of ranges; empty ranges are absent. Cumulative types sum over the ranges that aren't empty."""
    ranges = sorted(ranges, key=lambda r: r[1])
    labels = F.array(*[F.lit(label) for label, _ in ranges])
    out = df.select(bucket(value, ranges).alias("i")).where("i is not null").groupBy("i").agg(F.count("*").alias("count"))
    # as many rows as there are ranges at most
    if range_type == "CountAboveRange":
        out = out.withColumn("count", F.sum("count").over(Window.orderBy(F.col("i").desc())))
    elif range_type == "CountBelowRange":
        out = out.withColumn("count", F.sum("count").over(Window.orderBy("i")))
    return out.select("i", F.get(labels, F.col("i")).alias("label"), "count").orderBy("i").select("label", "count")


def facet(df: DataFrame, q: QueryFacet) -> DataFrame:
    """Counts of one facet as (value or label, count)."""
    c = F.col(f"`{q.field}`")
    if q.ranges:
        return range_facet(df, geo.distance(c["lat"], c["lon"], q.base, q.unit) if q.base else c, q.ranges, q.range_type)
    return string_facet(df, q.field, q.prefix, q.length)


def index_facets(df: DataFrame, names, prefix: str = "", length: int = 0) -> DataFrame:
    """field, value, count over the whole index."""
    out = None
    for name in names:
        one = string_facet(df, name, prefix, length).select(F.lit(name).alias("field"), "value", "count")
        out = one if out is None else out.union(one)
    return out


def min_max(df: DataFrame, names) -> DataFrame:
    """field, min, max of numeric facets, in one pass."""
    stats = df.agg(*[f(F.col(f"`{n}`").cast("double")).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("a", F.min), ("z", F.max))])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max")) for i, n in enumerate(names)]))
    return stats.select(rows.alias("r")).select("r.*")


def order(df: DataFrame, keys, default=("_score",)) -> list[Column]:
    """Sort columns; doc_id is the last key. Later keys count after _score, too."""
    out = []
    for k in keys:
        c = F.col("score") if k.field == "_score" else F.col("doc_id") if k.field == "_id" else F.col(f"`{k.field}`")
        if k.base:
            c = geo.distance(c["lat"], c["lon"], k.base, k.unit)
        out.append(c.desc_nulls_last() if k.order.lower().startswith("desc") else c.asc_nulls_last())
    if not keys and "score" in df.columns:
        out.append(F.col("score").desc())
    return [*out, F.col("doc_id").asc()]


def top(df: DataFrame, keys, length: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order(df, keys))
    return (out.offset(offset) if offset else out).limit(length)


def facet_value(df: DataFrame, doc_id: int, name: str) -> DataFrame:
    """The typed value of one document's facet."""
    return df.where(F.col("doc_id") == doc_id).select(F.col(f"`{name}`").alias("value"))
