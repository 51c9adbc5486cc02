"""Counts, histograms and descriptions of a graph's annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.operators.graph import Graph


def _rows(g: Graph, kind: str) -> DataFrame:
    if kind not in ("vertex", "edge"):
        raise ValueError(kind)
    return g.vertex_rows if kind == "vertex" else g.edge_rows


def counts(g: Graph) -> DataFrame:
    """(vertices, edges): one row; linked graphs of other stores add theirs."""
    from functools import reduce

    graphs = [g, *g.remotes]
    both = reduce(DataFrame.unionByName, [x.v.distinct().select(F.lit(1).alias("v"), F.lit(0).alias("e")) for x in graphs] + [x.e.distinct().select(F.lit(0).alias("v"), F.lit(1).alias("e")) for x in graphs])
    return both.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("vertices"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


def histogram(g: Graph, kind: str, key: str) -> DataFrame:
    """(value, n) of the values there are."""
    return _rows(g, kind).select(F.col("annotations")[key].alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def _numbers(g: Graph, kind: str, key: str) -> DataFrame:
    return _rows(g, kind).select(F.col("annotations")[key].try_cast("double").alias("x")).where("x is not null and not isnan(x)")


def mean(g: Graph, kind: str, key: str) -> DataFrame:
    """(mean): one row, or none if no value is a number; other values don't count."""
    return _numbers(g, kind, key).agg(F.avg("x").alias("mean"), F.count("x").alias("n")).where("n > 0").select("mean")


def std(g: Graph, kind: str, key: str) -> DataFrame:
    """(std): the sample standard deviation, null for one number; no row for none."""
    return _numbers(g, kind, key).agg(F.stddev_samp("x").alias("std"), F.count("x").alias("n")).where("n > 0").select("std")


def distribution(g: Graph, kind: str, key: str, bins: int) -> DataFrame:
    """(low, high, n) of equal bins: the range is max - min + 1, a bin [b, b + step) while b + step < max, the last one closed at max.

    Minimum and maximum are one aggregation, joined back as a single row; so the plan is lazy and fits any table.
    """
    if bins < 1:
        raise ValueError("bins")
    x = _numbers(g, kind, key)
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo is not null").withColumn("step", (F.col("hi") - F.col("lo") + 1) / bins)
    full = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / F.col("step")).cast("int") - 1, F.lit(0))  # bins that end before the maximum
    made = ends.withColumn("full", full).select("*", F.explode(F.sequence(F.lit(0), "full")).alias("b"))
    made = made.select("b", (F.col("lo") + F.col("b") * F.col("step")).alias("low"), F.when(F.col("b") == F.col("full"), F.col("hi")).otherwise(F.col("lo") + (F.col("b") + 1) * F.col("step")).alias("high"))
    at = x.join(F.broadcast(ends.withColumn("full", full))).select(F.least(F.floor((F.col("x") - F.col("lo")) / F.col("step")).cast("int"), F.col("full")).alias("b"))
    return made.join(at.groupBy("b").agg(F.count("*").alias("n")), "b", "left").select("low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def describe_keys(g: Graph, kind: str, limit: int | None = None) -> DataFrame:
    """(key): the annotation keys there are, in order."""
    keys = _rows(g, kind).select(F.explode(F.map_keys("annotations")).alias("key")).distinct().orderBy("key")
    return keys if limit is None else keys.limit(limit)


def describe_count(g: Graph, kind: str, key: str, limit: int | None = None) -> DataFrame:
    """(value, n) in the order of value."""
    out = histogram(g, kind, key).orderBy("value")
    return out if limit is None else out.limit(limit)


def describe_minmax(g: Graph, kind: str, key: str) -> DataFrame:
    """(min, max) as text; UNDEFINED if there are no values."""
    x = _rows(g, kind).select(F.col("annotations")[key].alias("x"))
    return x.agg(F.coalesce(F.min("x"), F.lit("UNDEFINED")).alias("min"), F.coalesce(F.max("x"), F.lit("UNDEFINED")).alias("max"))


def noisy(table: DataFrame, column: str, epsilon: float, seed: int | None = None) -> DataFrame:
    """``column`` of counts with Laplace noise of scale 1/epsilon, cut to whole numbers of at least 0: the differentially private form."""
    if epsilon <= 0:
        raise ValueError("epsilon")
    u = (F.rand() if seed is None else F.rand(seed)) - 0.5
    noise = -F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300))) / epsilon
    return table.withColumn(column, F.greatest(F.col(column) + noise, F.lit(0.0)).cast("bigint"))
