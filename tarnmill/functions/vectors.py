"""Vectors in array<double> columns: parsing, cosine, and means of pairs and of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(c: Column) -> Column:
    """A JSON array or a comma list of numbers; null where it is neither or holds something else."""
    s = F.trim(c)
    listed = F.transform(F.filter(F.split(s, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("double"))
    whole = F.when(s.startswith("[") & s.endswith("]"), F.from_json(s, "array<double>")).when(s.contains(","), listed)
    return F.when(~F.exists(whole, lambda x: x.isNull()), whole)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 for empty or null vectors, unequal lengths and zero norms."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    valid = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(valid & (norms > 0), dot(a, b) / norms).otherwise(F.lit(-1.0))


def mean(a: Column, b: Column) -> Column:
    """The mean of two vectors, or the one that is there; null if their lengths differ."""
    return F.when(a.isNull(), b).when(b.isNull(), a).when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (x + y) / 2))


def group_mean(rows: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, mean): the mean of each group's vectors; null and empty ones are skipped, and lengths that differ give null.

    Sums are taken place by place with partial aggregates, so no group's vectors are ever in one place.
    """
    held = rows.filter(F.size(vector) > 0).select(by, F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("d"))
    places = held.select(by, "d", F.posexplode("v").alias("i", "x")).groupBy(by, "i").agg(F.avg("x").alias("x"), F.min("d").alias("least"), F.max("d").alias("most"))
    whole = places.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"))
    means = whole.select(by, F.when(F.col("least") == F.col("most"), F.col("mean")).alias("mean"))
    return rows.select(by).distinct().join(means, by, "left")
