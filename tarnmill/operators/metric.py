"""Cells of vectors around centroids, with angle bounds: an index for exact nearest vectors, and an exact similarity join.

Centroids are fitted on a bounded sample, every vector is assigned to its nearest one, and each cell keeps the least and the
greatest angle between its vectors and its centroid. By the triangle inequality, a vector at an angle t from a centroid has
at least the angle max(t - greatest, least - t) to anything in that cell, so cells that cannot hold a near enough vector
are left out, and nothing else is. How many are left out depends on the vectors: in many dimensions without clusters few are.

Null and empty vectors, zero vectors and vectors with a null or NaN match nothing; vectors of another length are another space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.operators.staging import stage

SAMPLE = 20_000  # vectors that centroids are fitted on at most
MOST_CELLS = 2048  # of vectors of one length
PART = 16384  # vectors of a cell that meet others in one task
TILE = 512  # of these are multiplied at once
SLICE = 128  # vectors that meet all centroids at once
SEEDS = 3  # cells of a query that are searched before the threshold is known
SLACK = 1e-6  # what scores are kept below a threshold, so that rounded ties are whole


def valid(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(id, vector, dims): the vectors that can match something, as doubles."""
    v = F.col(column).cast("array<double>")
    held = rows.select(F.col(key).alias("id"), v.alias("vector"), F.size(column).alias("dims")).filter("dims > 0")
    return held.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists("vector", lambda x: x != 0))


def unit(column: pa.Array) -> np.ndarray:
    x = np.stack(column.to_numpy(zero_copy_only=False)).astype(float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def fitted(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centroids at most of unit vectors x, by spherical k-means from evenly spread rows."""
    c = np.unique(x[np.linspace(0, len(x) - 1, k).astype(int)], axis=0)
    for _ in range(rounds):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(1), x)
        norms = np.sqrt((sums * sums).sum(1))
        c = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-300)[:, None], c)
    return c


def reached(x: np.ndarray, c: np.ndarray, threshold: float) -> float:
    """The share of (vector, cell) combinations of a sample that a join with this threshold has to look at."""
    t = angles(x, c)
    home, angle = t.argmin(1), t.min(1)
    shape = {int(i): (0, angle[home == i].min(), angle[home == i].max()) for i in np.unique(home)}
    return float(((bounds_of(x, 0, c, shape) >= threshold) & (t <= angle[:, None] + 2 * np.arccos(np.clip(threshold, -1, 1)))).mean())


def searched(x: np.ndarray, c: np.ndarray, k: int = 10, asked: int = 256) -> float:
    """The share of cells that a search for the k nearest has to visit, by some vectors of a sample among all of it."""
    t = angles(x, c)
    home, angle = t.argmin(1), t.min(1)
    shape = {int(i): (0, angle[home == i].min(), angle[home == i].max()) for i in np.unique(home)}
    some = x[np.linspace(0, len(x) - 1, min(asked, len(x))).astype(int)]
    kth = np.partition(some @ x.T, -min(k + 1, len(x)), axis=1)[:, -min(k + 1, len(x))]  # one is the vector itself
    return float((bounds_of(some, 0, c, shape) >= kth[:, None]).mean())


def centroids_of(held: DataFrame, sample: int = SAMPLE, cells: int | None = None, threshold: float | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """The first cell's number and the centroids of each vector length; about four times the square root of the rows are cells.

    All that comes to the driver is the sample: the vectors with a small enough hash of their id. Where a join with
    `threshold`, or without one a search for the ten nearest, would send the sample to most cells all the same, one cell holds
    all, whose parts meet as plain blocks.
    """
    sizes = {r.dims: r.n for r in held.groupBy("dims").agg(F.count("*").alias("n")).collect()}  # one row a vector length
    share = min(1.0, sample / max(1, sum(sizes.values())))
    rows = held.filter(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)) < int((1 << 30) * share)).select("dims", "vector").toArrow()
    out, first = {}, 0
    for dims, n in sorted(sizes.items()):
        own = rows.filter(pa.compute.equal(rows.column("dims"), dims)).column("vector").combine_chunks()
        k = max(1, min(cells or int(4 * n**0.5), MOST_CELLS, (len(own) + 1) // 2))
        c = fitted(unit(own), k) if len(own) else np.eye(1, dims)  # lengths too rare for the sample have one cell
        if len(own) and cells is None and len(c) > 1 and (searched(unit(own), c) if threshold is None else reached(unit(own), c, threshold)) > 0.5:
            c = fitted(unit(own), 1)
        out[dims], first = (first, c), first + len(c)
    return out


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows and unit vectors of each vector length in a batch, SLICE at once, as one may be sent to every cell."""
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        own = np.flatnonzero(dims == d)
        for rows in np.split(own, range(SLICE, len(own), SLICE)):
            yield int(d), rows, unit(batch.column("vector").take(pa.array(rows)))


def assigned(held: DataFrame, centroids: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """held with vector as a unit vector, its cell and its angle to the cell's centroid."""
    kind = held.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_length(batch):
                first, c = centroids[d]
                t = angles(x, c)
                near = t.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(list(x), pa.list_(pa.float64())), batch.column("dims").take(pa.array(rows)), pa.array(first + near, pa.int32()), pa.array(t[np.arange(len(x)), near])], ["id", "vector", "dims", "cell", "angle"])

    return held.mapInArrow(run, f"id {kind}, vector array<double>, dims int, cell int, angle double")


def shapes(cells: DataFrame) -> dict[int, tuple[int, float, float]]:
    """Rows, least and greatest angle of each cell: MOST_CELLS rows a vector length at most."""
    return {r.cell: (r.n, r.least, r.greatest) for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("greatest")).collect()}


def bounds_of(x: np.ndarray, first: int, c: np.ndarray, shape: dict[int, tuple[int, float, float]]) -> np.ndarray:
    """For unit vectors and cells, the greatest cosine that a vector of the cell can have; -2 for empty cells."""
    t = angles(x, c)
    least, greatest = (np.array([shape.get(first + i, (0, 0.0, 0.0))[j] for i in range(len(c))]) for j in (1, 2))
    there = np.array([first + i in shape for i in range(len(c))])
    return np.where(there, np.cos(np.clip(np.maximum(t - greatest, least - t), 0, np.pi)) + 1e-9, -2.0)


@dataclass
class Cells:
    """Assigned rows(id, vector, dims, cell, angle), the centroids and the cells' shapes."""

    centroids: dict[int, tuple[int, np.ndarray]]
    rows: DataFrame
    shape: dict[int, tuple[int, float, float]]

    def sizes(self, part: int = PART) -> DataFrame:
        """(cell, parts): in how many parts of about `part` a cell's rows are dealt; small enough to be broadcast."""
        return self.rows.sparkSession.createDataFrame([(c, max(1, -(-n // part))) for c, (n, _, _) in self.shape.items()], "cell int, parts int")


def partition(rows: DataFrame, key: str, column: str, sample: int = SAMPLE, cells: int | None = None, threshold: float | None = None) -> Cells:
    """The cells of rows(key, column); threshold is that of a join, if they are for one."""
    held = valid(rows, key, column)
    centroids = centroids_of(held, sample, cells, threshold)
    placed = stage(assigned(held, centroids), "cells")
    return Cells(centroids, placed, shapes(placed))


def write_index(cells: Cells, path: str) -> None:
    """Stores the cells, rows sorted by cell so that files hold few cells each."""
    spark = cells.rows.sparkSession
    spark.createDataFrame([(d, first, [float(x) for x in v], i) for d, (first, c) in cells.centroids.items() for i, v in enumerate(c)], "dims int, first int, centroid array<double>, at int").write.mode("overwrite").parquet(f"{path}/centroids")
    cells.rows.repartitionByRange("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")


def open_index(spark: SparkSession, path: str) -> Cells:
    held: dict[int, tuple[int, list]] = {}
    for r in spark.read.parquet(f"{path}/centroids").orderBy("dims", "at").collect():  # as many as were fitted
        held.setdefault(r.dims, (r.first, []))[1].append(r.centroid)
    rows = spark.read.parquet(f"{path}/rows")
    return Cells({d: (first, np.array(c)) for d, (first, c) in held.items()}, rows, shapes(rows))


def met(left: DataFrame, right: DataFrame, kinds: str, least: float, k: int | None) -> DataFrame:
    """Pairs of left(a, home, vector) and right(b, vector) of the same group (cell, part, share) from `least` on, each a's k best with ties."""

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"a": x.column("a")[:0], "home": x.column("home")[:0], "b": y.column("b")[:0], "score": pa.array([], pa.float64())})
        left, right = (c.column("vector").combine_chunks().flatten().to_numpy().reshape(c.num_rows, -1) for c in (x, y))
        found = []
        for i in range(0, len(left), TILE):
            s = left[i : i + TILE] @ right.T
            keep = s >= least
            if k and s.shape[1] > k:
                keep &= s >= np.partition(s, -k, axis=1)[:, [-k]] - SLACK
            m, n = np.nonzero(keep)
            found.append((m + i, n, s[m, n]))
        m, n, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": x.column("a").take(pa.array(m)), "home": x.column("home").take(pa.array(m)), "b": y.column("b").take(pa.array(n)), "score": score})

    group = ["cell", "part", "share"]
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, kinds)


def dealt(rows: DataFrame, parts: str, to: str, key: str) -> DataFrame:
    return rows.withColumn(to, F.pmod(F.xxhash64(key), F.col(parts)).cast("int"))


def in_all(rows: DataFrame, parts: str, to: str) -> DataFrame:
    return rows.withColumn(to, F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))


def search(cells: Cells, queries: DataFrame, k: int | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Hits (query_id, id, score) and the report (query_id, cells, visited), exact, for queries(query_id, vector).

    Hits are all vectors with a cosine of `least` or more, or with k such that they hold each query's k best, ties
    included. The most promising cells give the k-th best so far, and other cells are visited only where their bound
    reaches it.
    """
    asked = valid(queries, "query_id", "vector")
    kind, own = asked.schema["id"].dataType.simpleString(), cells.rows.schema["id"].dataType.simpleString()
    centroids, shape = cells.centroids, cells.shape

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows, x in by_length(batch):
                if d not in centroids:
                    continue
                first, c = centroids[d]
                bound = bounds_of(x, first, c, shape)
                q, cell = np.nonzero(bound >= least)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows[q])), pa.array(list(x[q]), pa.list_(pa.float64())), pa.array(first + cell, pa.int32()), pa.array(bound[q, cell])], ["query_id", "vector", "cell", "bound"])

    routes = stage(asked.mapInArrow(route, f"query_id {kind}, vector array<double>, cell int, bound double"), "routes")
    sizes = F.broadcast(cells.sizes())
    shares = max(1, -(-asked.count() // PART))  # so that a cell's queries are not all in one task

    def hits(chosen: DataFrame) -> DataFrame:
        left = in_all(chosen.select(F.col("query_id").alias("a"), F.lit(True).alias("home"), "vector", "cell").join(sizes, "cell"), "parts", "part")
        left = left.withColumn("share", F.pmod(F.xxhash64("a"), F.lit(shares)).cast("int")).drop("parts")
        right = in_all(dealt(cells.rows.select(F.col("id").alias("b"), "vector", "cell").join(sizes, "cell"), "parts", "part", "b").withColumn("shares", F.lit(shares)), "shares", "share").drop("parts", "shares")
        return met(left, right, f"a {kind}, home boolean, b {own}, score double", least, k).select(F.col("a").alias("query_id"), F.col("b").alias("id"), "score")

    if k is None or len(shape) <= SEEDS:  # the seeds are all there is
        judged = routes.withColumn("visited", F.lit(True))
    else:
        first = routes.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "cell"))).filter(F.col("place") <= SEEDS)
        kth = hits(first.drop("place")).withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("place") == k).select("query_id", F.col("score").alias("threshold"))
        judged = stage(routes.join(kth, "query_id", "left").withColumn("visited", F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - SLACK)).drop("threshold"), "judged")
    report = judged.groupBy("query_id").agg(F.count("*").alias("cells"), F.count_if("visited").alias("visited"))
    return hits(judged.filter("visited").select("query_id", "vector", "cell")), report


def pairs(cells: Cells, threshold: float, part: int = PART) -> tuple[DataFrame, DataFrame]:
    """All pairs (a, b, score) with a < b and a cosine of `threshold` or more, and the report (cell, residents, visitors, compared).

    A vector goes to the cells after its own that hold something near enough by their bound, and by its angles to the two
    centroids: what is nearest to another centroid is no nearer than half of what that centroid is farther.
    """
    kind, centroids, shape = cells.rows.schema["id"].dataType.simpleString(), cells.centroids, cells.shape
    reach = 2 * float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, angle = batch.column("cell").to_numpy(), batch.column("angle").to_numpy()
            for d, rows, x in by_length(batch):
                first, c = centroids[d]
                near = (bounds_of(x, first, c, shape) >= threshold) & (angles(x, c) <= angle[rows, None] + reach) & (first + np.arange(len(c)) > home[rows, None])
                v, cell = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows[v])), pa.array(list(x[v]), pa.list_(pa.float64())), pa.array(first + cell, pa.int32())], ["a", "vector", "cell"])

    visitors = stage(cells.rows.mapInArrow(route, f"a {kind}, vector array<double>, cell int"), "visitors")
    sizes = cells.sizes(part).join(visitors.groupBy("cell").agg(F.count("*").alias("visitors")), "cell", "left")
    residents = cells.rows.groupBy("cell").agg(F.count("*").alias("residents"))
    sizes = stage(residents.join(sizes, "cell").select("cell", "parts", "residents", F.coalesce("visitors", F.lit(0)).alias("visitors")).withColumn("shares", F.ceil((F.col("residents") + F.col("visitors")) / part).cast("int")), "sizes")
    # A row a cell. Where no visitor comes, parts and shares are the same blocks, and a pair of blocks meets once.
    each = F.broadcast(sizes.select("cell", "parts", "shares", (F.col("visitors") == 0).alias("alone")))
    left = visitors.select("a", F.lit(False).alias("home"), "vector", "cell").unionByName(cells.rows.select(F.col("id").alias("a"), F.lit(True).alias("home"), "vector", "cell"))
    left = dealt(left.join(each, "cell"), "shares", "share", "a")
    left = left.withColumn("part", F.explode(F.sequence(F.when(F.col("alone"), F.col("share")).otherwise(0), F.col("parts") - 1))).drop("parts", "shares", "alone")
    right = dealt(cells.rows.select(F.col("id").alias("b"), "vector", "cell").join(each, "cell"), "parts", "part", "b")
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.when(F.col("alone"), F.col("part")).otherwise(F.col("shares") - 1)))).drop("parts", "shares", "alone")
    found = met(left, right, f"a {kind}, home boolean, b {kind}, score double", threshold, None).filter("a <> b")
    once = found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
    n, v = F.col("residents"), F.col("visitors")
    return once, sizes.select("cell", "residents", "visitors", (F.floor(n * (n - 1) / 2) + v * n).alias("compared"))
