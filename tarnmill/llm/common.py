"""What several training-data operators share: inputs, folds, staging and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Hashes to try for file numbers that do not overlap; of a million files with a million rows each, one fails in four.
SEEDS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one where it is unset (local mode only)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tarnmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Spark's own setting that removes a query's shuffle files when the query ends.
CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files are removed as soon as the query ends, whether or not the driver collects its garbage."""
    before = spark.conf.get(CLEANS, None)
    spark.conf.set(CLEANS, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANS, before) if before else spark.conf.unset(CLEANS)


def staged(df: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage and survives lost executors.

    With `clean`, the shuffle files that the write needed are removed as soon as the table is there.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with cleaning(spark) if clean else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Removes what staged() wrote, once everything that reads it has been staged itself."""
    for df in tables:
        spark = df.sparkSession
        for name in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing refers to any more.

    It acts when the driver's JVM collects garbage, which a driver that only plans may not do for half an hour.
    """
    spark._jvm.System.gc()


def is_scan(docs: DataFrame) -> bool:
    """Whether docs is a Parquet table as it lies in its files, but for columns and filters."""
    node = docs._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    while kind(node) in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return kind(node) == "LogicalRelation" and kind(node.relation()) == "HadoopFsRelation" and node.relation().fileFormat().toString() == "Parquet"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name` that tells its rows apart, the same on every read, whatever reads it.

    A row's number is its place in its file plus a hash of the file's path, so it depends on no plan, task or core count.
    One job that reads no column finds how many rows each file has; the hash is seeded so that no two files' numbers
    overlap. What comes to the driver is a row a file, as the driver's list of files. Anything but a scan is staged first.
    """
    if not is_scan(docs):
        docs = staged(docs, "input")
    place = docs.metadataColumn("_metadata")
    first = lambda seed: F.xxhash64(F.lit(seed), place["file_path"]).bitwiseAND(F.lit((1 << 62) - 1))
    rows = place["row_index"]
    ends = docs.select(*[first(seed).alias(f"f{seed}") for seed in range(SEEDS)], place["file_path"].alias("path"), rows.alias("i")).groupBy("path").agg(F.max("i").alias("last"), *[F.min(f"f{seed}").alias(f"f{seed}") for seed in range(SEEDS)]).drop("path").collect()
    for seed in range(SEEDS):
        spans = sorted((r[f"f{seed}"], r[f"f{seed}"] + r.last) for r in ends)
        if all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False)):
            return docs.withColumn(name, first(seed) + rows)
    raise ValueError("too many files to number their rows")


def running(rows: DataFrame, group: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with `number`, their place in their group by `order` from 1, and with running sums within the group.

    Rows are dealt by ranges of (group, order), so a group of any size spans as many tasks as it needs. A range counts its
    own rows; what it carries over concerns its first group alone, so what is broadcast is a row a task at most. Null
    groups are one group, nulls in `order` come first, and rows that tie in all of `order` take any order among themselves.
    """
    ranged = staged(rows.withColumns(sums).repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("__part", group).orderBy(*order)
    totals = ranged.groupBy(group, "__part").agg(F.count("*").alias("number"), *[F.sum(k).alias(k) for k in sums])
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), *[F.sum(k).over(before).alias(f"__{k}") for k in ("number", *sums)]).filter("__number > 0")
    local = ranged.withColumns({"number": F.row_number().over(own).cast("long")} | {k: F.sum(k).over(own.rowsBetween(Window.unboundedPreceding, 0)) for k in sums})
    found = local.join(F.broadcast(carried), (F.col("__part") == F.col("__at")) & F.col(group).eqNullSafe(F.col("__group")), "left")
    return found.withColumns({k: F.col(k) + F.coalesce(f"__{k}", F.lit(0)) for k in ("number", *sums)}).drop("__part", "__group", "__at", *[f"__{k}" for k in ("number", *sums)])


def held_out(doc_id: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id as text leaves 2 when divided by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About `most` rows of df at most, the same ones on every run: those with a small enough hash of `key`."""
    n = df.count()
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("bounded sample"), key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def maybe_in(df: DataFrame, key: str, wanted: DataFrame, flag: str | None = None, slots: int = 1 << 17) -> DataFrame:
    """Rows of df whose long `key` may be among those of `wanted`, so that few rows enter a join with it.

    A hash picks one bit of `slots` longs; the longs are all that is broadcast, whatever the size of `wanted`, and a full
    set of bits only lets more rows through. With `flag`, all rows stay and that column has the answer.
    """
    h = F.xxhash64(F.lit("maybe"), F.col(key))
    slot, bit = F.pmod(F.shiftright(h, 6), F.lit(slots)), h.bitwiseAND(F.lit(63)).cast("int")
    bits = wanted.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits"))
    found = df.withColumns({"__slot": slot, "__bit": bit}).join(F.broadcast(bits), "__slot", "left" if flag else "inner")
    hit = F.coalesce(F.expr("getbit(__bits, __bit) = 1"), F.lit(False))
    found = found.withColumn(flag, hit) if flag else found.filter(hit)
    return found.drop("__slot", "__bit", "__bits")


def with_hot_keys(rows: DataFrame, keys: DataFrame, on: list[str], share: int = 1000) -> DataFrame:
    """The rows whose `on` is among those of keys(*on, n), n being how many rows have that key: a semi join that no key skews.

    Fewer than `share` keys can have a `share`-th of all rows each; those are joined by broadcast, the others by a shuffle.
    """
    most = keys.agg(F.sum("n")).first()[0] or 0
    hot = keys.filter(F.col("n") > most / share).select(*on)
    cold = keys.filter(F.col("n") <= most / share).select(*on)
    left = rows.join(F.broadcast(hot), on, "left_anti").join(cold.hint("merge"), on, "left_semi")
    return left.unionByName(rows.join(F.broadcast(hot), on, "left_semi"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about `most` text bytes each, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes, dtype=np.int64)
        at, n = 0, batch.num_rows
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
