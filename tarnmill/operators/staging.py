"""Tables between the steps of an operator, in the folder that all executors share, and numbering without one large task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stage_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode only)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tarnmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder, and reads it back."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df staged, its rows numbered from 1 in the order in which tasks wrote them: no row is moved for its number."""
    held = stage(df.withColumn("__id", F.monotonically_increasing_id()), "written")  # a task's number, then its rows, in 33 bits
    held = held.withColumn("__part", F.shiftright("__id", 33))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a task
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return held.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__before", "__id")


def numbered(df: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """df with its rows' places in `order`, from 1: ranges are numbered in their own tasks, then moved up by offsets."""
    ranged = df.withColumns({f"__k{i}": c for i, c in enumerate(order)})
    keys = [f"__k{i}" for i in range(len(order))]
    ranged = stage(ranged.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return ranged.join(F.broadcast(before), "__part").withColumn(name, (place + F.col("__before")).cast("long")).drop("__part", "__before", *keys)
