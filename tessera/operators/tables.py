"""Tables between the steps of an iteration: what is written ends the lineage, and all executors can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset a temporary folder, on a local master only, as a cluster's
    machines wouldn't see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("tessera.checkpoint.dir", root)
    return root.rstrip("/")


class Steps:
    """One table that grows by a part in each step, with a flat plan however many there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.where, self.parts = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}", []
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.where}/step={len(self.parts)}"
        df.write.parquet(path)
        if not self.parts:  # the folder goes when the application ends
            sc = self.spark.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(self.where)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(where)
        self.parts.append(path)
        self.schema = df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)


def numbered_rows(rows: DataFrame, order: str) -> DataFrame:
    """rows with _n from 0 in an order, through one range shuffle: ranges are numbered on their own, from starts that
    come from a count for each range. The ranged rows are written, as ranges made again might be cut elsewhere."""
    ranged = Steps(rows.sparkSession).add(rows.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("c"))  # a row for each partition
    starts = sizes.withColumn("_s", F.sum("c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", F.coalesce("_s", F.lit(0)).alias("_s"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("_i", inside).join(F.broadcast(starts), "_p").withColumn("_n", F.col("_i") + F.col("_s")).drop("_i", "_s", "_p")


def running_sums(rows: DataFrame, group: list[str], order: list[str], amount: str | None = None) -> DataFrame:
    """rows with _upto, the sum of the amount (1 if there's none) over the rows of the same group up to each row in an order
    that leaves no ties. One range shuffle over group and order cuts hot groups into ranges; what a group has in the ranges
    before comes from a sum for each range that it goes on from or into, two a range at most. No task sees a whole group."""
    own = rows.withColumns({"_g": F.struct(*group), "_a": F.col(amount) if amount else F.lit(1).cast("long")})
    ranged = Steps(rows.sparkSession).add(own.repartitionByRange(*(F.col(c) for c in (*group, *order))).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p", "_g").agg(F.sum("_a").alias("_s"))
    over = sums.groupBy("_g").agg(F.min("_p").alias("lo"), F.max("_p").alias("hi")).filter("lo < hi").select(F.col("_g").alias("_h"))
    parts = sums.join(F.broadcast(over), F.col("_g").eqNullSafe(F.col("_h")), "left_semi")
    before = F.sum("_s").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(F.col("_p").alias("_q"), F.col("_g").alias("_h"), before.alias("_b"))
    inside = F.sum("_a").over(Window.partitionBy("_p", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_i", inside).join(F.broadcast(offsets), (F.col("_p") == F.col("_q")) & F.col("_g").eqNullSafe(F.col("_h")), "left")
    return placed.withColumn("_upto", F.col("_i") + F.coalesce("_b", F.lit(0))).select(*rows.columns, "_upto")


def frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of df with the largest counts, at most `most` of them: down to the lowest step of the counts' logarithm that
    fits whole. Only a row for each step comes to the driver."""
    step = F.floor(F.log2(F.col(count)) * 16)
    left, least = most, None
    for r in df.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():  # 64 * 16 rows at most
        left -= r["n"]
        if left < 0:
            break
        least = r["s"]
    return df.filter(step >= least) if least is not None else df.limit(0)
