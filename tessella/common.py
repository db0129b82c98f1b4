"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: White space as Unicode (and Python's str.isspace) has it; Spark's trim() removes only U+0020.
WHITE = r"[\s\x{1C}-\x{1F}]"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once a session: Python workers import it by name, and need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella_sources.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; columns are pruned by the caller's select."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names.

    Only where the session names none and runs in one process (tests, a laptop) is a temporary folder used; on a cluster its executors
    would not share it, so there it is an error. The files survive the loss of any executor.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("a cluster must name a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessella-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Rows of a plain scan over at least as many partitions as there are cores: a few files of much text, worked on by the character, would
    leave cores idle. A scan of enough partitions, which is every large one, and a plan that shuffles anyway are left as they are."""
    plan = df._jdf.queryExecution().executedPlan()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def strip(c: Column | str) -> Column:
    """Trim every kind of Unicode white space."""
    return F.regexp_replace(c, rf"(?U)^{WHITE}+|{WHITE}+$", "")


def blank(c: Column | str) -> Column:
    """True for null, empty and white-space-only strings."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~col.rlike(r"(?U)[^\s\x{1C}-\x{1F}]"), F.lit(True))


def latest(df: DataFrame, key: str, at: str, *columns: str) -> DataFrame:
    """One row per key: the one delivered last. Rows that agree in `at` are told apart by their other columns, so
    the result does not depend on the order of delivery. Null keys are left out. `max` of a struct is combined on
    the map side, so a key delivered very often costs one row per input partition."""
    rest = [c for c in columns if c not in (key, at)]
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_last")).select(key, "_last.*")


def dense_ordinals(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with ordinal 0, 1, 2, ... in the stated order, without gathering them in one task: rows are range-partitioned by the order and
    numbered in each partition, and the partitions' sizes, one number each, give the offsets."""
    spread = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    sizes = spread.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    offsets = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return spread.join(F.broadcast(offsets), "_p").withColumn("ordinal", F.col("_offset") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_offset")  # one row a partition
