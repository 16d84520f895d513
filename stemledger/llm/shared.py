"""What several operators need: shared staging, distributed components, sound text arrays."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local master without the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = os.path.join(tempfile.gettempdir(), f"stemledger-{os.getuid()}-{spark.sparkContext.applicationId}")
    return f"file://{root}"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that is deleted when the application ends."""
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    fs, place = _hadoop(spark, path)
    fs.deleteOnExit(place)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, place = _hadoop(spark, path)
    fs.delete(place, True)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: work is not repeated and lineage is cut."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        drop_path(table.sparkSession, table.staged_path)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for undirected edges (a, b) of longs; component is the smallest node reachable.

    Alternating large-star and small-star steps, each a combined minimum and a join on the node, so
    a hub's neighbours are never gathered in one place. Every round is written to the shared folder.
    The state is a set of edges (a, b) with a > b; it is final when each a has one b and no b is an a.
    Staged rounds are deleted but for the last, which the result reads.
    """
    state = staged(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(),
        name,
    )
    while not _is_stars(state):
        both = state.select("a", "b").union(state.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a > b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            joined.select("a", F.col("m").alias("b"))
        )
        following = staged(small.filter("a > b").distinct(), name)
        release(state)
        state = following
    roots = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _is_stars(state: DataFrame) -> bool:
    seen = state.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        state.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    bad = seen.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not bad.filter("up > 1 or (up > 0 and down > 0)").limit(1).count()
