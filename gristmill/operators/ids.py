"""Checkpoints and dense ids."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of its own only where the session names none and all is one machine (tests)."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="gristmill-"))
    return named or sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """``df`` with ids start, start + 1, ... in the given order, without one task that sees all rows.

    Rows are range-partitioned and numbered within partitions; the partitions' counts (one number each) give the offsets.
    """
    r = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    counts = r.groupBy(part.alias("p")).count().orderBy("p").collect()
    offsets, total = {}, start
    for p, n in counts:
        offsets[p] = total
        total += n
    if not offsets:
        return r.withColumn(name, F.lit(None).cast("long")).drop("_at")
    base = F.element_at(F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv]), part)
    return r.withColumn(name, (base + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at")
