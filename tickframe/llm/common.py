"""Shared plumbing of the training-data operators: tables, sizing, and cutting lineage in the shared folder."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input bytes (as stored) that one batch or bucket of the grouped operators should hold.
TARGET_BYTES = 4 << 20
#: Stored bytes of input for one partition of a table that is written between steps.
PART_BYTES = 1 << 20
#: Seconds between two hints to collect garbage.
HINT_S = 2.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where that is unset, a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = getattr(shared_dir, "own", None)
    if found is None:
        found = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tickframe-")
    return found


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session may be gone already; the folder is then left to its owner
        return


def delete_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(delete, spark, path)


class Materialized:
    """A table written to the shared folder; `df` reads it back, `drop()` deletes it once no plan needs it."""

    hinted = 0.0

    def __init__(self, spark: SparkSession, df: DataFrame):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tickframe/{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = spark.read.schema(df.schema).parquet(self.path)
        delete_at_exit(spark, self.path)
        # a job's shuffle files go when the driver has collected its plan; without this hint they stay for the session
        if time.monotonic() - Materialized.hinted > HINT_S:
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            Materialized.hinted = time.monotonic()

    def drop(self) -> None:
        delete(self.spark, self.path)


def materialize(df: DataFrame) -> Materialized:
    """Cut the lineage of df: a lost executor costs a re-read of the shared folder, not a recomputation."""
    return Materialized(df.sparkSession, df)


def few(df: DataFrame, of: DataFrame, narrow: bool = True) -> DataFrame:
    """df in as many partitions as the size of a table it is made of asks for, so that small tables make few files.

    narrow: the last stage of df is cheap and runs in these partitions; else its result is dealt again.
    """
    n = max(1, -(-stored_bytes(of) // PART_BYTES))
    if n >= shuffle_partitions(df.sparkSession):
        return df
    return df.coalesce(n) if narrow else df.repartition(n)


#: Estimates from here on mean that Catalyst doesn't know.
_UNKNOWN = 1 << 60


def stored_bytes(df: DataFrame) -> int:
    """Size of df by Catalyst's estimate, which costs no job, but no more than its inputs; measured where it is unknown."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    inputs = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    known = min(int(str(plan.stats().sizeInBytes())), inputs)
    if known < _UNKNOWN:
        return known
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema]
    return int(df.agg(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()[0] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(df: DataFrame, target: int = TARGET_BYTES) -> int:
    """How many batches to cut df into, so that each holds about target stored bytes at any input size."""
    return int(min(1 << 23, max(shuffle_partitions(df.sparkSession), -(-stored_bytes(df) // target))))


def batch_of(pieces: int):
    """The batch of a document, by doc_id; rows without one are dealt by their text."""
    return F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(pieces)).cast("int")
