"""Change logs on disk: one Parquet directory a table, rows with tick, seq and (for entities) entity_index, delta_type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, SourceIOError


def tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the table directories under root, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    try:
        found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    except Exception as e:
        raise SourceIOError(f"can't read log {root}: {e}".splitlines()[0]) from e
    names = [s.getPath().getName() for s in found]
    return sorted(n.removesuffix(".parquet") for n in names if not n.startswith(("_", ".")))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    for path in (f"{root.rstrip('/')}/{name}", f"{root.rstrip('/')}/{name}.parquet"):
        try:
            return spark.read.parquet(path)
        except Exception as e:
            error = e
    raise SchemaError(f"table {name} of {root} has no readable schema: {error}".splitlines()[0])


def is_entity(schema: T.StructType) -> bool:
    return {"tick", "entity_index", "delta_type"} <= set(schema.names)


def write_table(rows: DataFrame, root: str, name: str, ticks_per_part: int | None = None, mode: str = "overwrite") -> None:
    """Write a table in tick order within files; with ticks_per_part, one directory for each range of ticks.

    A tick range is dealt to one task a part, so that scans of a range read few, sorted files.
    """
    path = f"{root.rstrip('/')}/{name}"
    order = [c for c in ("tick", "seq") if c in rows.columns]
    if ticks_per_part:
        parted = rows.withColumn("tick_part", F.floor(F.col("tick") / ticks_per_part).cast("int"))
        parted.repartition("tick_part").sortWithinPartitions("tick_part", *order).write.mode(mode).partitionBy("tick_part").parquet(path)
    else:
        rows.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def read_stream(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None, files_per_trigger: int = 1) -> DataFrame:
    """The table's files as a stream, a few of them a micro-batch (the rate limit of a file log)."""
    schema = schema or read_table(spark, root, name).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{root.rstrip('/')}/{name}")
