"""Game-like logs derived from the `events` table: an entity change log and an event log on one tick clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log: full snapshots; data columns are null on delete and leave."""
    e = read(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    kind = F.when(F.col("event_type") == "signup", "create").when(error & (F.col("event_id") % 5 == 0), "leave").when(error, "delete").otherwise("update")
    live = lambda c, name: F.when(~error, c).cast("bigint").alias(name)
    return e.select(
        F.expr("cast(event_id div 2 as int)").alias("tick"),
        F.col("event_id").alias("seq"),
        F.col("user_id").cast("int").alias("entity_index"),
        kind.alias("delta_type"),
        live(2 + F.col("user_id") % 2, "m_iTeamNum"),
        live(F.floor(F.col("value") * 10), "m_iHealth"),
        live(F.lit(5000), "m_iMaxHealth"),
        live(F.col("event_id") % 256, "cellX"),
        live((F.col("event_id") * 7) % 256, "cellY"),
        (F.col("user_id") % 3).alias("part"),
    )


def damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log: one row a hit."""
    e = read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(
        F.expr("cast(event_id div 2 as int)").alias("tick"),
        F.col("event_id").alias("seq"),
        F.floor("value").cast("int").alias("damage"),
        F.col("user_id").cast("int").alias("entindex_victim"),
        ((F.col("user_id") * 7 + 3) % 150).cast("int").alias("entindex_attacker"),
    )


#: The same logs for DuckDB, as the head of a WITH clause.
CTES = """WITH pawn AS (
  SELECT CAST(event_id // 2 AS INTEGER) AS tick, event_id AS seq, CAST(user_id AS INTEGER) AS entity_index,
         CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'leave' WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS delta_type,
         CASE WHEN event_type <> 'error' THEN 2 + user_id % 2 END AS "m_iTeamNum",
         CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) END AS "m_iHealth",
         CASE WHEN event_type <> 'error' THEN CAST(5000 AS BIGINT) END AS "m_iMaxHealth",
         CASE WHEN event_type <> 'error' THEN event_id % 256 END AS "cellX",
         CASE WHEN event_type <> 'error' THEN (event_id * 7) % 256 END AS "cellY",
         user_id % 3 AS part
  FROM events
), damage AS (
  SELECT CAST(event_id // 2 AS INTEGER) AS tick, event_id AS seq, CAST(floor(value) AS INTEGER) AS damage,
         CAST(user_id AS INTEGER) AS entindex_victim, CAST((user_id * 7 + 3) % 150 AS INTEGER) AS entindex_attacker
  FROM events WHERE event_type = 'purchase'
)"""
