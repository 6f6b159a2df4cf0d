"""The log operators on streams: joins and groups on tick time, state machines per entity, and fan-out of one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scalars import event_time
from ..operators.analytics import COOLDOWN


def timed(stream: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Adds ts, the tick's event time, with a watermark; logs come in tick order, so no delay is needed."""
    return stream.withColumn("ts", event_time(F.col("tick"))).withWatermark("ts", delay)


def tick_join(left: DataFrame, right: DataFrame, on: tuple[str, ...] = ("tick",)) -> DataFrame:
    """Inner join of two streams on equal ticks (and more keys); the watermark on both sides bounds the state."""
    a, b = timed(left), timed(right)
    return a.join(b, [*on, "ts"]).drop("ts")


def per_window(stream: DataFrame, seconds: int, *aggregates) -> DataFrame:
    """Aggregates over windows of game time. The last window is emitted once a later row (end_of_stream) has come."""
    return timed(stream).groupBy(F.window("ts", f"{seconds} seconds")).agg(*aggregates)


def end_of_stream(log: DataFrame, after: int, far: int = 1_000_000) -> DataFrame:
    """A row of nulls with a tick so late that every window and join before it is complete."""
    spark = log.sparkSession
    row = spark.range(1)
    return row.select(*(F.lit(after + far).cast("int").alias(f.name) if f.name == "tick" else F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema.fields))


def _sorted(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["tick", "seq"], kind="stable")


def combat(stream: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """START and END rows, as analytics.combat gives them, from a stream: a few numbers of state for each live entity."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        alive, health, last, fighting = state.get if state.exists else (False, 0, 0, False)
        out = []
        for r in _sorted(frames).itertuples(index=False):
            if r.delta_type == "create":
                alive, health, last, fighting = True, int(r.m_iHealth), 0, False
            elif r.delta_type == "delete":
                alive = fighting = False
            elif r.delta_type == "update" and alive:
                loss, health = health - int(r.m_iHealth), int(r.m_iHealth)
                if loss > 0:
                    if not fighting:
                        out.append((r.tick, r.seq, key[0], "START", loss))
                    fighting, last = True, int(r.tick)
                elif fighting and r.tick - last > cooldown:
                    fighting = False
                    out.append((r.tick, r.seq, key[0], "END", None))
        if alive:
            state.update((alive, health, last, fighting))
        elif state.exists:
            state.remove()
        frame = pd.DataFrame(out, columns=["tick", "seq", "entity_index", "kind", "damage"])
        yield frame.astype({"tick": "int32", "seq": "int64", "entity_index": "int32", "damage": "Int64"})

    return stream.groupBy("entity_index").applyInPandasWithState(step, "tick int, seq bigint, entity_index int, kind string, damage bigint", "alive boolean, health bigint, last int, fighting boolean", "append", GroupStateTimeout.NoTimeout)


def lifecycle(stream: DataFrame) -> DataFrame:
    """Spawn and death rows with the team a life was created with; leave rows don't end it."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        team = state.get[0] if state.exists else None
        out = []
        for r in _sorted(frames).itertuples(index=False):
            if r.delta_type == "create":
                team = int(r.m_iTeamNum)
                out.append((r.tick, r.seq, key[0], "spawn", team))
            elif r.delta_type == "delete" and team is not None:
                out.append((r.tick, r.seq, key[0], "death", team))
                team = None
        if team is not None:
            state.update((team,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["tick", "seq", "entity_index", "kind", "team"]).astype({"tick": "int32", "seq": "int64", "entity_index": "int32", "team": "int64"})

    return stream.groupBy("entity_index").applyInPandasWithState(step, "tick int, seq bigint, entity_index int, kind string, team bigint", "team bigint", "append", GroupStateTimeout.NoTimeout)


def ownership(stream: DataFrame) -> DataFrame:
    """Updates that change a node's team."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        team = state.get[0] if state.exists else None
        out = []
        for r in _sorted(frames).itertuples(index=False):
            if r.delta_type == "create":
                team = int(r.m_iTeamNum)
            elif r.delta_type == "update" and team is not None and team != r.m_iTeamNum:
                out.append((r.tick, r.seq, key[0], team, int(r.m_iTeamNum)))
                team = int(r.m_iTeamNum)
        if team is not None:
            state.update((team,))
        yield pd.DataFrame(out, columns=["tick", "seq", "entity_index", "old_team", "new_team"]).astype({"tick": "int32", "seq": "int64", "entity_index": "int32", "old_team": "int64", "new_team": "int64"})

    return stream.groupBy("entity_index").applyInPandasWithState(step, "tick int, seq bigint, entity_index int, old_team bigint, new_team bigint", "team bigint", "append", GroupStateTimeout.NoTimeout)


def latest_state(stream: DataFrame) -> DataFrame:
    """Last snapshot of each entity; for output mode update or complete."""
    rows = stream.where("delta_type IN ('create', 'update')")
    return rows.groupBy("entity_index").agg(F.max_by(F.struct("tick", F.col("m_iHealth").alias("health"), F.col("m_iTeamNum").alias("team")), F.struct("tick", "seq")).alias("r")).select("entity_index", "r.tick", "r.health", "r.team")


def fan_out(stream: DataFrame, queries: dict[str, Callable[[DataFrame], DataFrame]], sink: Callable[[str, DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Several queries over one pass of a stream: each micro-batch is kept while all of them read it."""

    def run(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for name, query in queries.items():
                sink(name, query(batch), epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stats(query: StreamingQuery) -> dict[str, int]:
    """Rows and micro-batches read so far, and rows the last one left in state."""
    progress = query.recentProgress
    state = [s.numRowsTotal for s in progress[-1].stateOperators] if progress else []
    return {"rows_produced": sum(p.numInputRows for p in progress), "batches": len(progress), "rows_buffered": sum(state)}
