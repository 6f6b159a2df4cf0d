"""Analytics over tick-ordered logs as DataFrame plans.

Change logs have tick, seq, entity_index, delta_type and data columns that are null on delete and leave. Slots are
reused: what belongs together is a life, from a create to the next one. Order is always (tick, seq); windows are
partitioned by entity, so plans shuffle once on the entity and every later window reuses that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import game_seconds, lane_of, team_name, world

COOLDOWN = 192


def _order(*by: str):
    return Window.partitionBy(*by).orderBy("tick", "seq")


def _so_far(*by: str):
    return _order(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lives(log: DataFrame, terminal: tuple[str, ...] = ("delete",), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The log's rows that belong to a life, with life_id; rows before a first create or after a terminal row go."""
    kept = log.where(F.col("delta_type").isin(*keep)) if keep else log
    numbered = kept.withColumn("life_id", F.sum((F.col("delta_type") == "create").cast("int")).over(_so_far("entity_index"))).where("life_id > 0")
    before = _order("entity_index", "life_id").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.max(F.col("delta_type").isin(*terminal).cast("int")).over(before), F.lit(0))
    return numbered.withColumn("__ended", ended).where("__ended = 0").drop("__ended")


def hits(damage: DataFrame, pawn: DataFrame) -> DataFrame:
    """Damage events with the victim's snapshots of the same tick; every snapshot of the tick matches."""
    p = pawn.where("cellX IS NOT NULL").select("tick", F.col("entity_index").alias("entindex_victim"), "cellX", "cellY")
    return damage.where("damage > 0").join(p, ["tick", "entindex_victim"])


def hotspot_grid(damage: DataFrame, pawn: DataFrame, side: float = 1000.0) -> DataFrame:
    grid = lambda c: F.floor(world(F.col(c)) / side).cast("bigint")
    return hits(damage, pawn).groupBy(grid("cellX").alias("grid_x"), grid("cellY").alias("grid_y")).agg(F.sum("damage").cast("bigint").alias("damage"), F.count(F.lit(1)).alias("events"))


def quadrants(grid: DataFrame) -> DataFrame:
    west, south = F.col("grid_x") < -13, F.col("grid_y") < -13
    name = F.when(west & south, "Northwest").when(west, "Southwest").when(south, "Northeast").otherwise("Southeast")
    by = grid.groupBy(name.alias("location")).agg(F.sum("damage").cast("bigint").alias("damage"), F.sum("events").cast("bigint").alias("events"))
    total = F.sum("damage").over(Window.partitionBy())
    return by.withColumn("pct", F.round(F.when(total == 0, F.lit(0.0)).otherwise(F.col("damage") * 100.0 / total), 4))


def top_cells(grid: DataFrame, n: int = 5) -> DataFrame:
    return grid.orderBy(F.desc("damage"), "grid_x", "grid_y").limit(n)


def game_duration(damage: DataFrame, pawn: DataFrame) -> DataFrame:
    return hits(damage, pawn).agg(game_seconds(F.max("tick")).alias("seconds"))


def latest_state(log: DataFrame) -> DataFrame:
    """Last create or update of each entity; no sort, one partial aggregate a task."""
    row = F.max_by(F.struct("tick", F.col("m_iHealth").alias("health"), F.col("m_iTeamNum").alias("team")), F.struct("tick", "seq"))
    return log.where("delta_type IN ('create', 'update')").groupBy("entity_index").agg(row.alias("r")).select("entity_index", "r.tick", "r.health", "r.team")


def state_as_of(log: DataFrame, tick: int) -> DataFrame:
    """Entities alive at the end of a tick, with their last snapshot."""
    rows = lives(log.where(F.col("tick") <= tick), ("delete", "leave"))
    last = rows.groupBy("entity_index").agg(F.max_by(F.struct("delta_type", "tick", "m_iHealth", "m_iTeamNum"), F.struct("tick", "seq")).alias("r"))
    return last.where("r.delta_type IN ('create', 'update')").select("entity_index", "r.tick", F.col("r.m_iHealth").alias("health"), F.col("r.m_iTeamNum").alias("team"))


def scoreboard(log: DataFrame, every: int = 1920) -> DataFrame:
    """Each entity's last snapshot at the end of every period, carried over periods without one."""
    rows = log.where("delta_type IN ('create', 'update')").withColumn("bucket", F.floor(F.col("tick") / every).cast("bigint"))
    last = rows.groupBy("entity_index", "bucket").agg(F.max_by(F.struct("m_iTeamNum", "m_iHealth"), F.struct("tick", "seq")).alias("r"))
    end = F.broadcast(rows.agg(F.max("bucket").alias("end")))  # one row
    until = F.coalesce(F.lead("bucket").over(Window.partitionBy("entity_index").orderBy("bucket")) - 1, F.col("end"))
    return last.crossJoin(end).withColumn("until", until).select("entity_index", "r", F.explode(F.sequence("bucket", "until")).alias("bucket")).select("bucket", "entity_index", F.col("r.m_iTeamNum").alias("team"), F.col("r.m_iHealth").alias("health"))


def positions(log: DataFrame) -> DataFrame:
    return log.where("delta_type IN ('create', 'update')").select("tick", "entity_index", team_name(F.col("m_iTeamNum")).alias("team"), world(F.col("cellX")).alias("world_x"), world(F.col("cellY")).alias("world_y"))


def combat(log: DataFrame, cooldown: int = COOLDOWN) -> DataFrame:
    """START at a life's first loss of health after a pause, END at the first quiet row more than cooldown ticks after the last loss."""
    rows = lives(log, ("delete",), ("create", "update", "delete")).where("delta_type <> 'delete'")
    life = _order("entity_index", "life_id")
    loss = F.lag("m_iHealth").over(life) - F.col("m_iHealth")
    rows = rows.withColumn("damage", F.when((F.col("delta_type") == "update") & (loss > 0), loss))
    hit_tick = F.when(F.col("damage").isNotNull(), F.col("tick"))
    rows = rows.withColumn("ld", F.last(hit_tick, ignorenulls=True).over(life.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("p_tick", F.lag("tick").over(life)).withColumn("p_hit", F.lag(F.col("damage").isNotNull()).over(life))
    start = F.col("damage").isNotNull() & (F.col("ld").isNull() | (~F.col("p_hit") & (F.col("p_tick") - F.col("ld") > cooldown)))
    quiet = (F.col("delta_type") == "update") & F.col("damage").isNull()
    end = quiet & (F.col("tick") - F.col("ld") > cooldown) & (F.col("p_hit") | (F.col("p_tick") - F.col("ld") <= cooldown))
    kind = F.when(start, "START").when(end, "END")
    return rows.withColumn("kind", kind).where("kind IS NOT NULL").select("tick", "seq", "entity_index", "kind", "damage")


def damage_rows(log: DataFrame) -> DataFrame:
    """Every loss of health, with the share of health left after it."""
    rows = lives(log, ("delete",), ("create", "update", "delete")).where("delta_type <> 'delete'")
    rows = rows.withColumn("damage", F.lag("m_iHealth").over(_order("entity_index", "life_id")) - F.col("m_iHealth"))
    pct = F.when(F.col("m_iMaxHealth") > 0, F.round(F.col("m_iHealth") * 100.0 / F.col("m_iMaxHealth"), 4)).otherwise(F.lit(0.0))
    return rows.where("delta_type = 'update' AND damage > 0").select("tick", "seq", "entity_index", "damage", pct.alias("pct_left"))


def lifecycle(log: DataFrame) -> DataFrame:
    """Spawns, deaths and living by the team and lane a life was created with; leave rows don't end a life."""
    rows = lives(log, ("delete",), ("create", "update", "delete"))
    by = rows.groupBy("entity_index", "life_id").agg(F.min_by(F.struct("m_iTeamNum", "cellX"), F.struct("tick", "seq")).alias("c"), F.max((F.col("delta_type") == "delete").cast("int")).alias("dead"))
    last = F.max("life_id").over(Window.partitionBy("entity_index"))
    by = by.withColumn("living", ((F.col("dead") == 0) & (F.col("life_id") == last)).cast("int"))
    return by.groupBy(team_name(F.col("c.m_iTeamNum")).alias("team"), lane_of(world(F.col("c.cellX"))).alias("lane")).agg(F.count(F.lit(1)).alias("spawns"), F.sum("dead").cast("bigint").alias("deaths"), F.sum("living").cast("bigint").alias("active"))


def objectives(tables: dict[str, DataFrame]) -> DataFrame:
    """Spawns, destructions and changes of health over several entity tables, tagged by type."""
    tagged = None
    for name, df in tables.items():
        one = df.withColumn("type", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one, allowMissingColumns=True)
    rows = tagged.where("delta_type IN ('create', 'update', 'delete')")
    key = ("type", "entity_index")
    rows = rows.withColumn("life_id", F.sum((F.col("delta_type") == "create").cast("int")).over(_so_far(*key)))
    life = _order(*key, "life_id")
    ended = F.coalesce(F.max((F.col("delta_type") == "delete").cast("int")).over(life.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("known", (F.col("life_id") > 0) & (ended == 0)).withColumn("old_health", F.lag("m_iHealth").over(life)).withColumn("top", F.first("m_iMaxHealth").over(life))
    changed = F.col("known") & (F.col("delta_type") == "update") & (F.col("m_iHealth") != F.col("old_health"))
    kind = F.when(F.col("delta_type") == "create", "spawn").when(F.col("delta_type") == "delete", "destroyed").when(changed, "change")
    is_change = F.col("kind") == "change"
    pct = F.when(F.col("top") > 0, F.round(F.col("m_iHealth") * 100.0 / F.col("top"), 4)).otherwise(F.lit(0.0))
    out = rows.withColumn("kind", kind).where("kind IS NOT NULL")
    return out.select("type", "entity_index", "tick", "seq", "kind", F.when(is_change, F.col("old_health")).alias("old_health"), F.col("m_iHealth").alias("new_health"), F.when(is_change, F.col("old_health") - F.col("m_iHealth")).alias("damage"), F.when(is_change, pct).alias("pct"))


def running(rows: DataFrame, values: list[str], block: Column) -> DataFrame:
    """Running totals of values over the whole log in order of (tick, seq), without one task for the whole log.

    block must grow with the tick. Totals run within blocks; each block starts from the sum of those before it, of which
    there is one row a block.
    """
    rows = rows.withColumn("__block", block)
    sums = rows.groupBy("__block").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("__block", *(F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values))
    inside = _so_far("__block")
    out = rows
    for v in values:
        out = out.withColumn(v, F.sum(v).over(inside))
    return out.join(ahead, "__block").withColumns({v: F.col(v) + F.col(f"__{v}") for v in values}).drop("__block", *(f"__{v}" for v in values))


def ownership_flips(log: DataFrame) -> DataFrame:
    """Updates that change a node's team, with its lane at creation and how many nodes each team then holds."""
    rows = log.where("delta_type IN ('create', 'update')").withColumn("life_id", F.sum((F.col("delta_type") == "create").cast("int")).over(_so_far("entity_index"))).where("life_id > 0")
    life = _order("entity_index", "life_id")
    rows = rows.withColumn("lane", lane_of(world(F.first("cellX").over(life)))).withColumn("old_team", F.lag("m_iTeamNum").over(life))
    # what the slot held before, in this life or the one a new create replaces
    rows = rows.withColumn("held", F.lag("m_iTeamNum").over(_order("entity_index")))
    is_ = lambda c, t: (F.col(c).eqNullSafe(F.lit(t))).cast("int")
    rows = rows.withColumn("n_amber", is_("m_iTeamNum", 2) - is_("held", 2)).withColumn("n_sapphire", is_("m_iTeamNum", 3) - is_("held", 3))
    moved = rows.where((F.col("delta_type") == "create") | (F.col("old_team") != F.col("m_iTeamNum")))
    total = running(moved, ["n_amber", "n_sapphire"], F.floor(F.col("tick") / 4096))
    return total.where("delta_type = 'update'").select("tick", "seq", "entity_index", "lane", "old_team", F.col("m_iTeamNum").alias("new_team"), F.col("n_amber").cast("bigint").alias("n_amber"), F.col("n_sapphire").cast("bigint").alias("n_sapphire"))


def summary(log: DataFrame, damage: DataFrame) -> DataFrame:
    """By team: heroes alive, deaths (of the last known team); total damage and last tick of the whole match."""
    rows = lives(log, ("delete",), ("create", "update", "delete"))
    by = rows.groupBy("entity_index", "life_id").agg(F.max_by("m_iTeamNum", F.when(F.col("delta_type") != "delete", F.struct("tick", "seq"))).alias("m_iTeamNum"), F.max((F.col("delta_type") == "delete").cast("int")).alias("dead"))
    by = by.withColumn("living", ((F.col("dead") == 0) & (F.col("life_id") == F.max("life_id").over(Window.partitionBy("entity_index")))).cast("int"))
    teams = by.groupBy(team_name(F.col("m_iTeamNum")).alias("team")).agg(F.sum("living").cast("bigint").alias("alive"), F.sum("dead").cast("bigint").alias("deaths"))
    whole = F.broadcast(damage.agg(F.coalesce(F.sum("damage"), F.lit(0)).cast("bigint").alias("total_damage")).crossJoin(log.agg(F.max("tick").alias("last_tick"))))  # one row
    return teams.crossJoin(whole)


def asof_health(damage: DataFrame, log: DataFrame) -> DataFrame:
    """The victim's last known snapshot at or before each hit: one union, one shuffle on the entity, no range join."""
    snap = log.where("delta_type IN ('create', 'update')").select("entity_index", "tick", "seq", F.lit(0).alias("is_event"), F.col("m_iHealth").alias("health"), F.lit(None).cast("int").alias("damage"))
    hit = damage.select(F.col("entindex_victim").alias("entity_index"), "tick", "seq", F.lit(1).alias("is_event"), F.lit(None).cast("bigint").alias("health"), "damage")
    by = Window.partitionBy("entity_index").orderBy("tick", "is_event", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return snap.unionByName(hit).withColumn("health", F.last("health", ignorenulls=True).over(by)).where("is_event = 1").select("seq", "tick", F.col("entity_index").alias("victim"), "damage", "health")
