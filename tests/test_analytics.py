"""Edge cases of the log operators on hand-written logs, and the combat windows against the state machine."""

import random

import pytest
from pyspark.sql import functions as F

from tickframe.operators import analytics as A

SCHEMA = "tick int, seq bigint, entity_index int, delta_type string, m_iTeamNum bigint, m_iHealth bigint, m_iMaxHealth bigint, cellX bigint, cellY bigint"


def log(spark, *rows):
    """Rows (tick, entity, kind, team, health)."""
    out = [(t, i, e, k, *((team, h, 100, 10, 20) if k in ("create", "update") else (None,) * 5)) for i, (t, e, k, team, h) in enumerate(rows)]
    return spark.createDataFrame(out, SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_lives_of_a_reused_slot(spark):
    df = log(spark, (1, 5, "update", 2, 1), (2, 5, "create", 2, 9), (3, 5, "delete", None, None), (4, 5, "update", 2, 8), (5, 5, "create", 3, 7), (6, 5, "create", 3, 6))
    assert rows(A.lives(df), "tick", "life_id") == [(2, 1), (3, 1), (5, 2), (6, 3)]


def test_latest_state_ignores_ends(spark):
    df = log(spark, (1, 1, "create", 2, 10), (2, 1, "update", 2, 7), (2, 1, "update", 2, 6), (3, 1, "delete", None, None))
    assert rows(A.latest_state(df), "entity_index", "tick", "health") == [(1, 2, 6)]


def test_state_as_of_a_tick(spark):
    df = log(spark, (-1, 1, "create", 2, 10), (5, 1, "leave", None, None), (6, 2, "create", 3, 4), (7, 2, "update", 3, 3), (9, 2, "update", 3, 1))
    assert rows(A.state_as_of(df, 8), "entity_index", "health") == [(2, 3)]
    assert rows(A.state_as_of(df, 4), "entity_index", "health") == [(1, 10)]


@pytest.mark.parametrize(("gap", "kinds"), [(192, ["START"]), (193, ["START", "END"])])
def test_combat_ends_after_more_than_the_cooldown(spark, gap, kinds):
    df = log(spark, (0, 1, "create", 2, 100), (10, 1, "update", 2, 90), (10 + gap, 1, "update", 2, 90))
    assert [r["kind"] for r in A.combat(df).orderBy("tick").collect()] == kinds


def machine(rows_, cooldown=192):
    heroes, out = {}, []
    for t, s, e, k, h in rows_:
        if k == "create":
            heroes[e] = [h, 0, False]
        elif k == "delete":
            heroes.pop(e, None)
        elif k == "update" and e in heroes:
            x = heroes[e]
            old, x[0] = x[0], h
            if h < old:
                if not x[2]:
                    x[2] = True
                    out.append((t, s, e, "START", old - h))
                x[1] = t
            elif x[2] and t - x[1] > cooldown:
                x[2] = False
                out.append((t, s, e, "END", None))
    return sorted(out, key=repr)


def test_combat_equals_the_state_machine(spark):
    rng = random.Random(3)
    t, out = 0, []
    for _ in range(3000):
        t += rng.choice([0, 1, 5, 40, 120])
        out.append((t, rng.randrange(8), rng.choices(["create", "update", "delete", "leave"], [2, 20, 1, 1])[0], 2, rng.randrange(100)))
    df = log(spark, *out)
    got = sorted((tuple(r) for r in A.combat(df).collect()), key=repr)
    assert got == machine([(t, i, e, k, h) for i, (t, e, k, _, h) in enumerate(out)])


def test_lifecycle_counts_respawns(spark):
    df = log(spark, (1, 1, "create", 2, 9), (2, 1, "create", 2, 9), (3, 1, "delete", None, None), (3, 1, "delete", None, None), (4, 2, "create", 3, 1), (5, 2, "leave", None, None))
    assert rows(A.lifecycle(df), "team", "spawns", "deaths", "active") == [("Amber", 2, 1, 0), ("Sapphire", 1, 0, 1)]


def test_duplicate_snapshots_multiply_hits(spark):
    pawn = log(spark, (5, 1, "create", 2, 9), (5, 1, "update", 2, 8), (5, 2, "delete", None, None))
    damage = spark.createDataFrame([(5, 0, 7, 1, 2), (5, 1, 0, 1, 2), (5, 2, 3, 2, 1)], "tick int, seq bigint, damage int, entindex_victim int, entindex_attacker int")
    assert rows(A.hotspot_grid(damage, pawn), "damage", "events") == [(14, 2)]


def test_flips_count_nodes_over_blocks(spark):
    df = log(spark, (1, 1, "create", 2, 1), (2, 2, "create", 3, 1), (5000, 1, "update", 3, 1), (9000, 1, "update", 3, 1), (9001, 2, "update", 2, 1))
    assert rows(A.ownership_flips(df), "tick", "old_team", "new_team", "n_amber", "n_sapphire") == [(5000, 2, 3, 0, 2), (9001, 3, 2, 1, 1)]


def test_empty_log(spark):
    df = log(spark, (1, 1, "create", 2, 1)).where("false")
    for f in (A.latest_state, A.scoreboard, A.combat, A.lifecycle, A.ownership_flips, A.positions):
        assert f(df).count() == 0


def test_extra_columns_do_no_harm(spark):
    df = log(spark, (1, 1, "create", 2, 9), (2, 1, "update", 2, 5)).withColumn("kind", F.lit("x")).withColumn("damage", F.lit(1)).withColumn("ld", F.lit(0))
    assert A.combat(df).count() == 1
