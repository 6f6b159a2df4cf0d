"""Column functions of the game clock, world and handles, and a few scalars Spark has no name for."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TICKS_PER_SECOND = 64.0
#: Bits of a handle that hold the entity's slot, and the handle of no entity.
HANDLE_SLOT = (1 << 14) - 1
HANDLE_NONE = (1 << 24) - 1


def game_seconds(tick: Column) -> Column:
    return tick / F.lit(TICKS_PER_SECOND)


def world(cell: Column, cell_width: float = 128.0, offset: Column | float = 0.0) -> Column:
    """World coordinate of a grid cell (128 wide in the analytics, 512 in the library's own helper) plus an offset in it."""
    return cell * F.lit(cell_width) - F.lit(16384.0) + offset


def team_name(team: Column) -> Column:
    return F.when(team == 2, "Amber").when(team.isNotNull(), "Sapphire")


def lane_of(x: Column) -> Column:
    return F.when(x < -1530, "Yellow").when(x > 1530, "Green").when(x.isNotNull(), "Blue")


def handle_slot(handle: Column) -> Column:
    """Entity slot of a handle, null for the handle of no entity."""
    return F.when(handle != HANDLE_NONE, handle.bitwiseAND(HANDLE_SLOT))


def event_time(tick: Column) -> Column:
    """A timestamp for a tick: 64 ticks a second after a base past the epoch, so that tick 0 is no late row."""
    return F.timestamp_micros(F.lit(1704067200000000) + tick.cast("bigint") * 15625)


def date_bin(seconds: int, ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def _whole(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two columns without their nulls (as zeros), and where either is null."""
    null = pc.or_(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    x, y = (np.abs(pc.fill_null(v.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)) for v in (a, b))
    if (x < 0).any() or (y < 0).any():
        raise OverflowError("no divisor of the least bigint")
    return x, y, null


@F.arrow_udf(T.LongType())
def gcd(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y, null = _whole(a, b)
    return pa.array(np.gcd(x, y), pa.int64(), mask=null)


@F.arrow_udf(T.LongType())
def lcm(a: pa.Array, b: pa.Array) -> pa.Array:
    x, y, null = _whole(a, b)
    steps = x // np.maximum(np.gcd(x, y), 1)
    if (steps > np.iinfo(np.int64).max // np.maximum(y, 1)).any():
        raise OverflowError("a least common multiple beyond bigint")
    return pa.array(steps * y, pa.int64(), mask=null)


@F.pandas_udf(T.StringType())
def blake2b(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else hashlib.blake2b(v.encode() if isinstance(v, str) else v).hexdigest())


@F.pandas_udf(T.StringType())
def blake2s(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else hashlib.blake2s(v.encode() if isinstance(v, str) else v).hexdigest())


def register(spark) -> None:
    """Make the functions without a built-in known to SQL."""
    for name, f in (("gcd", gcd), ("lcm", lcm), ("blake2b", blake2b), ("blake2s", blake2s)):
        spark.udf.register(name, f)
