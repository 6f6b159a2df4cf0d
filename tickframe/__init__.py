"""Tick-ordered telemetry logs, queried with Spark."""

from .errors import TelemetryError
from .session import LogSession, QueryHandle, create_spark, from_dataframes, open_log

__all__ = ["LogSession", "QueryHandle", "TelemetryError", "create_spark", "from_dataframes", "open_log"]
