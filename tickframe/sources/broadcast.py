"""Live broadcasts over HTTP: the client's states and retries, and a streaming data source with a fragment a partition.

A broadcast offers /sync (metadata as JSON), /{signup}/start, /{n}/full and /{n}/delta. Fragments hold change-log rows as
JSON lines; other encodings are decoded by a function given to the client.
"""

from __future__ import annotations

import http.client
import json
import logging
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..errors import DecodeError, SourceIOError


@dataclass(frozen=True)
class ClientConfig:
    """Seconds, but for delta_retries."""

    delta_retries: int = 5
    sync_timeout: float = 30.0
    start_timeout: float = 30.0
    backoff_base: float = 0.5
    backoff_max: float = 4.0
    request_timeout: float = 30.0

    def backoff(self, attempt: int) -> float:
        """Delay before the next try: doubling from the base on, four times at most, up to the limit."""
        return min(self.backoff_base * 2 ** min(max(attempt - 1, 0), 4), self.backoff_max)


@dataclass(frozen=True)
class SyncInfo:
    tick: int = 0
    endtick: int = 0
    maxtick: int = 0
    rtdelay: float = 0.0
    rcvage: float = 0.0
    fragment: int = 0
    signup_fragment: int = 0
    tps: int = 0
    keyframe_interval: int = 0
    map: str = ""
    protocol: int = 0

    @classmethod
    def parse(cls, body: bytes) -> SyncInfo:
        raw = json.loads(body)
        return cls(**{f.name: raw[f.name] for f in fields(cls)})


SYNC_SCHEMA = T.StructType([T.StructField(f.name, {"int": T.LongType(), "float": T.DoubleType(), "str": T.StringType()}[f.type]) for f in fields(SyncInfo)])


class Cancelled(SourceIOError):
    """The client was told to stop."""


class BodyError(OSError):
    """A request was answered, but its body broke off."""


def http_get(url: str, timeout: float) -> tuple[int, bytes]:
    """(status, body); connection failures raise OSError, bodies that break off BodyError."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            try:
                return r.status, r.read()
            except (OSError, http.client.HTTPException) as e:
                raise BodyError(f"{url}: {e!r}") from e
    except urllib.error.HTTPError as e:
        return e.code, b""


class BroadcastClient:
    """START, then one full frame, then deltas until one stays missing."""

    def __init__(self, url: str, config: ClientConfig = ClientConfig(), get: Callable[[str, float], tuple[int, bytes]] = http_get, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, cancelled: Callable[[], bool] = lambda: False):
        self.url, self.config, self.get, self.sleep, self.clock, self.cancelled = url.rstrip("/"), config, get, sleep, clock, cancelled
        self.info: SyncInfo | None = None
        self.skipped = 0

    def _try(self, url: str) -> tuple[int, bytes]:
        if self.cancelled():
            raise Cancelled("cancelled")
        return self.get(url, self.config.request_timeout)

    def _until(self, url: str, timeout: float, parse: Callable[[bytes], object]):
        """Retry with growing delays until parse accepts a body."""
        began, attempt = self.clock(), 0
        while self.clock() - began < timeout:
            attempt += 1
            try:
                status, body = self._try(url)
                if status == 200:
                    return parse(body)
            except (OSError, ValueError, KeyError, TypeError) as e:
                if isinstance(e, Cancelled):
                    raise
            self.sleep(self.config.backoff(attempt))
        raise SourceIOError(f"broadcast not ready: {url}")

    def sync(self) -> SyncInfo:
        self.info = self._until(f"{self.url}/sync", self.config.sync_timeout, SyncInfo.parse)
        return self.info

    def start(self) -> bytes:
        info = self.info or self.sync()
        return self._until(f"{self.url}/{info.signup_fragment}/start", self.config.start_timeout, lambda b: b)

    def fragment(self, number: int, kind: str) -> bytes | None:
        """A fragment's body; None if it stays missing. A delta whose body breaks off is skipped (empty) and counted."""
        info = self.info or self.sync()
        for attempt in range(self.config.delta_retries + 1):
            try:
                status, body = self._try(f"{self.url}/{number}/{kind}")
            except OSError as e:
                if kind != "delta" or not isinstance(e, BodyError):
                    raise SourceIOError(f"fragment {number}/{kind}: {e}") from e
                self.skipped += 1
                logging.getLogger(__name__).warning("fragment %d/%s skipped, %d so far: %s", number, kind, self.skipped, e)
                return b""
            if status == 200:
                return body
            if status != 404:
                raise SourceIOError(f"fragment {number}/{kind}: HTTP {status}")
            if attempt < self.config.delta_retries:
                self.sleep(info.keyframe_interval)
        return None

    def packets(self) -> Iterator[tuple[str, int, bytes]]:
        """(kind, fragment, body) from the start on; the start packet comes once."""
        info = self.sync()
        yield "start", info.signup_fragment, self.start()
        full = self.fragment(info.fragment, "full")
        if full is None:
            return
        yield "full", info.fragment, full
        number = info.fragment
        while (body := self.fragment(number, "delta")) is not None:
            yield "delta", number, body
            number += 1


def json_rows(body: bytes, schema: T.StructType) -> Iterator[tuple]:
    for line in body.splitlines():
        if line.strip():
            try:
                row = json.loads(line)
            except ValueError as e:
                raise DecodeError(f"bad row in fragment: {line[:80]!r}") from e
            yield tuple(row.get(f.name) for f in schema.fields)


@dataclass
class Fragment(InputPartition):
    number: int
    kind: str


class BroadcastStream(DataSourceStreamReader):
    """Offsets are fragment numbers; a micro-batch reads its fragments in parallel, the first one also start and full."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def client(self) -> BroadcastClient:
        return BroadcastClient(self.options["url"], ClientConfig(delta_retries=int(self.options.get("deltaRetries", 5))))

    def initialOffset(self) -> dict:
        return {"fragment": -1}

    def latestOffset(self) -> dict:
        return {"fragment": self.client().sync().fragment}

    def partitions(self, start: dict, end: dict) -> list[Fragment]:
        info = self.client().sync()
        if start["fragment"] < 0:
            return [Fragment(info.signup_fragment, "start"), Fragment(end["fragment"], "full"), Fragment(end["fragment"], "delta")]
        return [Fragment(n, "delta") for n in range(start["fragment"] + 1, end["fragment"] + 1)]

    def read(self, partition: Fragment) -> Iterator[tuple]:
        client = self.client()
        body = client.start() if partition.kind == "start" else client.fragment(partition.number, partition.kind)
        if body is None:
            raise SourceIOError(f"fragment {partition.number} is gone")  # fails loudly: a silent gap would corrupt the log
        yield from json_rows(body, self.schema)

    def commit(self, end: dict) -> None:
        pass


class BroadcastSource(DataSource):
    """spark.readStream.format("telemetry_broadcast").schema(...).option("url", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "telemetry_broadcast"

    def schema(self) -> str:
        return "tick int, seq bigint, entity_index int, delta_type string"

    def streamReader(self, schema: T.StructType) -> BroadcastStream:
        return BroadcastStream(schema, dict(self.options))
