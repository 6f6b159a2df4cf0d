"""Query sessions over a log: register queries, start once, read Arrow batches."""

from __future__ import annotations

import asyncio
import logging
import uuid
from collections.abc import AsyncIterator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from .errors import AlreadyStarted, ArrowError, NoQueries, QueryError, SessionError, query_error
from .functions import scalars
from .plans import safety
from .plans.tables import require_query
from .sources import changelog

log = logging.getLogger(__name__)
BATCH_SIZE = 1024


def create_spark(app: str = "tickframe", **conf: str) -> SparkSession:
    """A Spark session in which the logs' SQL runs as written: quoted mixed-case names, UTC, adaptive plans."""
    builder = SparkSession.builder.appName(app)
    base = {
        "spark.sql.ansi.enabled": "true",  # without it double quotes make texts, whatever the next setting says
        "spark.sql.ansi.doubleQuotedIdentifiers": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


class QueryHandle:
    """The result of one registered query: its schema at once, its batches after the session has started."""

    def __init__(self, session: LogSession, df: DataFrame, sql: str):
        self._session, self.df, self.sql = session, df, sql
        self.stats = {"batches": 0, "rows": 0}
        self._tag = f"{session._tag}-{uuid.uuid4().hex}"

    @property
    def schema(self) -> pa.Schema:
        return to_arrow_schema(self.df.schema)

    def __iter__(self) -> Iterator[pa.RecordBatch]:
        """Batches of at most the session's batch size; partitions are fetched one after the other, not all at once.

        The jobs carry the session's tag and the handle's, whichever thread iterates; leaving early cancels them.
        """
        self._session._running()
        most = self._session.batch_size

        def pack(batches):
            for b in batches:
                for at in range(0, b.num_rows, most):
                    part = b.slice(at, most)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    yield pa.record_batch({"ipc": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        context, tags, ended = self._session.spark.sparkContext, (self._session._tag, self._tag), False
        for t in tags:
            context.addJobTag(t)
        try:
            rows = self.df.mapInArrow(pack, "ipc binary").toLocalIterator()
        finally:
            for t in tags:
                context.removeJobTag(t)
        try:
            for row in rows:
                if self._session._closed:
                    return
                try:
                    batches = list(pa.ipc.open_stream(bytes(row["ipc"])))
                except pa.ArrowInvalid as e:
                    raise ArrowError(str(e)) from e
                for b in batches:
                    self.stats["batches"] += 1
                    self.stats["rows"] += b.num_rows
                    yield b
            ended = True
        finally:
            if not ended:
                context.cancelJobsWithTag(self._tag)

    async def __aiter__(self) -> AsyncIterator[pa.RecordBatch]:
        it, end = iter(self), object()
        while (b := await asyncio.to_thread(next, it, end)) is not end:
            yield b

    def to_arrow(self) -> pa.Table:
        return pa.Table.from_batches(list(self), self.schema)


class LogSession:
    """Queries over the tables of one log.

    batch: any query runs. strict: queries whose plans hold back their output are refused when they are added. Each query
    reads the columns and rows it needs; nothing is kept between them, so a log of any size fills no disk.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], *, batch_size: int = BATCH_SIZE, reject_pipeline_breakers: bool = False):
        if batch_size < 1:
            raise SessionError("batch_size must be positive")
        self.spark, self.batch_size, self.strict = spark, batch_size, reject_pipeline_breakers
        self._tables = tables
        self._handles: list[QueryHandle] = []
        self._started = self._closed = False
        self._tag = f"tickframe-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    @property
    def schemas(self) -> dict[str, pa.Schema]:
        return {n: to_arrow_schema(df.schema) for n, df in self._tables.items()}

    def get_tables(self) -> list[str]:
        return sorted(self._tables)

    def get_schema(self, table: str) -> pa.Schema | None:
        df = self._tables.get(table)
        return to_arrow_schema(df.schema) if df is not None else None

    def add_query(self, sql: str) -> QueryHandle:
        """Plan a query at once: unknown tables or columns and bad syntax fail here, and so does all that is no query."""
        self._open()
        if self._started:
            raise AlreadyStarted("queries can't be added after start")
        try:
            require_query(self.spark, sql)
            df = self.spark.sql(sql)
            df.schema  # noqa: B018  analyses the plan
        except QueryError:
            raise
        except Exception as e:
            raise query_error(e) from e
        found = safety.analyze(df)
        if not found.streaming_safe:
            if self.strict:
                safety.require_streaming_safe(df)
            log.info("%s", found.report())
        handle = QueryHandle(self, df, sql)
        self._handles.append(handle)
        return handle

    def start(self) -> None:
        self._open()
        if self._started:
            raise AlreadyStarted("the session has started")
        if not self._handles:
            raise NoQueries("no queries registered")
        self._started = True

    def cancel(self) -> None:
        """Stop the jobs of all handles, on whichever threads they were begun."""
        self._closed = True
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def close(self) -> None:
        self._closed = True

    def _open(self) -> None:
        if self._closed:
            raise SessionError("the session is closed")

    def _running(self) -> None:
        self._open()
        if not self._started:
            raise SessionError("the session has not started")

    def __enter__(self) -> LogSession:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    async def __aenter__(self) -> LogSession:
        return self

    async def __aexit__(self, *exc) -> None:
        self.close()


def _own(spark: SparkSession) -> SparkSession:
    """A Spark session of its own on the same cluster: its settings, views and functions are not the caller's."""
    own = spark.newSession()
    own.conf.set("spark.sql.ansi.enabled", "true")  # plans taken over keep the mode that they were analysed in
    own.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    own.conf.set("spark.sql.session.timeZone", "UTC")
    scalars.register(own)
    return own


def open_log(path: str, *, spark: SparkSession | None = None, batch_size: int = BATCH_SIZE, reject_pipeline_breakers: bool = False) -> LogSession:
    """A session over a change log's directory, in a Spark session of its own."""
    spark = _own(spark or SparkSession.builder.appName("tickframe").getOrCreate())  # create_spark() would change a caller's settings
    names = changelog.tables(spark, path)
    return LogSession(spark, {n: changelog.read_table(spark, path, n) for n in names}, batch_size=batch_size, reject_pipeline_breakers=reject_pipeline_breakers)


def from_dataframes(tables: dict[str, DataFrame], *, batch_size: int = BATCH_SIZE, reject_pipeline_breakers: bool = False) -> LogSession:
    """A session over DataFrames of one Spark session; their plans are taken over into a Spark session of its own."""
    if not tables:
        raise SessionError("no tables")
    spark = _own(next(iter(tables.values())).sparkSession)
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    own = {n: DataFrame(rows(spark._jsparkSession, df._jdf.queryExecution().analyzed()), spark) for n, df in tables.items()}
    return LogSession(spark, own, batch_size=batch_size, reject_pipeline_breakers=reject_pipeline_breakers)
