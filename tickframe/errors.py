"""The exception tree of the session API."""

from __future__ import annotations


class TelemetryError(Exception):
    """Base of all errors raised by this package."""


class SourceIOError(TelemetryError):
    """A log could not be read (missing path, failed download)."""


class SchemaError(TelemetryError):
    """A table's schema could not be discovered or built."""


class ArrowError(TelemetryError):
    """A result could not be turned into Arrow batches."""


class DecodeError(TelemetryError):
    """A broadcast or log fragment could not be decoded."""


class SessionError(TelemetryError):
    """The session's life cycle was violated."""


class AlreadyStarted(SessionError):
    """Queries can't be added, nor the session started, once it runs."""


class NoQueries(SessionError):
    """The session was started without a query."""


class QueryError(TelemetryError):
    """A SQL text could not be planned or run; `kind` refines it."""

    def __init__(self, message: str, kind: str = "other"):
        super().__init__(message)
        self.kind = kind


class PipelineBreakerError(QueryError):
    """A plan needs all its input before its first row; `analysis` tells where."""

    def __init__(self, analysis):
        super().__init__(analysis.report(), "pipeline_breaker")
        self.analysis = analysis


#: Spark's error conditions by what went wrong.
_KINDS = {
    "PARSE_SYNTAX_ERROR": "syntax",
    "UNRESOLVED_COLUMN": "field_not_found",
    "AMBIGUOUS_REFERENCE": "ambiguous",
    "AMBIGUOUS_COLUMN_OR_FIELD": "ambiguous",
    "DUPLICATED": "duplicate",
    "TABLE_OR_VIEW_NOT_FOUND": "invalid_table",
    "UNSUPPORTED": "not_implemented",
    "NOT_SUPPORTED": "not_implemented",
}


def query_error(e: Exception) -> QueryError:
    """The QueryError for an exception of Spark's parser or analyzer."""
    condition = (getattr(e, "getCondition", lambda: None)() or getattr(e, "getErrorClass", lambda: None)() or "") or ""
    kind = next((k for prefix, k in _KINDS.items() if prefix in condition), "other")
    return QueryError(str(e).split("\n\nJVM stacktrace")[0], kind)
