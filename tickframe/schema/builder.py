"""Table schemas from serializers and event messages: flattening, naming and collision rules as pure functions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from .types import map_type

#: Levels of nested components below which fields are cut.
MAX_DEPTH = 5
BASE = (
    T.StructField("tick", T.IntegerType(), False),
    T.StructField("entity_index", T.IntegerType(), False),
    T.StructField("delta_type", T.StringType(), False),
)


@dataclass(frozen=True)
class SourceField:
    """A serializer's field: children are the fields of the component a pointer field refers to."""

    name: str
    type: str
    send_node: str = ""
    children: tuple[SourceField, ...] = ()


@dataclass
class TableSchema:
    name: str
    struct: T.StructType
    #: For each column after the base ones: the path of the source field it comes from.
    paths: dict[str, str] = field(default_factory=dict)


def column_name(*parts: str) -> str:
    """Path parts joined by dots, dots written as double underscores."""
    return ".".join(p for p in parts if p).replace(".", "__")


def build_schema(name: str, fields: list[SourceField], narrow: bool = False) -> TableSchema:
    """The change-log schema of a serializer.

    Pointer fields are followed to MAX_DEPTH; nested serializers without a pointer make no column. The first of two equal
    names wins, base columns cannot be shadowed, and a vector one of whose columns is taken makes none.
    """
    if not name:
        name = "unknown"
    out = TableSchema(name, T.StructType(list(BASE)))
    taken = {f.name for f in BASE}

    def add(f: SourceField, prefix: str, depth: int) -> None:
        path = ".".join(p for p in (prefix, f.send_node, f.name) if p)
        if f.children:
            if depth < MAX_DEPTH:
                for child in f.children:
                    add(child, path, depth + 1)
            return
        mapped = map_type(f.type, narrow)
        if mapped.nested:
            return
        names = [column_name(path) + suffix for suffix in mapped.suffixes]
        if taken & set(names):
            return
        taken.update(names)
        for n in names:
            out.struct.add(n, mapped.spark, True)
            out.paths[n] = path

    for f in fields:
        add(f, "", 0)
    return out


#: Kinds of message fields by the Spark type they map to.
MESSAGE_KINDS = {
    T.IntegerType(): ("int32", "sint32", "sfixed32", "enum"),
    T.LongType(): ("int64", "sint64", "sfixed64", "uint32", "fixed32"),
    T.DecimalType(20, 0): ("uint64", "fixed64"),
    T.FloatType(): ("float",),
    T.DoubleType(): ("double",),
    T.BooleanType(): ("bool",),
    T.StringType(): ("string",),
    T.BinaryType(): ("bytes",),
}
_KIND_OF = {k: t for t, kinds in MESSAGE_KINDS.items() for k in kinds}


@dataclass(frozen=True)
class MessageField:
    name: str
    kind: str
    repeated: bool = False
    fields: tuple[MessageField, ...] = ()


def message_type(f: MessageField) -> T.DataType:
    if f.kind == "message":
        inner: T.DataType = T.StructType([T.StructField(x.name, message_type(x), True) for x in f.fields])
    elif f.kind in _KIND_OF:
        inner = _KIND_OF[f.kind]
    else:
        raise SchemaError(f"unknown kind {f.kind!r} of message field {f.name!r}")
    return T.ArrayType(inner, True) if f.repeated else inner


def event_schema(fields: list[MessageField]) -> T.StructType:
    """Schema of an event table: tick first and never null, message fields all nullable; a field named tick is skipped."""
    out = T.StructType([T.StructField("tick", T.IntegerType(), False)])
    seen = {"tick"}
    for f in fields:
        if f.name not in seen:
            seen.add(f.name)
            out.add(f.name, message_type(f), True)
    return out


#: How the messages of a short event name may be called, in the order in which they are tried.
MESSAGE_NAMES = ("CCitadelUserMsg_{}", "CCitadelUserMessage_{}", "CCitadelUserMsg{}")


def event_tables(ids: dict[str, int], messages: set[str], prefix: str = "k_EUserMsg_") -> dict[str, str]:
    """Event table name to message name, in order of message ids; ids without a message are left out."""
    forms = MESSAGE_NAMES
    out = {}
    for name in sorted(ids, key=ids.get):
        short = name.removeprefix(prefix)
        found = next((m for m in (form.format(short) for form in forms) if m in messages), None)
        if name.startswith(prefix) and found:
            out[f"{short}Event"] = found
    return out


def conform(rows: DataFrame, schema: T.StructType, compat: bool = False) -> DataFrame:
    """Rows with exactly the schema's columns: missing ones null, integers wrapped and not failed on.

    compat: list columns are nulled, as decoders that cannot fill them do.
    """
    have = set(rows.columns)

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`") if f.name in have else F.lit(None)
        if compat and isinstance(f.dataType, T.ArrayType):
            c = F.lit(None)
        if f.name in have and isinstance(f.dataType, T.IntegerType) and isinstance(rows.schema[f.name].dataType, T.LongType):
            low = c.bitwiseAND(0xFFFFFFFF)  # two's complement, whatever spark.sql.ansi.enabled says
            c = F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low)
        if f.name in have and isinstance(f.dataType, T.StringType) and isinstance(rows.schema[f.name].dataType, T.BinaryType):
            return F.expr(f"try_validate_utf8(cast(`{f.name}` as string))").alias(f.name)
        return c.cast(f.dataType).alias(f.name)

    return rows.select(*(one(f) for f in schema.fields))
