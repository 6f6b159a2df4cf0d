"""Source type strings to Spark types: a small grammar, the type map, and flattening of vectors to columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError


@dataclass(frozen=True)
class TypeExpr:
    """A parsed type string: a name with an optional template argument, pointer mark or array length."""

    name: str
    argument: TypeExpr | None = None
    pointer: bool = False
    length: int | str | None = None  # a number, or the name of a constant
    element: TypeExpr | None = None  # of an array


_TOKEN = re.compile(r"\s*([A-Za-z_][A-Za-z0-9_:]*|\d+|[<>\[\]*])")


def parse_type(text: str) -> TypeExpr:
    """Grammar: name, then any of `< type >`, `[ length ]`, `*`, applied from left to right."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise SchemaError(f"unexpected character at {at} in type {text!r}")
        tokens.append(m[1])
        at = m.end()

    def take(k: int, what: str) -> int:
        if k >= len(tokens) or (what and tokens[k] != what):
            raise SchemaError(f"{what or 'a name'} expected in type {text!r}")
        return k + 1

    def read(k: int) -> tuple[TypeExpr, int]:
        k = take(k, "")
        name = tokens[k - 1]
        if not re.match(r"[A-Za-z_]", name):
            raise SchemaError(f"a type can't begin with {name!r} in {text!r}")
        out = TypeExpr(name)
        while k < len(tokens) and tokens[k] in "<[*":
            if tokens[k] == "*":
                out, k = TypeExpr(out.name, out.argument, True, element=out.element, length=out.length), k + 1
            elif tokens[k] == "<":
                inner, k = read(k + 1)
                k = take(k, ">")
                out = TypeExpr(out.name, inner, out.pointer)
            else:
                k = take(k + 1, "")
                size = tokens[k - 1]
                k = take(k, "]")
                if size in "<>[]*":
                    raise SchemaError(f"{size!r} is no length in {text!r}")
                out = TypeExpr(out.name, out.argument, out.pointer, int(size) if size.isdigit() else size, out)
        return out, k

    expr, k = read(0)
    if k < len(tokens):
        raise SchemaError(f"{tokens[k]!r} is left over in type {text!r}")
    return expr


#: Source type names by the Spark type they map to.
SCALARS = {
    T.LongType(): ("int8", "int16", "int32", "int64", "Color"),
    T.DecimalType(20, 0): ("uint8", "uint16", "uint32", "uint64", "CEntityIndex"),
    T.FloatType(): ("float32", "float", "GameTime_t", "GameTick_t", "CNetworkedQuantizedFloat"),
    T.DoubleType(): ("float64", "double"),
    T.BooleanType(): ("bool",),
    T.BinaryType(): ("CUtlString", "CUtlStringToken", "CUtlSymbolLarge", "char"),
    T.IntegerType(): ("HSequence", "AbilityID_t", "ItemDefID_t", "HeroID_t"),
}
#: Vector types by their components.
VECTORS = {"xyz": ("Vector", "Vector3D", "VectorWS", "QAngle"), "xy": ("Vector2D",), "xyzw": ("Vector4D", "Quaternion")}
LISTS = ("CNetworkUtlVectorBase", "CUtlVectorEmbeddedNetworkVar")
#: Unsigned types that fit a signed 64-bit integer; used where a column's domain is known to.
NARROW = ("uint8", "uint16", "uint32", "CEntityIndex")

_SCALAR_OF = {name: t for t, names in SCALARS.items() for name in names}
_AXES_OF = {name: axes for axes, names in VECTORS.items() for name in names}


@dataclass(frozen=True)
class Mapped:
    """What a source field becomes: a Spark type, one column an axis, or nothing (a nested serializer)."""

    spark: T.DataType | None
    axes: str = ""

    @property
    def nested(self) -> bool:
        return self.spark is None

    @property
    def suffixes(self) -> tuple[str, ...]:
        return tuple(f"__{a}" for a in self.axes) or ("",)


def map_type(text: str, narrow: bool = False) -> Mapped:
    """The mapping of a source type string. narrow: unsigned types below 64 bits become bigint instead of decimal."""
    try:
        expr = parse_type(text.strip())
    except SchemaError:
        return Mapped(T.BinaryType())
    return _map(expr, narrow)


def _map(e: TypeExpr, narrow: bool) -> Mapped:
    if e.element is not None:
        if e.element.name == "char":
            return Mapped(T.BinaryType())  # one string, not a list of characters
        inner = _map(e.element, narrow)
        return Mapped(T.ArrayType(_element(inner))) if not inner.nested else inner
    if e.argument is not None:
        if e.name in LISTS:
            inner = _map(e.argument, narrow)
            return Mapped(T.ArrayType(_element(inner)))
        if e.name == "CHandle":
            return Mapped(T.LongType())
        if e.name == "CStrongHandle":
            return Mapped(T.DecimalType(20, 0))
    if e.name in _AXES_OF:
        return Mapped(T.FloatType(), _AXES_OF[e.name])
    if narrow and e.name in NARROW:
        return Mapped(T.LongType())
    if e.name in _SCALAR_OF:
        return Mapped(_SCALAR_OF[e.name])
    if re.match(r"C[A-Z]", e.name):
        return Mapped(None)
    return Mapped(T.BinaryType())


def _element(m: Mapped) -> T.DataType:
    if m.axes:
        return T.StructType([T.StructField(a, m.spark) for a in m.axes])
    return m.spark if m.spark is not None else T.NullType()


def flatten(name: str, text: str, value: Column) -> list[tuple[str, Column]]:
    """(column name, column) of each component of a vector-typed array column, or the column itself."""
    m = map_type(text)
    if not m.axes:
        return [(name, value)]
    return [(f"{name}{suffix}", F.get(value, F.lit(k))) for k, suffix in enumerate(m.suffixes)]
