"""Framed replays: a file's header and commands, a broadcast fragment's commands, as rows of (cmd, tick, body).

Each command's length stands in its own head, so one file is one task; a log of many files is read in parallel. What is in
the bodies needs message definitions, which are not part of this package.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import DecodeError

#: A file's first bytes, followed by two offsets; the bit of a command whose body is compressed; a fragment's head.
STAMP = b"PBDEMS2\0"
OFFSETS = struct.Struct("<ii")
COMPRESSED = 64
FRAGMENT_HEAD = struct.Struct("<BixI")
#: Bytes of a fragment's send tables that are not part of them.
FRAGMENT_TABLES_SKIP = 4
#: Commands by their numbers.
COMMANDS = (
    "Stop", "FileHeader", "FileInfo", "SyncTick", "SendTables", "ClassInfo", "StringTables", "Packet", "SignonPacket", "ConsoleCmd",
    "CustomData", "CustomDataCallbacks", "UserCmd", "FullPacket", "SaveGame", "SpawnGroups", "AnimationData", "AnimationHeader", "Recovery",
)
SCHEMA = "position bigint, cmd string, tick int, compressed boolean, body binary"
#: Bytes of bodies in one batch of rows.
BATCH_BYTES = 4 << 20


@dataclass(frozen=True)
class Frame:
    position: int
    cmd: str
    tick: int
    compressed: bool
    body: bytes


def _command(number: int, at: int) -> str:
    if number >= len(COMMANDS):
        raise DecodeError(f"unknown command {number} at {at}")
    return COMMANDS[number]


def _uvarint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for k in range(5):
        if at + k >= len(data):
            raise DecodeError(f"a command's head breaks off at {at + k}")
        value |= (data[at + k] & 127) << 7 * k
        if data[at + k] < 128:
            return value & 0xFFFFFFFF, at + k + 1
    raise DecodeError(f"a number goes on for too many bytes at {at}")


def _body(data: bytes, at: int, size: int) -> bytes:
    if at + size > len(data):
        raise DecodeError(f"a command's body of {size} bytes breaks off at {len(data)}")
    return data[at : at + size]


def _signed(tick: int) -> int:
    return tick - (1 << 32) if tick >> 31 else tick


def file_offsets(data: bytes) -> tuple[int, int]:
    """Offsets of the file information and of the spawn groups, from a file's header."""
    if data[: len(STAMP)] != STAMP:
        raise DecodeError(f"no replay: it begins with {data[:len(STAMP)]!r}")
    if len(data) < len(STAMP) + OFFSETS.size:
        raise DecodeError("the header breaks off")
    return OFFSETS.unpack_from(data, len(STAMP))


def file_frames(data: bytes) -> Iterator[Frame]:
    """Commands of a file in order; compressed bodies are unpacked. Ticks before the match are -1."""
    file_offsets(data)
    at = len(STAMP) + OFFSETS.size
    while at < len(data):
        position = at
        raw, at = _uvarint(data, at)
        tick, at = _uvarint(data, at)
        size, at = _uvarint(data, at)
        body, at = _body(data, at, size), at + size
        packed = bool(raw & COMPRESSED)
        if packed:
            length, _ = _uvarint(body, 0)
            try:
                body = pa.Codec("snappy").decompress(body, length, asbytes=True)
            except (OSError, pa.ArrowInvalid) as e:
                raise DecodeError(f"the body at {position} can't be unpacked: {e}") from e
        yield Frame(position, _command(raw & ~COMPRESSED, position), _signed(tick), packed, body)


def fragment_frames(data: bytes) -> Iterator[Frame]:
    """Commands of a broadcast fragment in order; their bodies are never compressed."""
    at = 0
    while at < len(data):
        if at + FRAGMENT_HEAD.size > len(data):
            raise DecodeError(f"a command's head breaks off at {len(data)}")
        number, tick, size = FRAGMENT_HEAD.unpack_from(data, at)
        cmd, body = _command(number, at), _body(data, at + FRAGMENT_HEAD.size, size)
        yield Frame(at, cmd, tick, False, body[FRAGMENT_TABLES_SKIP:] if cmd == "SendTables" else body)
        at += FRAGMENT_HEAD.size + size


def _varint_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def write_file(rows: Iterator[tuple[str, int, bytes, bool]]) -> bytes:
    """A file of commands (cmd, tick, body, compressed), without offsets."""
    out = bytearray(STAMP + OFFSETS.pack(0, 0))
    for cmd, tick, body, packed in rows:
        body = pa.Codec("snappy").compress(body, asbytes=True) if packed else body
        out += _varint_bytes(COMMANDS.index(cmd) | COMPRESSED * packed) + _varint_bytes(tick & 0xFFFFFFFF) + _varint_bytes(len(body)) + body
    return bytes(out)


def write_fragment(rows: Iterator[tuple[str, int, bytes]]) -> bytes:
    """A broadcast fragment of commands (cmd, tick, body)."""
    out = bytearray()
    for cmd, tick, body in rows:
        body = bytes(FRAGMENT_TABLES_SKIP) + body if cmd == "SendTables" else body
        out += FRAGMENT_HEAD.pack(COMMANDS.index(cmd), tick, len(body)) + body
    return bytes(out)


def framed(rows: DataFrame, fragment: bool = False) -> DataFrame:
    """Files, or fragments, of the rows' commands (cmd, tick, body, compressed): one for each Arrow batch."""

    def run(batches):
        for b in batches:
            columns = ("cmd", "tick", "body") if fragment else ("cmd", "tick", "body", "compressed")
            commands = zip(*(b.column(c).to_pylist() for c in columns))
            yield pa.record_batch([pa.array([(write_fragment if fragment else write_file)(commands)], pa.binary())], ["content"])

    return rows.select("cmd", "tick", "body", "compressed").mapInArrow(run, "content binary")


def unframed(files: DataFrame, fragment: bool = False) -> DataFrame:
    """The commands of each `content` of files or fragments, in batches of bounded size; null content has none."""
    types = [pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.binary()]
    names = ["position", "cmd", "tick", "compressed", "body"]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                content = b.column("content")[k].as_py()
                rows, held = [], 0
                for f in (fragment_frames if fragment else file_frames)(content) if content is not None else ():
                    rows.append((f.position, f.cmd, f.tick, f.compressed, f.body))
                    held += len(f.body)
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("content").mapInArrow(run, SCHEMA)


def read_replays(spark: SparkSession, path: str) -> DataFrame:
    """Commands of all replay files under a path, in any file system that Spark reads; a file is held by its task as a whole."""
    return unframed(spark.read.format("binaryFile").load(path))
