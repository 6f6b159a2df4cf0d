"""Values packed in the bits of a message, the lowest bit of a byte first: reader and writer."""

from __future__ import annotations

import math
import struct

import numpy as np

from ..errors import DecodeError

#: Bits of a coordinate's whole and fractional part, of a unit vector's component, and of short field numbers.
COORD_WHOLE, COORD_PART, NORMAL_PART = 14, 5, 11
FIELD_WIDTHS = (2, 4, 10, 17, 31)
#: Further bits of a short unsigned number, by the two high ones of its first six.
SHORT_MORE = (0, 4, 8, 28)


class Bits:
    """Reads a message's values one after the other; reading past its end is a DecodeError."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    @property
    def left(self) -> int:
        return self.end - self.at

    def take(self, n: int) -> int:
        stop = self.at + n
        if stop > self.end:
            raise DecodeError(f"{n} bits wanted, {self.left} left")
        word = int.from_bytes(self.data[self.at >> 3 : stop + 7 >> 3], "little")
        value = word >> (self.at & 7) & (1 << n) - 1
        self.at = stop
        return value

    def flag(self) -> bool:
        return self.take(1) == 1

    def raw(self, n: int) -> bytes:
        return self.take(8 * n).to_bytes(n, "little")

    def uvarint(self, bits: int = 64) -> int:
        """Seven bits a byte, the high one says that more follow."""
        value = 0
        for shift in range(0, bits, 7):
            byte = self.take(8)
            value |= (byte & 127) << shift
            if byte < 128:
                return value & (1 << bits) - 1
        raise DecodeError("a number goes on for too many bytes")

    def varint(self, bits: int = 64) -> int:
        """Signs alternate: 0, -1, 1, -2, ..."""
        value = self.uvarint(bits)
        return -(value + 1 >> 1) if value & 1 else value >> 1

    def short(self) -> int:
        head = self.take(6)
        return head & 15 | self.take(SHORT_MORE[head >> 4]) << 4

    def field_number(self) -> int:
        """A width is chosen by the first set flag of four; none set: the largest."""
        k = next((k for k in range(len(FIELD_WIDTHS) - 1) if self.flag()), len(FIELD_WIDTHS) - 1)
        return self.take(FIELD_WIDTHS[k])

    def float32(self) -> float:
        return struct.unpack("<f", self.raw(4))[0]

    def coord(self) -> float:
        whole, part = self.flag(), self.flag()
        if not (whole or part):
            return 0.0
        negative = self.flag()
        value = (self.take(COORD_WHOLE) + 1 if whole else 0) + (self.take(COORD_PART) if part else 0) / (1 << COORD_PART)
        return -value if negative else float(value)

    def normal(self) -> float:
        negative = self.flag()
        value = np.float32(self.take(NORMAL_PART)) * (np.float32(1) / np.float32((1 << NORMAL_PART) - 1))
        return float(-value if negative else value)

    def coords(self) -> list[float]:
        there = [self.flag() for _ in "xyz"]
        return [self.coord() if t else 0.0 for t in there]

    def normals(self) -> list[float]:
        """A unit vector: z follows from x and y but for its sign."""
        there = [self.flag() for _ in "xy"]
        x, y = (self.normal() if t else 0.0 for t in there)
        negative = self.flag()
        rest = np.float32(1) - (np.float32(x) * np.float32(x) + np.float32(y) * np.float32(y))
        z = float(np.sqrt(rest)) if rest > 0 else 0.0
        return [x, y, -z if negative else z]

    def angle(self, n: int) -> float:
        return float(np.float32(self.take(n)) * np.float32(360 / (1 << n)))

    def text(self, line: bool = False) -> bytes:
        """Bytes before a zero byte, or before a line's end too."""
        out = bytearray()
        while (byte := self.take(8)) and not (line and byte == 10):
            out.append(byte)
        return bytes(out)


class BitsOut:
    """Writes what Bits reads."""

    def __init__(self):
        self.word = self.n = 0

    def put(self, value: int, n: int) -> BitsOut:
        self.word |= (value & (1 << n) - 1) << self.n
        self.n += n
        return self

    def uvarint(self, value: int) -> BitsOut:
        while value > 127:
            self.put(value & 127 | 128, 8)
            value >>= 7
        return self.put(value, 8)

    def varint(self, value: int) -> BitsOut:
        return self.uvarint(-2 * value - 1 if value < 0 else 2 * value)

    def short(self, value: int) -> BitsOut:
        kind = next(k for k, more in enumerate(SHORT_MORE) if value < 1 << 4 + more)
        return self.put(value & 15 | kind << 4, 6).put(value >> 4, SHORT_MORE[kind])

    def field_number(self, value: int) -> BitsOut:
        k = next(k for k, width in enumerate(FIELD_WIDTHS) if value < 1 << width)
        last = len(FIELD_WIDTHS) - 1
        return (self.put(0, last) if k == last else self.put(1 << k, k + 1)).put(value, FIELD_WIDTHS[k])

    def coord(self, value: float) -> BitsOut:
        """The nearest coordinate toward zero."""
        part, whole = math.modf(abs(value))
        part, whole = int(part * (1 << COORD_PART)), int(whole)
        self.put(whole > 0, 1).put(part > 0, 1)
        if whole or part:
            self.put(value < 0, 1)
        if whole:
            self.put(whole - 1, COORD_WHOLE)
        return self.put(part, COORD_PART) if part else self

    def bytes(self) -> bytes:
        return self.word.to_bytes(-(-self.n // 8), "little")
