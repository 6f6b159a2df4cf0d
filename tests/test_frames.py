"""Framing and bits against bytes made by hand, and files read through Spark."""

import random

import pytest

from tickframe.errors import DecodeError
from tickframe.functions import scalars
from tickframe.functions.bits import Bits, BitsOut
from tickframe.sources import frames

HEAD = b"PBDEMS2\0" + (1000).to_bytes(4, "little") + (-1).to_bytes(4, "little", signed=True)


def test_file_by_hand():
    # a packet at tick 300 of two bytes, a sign-on packet before the match, and a packed packet: raw snappy, one literal of 3 bytes
    data = HEAD + bytes([7, 0xAC, 0x02, 2]) + b"ab" + bytes([8, 0xFF, 0xFF, 0xFF, 0xFF, 0x0F, 0]) + bytes([7 | 64, 5, 5, 3, 2 << 2]) + b"xyz"
    assert frames.file_offsets(data) == (1000, -1)
    assert list(frames.file_frames(data)) == [frames.Frame(16, "Packet", 300, False, b"ab"), frames.Frame(22, "SignonPacket", -1, False, b""), frames.Frame(29, "Packet", 5, True, b"xyz")]


def test_fragment_by_hand():
    data = bytes([7]) + (-1).to_bytes(4, "little", signed=True) + b"\x09" + (2).to_bytes(4, "little") + b"ab" + bytes([4, 1, 0, 0, 0, 0, 6, 0, 0, 0]) + b"skipDE"
    assert list(frames.fragment_frames(data)) == [frames.Frame(0, "Packet", -1, False, b"ab"), frames.Frame(12, "SendTables", 1, False, b"DE")]
    assert list(frames.fragment_frames(b"")) == []


@pytest.mark.parametrize("data", [b"", b"HL2DEMO\0" + bytes(8), HEAD[:12], HEAD + b"\x07", HEAD + bytes([7, 1, 9]) + b"ab", HEAD + bytes([63, 1, 0]), HEAD + bytes([7 | 64, 5, 2, 9, 9]), HEAD + b"\x80" * 6])
def test_broken_files(data):
    with pytest.raises(DecodeError):
        list(frames.file_frames(data))


@pytest.mark.parametrize("data", [b"\x07", bytes([7, 0, 0, 0, 0, 0, 3, 0, 0, 0]) + b"ab", bytes([99, 0, 0, 0, 0, 0, 0, 0, 0, 0])])
def test_broken_fragments(data):
    with pytest.raises(DecodeError):
        list(frames.fragment_frames(data))


def test_files_are_read_through_spark(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for k in range(3):
        rows = [(rng.choice(frames.COMMANDS), rng.choice([-1, 0, 5, 1 << 20]), rng.randbytes(rng.choice([0, 1, 5000])) * 3, rng.random() < 0.5) for _ in range(40)]
        (tmp_path / f"{k}.dem").write_bytes(frames.write_file(rows))
        want += rows
    got = [(r.cmd, r.tick, bytes(r.body), r.compressed) for r in frames.read_replays(spark, f"{tmp_path}/*.dem").collect()]
    assert sorted(got) == sorted(want)
    none = spark.createDataFrame([(None,)], "content binary")
    assert frames.unframed(none).count() == 0


def test_bits_by_hand():
    r = Bits(bytes([0b10110101, 0b00000011]))
    assert (r.take(3), r.flag(), r.take(6), r.left) == (0b101, False, 0b111011, 6)
    assert r.take(0) == 0
    with pytest.raises(DecodeError):
        r.take(7)
    assert Bits(b"\xac\x02").uvarint() == 300
    assert [Bits(bytes([b])).varint() for b in range(5)] == [0, -1, 1, -2, 2]
    assert Bits(b"\xff\xff\xff\xff\x0f").uvarint(32) == 0xFFFFFFFF
    with pytest.raises(DecodeError):
        Bits(b"\xff" * 10).uvarint(32)
    assert Bits(b"\x00\x00\x80\x3f").float32() == 1.0
    assert (Bits(b"ab\0c").text(), Bits(b"a\nb\0").text(line=True), Bits(b"a\nb\0").text()) == (b"ab", b"a", b"a\nb")
    assert Bits(b"\x40").angle(8) == 90.0


def test_short_numbers_and_field_numbers():
    assert [Bits(BitsOut().short(v).bytes()).short() for v in (0, 15, 16, 255, 256, 4095, 4096, (1 << 32) - 1)] == [0, 15, 16, 255, 256, 4095, 4096, (1 << 32) - 1]
    assert Bits(bytes([0b010101, 0b0000])).short() == 0b0101
    assert Bits(bytes([0b11010101, 0b11])).short() == 0xF5
    values = (0, 3, 4, 15, 16, 1023, 1024, (1 << 17) - 1, 1 << 17, (1 << 31) - 1)
    assert tuple(Bits(BitsOut().field_number(v).bytes()).field_number() for v in values) == values
    assert Bits(bytes([0b101])).field_number() == 2


def test_coordinates_and_unit_vectors():
    for v in (0.0, 1.0, -1.0, 16384.0, 0.5, -0.03125, 100.75, -16383.96875):
        assert Bits(BitsOut().coord(v).bytes()).coord() == v
    out = BitsOut().put(0b101, 3).coord(2.5).coord(-7.0)
    assert Bits(out.bytes()).coords() == [2.5, 0.0, -7.0]
    assert Bits(BitsOut().put(0, 2).put(1, 1).bytes()).normals() == [0.0, 0.0, -1.0]
    x = Bits(BitsOut().put(0b01, 2).put(1, 1).put(2047, 11).put(0, 1).bytes()).normals()
    assert x[0] == pytest.approx(-1.0) and x[1:] == [0.0, pytest.approx(0.0, abs=1e-3)]


def test_divisors_are_exact_and_null(spark):
    big = (1 << 62) - 2
    df = spark.createDataFrame([(big, 2), (None, 3), (-4, 6), (0, 0), (0, 5)], "a bigint, b bigint")
    got = [tuple(r) for r in df.select(scalars.gcd("a", "b"), scalars.lcm("a", "b")).collect()]
    assert got == [(2, big), (None, None), (2, 12), (0, 0), (5, 0)]
    with pytest.raises(Exception, match="beyond bigint"):
        spark.createDataFrame([(big, big - 1)], "a bigint, b bigint").select(scalars.lcm("a", "b")).collect()
    scalars.register(spark)
    assert spark.sql("SELECT gcd(12, 18) AS g, lcm(4, CAST(NULL AS BIGINT)) AS l").first() == (6, None)
