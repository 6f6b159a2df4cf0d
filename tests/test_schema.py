import pytest
from pyspark.sql import types as T

from tickframe.errors import SchemaError
from tickframe.schema.builder import MessageField, SourceField, build_schema, column_name, conform, event_schema, event_tables
from tickframe.schema.types import TypeExpr, map_type, parse_type


def test_grammar():
    assert parse_type("int32") == TypeExpr("int32")
    assert parse_type("CHandle< CBaseEntity >").argument == TypeExpr("CBaseEntity")
    assert parse_type("CBodyComponent*").pointer
    assert parse_type("float32[24]").length == 24
    assert parse_type("uint64[MAX_PLAYERS]").length == "MAX_PLAYERS"
    assert parse_type("A< B< C > >[2]").element.argument.argument == TypeExpr("C")


@pytest.mark.parametrize("bad", ["", "<a>", "a<b", "a[", "a[>]", "a]", "4", "a b"])
def test_bad_types(bad):
    with pytest.raises(SchemaError):
        parse_type(bad)


@pytest.mark.parametrize(
    ("text", "spark_type", "axes"),
    [
        ("int8", T.LongType(), ""), ("uint64", T.DecimalType(20, 0), ""), ("CEntityIndex", T.DecimalType(20, 0), ""), ("float32", T.FloatType(), ""), ("GameTime_t", T.FloatType(), ""), ("double", T.DoubleType(), ""), ("bool", T.BooleanType(), ""),
        ("CUtlString", T.BinaryType(), ""), ("char*", T.BinaryType(), ""), ("char[129]", T.BinaryType(), ""), ("Vector", T.FloatType(), "xyz"), ("QAngle", T.FloatType(), "xyz"), ("Vector2D", T.FloatType(), "xy"), ("Quaternion", T.FloatType(), "xyzw"), ("Color", T.LongType(), ""),
        ("CHandle< CBaseEntity >", T.LongType(), ""), ("CStrongHandle< X >", T.DecimalType(20, 0), ""), ("HeroID_t", T.IntegerType(), ""), ("int32[4]", T.ArrayType(T.LongType()), ""), ("CNetworkUtlVectorBase< uint32 >", T.ArrayType(T.DecimalType(20, 0)), ""), ("CSomething", None, ""), ("somethingElse", T.BinaryType(), ""),
    ],
)
def test_type_map(text, spark_type, axes):
    m = map_type(text)
    assert (m.spark, m.axes, m.nested) == (spark_type, axes, spark_type is None)


def test_narrow_unsigned():
    assert map_type("uint32", narrow=True).spark == T.LongType()
    assert map_type("uint64", narrow=True).spark == T.DecimalType(20, 0)


def test_build_schema():
    inner = SourceField("m_pComp", "CComp*", children=(SourceField("m_cellX", "uint16"), SourceField("m_nested", "COther")))
    s = build_schema("Pawn", [SourceField("m_iHealth", "int32"), SourceField("tick", "int32"), inner, SourceField("m_vec", "Vector"), SourceField("m_id", "HeroID_t", send_node="m_Hero.m_load")])
    assert s.struct.names == ["tick", "entity_index", "delta_type", "m_iHealth", "m_pComp__m_cellX", "m_vec__x", "m_vec__y", "m_vec__z", "m_Hero__m_load__m_id"]
    assert [f.nullable for f in s.struct.fields[:4]] == [False, False, False, True]
    assert s.paths["m_pComp__m_cellX"] == "m_pComp.m_cellX"
    assert column_name("a", "", "b.c") == "a__b__c"


def test_first_name_wins_and_vectors_are_all_or_nothing():
    s = build_schema("", [SourceField("v__y", "bool"), SourceField("v", "Vector"), SourceField("v__y", "int32")])
    assert s.name == "unknown"
    assert s.struct.names[3:] == ["v__y"] and s.struct["v__y"].dataType == T.BooleanType()


def test_depth_is_cut():
    f = SourceField("leaf", "bool")
    for k in range(7):
        f = SourceField(f"p{k}", "CComp*", children=(f, SourceField(f"own{k}", "bool")))
    names = build_schema("D", [f]).struct.names
    assert "p6__own6" in names and not any(n.endswith("leaf") for n in names)


def test_events():
    s = event_schema([MessageField("damage", "int32"), MessageField("tick", "int32"), MessageField("flags", "uint64", repeated=True), MessageField("pos", "message", fields=(MessageField("x", "float"),)), MessageField("kind", "enum")])
    assert s.names == ["tick", "damage", "flags", "pos", "kind"]
    assert s["flags"].dataType == T.ArrayType(T.DecimalType(20, 0)) and s["pos"].dataType["x"].dataType == T.FloatType()
    assert not s["tick"].nullable and s["kind"].dataType == T.IntegerType()
    with pytest.raises(SchemaError):
        event_schema([MessageField("x", "group")])
    ids = {"k_EUserMsg_Damage": 300, "k_EUserMsg_None": 1, "k_EUserMsg_Chat": 2, "other": 3}
    assert list(event_tables(ids, {"CCitadelUserMsg_Damage", "CCitadelUserMessage_Chat", "CCitadelUserMsg_other"}).items()) == [("ChatEvent", "CCitadelUserMessage_Chat"), ("DamageEvent", "CCitadelUserMsg_Damage")]


def test_conform(spark):
    df = spark.createDataFrame([(1, 2**32 + 5, bytearray(b"\xff"), [1])], "tick int, n bigint, s binary, l array<int>")
    want = T.StructType().add("tick", T.IntegerType()).add("n", T.IntegerType()).add("s", T.StringType()).add("l", T.ArrayType(T.IntegerType())).add("gone", T.DoubleType())
    assert tuple(conform(df, want).first()) == (1, 5, None, [1], None)
    assert conform(df, want, compat=True).first()["l"] is None
