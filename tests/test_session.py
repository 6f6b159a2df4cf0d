import asyncio

import pyarrow as pa
import pytest
from duck import same
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tickframe import create_spark, from_dataframes, open_log
from tickframe.errors import AlreadyStarted, NoQueries, PipelineBreakerError, QueryError, SessionError, SourceIOError
from tickframe.plans import catalog
from tickframe.plans.safety import analyze
from tickframe.plans.tables import extract_table_names
from tickframe.sources import adapter, changelog


@pytest.fixture(scope="module")
def root(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("log"))
    changelog.write_table(adapter.pawn(spark, sf), root, "PawnLog")
    changelog.write_table(adapter.damage(spark, sf), root, "DamageEvent", ticks_per_part=200)
    return root


@pytest.fixture
def session(spark, root):
    with open_log(root, spark=spark, batch_size=100) as s:
        yield s


def test_catalog(session):
    assert session.get_tables() == ["DamageEvent", "PawnLog"]
    assert session.get_schema("PawnLog").names[:4] == ["tick", "seq", "entity_index", "delta_type"]
    assert session.get_schema("nope") is None
    assert set(session.schemas) == {"DamageEvent", "PawnLog"}
    assert "entity_index" not in session.get_schema("DamageEvent").names


def test_quoted_names_and_batches(session):
    h = session.add_query('SELECT tick, "m_iHealth", "m_iHealth" > 0 AS alive FROM PawnLog WHERE delta_type <> \'leave\'')
    assert h.schema.names == ["tick", "m_iHealth", "alive"]
    session.start()
    batches = list(h)
    assert all(isinstance(b, pa.RecordBatch) and b.num_rows <= 100 for b in batches)
    assert sum(b.num_rows for b in batches) == h.df.count() == h.stats["rows"]
    assert session.get_tables() == ["DamageEvent", "PawnLog"]


def test_limit_is_exact(session):
    h = session.add_query("SELECT tick FROM PawnLog LIMIT 37")
    session.start()
    assert h.to_arrow().num_rows == 37


def test_two_queries_read_what_they_need(session):
    a = session.add_query("SELECT tick FROM PawnLog WHERE delta_type = 'create'")
    b = session.add_query("SELECT d.tick, p.entity_index FROM DamageEvent d JOIN PawnLog p ON d.tick = p.tick")
    session.start()
    plan = session.spark.sql(a.sql)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" not in plan and "m_iHealth" not in plan
    assert a.to_arrow().num_rows > 0 and b.to_arrow().num_rows > 0


@pytest.mark.parametrize("sql", ["DROP VIEW PawnLog", "CREATE VIEW v AS SELECT 1", "INSERT INTO PawnLog SELECT * FROM PawnLog", "WITH w AS (SELECT 1) INSERT INTO PawnLog SELECT * FROM w", "SET spark.sql.ansi.enabled = false", "SHOW TABLES", "EXPLAIN SELECT 1", "CACHE TABLE PawnLog", "DELETE FROM PawnLog", "BEGIN SELECT 1; END", "DESCRIBE PawnLog"])
def test_only_queries_are_accepted(session, sql):
    with pytest.raises(QueryError):
        session.add_query(sql)
    h = session.add_query("SELECT count(*) AS n FROM PawnLog")
    session.start()
    assert h.to_arrow().to_pydict()["n"][0] > 0


def test_leaving_early_cancels(session):
    h = session.add_query("SELECT tick FROM PawnLog")
    session.start()
    it = iter(h)
    assert next(it).num_rows > 0
    it.close()
    assert not session.spark.sparkContext.getJobTags()
    assert h.to_arrow().num_rows == h.df.count()


def test_cancel_reaches_other_threads(session):
    import threading
    import time

    h = session.add_query("SELECT p.tick FROM PawnLog p, PawnLog q, PawnLog r, PawnLog s WHERE p.seq + q.seq + r.seq + s.seq < -1")
    session.start()
    ended = []

    def run():
        try:
            ended.append(list(h))
        except Exception as e:  # a cancelled job fails
            ended.append(e)

    t = threading.Thread(target=run)
    t.start()
    time.sleep(8)
    assert t.is_alive()
    session.cancel()
    t.join(60)
    assert not t.is_alive() and ended


def test_async(session):
    h = session.add_query("SELECT tick FROM DamageEvent")

    async def run():
        async with session as s:
            s.start()
            return [b.num_rows async for b in h]

    assert sum(asyncio.run(run())) > 0
    with pytest.raises(SessionError):
        session.add_query("SELECT 1")


def test_life_cycle(session):
    with pytest.raises(NoQueries):
        session.start()
    h = session.add_query("SELECT 1 AS one")
    with pytest.raises(SessionError):
        list(h)
    session.start()
    with pytest.raises(AlreadyStarted):
        session.start()
    with pytest.raises(AlreadyStarted):
        session.add_query("SELECT 1")


@pytest.mark.parametrize(("sql", "kind"), [("SELEC 1", "syntax"), ("SELECT nope FROM PawnLog", "field_not_found"), ("SELECT 1 FROM Nope", "invalid_table"), ("SELECT seq FROM PawnLog a JOIN PawnLog b ON a.tick = b.tick", "ambiguous")])
def test_errors_come_when_added(session, sql, kind):
    with pytest.raises(QueryError) as e:
        session.add_query(sql)
    assert e.value.kind == kind


def test_missing_log(spark):
    with pytest.raises(SourceIOError):
        open_log("/nowhere/at/all", spark=spark)


def test_strict_refuses_breakers(spark, root):
    with open_log(root, spark=spark, reject_pipeline_breakers=True) as s:
        with pytest.raises(PipelineBreakerError) as e:
            s.add_query("SELECT count(*) FROM DamageEvent")
        assert "Aggregate at depth 0" in str(e.value)
        s.add_query("SELECT tick, max(damage) FROM DamageEvent GROUP BY tick")
        s.add_query("SELECT tick FROM DamageEvent ORDER BY tick")
        s.add_query("SELECT d.tick FROM DamageEvent d JOIN PawnLog p ON d.tick = p.tick")


def test_from_dataframes(spark, sf):
    with from_dataframes({"D": adapter.damage(spark, sf)}) as s:
        h = s.add_query("SELECT sum(damage) AS n FROM D")
        s.start()
        assert h.to_arrow().to_pydict()["n"][0] > 0
    assert not spark.catalog.tableExists("D")


def test_from_dataframes_runs_the_logs_sql(spark, sf):
    base = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "false")
    try:
        with from_dataframes({"D": adapter.damage(spark, sf)}) as s:
            h = s.add_query('SELECT "tick", gcd(damage, 4) AS g FROM D')
            s.start()
            got = h.to_arrow()
    finally:
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", base)
    assert got.schema.names == ["tick", "g"] and all(isinstance(x, int) for x in got["tick"].to_pylist())
    with pytest.raises(SessionError):
        from_dataframes({})


@pytest.fixture
def legacy(spark):
    """A session that is set up without ANSI mode, so are sessions that come of it; the thread's active one has it off too."""
    key = "spark.sql.ansi.enabled"
    base = spark.conf.get(key)
    own = SparkSession(spark.sparkContext, spark._jvm.org.apache.spark.sql.classic.SparkSession(spark._jsc.sc(), {key: "false"}))
    assert own.newSession().conf.get(key) == "false"
    spark.conf.set(key, "false")
    try:
        yield own
    finally:
        spark.conf.set(key, base)


def test_quoted_identifiers_of_a_plain_session(spark, sf):
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    base = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        same(catalog.QUERIES["quoted_identifiers"](spark, sf), catalog.ORACLE_SQL["quoted_identifiers"], sf)
    finally:
        spark.conf.set(key, base)


def test_quoted_identifiers_without_ansi_mode(legacy, sf):
    same(catalog.QUERIES["quoted_identifiers"](legacy, sf), catalog.ORACLE_SQL["quoted_identifiers"], sf)


def test_taken_over_plans_keep_their_mode(legacy):
    df = legacy.sql("SELECT id AS `Id`, cast('x' AS int) AS n, 1 / (id - 1) AS d, cast(id + 2147483647 AS int) + 1 AS i FROM range(2)")
    with from_dataframes({"T": df}) as s:
        h = s.add_query('SELECT "Id", n, d, i FROM T ORDER BY "Id"')
        s.start()
        assert h.to_arrow().to_pylist() == [r.asDict() for r in df.orderBy("Id").collect()] == [{"Id": 0, "n": None, "d": -1.0, "i": -2147483648}, {"Id": 1, "n": None, "d": None, "i": -2147483647}]


def test_logs_read_quoted_names_without_ansi_mode(spark, legacy, root):
    for given in (legacy, None):
        with open_log(root, spark=given) as s:
            assert s.add_query('SELECT "tick", "m_iHealth" AS "Health Points" FROM "PawnLog"').schema.types == [pa.int32(), pa.int64()]
            assert extract_table_names(s.spark, 'SELECT * FROM "PawnLog"') == ["PawnLog"]
    for caller in (spark, legacy):  # they are as they were
        assert caller.conf.get("spark.sql.ansi.enabled") == "false" and caller.sql('SELECT "id" FROM range(3)').first()[0] == "id"
        with pytest.raises(QueryError):
            extract_table_names(caller, 'SELECT * FROM "PawnLog"')


def test_create_spark_reads_quoted_names(legacy):
    assert create_spark("tests").sql('SELECT "id" FROM range(3)').first()[0] == 0


def test_analysis(spark):
    t = spark.range(5).select(F.col("id").cast("int").alias("tick"), F.lit(1).alias("value"))
    t.createOrReplaceTempView("t_analysis")
    q = lambda s: analyze(spark.sql(s))
    assert q("SELECT tick FROM t_analysis WHERE value > 0").streaming_safe
    assert q("SELECT tick FROM t_analysis UNION ALL SELECT value FROM t_analysis LIMIT 3").streaming_safe
    a = q("SELECT value FROM (SELECT value, tick FROM t_analysis ORDER BY value) WHERE tick > 0")
    assert [b.operator for b in a.breakers] == ["Sort"] and a.breakers[0].path.startswith("Project -> Filter") and a.breakers[0].depth == 2
    # only the root cause: the aggregate above a sort is held back by it anyway
    assert [b.operator for b in q("SELECT count(*) FROM (SELECT * FROM t_analysis ORDER BY value)").breakers] == ["Sort"]
    for sql in ("SELECT DISTINCT value FROM t_analysis", "SELECT row_number() OVER (ORDER BY value) FROM t_analysis", "SELECT value FROM t_analysis EXCEPT SELECT tick FROM t_analysis", "SELECT * FROM t_analysis a LEFT JOIN t_analysis b ON a.tick = b.tick", "SELECT * FROM t_analysis a JOIN t_analysis b ON a.tick < b.tick"):
        assert not q(sql).streaming_safe, sql
    assert "ok" in q("SELECT 1").report() and "Sort at depth" in a.report()


@pytest.mark.parametrize(
    ("sql", "names"),
    [
        ("SELECT * FROM A", ["A"]),
        ("SELECT * FROM B UNION ALL SELECT * FROM A UNION ALL SELECT * FROM B", ["A", "B"]),
        ("SELECT * FROM A a JOIN db.B b ON a.x = b.x", ["A", "B"]),
        ("SELECT * FROM (SELECT * FROM C) x", ["C"]),
        ("WITH w AS (SELECT * FROM D) SELECT * FROM w", ["D", "w"]),
        ("SELECT (SELECT max(x) FROM E) FROM A WHERE x IN (SELECT x FROM F)", ["A"]),
        ("INSERT INTO G SELECT * FROM A", ["A", "G"]),
    ],
)
def test_table_names(spark, sql, names):
    assert extract_table_names(spark, sql) == names


def test_bad_sql_has_no_tables(spark):
    with pytest.raises(QueryError):
        extract_table_names(spark, "SELECT * FROM (SELECT")
