"""Streams give what their batch twins give."""

import json

import pytest
from pyspark.sql import functions as F

from tickframe.errors import SourceIOError
from tickframe.operators import analytics
from tickframe.sources import adapter, broadcast, changelog
from tickframe.streaming import ops


@pytest.fixture(scope="module")
def root(spark, sf, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stream"))
    pawn = adapter.pawn(spark, sf)
    pawn.repartitionByRange(3, "tick").sortWithinPartitions("tick", "seq").write.parquet(f"{root}/Pawn")
    adapter.damage(spark, sf).coalesce(1).write.parquet(f"{root}/Damage")
    return root


def pawn(spark, root, tmp):
    """Files in tick order, one a micro-batch."""
    files = sorted((f.min_tick, f.file) for f in spark.read.parquet(f"{root}/Pawn").groupBy(F.input_file_name().alias("file")).agg(F.min("tick").alias("min_tick")).collect())
    import os
    import shutil

    for k, (_, f) in enumerate(files):
        shutil.copy(f.removeprefix("file://"), tmp / f"{k}.parquet")
        os.utime(tmp / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(spark.read.parquet(f"{root}/Pawn").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_combat(spark, sf, root, tmp_path):
    drain(ops.combat(pawn(spark, root, tmp_path)), "s_combat")
    same(spark.table("s_combat"), analytics.combat(adapter.pawn(spark, sf)))


def test_lifecycle(spark, sf, root, tmp_path):
    q = drain(ops.lifecycle(pawn(spark, root, tmp_path)), "s_life")
    got = {(r.kind, r.team): r.n for r in spark.table("s_life").groupBy("kind", "team").agg(F.count("*").alias("n")).collect()}
    for r in analytics.lifecycle(adapter.pawn(spark, sf)).groupBy("team").agg(F.sum("spawns").alias("s"), F.sum("deaths").alias("d")).collect():
        team = 2 if r.team == "Amber" else 3
        assert (got.get(("spawn", team), 0), got.get(("death", team), 0)) == (r.s, r.d)
    assert ops.stats(q)["rows_produced"] == adapter.pawn(spark, sf).count()


def test_ownership(spark, sf, root, tmp_path):
    changing = lambda df: df.withColumn("m_iTeamNum", F.when(F.col("m_iTeamNum").isNotNull(), 2 + F.col("seq") % 2))
    drain(ops.ownership(changing(pawn(spark, root, tmp_path))), "s_own")
    want = analytics.ownership_flips(changing(adapter.pawn(spark, sf))).select("tick", "seq", "entity_index", "old_team", "new_team")
    same(spark.table("s_own"), want)


def test_latest_state(spark, sf, root, tmp_path):
    drain(ops.latest_state(pawn(spark, root, tmp_path)), "s_latest", "complete")
    same(spark.table("s_latest"), analytics.latest_state(adapter.pawn(spark, sf)))


def test_tick_join(spark, sf, root, tmp_path):
    d = changelog.read_stream(spark, root, "Damage").select("tick", "damage", F.col("seq").alias("d_seq"))
    p = pawn(spark, root, tmp_path).select("tick", "entity_index")
    drain(ops.tick_join(d, p), "s_join")
    want = adapter.damage(spark, sf).select("tick", "damage", F.col("seq").alias("d_seq")).join(adapter.pawn(spark, sf).select("tick", "entity_index"), "tick")
    same(spark.table("s_join").select("tick", "damage", "d_seq", "entity_index"), want.select("tick", "damage", "d_seq", "entity_index"))


def test_windows_complete_with_a_last_row(spark, tmp_path):
    log = spark.range(20).select(F.col("id").cast("int").alias("tick"), F.col("id").alias("seq"))
    log.coalesce(1).write.parquet(str(tmp_path / "t"))
    ops.end_of_stream(log, 20).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    s = spark.readStream.schema(log.schema).parquet(str(tmp_path / "t"))
    # 8 ticks are an eighth of a second
    timed = ops.timed(s).groupBy(F.window("ts", "125 milliseconds")).agg(F.count("seq").alias("n"))
    drain(timed, "s_window")
    assert sorted(r.n for r in spark.table("s_window").collect() if r.n) == [4, 8, 8]


def test_fan_out_reads_once(spark, root, tmp_path):
    got = {}
    (tmp_path / "in").mkdir()
    q = ops.fan_out(pawn(spark, root, tmp_path / "in"), {"creates": lambda df: df.where("delta_type = 'create'"), "all": lambda df: df}, lambda n, df, e: got.update({n: got.get(n, 0) + df.count()}), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert got["all"] == spark.read.parquet(f"{root}/Pawn").count() > got["creates"] > 0


INFO = {"tick": 1, "endtick": 2, "maxtick": 3, "rtdelay": 0.5, "rcvage": 1.0, "fragment": 7, "signup_fragment": 0, "tps": 64, "keyframe_interval": 3, "map": "m", "protocol": 5}


class Server:
    def __init__(self, answers):
        self.answers, self.asked, self.slept = answers, [], []

    def get(self, url, timeout):
        path = url.removeprefix("http://x/")
        self.asked.append(path)
        a = self.answers.get(path, (404, b""))
        a = a.pop(0) if isinstance(a, list) else a
        if isinstance(a, Exception):
            raise a
        return a

    def client(self, **config):
        now = [0.0]

        def sleep(s):
            self.slept.append(s)
            now[0] += s

        return broadcast.BroadcastClient("http://x/", broadcast.ClientConfig(**config), self.get, sleep, lambda: now[0])


def test_broadcast_states():
    s = Server({"sync": [(503, b""), OSError("down"), (200, b"{"), (200, json.dumps(INFO).encode())], "0/start": (200, b"S"), "7/full": (200, b"F"), "7/delta": (200, b"a"), "8/delta": [(404, b""), (200, b"b")]})
    assert list(s.client(delta_retries=2).packets()) == [("start", 0, b"S"), ("full", 7, b"F"), ("delta", 7, b"a"), ("delta", 8, b"b")]
    assert s.slept == [0.5, 1.0, 2.0, 3, 3, 3] and s.asked.count("9/delta") == 3


def test_broadcast_failures():
    with pytest.raises(SourceIOError):
        Server({}).client(sync_timeout=3).sync()
    s = Server({"sync": (200, json.dumps(INFO).encode()), "0/start": (200, b""), "7/full": (500, b"")})
    with pytest.raises(SourceIOError):
        list(s.client().packets())
    c = s.client()
    c.cancelled = lambda: True
    with pytest.raises(broadcast.Cancelled):
        c.sync()


@pytest.mark.parametrize("kind", ["full", "delta"])
def test_failed_requests_are_no_empty_fragments(kind):
    s = Server({"sync": (200, json.dumps(INFO).encode()), f"7/{kind}": OSError("refused")})
    with pytest.raises(SourceIOError, match="refused"):
        s.client().fragment(7, kind)


def test_broken_bodies():
    import http.server
    import threading

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            body = json.dumps(INFO).encode() if self.path == "/sync" else b"short"
            self.send_header("Content-Length", str(len(body) + (0 if self.path == "/sync" else 9)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = broadcast.BroadcastClient(f"http://127.0.0.1:{server.server_port}")
        assert c.fragment(7, "delta") == b"" and c.skipped == 1
        with pytest.raises(SourceIOError):
            c.fragment(7, "full")
    finally:
        server.shutdown()


def test_backoff():
    c = broadcast.ClientConfig()
    assert [c.backoff(k) for k in (1, 2, 3, 4, 5, 9)] == [0.5, 1, 2, 4, 4, 4]
    assert broadcast.SYNC_SCHEMA.names[0] == "tick" and broadcast.SyncInfo.parse(json.dumps(INFO).encode()).map == "m"


def test_broadcast_stream(spark, tmp_path):
    import http.server
    import threading

    row = lambda t: json.dumps({"tick": t, "seq": t, "entity_index": 1, "delta_type": "update"}).encode()
    answers = {"/sync": json.dumps(INFO | {"fragment": 7}).encode(), "/0/start": row(0), "/7/full": row(1), "/7/delta": row(2) + b"\n" + row(3)}

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            body = answers.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(broadcast.BroadcastSource)
    s = spark.readStream.format("telemetry_broadcast").option("url", f"http://127.0.0.1:{server.server_port}").load()
    q = s.writeStream.format("memory").queryName("s_cast").trigger(processingTime="100 milliseconds").start()
    try:
        q.processAllAvailable()
        assert sorted(r.tick for r in spark.table("s_cast").collect()) == [0, 1, 2, 3]
    finally:
        q.stop()
        server.shutdown()
