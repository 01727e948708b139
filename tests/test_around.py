"""Hooks, cache, resilience, files, scaffold, streams."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.cache import ResultCache
from tidemark.errors import CircuitOpen, NotSupported, QueryError, SessionBusy
from tidemark.hooks import Audit, Interceptor
from tidemark.resilience import Breaker, Policy
from tidemark.scaffold import declaration, scaffold
from tidemark.session import Options
from tidemark.sources import tables as t
from tidemark.sqlfile import load_sql, sections, sql_template
from tidemark.streaming import windows
from tidemark.streaming.channel import Channels


def test_interceptors_in_order(spark, sf):
    s, seen = t.open_tables(spark, sf), []

    class Note(Interceptor):
        def __init__(self, name, priority):
            self.name, self.priority = name, priority

        def before(self, statement):
            seen.append(self.name)

        def failed(self, statement, error):
            raise RuntimeError("never seen")

    audit = Audit()
    for i in (Note("late", 300), audit, Note("early", 1)):
        s.add_interceptor(i)
    s.query(t.REGION).where("r_regionkey = {}", 1).df()
    assert seen == ["early", "late"] and audit.entries[0][2:] == (1, "ok")
    with pytest.raises(Exception) as wrong:
        s.sql("SELECT nonsense FROM nowhere")
    assert not isinstance(wrong.value, RuntimeError) and audit.entries[-1][3] != "ok" and s.hooks.counters == {"done": 1, "failed": 1}


def test_cache_keys_know_tenant_and_filters(spark, sf):
    s = t.open_tables(spark, sf)
    rows = s.query(t.REGION).cached("regions").to_list()
    rows.clear()
    assert len(s.query(t.REGION).cached("regions").to_list()) == 5 and s.cache.counters["hit"] == 1
    a = s.with_tenant(1).query(t.EVENTS_T).cached("events").to_list()
    b = s.with_tenant(2).query(t.EVENTS_T).cached("events").to_list()
    assert a and b and {r["tenant_id"] for r in a} == {1} and {r["tenant_id"] for r in b} == {2}


def test_cache_is_bounded():
    now = [0.0]
    c = ResultCache(2, clock=lambda: now[0])
    assert c.put("a", [1], 10) and c.put("b", [2], 100) and not c.put("c", [3], 10)
    now[0] = 11
    assert c.get("a") is None and c.put("c", [3], 10) and c.get("b") == [2]


def test_retry_and_breaker():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert Policy(5, sleep=pauses.append).run(flaky) == "ok" and len(pauses) == 2 and pauses[0] < pauses[1]
    with pytest.raises(QueryError):
        Policy(5, sleep=pauses.append).run(lambda: (_ for _ in ()).throw(QueryError("no")))
    now = [0.0]
    p = Policy(breaker=Breaker(2, 10, clock=lambda: now[0]))

    def down():
        raise ConnectionError

    for _ in range(2):
        with pytest.raises(ConnectionError):
            p.run(down)
    with pytest.raises(CircuitOpen):
        p.run(down)
    now[0] = 11
    assert p.run(lambda: 1) == 1 and p.breaker.failures == 0


def test_session_gate_and_options(spark, sf, monkeypatch):
    s = t.open_tables(spark, sf)
    held, errors = threading.Event(), []
    with s.operation():
        def other():
            try:
                s.query(t.REGION).df()
            except SessionBusy as e:
                errors.append(e)
            held.set()

        threading.Thread(target=other).start()
        held.wait(20)
    assert errors
    monkeypatch.setenv("WHERE", "/tmp/x")
    assert Options(store="$ENV:WHERE").resolved_store() == "/tmp/x" and "/tmp/x" not in str(Options(store="/tmp/x"))
    assert Options.production().retries == 3
    with pytest.raises(QueryError):
        Options(retries=-1).validated()
    with pytest.raises(NotSupported):
        s.with_isolation("serializable")
    assert s.with_isolation("snapshot") is s


def test_timeout(spark, sf):
    s = t.open_tables(spark, sf)
    heavy = "length(concat_ws(',', transform(sequence(1, 300000), i -> sha2(cast(i + lineitem.l_orderkey AS string), 256))))"
    slow = s.query(t.LINEITEM).where(f"{heavy} > {{}}", 0)
    with pytest.raises(TimeoutError):
        slow.timeout(2.0).to_list()


def test_sql_files(tmp_path):
    (tmp_path / "a.sql").write_text("SELECT 1\n-- @pg\nFROM pg\n-- @spark\nFROM sp\n-- @all\nLIMIT 1\n")
    assert load_sql(str(tmp_path), "a.sql") == "SELECT 1\nFROM sp\nLIMIT 1"
    for bad in ("/etc/passwd", "../a.sql", "C:\\x.sql", "missing.sql", ""):
        with pytest.raises(QueryError):
            load_sql(str(tmp_path), bad)
    with pytest.raises(QueryError):
        sections("-- @pg\nSELECT 1", "spark")
    with pytest.raises(QueryError):
        sections("-- @oracle\nSELECT 1")
    sql_template("t_once", "SELECT 1")
    with pytest.raises(QueryError):
        sql_template("t_once", "SELECT 2")


def test_scaffold_declares_what_it_reads(spark, sf):
    space: dict = {}
    exec(scaffold(spark, sf, ["region", "orders"]), space)
    assert space["ORDERS"].names == t.ORDERS.names and [c.type for c in space["ORDERS"].columns] == [c.type for c in t.ORDERS.columns]
    assert "tenant=True" in declaration("2x", spark.createDataFrame([], "id long, tenant_id long").schema)


def test_channel_delivers_each_message_once(spark, tmp_path):
    c, got, errors = Channels(spark, str(tmp_path)), [], []
    c.notify("orders", "1")
    c.notify("other", "2")

    def take(channel, payload):
        if payload == "3":
            raise ValueError
        got.append((channel, payload))

    c.listen("orders", on_message=take, name="l", once=True).awaitTermination()
    c.notify("orders", "3")
    c.notify("orders", "4")
    c.listen("orders", on_message=take, on_error=errors.append, name="l", once=True).awaitTermination()
    assert got == [("orders", "1"), ("orders", "4")] and len(errors) == 1
    with pytest.raises(QueryError):
        c.notify("", "x")


def test_windows_over_a_stream_match_the_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "1 hour", "event_type", watermark="10 minutes", n=F.count("*"))
    q = out.writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = windows.tumbling(events, "1 hour", "event_type", n=F.count("*"))
    as_text = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert as_text(spark.table("win")) == as_text(want)
    assert windows.sliding(events, "2 hours", "1 hour", n=F.count("*")).agg(F.sum("n")).first()[0] == 2 * events.count()
    assert windows.sessions(events, "5 minutes", "user_id", n=F.count("*")).agg(F.sum("n")).first()[0] == events.count()
