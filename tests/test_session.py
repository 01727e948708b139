"""Parts and manifests, transactions of derived sessions, hooks around actions, converters, traces, naming."""

import threading
import warnings
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.entity import Col, Converter, Entity
from tidemark.errors import ConstraintError, NotSupported, QueryError, VersionConflict
from tidemark.hooks import Audit
from tidemark.session import Options, Session
from tidemark.sources import tables as t
from tidemark.sources.snapshots import SnapshotStore

ITEMS = Entity("items", (Col("id", "long", key=True, identity=True), Col("name"), Col("code", unique=True)))
OWNED = Entity("owned", (Col("id", "long", key=True), Col("tenant_id", "long", nullable=False), Col("value")), tenant=True)
KEYED = Entity("keyed", (Col("id", "string", key=True, converter=Converter(lambda c: F.concat(F.lit("k"), c.cast("string")), lambda c: F.substring(c, 2, 20).cast("long"), T.LongType())), Col("details", json=T.StructType([T.StructField("Key", T.StringType()), T.StructField("Count", T.IntegerType())]))))


@pytest.fixture
def s(spark, tmp_path):
    session = Session.open(spark, options=Options.testing(store=str(tmp_path / "store")))
    for e in (ITEMS, OWNED, KEYED):
        session.managed(e)
    session.migrate()
    return session


def test_an_insert_writes_its_own_rows_alone(s):
    for k in range(3):
        s.insert(ITEMS, s.spark.range(10).select(F.lit(f"n{k}").alias("name"), (F.col("id") + 10 * k).cast("string").alias("code")))
    parts = s.store().manifest()["items"]
    assert [(p["rows"], p["low"], p["high"]) for p in parts] == [(10, 1, 10), (10, 11, 20), (10, 21, 30)]
    assert s.query(ITEMS).count() == 30
    assert s.update_rows(ITEMS, [{"id": 12, "name": "new", "code": "x"}]) == 1
    after = s.store().manifest()["items"]
    assert [p for p in parts if p in after] == [parts[0], parts[2]] and s.get(ITEMS, 12)["name"] == "new"
    assert s.delete(ITEMS, 1, 2, 99) == 2 and s.query(ITEMS).count() == 28
    with pytest.raises(ConstraintError):  # a code that another part holds
        s.insert(ITEMS, [{"name": "again", "code": "25"}])
    with pytest.raises(ConstraintError):
        s.seed(OWNED, [{"id": None, "tenant_id": 1}])
    s.insert(OWNED, [{"id": 5, "tenant_id": 1}])
    with pytest.raises(ConstraintError):  # a key that another part holds
        s.insert(OWNED, [{"id": 5, "tenant_id": 2}])
    assert s.query(ITEMS).count() == 28


def test_parts_are_made_one_and_old_ones_go(s):
    for k in range(4):
        s.insert(ITEMS, [{"name": str(k), "code": str(k)}])
    rows = sorted(map(tuple, s.all(ITEMS).collect()))
    assert s.store().compact(ITEMS) == 4 and len(s.store().manifest()["items"]) == 1
    assert sorted(map(tuple, s.all(ITEMS).collect())) == rows
    assert s.store().vacuum(keep=1, older=3600) == 0 and s.store().vacuum(keep=1, older=-60) == 4
    assert sorted(map(tuple, s.all(ITEMS).collect())) == rows and len(s.store().numbers()) == 1


def test_rows_that_change_between_runs_are_made_once(s):
    """Partitions and values differ from run to run; the numbering and the rules see one run."""
    rows = s.spark.range(200).repartition(5).select(F.uuid().alias("code"), F.rand().cast("string").alias("name"))
    assert s.insert(ITEMS, rows) == 200
    assert sorted(r["id"] for r in s.all(ITEMS).collect()) == list(range(1, 201))


def test_a_manifest_is_whole_or_not_there(s, tmp_path):
    store, won = SnapshotStore(s.spark, str(tmp_path / "race")), []
    threads = [threading.Thread(target=lambda k=k: won.append((k, store.storage.create("manifests/x", f"text {k}")))) for k in range(6)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sum(ok for _, ok in won) == 1 and store.storage.read("manifests/x") == f"text {next(k for k, ok in won if ok)}"
    assert store.storage.names("aside") == []
    source, _ = store.storage._at("manifests/x")
    other, fs = store.storage._at("manifests/y")
    store.storage._rename(source, other)  # the way of stores other than local files
    assert store.storage.names("manifests") == ["y"]
    fs.create(source, False).close()
    with pytest.raises(Exception, match="(?i)exist"):
        store.storage._rename(source, other)


def test_a_lock_that_was_left_behind_is_taken(s):
    store = s.store()
    assert store.lock("a", lease=-1) and store.lock("a", lease=60) and not store.lock("a")
    store.unlock("a")
    assert store.lock("a")


def test_derived_sessions_share_the_transaction(s):
    one = s.with_tenant(1)
    with one.transaction():
        assert one.insert(OWNED, [{"id": 1, "tenant_id": 1, "value": "a"}, {"id": 2, "tenant_id": 2, "value": "b"}]) == 2
        assert one.query(OWNED).count() == 1 and s.query(OWNED).count() == 2
        assert one.query(OWNED).set("value", "c").update() == 1
        assert s.with_tenant(2).update_rows(OWNED, [{"id": 2, "tenant_id": 2, "value": "d"}]) == 1
        with pytest.raises(QueryError):
            with s.transaction():
                pass
    assert sorted(r["value"] for r in s.query(OWNED).df().collect()) == ["c", "d"]


def test_failed_actions_are_told_as_failed(s):
    audit = Audit()
    s.add_interceptor(audit)
    s.insert(OWNED, [{"id": 1, "tenant_id": 1, "value": "no number"}])
    with pytest.raises(Exception, match="(?i)cast"):
        s.query(OWNED).where("CAST(value AS INT) > {}", 1).to_list()
    assert audit.entries[-1][0] == "owned" and audit.entries[-1][3] not in ("ok", "")
    with pytest.raises(Exception, match="(?i)cast"):
        s.scalar("SELECT sum(CAST(value AS INT)) FROM o", o=OWNED)
    assert audit.entries[-1][3] != "ok" and s.query(OWNED).count() == 1 and audit.entries[-1][3] == "ok"
    with pytest.raises(ConstraintError):
        s.insert(OWNED, [{"id": 1, "tenant_id": 1}])
    assert audit.entries[-1][3] == "ConstraintError"
    runs = s.hooks.metrics.runs
    assert runs["insert", "owned", "", "ok"] == 1 and runs["insert", "owned", "", "ConstraintError"] == 1 and runs["count", "owned", "", "ok"] == 1


def test_traces_and_metrics(s):
    s.insert(OWNED, [{"id": k, "tenant_id": 1} for k in range(5)])
    assert len(s.query(OWNED).tracing().metrics("report").to_list()) == 5 and s.query(OWNED).count() == 5
    (trace,) = s.traces
    assert trace.entity == "owned" and trace.operation == "select" and trace.jobs >= 1 and trace.tasks >= trace.stages >= 1 and not trace.error
    key = ("select", "owned", "report", "ok")
    assert s.hooks.metrics.runs[key] == 1 and sum(s.hooks.metrics.buckets[key]) == 1 and s.hooks.metrics.seconds[key] > 0


def test_cache_and_page_know_the_manifest(s):
    s.insert(OWNED, [{"id": 1, "tenant_id": 1}])
    q = s.query(OWNED).cached("all")
    assert len(q.to_list()) == 1
    rows, total = s.query(OWNED).page(5)
    s.insert(OWNED, [{"id": 2, "tenant_id": 1}])
    assert len(q.to_list()) == 2 and len(q.to_list()) == 2 and s.cache.counters["hit"] == 1
    assert rows.count() == total.first()[0] == 1
    with s.transaction():
        s.insert(OWNED, [{"id": 3, "tenant_id": 1}])
        assert len(q.to_list()) == 3
    with pytest.raises(QueryError):
        s.query(OWNED).take(3).page(2)


def test_clauses_raise_rather_than_go(s):
    q = s.query(OWNED)
    with pytest.raises(QueryError):
        q.window("row_number()", "ORDER BY id", "n").agg(n="count(*)").df()
    for wrong in (q.raw("LIMIT 1"), q.select("value"), q.cached("x"), q.skip(1)):
        with pytest.raises(NotSupported):
            wrong.set("value", "x").compile_update()
    assert q.tag("why").set("value", "x").compile_update()[0].startswith("/* why */ UPDATE")


def test_views_are_gone_and_callers_views_stay(s):
    s.spark.range(3).createOrReplaceTempView("o")
    before = {r.name for r in s.spark.catalog.listTables() if r.isTemporary}
    s.insert(OWNED, [{"id": k, "tenant_id": 1} for k in range(5)])
    assert s.query(OWNED).where_in("id", range(600)).count() == 5 and s.scalar("SELECT count(*) FROM o", o=OWNED) == 5
    assert {r.name for r in s.spark.catalog.listTables() if r.isTemporary} == before and s.spark.table("o").count() == 3
    s.spark.catalog.dropTempView("o")


def test_literals_within_a_cte_stay(s):
    s.insert(OWNED, [{"id": 1, "tenant_id": 1, "value": ":p0"}, {"id": 2, "tenant_id": 1, "value": ":p1"}])
    inner = s.query(OWNED).where("value <> ':p0'").where("id > {}", 0)
    outer = s.query(OWNED).where("id < {}", 9).with_cte("some", inner)
    assert [r["value"] for r in outer.df().collect()] == [":p1"] and outer.explain_sql()[1] == {"p0": 9, "p1": 0}


def test_converters_and_json_on_session_paths(s):
    assert s.insert(KEYED, [{"id": 7, "details": {"Key": "a", "Count": 2}}, {"id": 8, "details": None}]) == 2
    assert [tuple(r) for r in s.frame(KEYED).orderBy("id").collect()] == [("k7", '{"Key":"a","Count":2}'), ("k8", None)]
    row = s.get(KEYED, 7)
    assert row["id"] == 7 and row["details"]["Count"] == 2 and s.get(KEYED, 9) is None
    assert s.update_rows(KEYED, [{"id": 8, "details": {"Key": "b", "Count": 3}}]) == 1 and s.get(KEYED, 8)["details"]["Key"] == "b"
    assert s.query(KEYED).where_in("id", [8]).set("details", {"Key": "c", "Count": 4}).update() == 1 and s.get(KEYED, 8)["details"]["Count"] == 4
    assert s.save(KEYED, [{"id": 7, "details": {"Key": "z", "Count": 0}}, {"id": 9, "details": None}]) == 2
    assert s.delete(KEYED, 7) == 1 and [r["id"] for r in s.query(KEYED).order_by("id").to_list()] == [8, 9]
    assert s.query(KEYED).where_json("details", "Key", "c").count() == 1
    page, total = s.query(KEYED).page(1, after=9)
    assert [r["id"] for r in page.collect()] == [8] and total.first()[0] == 2


def test_stale_versions_across_parts(s):
    e = Entity("versioned", (Col("id", "long", key=True), Col("name"), Col("version", "long", version=True)))
    s.managed(e)
    s.migrate()
    for k in (1, 2):
        s.insert(e, [{"id": k, "name": "a", "version": 0}])
    with pytest.raises(VersionConflict):
        s.update_rows(e, [{"id": 1, "name": "b", "version": 0}, {"id": 3, "name": "b", "version": 0}])
    assert s.update_rows(e, [{"id": 2, "name": "b", "version": 0}]) == 1 and s.get(e, 2)["version"] == 1


def test_naming_timeout_tags_and_many_gets(spark, sf, tmp_path):
    s = Session(spark, options=Options(store=str(tmp_path / "n"), naming="snake", auto_tag=True))
    e = Entity("OrderLine", (Col("Id", "long", key=True), Col("UnitPrice", "decimal"), Col("kept_name", prop="Name")), unique=(("UnitPrice",),))
    s.managed(e)
    s.migrate()
    s.insert(e, [{"Id": 1, "UnitPrice": 2, "Name": "x"}])
    assert s.query(e).where_in("UnitPrice", [2]).df().columns == ["id", "unit_price", "kept_name"] and "order_line" in s.store().manifest()
    assert s.query(e).explain_sql()[0].startswith("/* test_session.py:")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        for _ in range(25):
            s.get(e, 1)
    assert sum("reads by key" in str(w.message) for w in seen) == 1
    assert s.with_timeout(600).query(e).count() == 1
    with pytest.raises(QueryError):
        s.with_timeout(0)
    with pytest.raises(QueryError):
        Options(naming="other").validated()


def test_references_to_unknown_tables_warn(spark, tmp_path):
    s = Session(spark, options=Options(store=str(tmp_path / "r")))
    s.managed(Entity("child", (Col("id", "long", key=True), Col("parent", "long", references=("parents", "id")))))
    with pytest.warns(UserWarning, match="parents"):
        s.migrate()


def test_sums_are_wide_and_exact(spark, sf):
    s = t.open_tables(spark, sf)
    s.catalog.frame(ITEMS, spark.createDataFrame([(1, "1e13", "0.00000001"), (2, "2", "0.00000002")], "id long, name string, code string"))
    assert str(s.aggregate(ITEMS, "sum", "CAST(name AS DOUBLE)").first()[0]) == "10000000000002.000000"
    assert s.aggregate(ITEMS, "avg", "CAST(name AS DOUBLE)").first()[0] == 5000000000001.0
    assert s.aggregate(ITEMS, "sum", "CAST(code AS DECIMAL(18,8))").first()[0] == Decimal("0.00000003")
