import pytest
from pyspark.sql import functions as F

from tidemark.entity import Col, Entity
from tidemark.errors import ConstraintError, QueryError, VersionConflict
from tidemark.session import Options, Session

ITEMS = Entity("items", (Col("id", "long", key=True, identity=True), Col("name", required=True), Col("price", "decimal"), Col("label", computed="concat(name, '!')"), Col("made", "timestamp", stamp=True)))
SOFT = Entity("soft", (Col("id", "long", key=True), Col("name"), Col("deleted_at", "timestamp")), soft_delete=True)
VERSIONED = Entity("versioned", (Col("id", "long", key=True), Col("name"), Col("version", "long", version=True)))
OWNED = Entity("owned", (Col("id", "long", key=True), Col("tenant_id", "long", nullable=False), Col("value")), tenant=True)


@pytest.fixture
def s(spark, tmp_path):
    session = Session.open(spark, options=Options.testing(store=str(tmp_path / "store")))
    for e in (ITEMS, SOFT, VERSIONED, OWNED):
        session.managed(e)
    assert session.migrate() == ["items", "soft", "versioned", "owned"] and session.migrate() == []
    return session


def names(s, entity, column="name"):
    return sorted(r[column] for r in s.query(entity).df().collect())


def test_insert_numbers_rows_and_fills(s):
    assert s.insert(ITEMS, [{"name": "a", "price": 1}, {"name": "b"}]) == 2
    assert s.insert(ITEMS, s.spark.range(40).repartition(3).select(F.lit(None).cast("long").alias("id"), F.col("id").cast("string").alias("name"), F.lit(None).cast("decimal(18,6)").alias("price"))) == 40
    rows = s.query(ITEMS).df().collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 43))
    assert all(r["label"] == r["name"] + "!" and r["made"] is not None for r in rows)


def test_rules_hold_on_write(s):
    with pytest.raises(ConstraintError):
        s.insert(ITEMS, [{"name": None}])
    s.insert(SOFT, [{"id": 1, "name": "a"}])
    with pytest.raises(ConstraintError):
        s.insert(SOFT, [{"id": 1, "name": "b"}])
    assert names(s, SOFT) == ["a"] and s.query(ITEMS).count() == 0


def test_soft_delete_happens_once(s):
    s.insert(SOFT, [{"id": 1, "name": "keep"}, {"id": 2, "name": "gone"}])
    assert s.delete(SOFT, 2) == 1
    first = s.ignore_filters().get(SOFT, 2)["deleted_at"]
    assert s.delete(SOFT, 2) == 0 and s.ignore_filters().get(SOFT, 2)["deleted_at"] == first
    assert s.query(SOFT).where("name = {}", "keep").or_where("name = {}", "gone").count() == 1
    assert s.aggregate(SOFT, "count").first()[0] == 1 and s.get(SOFT, 2) is None


def test_stale_versions_conflict_and_change_nothing(s):
    s.insert(VERSIONED, [{"id": 1, "name": "a", "version": 0}, {"id": 2, "name": "b", "version": 0}])
    assert s.update_rows(VERSIONED, [{"id": 1, "name": "A", "version": 0}]) == 1
    with pytest.raises(VersionConflict):
        s.update_rows(VERSIONED, [{"id": 1, "name": "x", "version": 0}, {"id": 2, "name": "y", "version": 0}])
    assert [(r["name"], r["version"]) for r in s.query(VERSIONED).order_by("id").df().collect()] == [("A", 1), ("b", 0)]
    with pytest.raises(QueryError):
        s.save(VERSIONED, [{"id": 1, "name": "z", "version": 0}])


def test_tenants_guard_writes(s):
    s.insert(OWNED, [{"id": 1, "tenant_id": 1, "value": "a"}, {"id": 2, "tenant_id": 2, "value": "b"}])
    one = s.with_tenant(1)
    assert one.delete(OWNED, 2) == 0 and one.update_rows(OWNED, [{"id": 2, "tenant_id": 1, "value": "x"}]) == 0
    assert one.query(OWNED).set("value", "c").or_where("1 = 1").update() == 1
    assert names(s, OWNED, "value") == ["b", "c"]


def test_upsert_and_seed(s):
    assert s.save(ITEMS, [{"name": "new"}]) == 1
    assert s.save(ITEMS, [{"id": 1, "name": "changed"}, {"id": 9, "name": "nine"}, {"id": 0, "name": "fresh"}]) == 3
    assert [(r["id"], r["name"], r["label"]) for r in s.query(ITEMS).order_by("id").df().collect()] == [(1, "changed", "changed!"), (9, "nine", "nine!"), (10, "fresh", "fresh!")]
    for name in ("x", "y"):
        s.seed(ITEMS, [{"id": 5, "name": name}])
    assert s.get(ITEMS, 5)["name"] == "y" and s.query(ITEMS).count() == 4
    with pytest.raises(ConstraintError):
        s.seed(ITEMS, [{"name": "keyless"}])
    with pytest.raises(ConstraintError):
        s.save(ITEMS, [{"id": 5, "name": "a"}, {"id": 5, "name": "b"}])


def test_transactions(s):
    with s.transaction() as work:
        s.insert(SOFT, [{"id": 1, "name": "a"}])
        work.savepoint("one")
        s.insert(SOFT, [{"id": 2, "name": "b"}])
        assert names(s, SOFT) == ["a", "b"]
        work.rollback_to("one")
        assert work.advisory_lock(7, 8) and not s.store().lock("7-8")
        with pytest.raises(QueryError):
            with s.transaction():
                pass
    assert names(s, SOFT) == ["a"] and s.store().lock("7-8")
    with pytest.raises(ZeroDivisionError):
        with s.transaction():
            s.insert(SOFT, [{"id": 3, "name": "c"}])
            1 / 0
    assert names(s, SOFT) == ["a"]


def test_second_writer_fails_and_readers_hold_on(s):
    s.insert(SOFT, [{"id": 1, "name": "a"}])
    s.pin("replica")
    store = s.store()
    with pytest.raises(VersionConflict):
        with store.transaction() as slow:
            slow.replace(SOFT, slow.read(SOFT))
            s.insert(SOFT, [{"id": 2, "name": "b"}])
    assert names(s, SOFT) == ["a", "b"]
    assert [r["name"] for r in s.query(SOFT).for_read().df().collect()] == ["a"] and s.query(SOFT).for_read().for_write().count() == 2


def test_schema_and_health(s):
    assert s.validate_schema(SOFT) == [] and s.health().ok
    with pytest.raises(QueryError):
        Session.open(s.spark).store()
