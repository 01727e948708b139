import warnings

import pytest

from tidemark.entity import Col, Converter, Entity
from tidemark.errors import DefinitionError, QueryError
from tidemark.functions import columns as C
from tidemark.functions.naming import converted, quoted
from tidemark.template import bind

KEY = Col("id", "long", key=True)


@pytest.mark.parametrize(
    "columns, more",
    [
        ((), {}),
        ((Col("a"),), {}),
        ((KEY, Col("b", "long", key=True)), {}),
        ((KEY, Col("a", "money")), {}),
        ((KEY, Col("a"), Col("A")), {}),
        ((Col("id", "string", key=True, identity=True),), {}),
        ((KEY, Col("v", "string", version=True)), {}),
        ((KEY, Col("v", "long", version=True), Col("w", "long", version=True)), {}),
        ((KEY, Col("v", "long", version=True, skip_insert=True)), {}),
        ((KEY, Col("at", "string", stamp=True)), {}),
        ((KEY, Col("c", computed="(a + b")), {}),
        ((KEY, Col("c", computed=" ")), {}),
        ((KEY, Col("j", "long", json=True)), {}),
        ((KEY, Col("j", json=True, converter=Converter(lambda c: c, lambda c: c))), {}),
        ((KEY,), {"soft_delete": True}),
        ((KEY,), {"tenant": True}),
        ((KEY, Col("deleted_at", "timestamp", nullable=False)), {"soft_delete": True}),
        ((KEY, Col("a")), {"unique": (("b",),)}),
        ((Col("id", "long", key=True, computed="1"),), {}),
    ],
)
def test_contradictions_are_refused(columns, more):
    with pytest.raises(DefinitionError):
        Entity("things", columns, **more)


def test_table_names_are_one_identifier():
    with pytest.raises(DefinitionError):
        Entity("a.b", (KEY,))


def test_nullable_tenant_warns():
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        Entity("things", (KEY, Col("tenant_id", "long")), tenant=True)
    assert any("tenant" in str(w.message) for w in seen)


def test_participation():
    c = Col("a", skip_insert=True)
    assert not c.insertable and not c.upsertable and c.updatable
    assert not Col("id", "long", key=True, identity=True).insertable and Col("id", "long", key=True, identity=True).upsertable
    assert not Col("v", "long", version=True).updatable


@pytest.mark.parametrize(
    "text, values, sql",
    [
        ("a = {}", (1,), "a = :p0"),
        ("a = {0} OR b = {0}", (1,), "a = :p0 OR b = :p0"),
        ("a = {1} AND b = {0:N2}", (1, 2), "a = :p1 AND b = :p0"),
        ("a = '{{x}}'", (), "a = '{x}'"),
        ("a = ':p0' AND b = {}", (3,), "a = ':p0' AND b = :p0"),
    ],
)
def test_bind(text, values, sql):
    assert bind(text, values)[0] == sql


@pytest.mark.parametrize("text, values", [("{", ()), ("a } b", ()), ("{} {}", (1,)), ("a", (1,)), ("{x}", (1,)), ("{0} {}", (1, 2)), ("{!r}", (1,))])
def test_bind_refuses(text, values):
    with pytest.raises(QueryError):
        bind(text, values)


def test_names():
    assert quoted("a`b") == "`a``b`"
    assert converted("OrderTotalUSD", "snake") == "order_total_usd" and converted("AbC", "lower") == "abc" and converted("AbC") == "AbC"
    for bad in ("", "a\nb"):
        with pytest.raises(QueryError):
            quoted(bad)


def test_json_text():
    import datetime as dt

    assert C.json_text(True) == "true" and C.json_text(7) == "7" and C.json_text("x") == "x" and C.json_text(None) is None
    with pytest.raises(QueryError):
        C.json_text(dt.date(2020, 1, 1))
    with pytest.raises(QueryError):
        C.json_path("")
    t = dt.time(3, 4, 5, 6)
    assert C.micros_time(C.time_micros(t)) == t


def test_types_round_trip(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    e = Entity("all_types", (KEY, Col("i", "int"), Col("s", "short"), Col("u", "unsigned_byte"), Col("t"), Col("c", "char"), Col("b", "bool"), Col("d", "decimal"), Col("f", "double"), Col("g", "float"), Col("ts", "timestamp"), Col("tz", "timestamp_utc"), Col("da", "date"), Col("ti", "time"), Col("bi", "binary"), Col("x", "uuid")))
    row = (1, 2, 3, 255, "a", "c", True, Decimal("1.5"), 0.25, 0.5, dt.datetime(2020, 1, 2, 3), dt.datetime(2020, 1, 2, 3), dt.date(2020, 1, 2), C.time_micros(dt.time(1)), bytearray(b"\0\xff\0"), "0-1")
    df = spark.createDataFrame([row, (2, *[None] * 15)], e.schema())
    df.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0])[0] == row
    assert back.where("bi = X'00FF00'").count() == 1
