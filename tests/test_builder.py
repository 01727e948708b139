import random

import pytest

from tidemark.errors import DefinitionError, NoRows, NotSupported, QueryError, TooManyRows
from tidemark.sources import tables as t


@pytest.fixture(scope="module")
def s(spark, sf):
    return t.open_tables(spark, sf)


def test_golden_text(s):
    q = s.with_tenant(3).query(t.EVENTS_T).where("value > {}", 5).or_where("event_type = {}", "click").where("user_id < {}", 9).order_by("event_id", descending=True).take(3).skip(2).tag("report")
    text, args = q.explain_sql()
    view = s.view_of(t.EVENTS_T)
    columns = ", ".join(f"`events_t`.`{c}`" for c in t.EVENTS_T.names)
    assert text == (
        f"/* report */ SELECT {columns} FROM `{view}` AS `events_t` WHERE (`events_t`.`tenant_id` = :p0) AND ((value > :p1) OR (event_type = :p2) AND (user_id < :p3))"
        " ORDER BY `events_t`.`event_id` DESC NULLS LAST LIMIT 3 OFFSET 2"
    )
    assert args == {"p0": 3, "p1": 5, "p2": "click", "p3": 9}


def test_branches_are_independent(s):
    base = s.query(t.ORDERS).where("o_totalprice > {}", 1000)
    a, b = base.where("o_orderstatus = {}", "O"), base.where("o_orderstatus = {}", "F")
    assert base.count() == a.count() + b.count() + base.where("o_orderstatus = {}", "P").count()
    assert len(base.clauses) == 1 and base.numbers == 1


def test_values_are_bound_not_spliced(s):
    assert s.query(t.NATION).where("n_name = {}", "x' OR '1' = '1").count() == 0
    assert s.query(t.EVENTS).where("props = '{{\"k\": 1}}'").df().columns == t.EVENTS.names


def test_or_cannot_leave_the_tenant(s):
    rows = s.with_tenant(2).query(t.EVENTS_T).or_where("tenant_id = {}", 1).df()
    assert rows.count() == 0
    assert {r[0] for r in s.with_tenant(2).query(t.EVENTS_T).or_where("1 = 1").df().select("tenant_id").distinct().collect()} == {2}
    with pytest.raises(QueryError):
        s.with_tenant(None)


def test_walk_of_pages_sees_each_row_once(s):
    q, seen, after = s.query(t.ORDERS).where("o_custkey < {}", 10).or_where("o_orderkey < {}", 40), [], None
    total = q.count()
    while True:
        rows, count = q.page(7, after=after)
        got = [r["o_orderkey"] for r in rows.collect()]
        assert count.first()[0] == total
        if not got:
            break
        seen += got
        after = got[-1]
    assert len(seen) == len(set(seen)) == total and seen == sorted(seen, reverse=True)


def test_guards(s):
    q = s.query(t.ORDERS)
    for wrong in (lambda: q.take(0), lambda: q.skip(-1), lambda: q.then_by("o_orderkey"), lambda: q.select(), lambda: q.tag("*/"), lambda: q.page(0), lambda: q.timeout(0), lambda: q.set("o_orderkey", 1), lambda: q.order_by("o_totalprice").page(3)):
        with pytest.raises(QueryError):
            wrong()
    with pytest.raises(DefinitionError):
        q.order_by("o.custkey")
    with pytest.raises(QueryError):
        q.group_by("o_custkey").df()
    with pytest.raises(NotSupported):
        q.for_update(skip_locked=True).df()
    assert q.for_share().explain_sql()[0].endswith("FOR SHARE")
    with pytest.raises(QueryError):
        q.compile_update()
    for wrong in (q.set("o_orderstatus", "X").take(1), q.set("o_orderstatus", "X").order_by("o_orderkey"), q.set("o_orderstatus", "X").group_by("o_custkey")):
        with pytest.raises(NotSupported):
            wrong.compile_update()


def test_terminals(s):
    q = s.query(t.REGION).order_by("r_regionkey")
    assert q.first()["r_regionkey"] == 0 and len(q.to_list()) == 5
    assert q.where("r_regionkey = {}", 9).first_or_none() is None and q.where("r_regionkey = {}", 9).single_or_none() is None
    with pytest.raises(NoRows):
        q.where("r_regionkey = {}", 9).first()
    with pytest.raises(TooManyRows):
        q.single()
    assert s.get(t.REGION, 3)["r_regionkey"] == 3 and s.get(t.REGION, 99) is None
    assert s.sql_single("SELECT count(*) AS n FROM r", r=t.REGION)["n"] == 5
    assert len(list(s.rows("SELECT * FROM r", r=t.REGION))) == 5
    assert s.scalar("SELECT max(r_regionkey) FROM r WHERE r_regionkey > {}", 100, default=-1, r=t.REGION) == -1
    with pytest.raises(DefinitionError):
        s.sql("SELECT r_name, r_regionkey FROM r", entity=t.REGION, r=t.REGION)


def test_pushdown_and_pruning(s):
    plan = s.query(t.ORDERS).where("o_custkey = {}", 5).select("o_orderkey")
    text = plan.df()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,5)]" in text and "o_totalprice" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("seed", range(25))
def test_random_filters_match_duckdb(s, sf, seed):
    """Random chains of where and or_where mean what SQL's precedence makes of them."""
    import duckdb

    rng, q, text = random.Random(seed), s.query(t.ORDERS), ""
    for _ in range(rng.randint(1, 6)):
        column, value = rng.choice([("o_orderkey", rng.randint(0, 1500)), ("o_custkey", rng.randint(0, 150)), ("o_totalprice", rng.randint(0, 400000))])
        op, way = rng.choice("<>"), rng.choice(["where", "or_where"])
        q = getattr(q, way)(f"{column} {op} {{}}", value)
        text += ("" if not text else " AND " if way == "where" else " OR ") + f"({column} {op} {value})"
    assert q.count() == duckdb.connect().execute(f"SELECT count(*) FROM read_parquet('{sf}/orders.parquet') WHERE {text}").fetchall()[0][0]
