"""Every operator as a named query over the benchmark tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tidemark.entity import Col, Converter, Entity
from tidemark.errors import ConstraintError, VersionConflict
from tidemark.functions.columns import to_stored
from tidemark.operators import vectors, writes
from tidemark.session import Options, Session
from tidemark.sources import tables as t
from tidemark.sqlfile import sections, sql_template
from tidemark.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NAMES = Entity("names", (Col("id", "long", key=True, identity=True), Col("name")))

SD = "(SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders)"
EV = "(SELECT *, user_id % 5 AS tenant_id FROM events)"
CV = "(SELECT *, c_custkey % 3 AS version FROM customer)"
MONEY = "DECIMAL(18,6)"


def query(name: str, sql: str | None = None):
    """Registers a function of a session under ``name``."""

    def put(made: Callable[[Session], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: made(t.open_tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return made

    return put


def stored(s: Session, *managed: Entity, **options) -> Session:
    """A session over the same files and over empty tables of a new store."""
    return t.open_store(s.spark, s.catalog.folder, *managed, **options)


# --- scans

query("scan_all", "SELECT * FROM nation")(lambda s: s.all(t.NATION))
query("scan_wide", "SELECT * FROM lineitem")(lambda s: s.all(t.LINEITEM))
query("get_by_key", "SELECT * FROM customer WHERE c_custkey = 42")(lambda s: s.get_df(t.CUSTOMER, 42))
query("project", "SELECT o_orderkey, o_totalprice FROM orders")(lambda s: s.query(t.ORDERS).select("o_orderkey", "o_totalprice").df())
query("raw_sql", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1")(
    lambda s: s.sql("SELECT o_orderstatus, count(*) AS n FROM o WHERE o_totalprice > {} GROUP BY 1", 1000, o=t.ORDERS)
)
query("raw_sql_typed", "SELECT * FROM region WHERE r_regionkey <> 2")(
    lambda s: s.sql("SELECT r_regionkey, r_name FROM r WHERE r_regionkey <> {0}", 2, entity=t.REGION, r=t.REGION)
)
query("scalar", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 30")(lambda s: s.sql("SELECT count(*) AS n FROM l WHERE l_quantity > {}", 30, l=t.LINEITEM))


@query("grid_second", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def _(s: Session) -> DataFrame:
    frames = s.several(("SELECT count(*) AS n FROM region_rows", ()), ("SELECT n_nationkey, n_name FROM nation_rows WHERE n_regionkey = {}", (1,)), region_rows=t.REGION, nation_rows=t.NATION)
    frames.read()
    return frames.read()


@query("procedure", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 500 GROUP BY 1")
def _(s: Session) -> DataFrame:
    s.procedure("rich_segments", lambda session, least: session.query(t.CUSTOMER).where("c_acctbal > {}", least).group_by("c_mktsegment").agg(n="count(*)").df())
    return s.call("rich_segments", least=500)


# --- filters

query("where_param", "SELECT * FROM orders WHERE o_totalprice > 100000")(lambda s: s.query(t.ORDERS).where("o_totalprice > {}", 100000).df())
query("where_and", "SELECT * FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")(
    lambda s: s.query(t.ORDERS).where("o_totalprice > {}", 100000).where("o_orderstatus = {}", "O").df()
)
query("where_or_precedence", "SELECT * FROM orders WHERE (o_totalprice > 300000) OR (o_orderpriority = '1-URGENT') AND (o_orderstatus = 'F')")(
    lambda s: s.query(t.ORDERS).where("o_totalprice > {}", 300000).or_where("o_orderpriority = {}", "1-URGENT").where("o_orderstatus = {}", "F").df()
)
query("where_in", "SELECT * FROM customer WHERE c_custkey IN (1, 5, 9, 77)")(lambda s: s.query(t.CUSTOMER).where_in("c_custkey", [1, 5, 9, 77]).df())
query("where_in_empty", "SELECT * FROM customer WHERE 1 = 0")(lambda s: s.query(t.CUSTOMER).where_in("c_custkey", []).df())
query("where_in_1500", "SELECT * FROM orders WHERE o_custkey IN (SELECT * FROM range(1500))")(lambda s: s.query(t.ORDERS).where_in("o_custkey", range(1500)).df())
query("where_not_in", "SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")(lambda s: s.query(t.CUSTOMER).where_not_in("c_mktsegment", ["BUILDING", "MACHINERY"]).df())
query("where_not_in_null", "SELECT * FROM customer WHERE c_mktsegment NOT IN ('BUILDING', NULL)")(lambda s: s.query(t.CUSTOMER).where_not_in("c_mktsegment", ["BUILDING", None]).df())
query("where_not_in_empty", "SELECT * FROM customer")(lambda s: s.query(t.CUSTOMER).where_not_in("c_mktsegment", []).df())
query("json_text_eq", "SELECT * FROM events WHERE json_extract_string(props, '$.k') = '7'")(lambda s: s.query(t.EVENTS).where_json("props", "k", "7").df())
query("json_number_eq", "SELECT * FROM events WHERE json_extract_string(props, '$.k') = '12'")(lambda s: s.query(t.EVENTS).where_json("props", "k", 12).df())
query("json_null", "SELECT * FROM events WHERE json_extract_string(props, '$.k') = NULL")(lambda s: s.query(t.EVENTS).where_json("props", "k", None).df())
query("null_predicate", f"SELECT * FROM {SD} WHERE deleted_at IS NOT NULL")(lambda s: s.ignore_filters().query(t.ORDERS_SD).where("deleted_at IS NOT NULL").df())
query("fragment_sql", "SELECT * FROM part WHERE p_name LIKE '%a%' AND p_size BETWEEN 5 AND 20 AND CASE WHEN p_size > 10 THEN 1 ELSE 0 END = 1")(
    lambda s: s.query(t.PART).where("p_name LIKE {}", "%a%").where("p_size BETWEEN {} AND {}", 5, 20).where("CASE WHEN p_size > {} THEN 1 ELSE 0 END = 1", 10).df()
)

# --- default filters

query("soft_delete_default", f"SELECT * FROM {SD} WHERE deleted_at IS NULL")(lambda s: s.all(t.ORDERS_SD))
query("soft_delete_or", f"SELECT * FROM {SD} WHERE deleted_at IS NULL AND ((o_totalprice > 200000) OR (o_orderstatus = 'F'))")(
    lambda s: s.query(t.ORDERS_SD).where("o_totalprice > {}", 200000).or_where("o_orderstatus = {}", "F").df()
)
query("ignore_filters", f"SELECT * FROM {SD}")(lambda s: s.ignore_filters().all(t.ORDERS_SD))
query("tenant_filter", f"SELECT * FROM {EV} WHERE tenant_id = 3")(lambda s: s.with_tenant(3).all(t.EVENTS_T))
query("tenant_or", f"SELECT * FROM {EV} WHERE tenant_id = 3 AND ((tenant_id = 1) OR (event_type = 'click'))")(
    lambda s: s.with_tenant(3).query(t.EVENTS_T).or_where("tenant_id = {}", 1).or_where("event_type = {}", "click").df()
)
query("tenant_join", f"SELECT e.* FROM {EV} e JOIN customer c ON e.user_id = c.c_custkey WHERE e.tenant_id = 2")(lambda s: s.with_tenant(2).query(t.EVENTS_T).include(t.CUSTOMER, "user_id").df())

# --- joins

query("join_inner", "SELECT o.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'")(
    lambda s: s.query(t.ORDERS).inner_join(t.CUSTOMER, "orders.o_custkey = customer.c_custkey AND customer.c_mktsegment = {}", "BUILDING").df()
)
query("join_left", "SELECT c.* FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")(
    lambda s: s.query(t.CUSTOMER).left_join(t.ORDERS, "orders.o_custkey = customer.c_custkey AND orders.o_totalprice > {}", 200000).df()
)
query("join_right", "SELECT o.* FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000")(
    lambda s: s.query(t.ORDERS).right_join(t.CUSTOMER, "orders.o_custkey = customer.c_custkey AND orders.o_totalprice > {}", 200000).df()
)
query("join_theta", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey")(lambda s: s.query(t.NATION).inner_join(t.REGION, "nation.n_regionkey < region.r_regionkey").df())
query("join_param", "SELECT l.* FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size > 40 WHERE l.l_quantity > 40")(
    lambda s: s.query(t.LINEITEM).inner_join(t.PART, "lineitem.l_partkey = part.p_partkey AND part.p_size > {}", 40).where("lineitem.l_quantity > {}", 40).df()
)
query("include", "SELECT l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'O'")(
    lambda s: s.query(t.LINEITEM).include(t.ORDERS, "l_orderkey").where("orders.o_orderstatus = {}", "O").df()
)
query("then_include", "SELECT l.* FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'MACHINERY'")(
    lambda s: s.query(t.LINEITEM).include(t.ORDERS, "l_orderkey").then_include(t.ORDERS, t.CUSTOMER, "o_custkey").where("customer.c_mktsegment = {}", "MACHINERY").df()
)
query("split_query", "SELECT * FROM lineitem WHERE l_quantity > 45")(lambda s: s.query(t.LINEITEM).inner_join(t.ORDERS, "lineitem.l_orderkey = orders.o_orderkey AND orders.o_totalprice > {}", 5).where("l_quantity > {}", 45).as_split().df())

# --- aggregates

query("count_where", "SELECT count(*) AS value FROM orders WHERE o_totalprice > 150000")(lambda s: s.aggregate(t.ORDERS, "count", "", "o_totalprice > {}", 150000))
query("count_default", f"SELECT count(*) AS value FROM {SD} WHERE deleted_at IS NULL")(lambda s: s.aggregate(t.ORDERS_SD, "count"))
query("sum_expr", f"SELECT CAST(sum(CAST(l_quantity * 2 AS {MONEY})) AS DECIMAL(28,6)) AS value FROM lineitem")(lambda s: s.aggregate(t.LINEITEM, "sum", "l_quantity * 2"))
query("avg_expr", f"SELECT CAST(sum(CAST(o_totalprice AS {MONEY})) AS DOUBLE) / count(*) AS value FROM orders")(lambda s: s.aggregate(t.ORDERS, "avg", "o_totalprice"))
query("sum_wide", "SELECT CAST(sum(CAST(o_orderkey * 1e10 AS DECIMAL(38,6))) AS DECIMAL(38,6)) AS value FROM orders")(lambda s: s.aggregate(t.ORDERS, "sum", "CAST(o_orderkey AS DOUBLE) * 1e10D"))
query("avg_wide", "SELECT CAST(sum(CAST(o_orderkey AS HUGEINT)) * 10000000000 AS DOUBLE) / count(*) AS value FROM orders")(lambda s: s.aggregate(t.ORDERS, "avg", "CAST(o_orderkey AS DOUBLE) * 1e10D"))
query("sum_eight_decimals", "SELECT sum(CAST(l_discount AS DECIMAL(18,8)) + 0.00000001::DECIMAL(18,8)) AS value FROM lineitem")(
    lambda s: s.aggregate(t.LINEITEM, "sum", "CAST(l_discount AS DECIMAL(18,8)) + CAST('0.00000001' AS DECIMAL(18,8))")
)
query("min_expr", "SELECT min(p_retailprice) AS value FROM part")(lambda s: s.aggregate(t.PART, "min", "p_retailprice"))
query("max_expr", "SELECT max(p_name) AS value FROM part")(lambda s: s.aggregate(t.PART, "max", "p_name"))
query("max_empty", "SELECT coalesce(max(p_size), 0) AS value FROM part WHERE p_size > 100000")(lambda s: s.aggregate(t.PART, "max", "p_size", "p_size > {}", 100000))
query("sum_empty", "SELECT CAST(0 AS DECIMAL(28,6)) AS value")(lambda s: s.aggregate(t.ORDERS, "sum", "o_totalprice", "1 = 0"))
query("avg_empty", "SELECT CAST(0 AS DOUBLE) AS value")(lambda s: s.aggregate(t.ORDERS, "avg", "o_totalprice", "1 = 0"))
query("group_by_agg", f"SELECT c_mktsegment, c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS {MONEY})) AS DECIMAL(28,6)) AS total FROM customer GROUP BY 1, 2")(
    lambda s: s.query(t.CUSTOMER).group_by("c_mktsegment", "c_nationkey").agg(n="count(*)", total=f"CAST(sum(CAST(c_acctbal AS {MONEY})) AS DECIMAL(28,6))").df()
)
query("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING (count(*) > 12) AND (max(o_totalprice) > 100000)")(
    lambda s: s.query(t.ORDERS).group_by("o_custkey").agg(n="count(*)").having("count(*) > {}", 12).having("max(o_totalprice) > {}", 100000).df()
)
query("count_groups", "SELECT count(*) AS n FROM (SELECT 1 FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 5)")(
    lambda s: s.query(t.CUSTOMER).group_by("c_nationkey", "c_mktsegment").having("count(*) > {}", 5).count_df()
)

# --- windows

query("window_row_number", "SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")(
    lambda s: s.query(t.ORDERS).window("row_number()", "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey", "rn").df()
)
query("window_rank", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r, lag(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS before FROM customer")(
    lambda s: s.query(t.CUSTOMER).window("rank()", "PARTITION BY c_mktsegment ORDER BY c_nationkey", "r").window("lag(c_custkey)", "PARTITION BY c_mktsegment ORDER BY c_custkey", "before").df()
)
query("window_frame", f"SELECT *, CAST(sum(CAST(value AS {MONEY})) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DECIMAL(28,6)) AS moving FROM events")(
    lambda s: s.query(t.EVENTS).window(f"sum(CAST(value AS {MONEY}))", "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW", "moving_sum").df().withColumn("moving", F.col("moving_sum").cast("decimal(28,6)")).drop("moving_sum")
)

# --- order, limit, pages

query("order_then", "SELECT * FROM (SELECT * FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100)")(
    lambda s: s.query(t.ORDERS).order_by("o_orderpriority").then_by("o_totalprice", descending=True).then_by("o_orderkey").take(100).df()
)
query("top_k", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")(
    lambda s: s.query(t.LINEITEM).order_by("l_extendedprice", descending=True).then_by("l_orderkey").then_by("l_linenumber").take(20).df()
)
query("skip_take", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 45")(lambda s: s.query(t.ORDERS).order_by("o_orderkey").skip(45).take(30).df())
query("skip_only", "SELECT * FROM nation ORDER BY n_nationkey OFFSET 20")(lambda s: s.query(t.NATION).order_by("n_nationkey").skip(20).df())
query("first", "SELECT * FROM part WHERE p_size > 10 ORDER BY p_partkey LIMIT 1")(lambda s: s.query(t.PART).where("p_size > {}", 10).order_by("p_partkey").take(1).df())
query("single", "SELECT * FROM region WHERE r_regionkey = 3")(lambda s: s.query(t.REGION).where("r_regionkey = {}", 3).take(2).df())
query("page_first", "SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey DESC LIMIT 25")(lambda s: s.query(t.ORDERS).where("o_orderstatus = {}", "O").page(25)[0])
query("page_next", "SELECT * FROM orders WHERE o_orderkey < 500 AND (o_orderstatus = 'O') ORDER BY o_orderkey DESC LIMIT 25")(lambda s: s.query(t.ORDERS).where("o_orderstatus = {}", "O").page(25, after=500)[0])
query("page_next_or", "SELECT * FROM orders WHERE o_orderkey < 500 AND ((o_orderstatus = 'O') OR (o_orderstatus = 'F')) ORDER BY o_orderkey DESC LIMIT 25")(
    lambda s: s.query(t.ORDERS).where("o_orderstatus = {}", "O").or_where("o_orderstatus = {}", "F").page(25, after=500)[0]
)
query("page_ascending_zero", "SELECT * FROM orders WHERE o_orderkey > 0 ORDER BY o_orderkey LIMIT 10")(lambda s: s.query(t.ORDERS).page(10, after=0, descending=False)[0])
query("page_total", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")(lambda s: s.query(t.ORDERS).where("o_orderstatus = {}", "O").page(25, after=500)[1])

# --- CTEs, files, templates

query("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT * FROM big WHERE o_orderstatus = 'F'")(
    lambda s: s.query(t.ORDERS).with_cte("big", s.query(t.ORDERS).where("o_totalprice > {}", 200000)).where("o_orderstatus = {}", "F").df()
)
query("cte_chain", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), urgent AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') SELECT * FROM urgent WHERE o_orderkey IN (SELECT o_orderkey FROM big)")(
    lambda s: s.query(t.ORDERS).with_cte("big", s.query(t.ORDERS).where("o_totalprice > {}", 100000)).with_cte("urgent", s.query(t.ORDERS).where("o_orderpriority = {}", "1-URGENT")).where("o_orderkey IN (SELECT o_orderkey FROM big)").df()
)
query("cte_default_filter", f"WITH kept AS (SELECT * FROM {SD} WHERE deleted_at IS NULL AND (o_totalprice > 1000)) SELECT * FROM kept WHERE deleted_at IS NULL")(
    lambda s: s.query(t.ORDERS_SD).with_cte("kept", s.query(t.ORDERS_SD).where("o_totalprice > {}", 1000)).df()
)
SQL_FILE = """SELECT n_regionkey, count(*) AS n
-- @pg
FROM pg_catalog.nation
-- @spark
FROM n
-- @all
GROUP BY n_regionkey
"""
query("sql_file", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")(lambda s: s.sql(sections(SQL_FILE, "spark"), n=t.NATION))
query("sql_template", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 1000 AND s_nationkey = 4")(
    lambda s: s.sql(sql_template("rich_suppliers", "SELECT s_suppkey, s_name FROM s WHERE s_acctbal > {1} AND s_nationkey = {0}"), 4, 1000, s=t.SUPPLIER)
)

# --- writes, as the table afterwards

EURO = Converter(lambda c: (c * 100).cast("long").cast("double"), lambda c: c / 100)


def _delta(s: Session, share: int, rest: int) -> DataFrame:
    """Changed customers: those whose key leaves ``rest``, with another balance."""
    return s.frame(t.CUSTOMER).where(F.col("c_custkey") % share == rest).withColumn("c_acctbal", F.col("c_custkey") * 1.0).withColumn("c_name", F.lit("changed"))


query("update_set", "SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment) FROM customer")(
    lambda s: writes.update_where(s.frame(t.CUSTOMER), t.CUSTOMER, F.col("c_mktsegment") == "BUILDING", {"c_mktsegment": F.lit("HOUSING")})
)
query("update_by_key", "SELECT * REPLACE (CASE WHEN c_custkey = 7 THEN 7.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey = 7 THEN 'changed' ELSE c_name END AS c_name) FROM customer")(
    lambda s: writes.update_by_key(s.frame(t.CUSTOMER), _delta(s, 1, 0).where("c_custkey = 7"), t.CUSTOMER)
)
query("bulk_update", "SELECT * REPLACE (CASE WHEN c_custkey % 4 = 1 THEN c_custkey * 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 = 1 THEN 'changed' ELSE c_name END AS c_name) FROM customer")(
    lambda s: writes.update_by_key(s.frame(t.CUSTOMER), _delta(s, 4, 1), t.CUSTOMER)
)
query("delete_hard", "SELECT * FROM customer WHERE c_custkey <> 5")(lambda s: writes.delete_keys(s.frame(t.CUSTOMER), s.frame(t.CUSTOMER).where("c_custkey = 5").select("c_custkey"), t.CUSTOMER))
query("bulk_delete", "SELECT * FROM orders WHERE o_custkey % 3 <> 0")(lambda s: writes.delete_keys(s.frame(t.ORDERS), s.frame(t.ORDERS).where("o_custkey % 3 = 0").select("o_orderkey"), t.ORDERS))
query("delete_soft", f"SELECT * REPLACE (CASE WHEN deleted_at IS NULL AND o_orderkey % 10 = 0 THEN TIMESTAMP '2030-01-01' ELSE deleted_at END AS deleted_at) FROM {SD}")(
    lambda s: writes.delete_keys(s.frame(t.ORDERS_SD), s.frame(t.ORDERS).where("o_orderkey % 10 = 0").select("o_orderkey"), t.ORDERS_SD, when=F.lit("2030-01-01").cast("timestamp_ntz"))
)
query("delete_tenant", f"SELECT * FROM {EV} WHERE NOT (tenant_id = 2 AND event_id % 2 = 0)")(lambda s: writes.delete_keys(s.frame(t.EVENTS_T), s.frame(t.EVENTS).where("event_id % 2 = 0").select("event_id"), t.EVENTS_T, tenant=2))


def _mixed(s: Session) -> DataFrame:
    """Half changed rows, half new ones."""
    return _delta(s, 2, 0).withColumn("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1_000_000))


UPSERT_SQL = """
WITH delta AS (SELECT CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS c_custkey, 'changed' AS c_name, c_nationkey, c_custkey * 1.0::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM delta UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM delta)
"""
query("upsert", UPSERT_SQL)(lambda s: writes.upsert(s.frame(t.CUSTOMER), _mixed(s), t.CUSTOMER))
query("bulk_merge", UPSERT_SQL)(lambda s: writes.upsert(writes.upsert(s.frame(t.CUSTOMER), _mixed(s).where("c_custkey < 1000000"), t.CUSTOMER), _mixed(s).where("c_custkey >= 1000000"), t.CUSTOMER))
query("seed_twice", UPSERT_SQL)(lambda s: writes.upsert(writes.upsert(s.frame(t.CUSTOMER), _mixed(s), t.CUSTOMER), _mixed(s), t.CUSTOMER))


@query("insert_identity", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 24 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region")
def _(s: Session) -> DataFrame:
    s = stored(s, NAMES)
    s.seed(NAMES, s.frame(t.NATION).where("n_nationkey > 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    s.insert(NAMES, s.frame(t.REGION).orderBy("r_regionkey").select(F.col("r_name").alias("name")))
    zero = s.frame(t.NATION).where("n_nationkey = 0").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return s.all(NAMES).unionByName(zero)


@query("version_update", f"SELECT * REPLACE (CASE WHEN c_custkey % 4 = 1 AND version = 1 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 1 AND version = 1 THEN c_custkey * 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 = 1 AND version = 1 THEN 2 ELSE version END AS version) FROM {CV}")
def _(s: Session) -> DataFrame:
    return writes.update_by_key(s.frame(t.CUSTOMER_V), _delta(s, 4, 1).withColumn("version", F.lit(1).cast("long")), t.CUSTOMER_V)


query("version_conflicts", f"SELECT c_custkey FROM {CV} WHERE c_custkey % 4 = 1 AND version <> 1")(
    lambda s: writes.outdated(s.frame(t.CUSTOMER_V), _delta(s, 4, 1).withColumn("version", F.lit(1).cast("long")), t.CUSTOMER_V).select("c_custkey")
)
query("fk_orphans", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")(
    lambda s: writes.orphans(s.frame(t.ORDERS), "o_custkey", s.frame(t.CUSTOMER).where("c_mktsegment <> 'BUILDING'"), "c_custkey")
)


@query("unique_violations", "SELECT 'p_brand,p_size' AS rule, count(*) AS n FROM (SELECT 1 FROM part GROUP BY p_brand, p_size HAVING count(*) > 1)")
def _(s: Session) -> DataFrame:
    return writes.unique_violations(s.frame(t.PART), Entity("part", t.PART.columns, unique=(("p_brand", "p_size"),)))


# --- writes through sessions, on a store

OWNED = Entity("owned", (Col("id", "long", key=True), Col("tenant_id", "long", nullable=False), Col("value")), tenant=True)
SOFT_CUSTOMER = Entity("soft_customer", (*t.CUSTOMER.columns, Col("deleted_at", "timestamp")), soft_delete=True)
STORED = Entity("customer_stored", t.CUSTOMER.columns)
STORED_V = Entity("customer_versioned", t.CUSTOMER_V.columns)
STORED_ORDERS = Entity("orders_stored", t.ORDERS.columns)
JOINED = "o.* FROM o JOIN c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = {}"
JOIN_SQL = "SELECT o.* FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING'"
OWNED_SQL = "SELECT c_custkey AS id, c_custkey % 3 AS tenant_id, c_name AS value FROM customer"


def _owned(s: Session) -> DataFrame:
    return s.frame(t.CUSTOMER).select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("tenant_id"), F.col("c_name").alias("value"))


@query("txn_insert_read", f"SELECT tenant_id, count(*) AS n FROM ({OWNED_SQL}) WHERE tenant_id = 1 GROUP BY 1")
def _(s: Session) -> DataFrame:
    """Within a transaction a tenant's session counts the rows that it has staged."""
    s = stored(s, OWNED)
    one = s.with_tenant(1)
    with one.transaction():
        one.insert(OWNED, _owned(s).where("tenant_id = 1"))
        n = one.query(OWNED).count()
        one.insert(OWNED, _owned(s).where("tenant_id = 2"))
        seen = one.query(OWNED).count()
    return s.spark.createDataFrame([(1, n)] if n == seen else [], "tenant_id long, n long")


@query("session_update", f"SELECT id, tenant_id, CASE WHEN tenant_id = 1 AND id > 20 THEN 'set' ELSE value END AS value FROM ({OWNED_SQL})")
def _(s: Session) -> DataFrame:
    """A tenant's set-based update in a transaction changes what that session staged, and no other tenant's rows."""
    s = stored(s, OWNED)
    s.insert(OWNED, _owned(s).where("tenant_id <> 1"))
    one = s.with_tenant(1)
    with one.transaction():
        one.insert(OWNED, _owned(s).where("tenant_id = 1"))
        one.query(OWNED).where("id > {}", 20).set("value", "set").update()
    return s.all(OWNED)


@query("session_update_rows", "SELECT * REPLACE (CASE WHEN c_custkey % 4 = 1 THEN c_custkey * 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 = 1 THEN 'changed' ELSE c_name END AS c_name) FROM customer")
def _(s: Session) -> DataFrame:
    """A table of several parts, of which those that hold changed keys are written anew."""
    s = stored(s, STORED)
    for k in range(3):
        s.insert(STORED, s.frame(t.CUSTOMER).where(F.col("c_custkey") % 3 == k))
    s.update_rows(STORED, _delta(s, 4, 1))
    return s.all(STORED)


@query("session_version", f"SELECT * REPLACE (CASE WHEN c_custkey % 4 = 1 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 4 = 1 THEN c_custkey * 1.0::DOUBLE ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 4 = 1 THEN version + 1 ELSE version END AS version) FROM {CV}")
def _(s: Session) -> DataFrame:
    """Rows in their version are updated and count on; a second update with a stale version changes nothing."""
    s = stored(s, STORED_V)
    s.insert(STORED_V, s.frame(t.CUSTOMER_V))
    delta = _delta(s, 4, 1).withColumn("version", F.col("c_custkey") % 3)
    s.update_rows(STORED_V, delta)
    try:
        s.update_rows(STORED_V, delta.withColumn("c_name", F.lit("stale")))
    except VersionConflict:
        pass
    return s.all(STORED_V)


@query("session_delete", "SELECT c_custkey, c_custkey % 5 = 0 AS gone FROM customer")
def _(s: Session) -> DataFrame:
    """Soft deletes by session: marked once, and hidden from the default filters."""
    s = stored(s, SOFT_CUSTOMER)
    s.insert(SOFT_CUSTOMER, s.frame(t.CUSTOMER))
    keys = s.frame(t.CUSTOMER).where("c_custkey % 5 = 0").select("c_custkey")
    n, again = s.delete_rows(SOFT_CUSTOMER, keys), s.delete_rows(SOFT_CUSTOMER, keys)
    live = s.all(SOFT_CUSTOMER).select("c_custkey", F.lit(False).alias("gone"))
    return live.unionByName(s.ignore_filters().all(SOFT_CUSTOMER).where("deleted_at IS NOT NULL").select("c_custkey", F.lit(n > 0 and again == 0).alias("gone")))


@query("session_delete_hard", "SELECT * FROM customer WHERE c_custkey % 5 <> 0")
def _(s: Session) -> DataFrame:
    s = stored(s, STORED)
    s.insert(STORED, s.frame(t.CUSTOMER).where("c_custkey < 100"))
    s.insert(STORED, s.frame(t.CUSTOMER).where("c_custkey >= 100"))
    s.delete_rows(STORED, s.frame(t.CUSTOMER).where("c_custkey % 5 = 0").select("c_custkey"))
    return s.all(STORED)


@query("session_save", UPSERT_SQL)
def _(s: Session) -> DataFrame:
    s = stored(s, STORED)
    s.insert(STORED, s.frame(t.CUSTOMER))
    s.save(STORED, _mixed(s))
    return s.all(STORED)


@query("session_seed", UPSERT_SQL)
def _(s: Session) -> DataFrame:
    s = stored(s, STORED)
    s.seed(STORED, s.frame(t.CUSTOMER))
    for _ in range(2):
        s.seed(STORED, _mixed(s))
    return s.all(STORED)


@query("session_bulk_insert", "SELECT * FROM orders")
def _(s: Session) -> DataFrame:
    """Bulk insert, in several parts that are then made one."""
    s = stored(s, STORED_ORDERS)
    for k in range(2):
        s.insert(STORED_ORDERS, s.frame(t.ORDERS).where(F.col("o_orderkey") % 2 == k))
    s.store().compact(STORED_ORDERS)
    return s.all(STORED_ORDERS)


@query("session_insert_values", "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c')) AS v(id, name)")
def _(s: Session) -> DataFrame:
    s = stored(s, NAMES)
    s.insert(NAMES, [{"name": "a"}])
    s.insert(NAMES, [{"name": "b"}, {"name": "c"}])
    return s.all(NAMES)


@query("savepoint", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey BETWEEN 1 AND 9")
def _(s: Session) -> DataFrame:
    """What follows a savepoint is rolled back; what comes before it is committed."""
    s, rows = stored(s, NAMES), s.frame(t.NATION).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    with s.transaction() as work:
        s.seed(NAMES, rows.where("id BETWEEN 1 AND 9"))
        work.savepoint("first")
        s.seed(NAMES, rows.where("id > 9"))
        work.rollback_to("first")
    return s.all(NAMES)


@query("rolled_back", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey = 3")
def _(s: Session) -> DataFrame:
    """A rule broken by one row of an insert leaves the table as it was."""
    s, rows = stored(s, NAMES), s.frame(t.NATION).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    s.seed(NAMES, rows.where("id = 3"))
    try:
        with s.transaction():
            s.seed(NAMES, rows.where("id > 3"))
            s.save(NAMES, rows.where("id > 4").union(rows.where("id > 20")))
    except ConstraintError:
        pass
    return s.all(NAMES)


@query("read_replica", "SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def _(s: Session) -> DataFrame:
    """A query for reading holds to the pinned snapshot while the table goes on."""
    s = stored(s, STORED_ORDERS)
    s.insert(STORED_ORDERS, s.frame(t.ORDERS).where("o_orderkey % 2 = 0"))
    s.pin("replica")
    s.insert(STORED_ORDERS, s.frame(t.ORDERS).where("o_orderkey % 2 = 1"))
    return s.query(STORED_ORDERS).for_read().df()


@query("page_one_snapshot", "SELECT count(*) AS n, CAST(10 AS BIGINT) AS page_rows FROM orders WHERE o_orderkey % 2 = 0")
def _(s: Session) -> DataFrame:
    """Page and total, planned before a commit, tell of the same snapshot after it."""
    s = stored(s, STORED_ORDERS)
    s.insert(STORED_ORDERS, s.frame(t.ORDERS).where("o_orderkey % 2 = 0"))
    rows, total = s.query(STORED_ORDERS).page(10)
    s.insert(STORED_ORDERS, s.frame(t.ORDERS).where("o_orderkey % 2 = 1"))
    return s.spark.createDataFrame([(total.first()["n"], rows.where("o_orderkey % 2 = 0").count())], "n long, page_rows long")


@query("cached_across_commits", "SELECT count(*) AS n FROM region")
def _(s: Session) -> DataFrame:
    """A cached result isn't used once the table has changed."""
    s, rows = stored(s, NAMES), s.frame(t.REGION).select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.col("r_name").alias("name"))
    s.seed(NAMES, rows.where("id < 3"))
    s.query(NAMES).cached("names").to_list()
    s.seed(NAMES, rows.where("id >= 3"))
    return s.spark.createDataFrame([(len(s.query(NAMES).cached("names").to_list()),)], "n long")


@query("stamped_and_computed", "SELECT s_suppkey AS id, concat(s_name, '!') AS label, true AS stamped FROM supplier")
def _(s: Session) -> DataFrame:
    """Stamps are now, in UTC; computed columns follow their expression."""
    made = Entity("made", (Col("id", "long", key=True), Col("name"), Col("label", computed="concat(name, '!')"), Col("made", "timestamp", stamp=True)))
    s = stored(s, made)
    s.insert(made, s.frame(t.SUPPLIER).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    age = F.unix_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())) - F.unix_timestamp(F.col("made").cast("timestamp"))
    return s.all(made).select("id", "label", F.abs(age).between(0, 3600).alias("stamped"))


@query("reserved_words", "SELECT n_nationkey AS id, n_name AS \"select\" FROM nation WHERE n_nationkey > 4")
def _(s: Session) -> DataFrame:
    order = Entity("order", (Col("id", "long", key=True), Col("select")))
    s = stored(s, order)
    s.insert(order, s.frame(t.NATION).select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("select")))
    return s.query(order).where("`order`.`id` > {}", 4).order_by("select").df()


@query("naming_snake", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2)")
def _(s: Session) -> DataFrame:
    """An entity declared in another style, under the naming option; properties keep their names in queries."""
    nation = Entity("Nation", (Col("NNationkey", "int", key=True), Col("NName"), Col("NRegionkey", "int")))
    snake = Session(s.spark, s.catalog, Options(naming="snake"))
    return snake.query(nation).where_in("NRegionkey", [1, 2]).order_by("NNationkey").df()


# --- terminals and the rest of a session, as rows

query("to_list", "SELECT * FROM nation WHERE n_regionkey = 2")(lambda s: s.spark.createDataFrame(s.query(t.NATION).where("n_regionkey = {}", 2).to_list(), t.NATION.schema()))
query("rows_streamed", "SELECT * FROM nation WHERE n_nationkey >= 7")(lambda s: s.spark.createDataFrame(list(s.rows("SELECT * FROM n WHERE n_nationkey >= {}", 7, n=t.NATION)), t.NATION.schema()))
query("sql_first", "SELECT * FROM region ORDER BY r_regionkey DESC LIMIT 1")(lambda s: s.spark.createDataFrame([s.sql_first("SELECT * FROM r ORDER BY r_regionkey DESC", r=t.REGION)], t.REGION.schema()))
query("sql_single", "SELECT * FROM region WHERE r_regionkey = 2")(lambda s: s.spark.createDataFrame([s.sql_single("SELECT * FROM r WHERE r_regionkey = {}", 2, r=t.REGION)], t.REGION.schema()))
query("scalar_default", "SELECT -1 AS n, (SELECT max(o_orderkey) FROM orders) AS greatest")(
    lambda s: s.spark.createDataFrame([(s.scalar("SELECT max(o_orderkey) FROM o WHERE o_orderkey < {}", -5, default=-1, o=t.ORDERS), s.scalar("SELECT max(o_orderkey) FROM o", o=t.ORDERS))], "n int, greatest long")
)
query("count_taken", "SELECT count(*) AS n FROM (SELECT 1 FROM orders LIMIT 40 OFFSET 7)")(lambda s: s.query(t.ORDERS).order_by("o_orderkey").take(40).skip(7).count_df())
query("in_memory_rows", "SELECT * FROM (VALUES (1, 'x'), (2, NULL)) AS v(id, name) WHERE name IS NULL OR id = 1")(lambda s: _in_memory(s).query(NAMES).where("name IS NULL").or_where("id = {}", 1).df())
query("filter_joined", f"SELECT l.* FROM lineitem l JOIN {SD} o ON l.l_orderkey = o.o_orderkey AND o.deleted_at IS NULL WHERE l.l_quantity > 40")(
    lambda s: s.query(t.LINEITEM).include(t.ORDERS_SD, "l_orderkey").where("l_quantity > {}", 40).filter_joined().df()
)
query("filter_joined_tenant", f"SELECT c.* FROM customer c LEFT JOIN {EV} e ON e.user_id = c.c_custkey AND e.value > 90 AND e.tenant_id = 2")(
    lambda s: s.with_tenant(2).query(t.CUSTOMER).left_join(t.EVENTS_T, "events_t.user_id = customer.c_custkey AND events_t.value > {}", 90).filter_joined().df()
)
query("cte_literal", "WITH named AS (SELECT * FROM region WHERE r_name <> ':p0' AND r_regionkey > 0) SELECT * FROM named WHERE r_regionkey < 4")(
    lambda s: s.query(t.REGION).where("r_regionkey < {}", 4).with_cte("named", s.query(t.REGION).where("r_name <> ':p0'").where("r_regionkey > {}", 0)).df()
)
query("cte_of_cte", "SELECT * FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'O' AND o_orderkey < 900")(
    lambda s: s.query(t.ORDERS).with_cte("b", s.query(t.ORDERS).with_cte("a", s.query(t.ORDERS).where("o_totalprice > {}", 50000)).where("o_orderstatus = {}", "O")).where("o_orderkey < {}", 900).df()
)
query("where_in_long", "SELECT * FROM orders WHERE o_orderkey IN (SELECT 3 * i FROM range(900) AS r(i))")(lambda s: s.query(t.ORDERS).where_in("o_orderkey", [3 * k for k in range(900)]).df())
query("where_not_in_long", "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT 3 * i FROM range(900) AS r(i))")(lambda s: s.query(t.ORDERS).where_not_in("o_orderkey", [3 * k for k in range(900)]).df())
query("raw_fragment", "SELECT * FROM part ORDER BY p_size DESC, p_partkey LIMIT 15")(lambda s: s.query(t.PART).raw("ORDER BY p_size DESC, p_partkey LIMIT 15").df())
query("property_names", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0")(lambda s: _suppliers(s))
query("join_broadcast", JOIN_SQL)(lambda s: s.sql(f"SELECT /*+ BROADCAST(c) */ {JOINED}", "BUILDING", o=t.ORDERS, c=t.CUSTOMER))
query("join_merge", JOIN_SQL)(lambda s: s.sql(f"SELECT /*+ MERGE(c) */ {JOINED}", "BUILDING", o=t.ORDERS, c=t.CUSTOMER))
query("join_shuffle_hash", JOIN_SQL)(lambda s: s.sql(f"SELECT /*+ SHUFFLE_HASH(c) */ {JOINED}", "BUILDING", o=t.ORDERS, c=t.CUSTOMER))
TYPED = "SELECT true AS flag, 7 AS whole, 'it''s {x}' AS words, TIMESTAMP '2024-02-29 12:30:00' AS at, DATE '2024-02-29' AS day, CAST(12.5 AS DECIMAL(18,6)) AS money, 2.5::DOUBLE AS share, n_name FROM nation WHERE n_name <> '' AND n_nationkey < 3"
query("typed_args", TYPED)(
    lambda s: s.sql(
        "SELECT {0} AS flag, {1} AS whole, {2} AS words, {3} AS at, {4} AS day, CAST({5} AS DECIMAL(18,6)) AS money, {6} AS share, n_name FROM n WHERE n_name <> {7} AND n_nationkey < {8}",
        True, 7, "it's {x}", dt.datetime(2024, 2, 29, 12, 30), dt.date(2024, 2, 29), Decimal("12.5"), 2.5, "", 3, n=t.NATION,
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
)


def _in_memory(s: Session) -> Session:
    s.catalog.frame(NAMES, s.spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id long, name string"))
    return s


def _suppliers(s: Session) -> DataFrame:
    """Properties under names of their own, over a table's columns."""
    named = Entity("supplier_named", (Col("s_suppkey", "long", prop="Key", key=True), Col("s_name", prop="Name"), Col("s_nationkey", "int", prop="Nation"), Col("s_acctbal", "double", prop="Balance")))
    s.catalog.register(named, lambda session, _: session.frame(t.SUPPLIER))
    return s.query(named).where_in("Nation", [3]).where("s_acctbal > {}", 0).select("Key", "Name").order_by("Balance").df()


# --- types

JSON_EVENTS = Entity("json_events", (Col("event_id", "long", key=True), Col("props", "string", json=StructType([StructField("k", LongType())]))))


@query("json_roundtrip", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(s: Session) -> DataFrame:
    """Structs go in, JSON text is stored, structs come out."""
    s = stored(s, JSON_EVENTS)
    s.insert(JSON_EVENTS, s.frame(t.EVENTS).select("event_id", F.from_json("props", "k long").alias("props")))
    return s.all(JSON_EVENTS).select("event_id", F.col("props.k").alias("k"))


CENTS = Entity("cents", (Col("s_suppkey", "long", key=True), Col("s_acctbal", "double", converter=EURO)))


@query("converter_roundtrip", "SELECT s_suppkey, CAST(s_suppkey * 7 AS DOUBLE) AS s_acctbal FROM supplier")
def _(s: Session) -> DataFrame:
    s = stored(s, CENTS)
    s.insert(CENTS, s.frame(t.SUPPLIER).select("s_suppkey", (F.col("s_suppkey") * 7.0).alias("s_acctbal")))
    return s.all(CENTS)


@query("converter_stored", "SELECT s_suppkey, CAST(s_suppkey * 700 AS DOUBLE) AS s_acctbal FROM supplier")
def _(s: Session) -> DataFrame:
    """What the store holds, and what a converted value that is set or sought becomes."""
    s = stored(s, CENTS)
    s.insert(CENTS, s.frame(t.SUPPLIER).select("s_suppkey", F.lit(1.0).alias("s_acctbal")))
    s.update_rows(CENTS, s.frame(t.SUPPLIER).select("s_suppkey", (F.col("s_suppkey") * 7.0).alias("s_acctbal")))
    s.query(CENTS).where_in("s_acctbal", [7.0]).set("s_acctbal", 7.0).update()
    return s.frame(CENTS)


BRANDED = Entity("branded", (Col("p_partkey", "long", key=True), Col("p_name"), Col("p_brand"), Col("label", computed="concat(p_brand, '/', p_name)")))
query("computed_column", "SELECT p_partkey, p_name, p_brand, concat(p_brand, '/', p_name) AS label FROM part")(lambda s: to_stored(s.frame(t.PART).select("p_partkey", "p_name", "p_brand"), BRANDED))

# --- beyond the reference: what Spark adds to such a layer

query("ext_union", "SELECT n_name AS name FROM nation UNION SELECT r_name FROM region")(lambda s: s.frame(t.NATION).select(F.col("n_name").alias("name")).union(s.frame(t.REGION).select("r_name")).distinct())
query("ext_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")(lambda s: s.frame(t.CUSTOMER).select("c_custkey").subtract(s.frame(t.ORDERS).select("o_custkey")))
query("ext_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")(lambda s: s.frame(t.CUSTOMER).select(F.col("c_nationkey").alias("k")).intersect(s.frame(t.SUPPLIER).select("s_nationkey")))
query("ext_semi_join", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")(
    lambda s: s.frame(t.CUSTOMER).join(s.frame(t.ORDERS).where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
)
query("ext_anti_join", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")(lambda s: s.frame(t.CUSTOMER).join(s.frame(t.ORDERS), F.col("c_custkey") == F.col("o_custkey"), "left_anti"))
query("ext_except_some", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")(
    lambda s: s.frame(t.CUSTOMER).select("c_custkey").subtract(s.frame(t.ORDERS).where("o_totalprice > 150000").select("o_custkey"))
)
query("ext_anti_join_some", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")(
    lambda s: s.frame(t.CUSTOMER).join(s.frame(t.ORDERS).where("o_totalprice > 150000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
)
query("ext_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")(lambda s: s.frame(t.CUSTOMER).rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")))
query("ext_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda s: s.frame(t.LINEITEM).cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")))
query("ext_window_typed", "SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC) AS r FROM orders")(
    lambda s: s.frame(t.ORDERS).select("o_orderkey", F.dense_rank().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"))).alias("r"))
)
query("ext_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")(
    lambda s: windows.tumbling(s.frame(t.EVENTS), "1 hour", "event_type", n=F.count("*"))
)
query("ext_tpch_q1", f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS {MONEY})) AS DECIMAL(28,6)) AS sum_qty, CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DECIMAL(28,6)) AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")(
    lambda s: s.query(t.LINEITEM).where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'").group_by("l_returnflag", "l_linestatus").agg(sum_qty=f"CAST(sum(CAST(l_quantity AS {MONEY})) AS DECIMAL(28,6))", sum_base=f"CAST(sum(CAST(l_extendedprice AS {MONEY})) AS DECIMAL(28,6))", n="count(*)").df()
)
query("ext_tpch_q3", f"SELECT o_orderkey, o_orderdate, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS {MONEY})) AS DECIMAL(28,6)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10")(
    lambda s: s.sql(f"SELECT o_orderkey, o_orderdate, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS {MONEY})) AS DECIMAL(28,6)) AS revenue FROM c JOIN o ON c_custkey = o_custkey JOIN l ON l_orderkey = o_orderkey WHERE c_mktsegment = {{}} GROUP BY 1, 2 ORDER BY revenue DESC, o_orderkey LIMIT 10", "BUILDING", c=t.CUSTOMER, o=t.ORDERS, l=t.LINEITEM)
)


def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    target = rows.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(rows, "embedding", target, 10).select("vec_id", "label")


QUERIES["ext_vector_top_k"] = _nearest
ORACLE_SQL["ext_vector_top_k"] = "SELECT vec_id, label FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), vec_id LIMIT 10"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed filters with OR, ordering and top-k through the builder."""
    s = t.open_tables(spark, sf_dir)
    return s.query(t.ORDERS).where("o_totalprice > {}", 100000).or_where("o_orderpriority = {}", "1-URGENT").order_by("o_totalprice", descending=True).then_by("o_orderkey").take(10).tag("flagship").df()


QUERIES["flagship"] = flagship
ORACLE_SQL["flagship"] = "SELECT * FROM orders WHERE (o_totalprice > 100000) OR (o_orderpriority = '1-URGENT') ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"
