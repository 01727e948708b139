"""The benchmark tables as entities, and the same with soft delete, tenants and versions derived."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.entity import Col, Entity
from tidemark.errors import QueryError
from tidemark.session import Options, Session
from tidemark.sources.catalog import Catalog


def _entity(table: str, columns: str, **more) -> Entity:
    """Columns as "name type", the first one the key."""
    cols = [c.split() for c in columns.split(", ")]
    return Entity(table, tuple(Col(n, t, key=k == 0) for k, (n, t) in enumerate(cols)), **more)


REGION = _entity("region", "r_regionkey int, r_name string")
NATION = _entity("nation", "n_nationkey int, n_name string, n_regionkey int")
CUSTOMER = _entity("customer", "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
SUPPLIER = _entity("supplier", "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
PART = _entity("part", "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
ORDERS = _entity("orders", _ORDERS)
LINEITEM = _entity("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
_EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
EVENTS = _entity("events", _EVENTS)
PLAIN = (REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM, EVENTS)

ORDERS_SD = _entity("orders_sd", _ORDERS + ", deleted_at timestamp", soft_delete=True)
EVENTS_T = Entity("events_t", (*EVENTS.columns, Col("tenant_id", "long", nullable=False)), tenant=True)
CUSTOMER_V = Entity("customer_v", (*CUSTOMER.columns, Col("version", "long", version=True)))


def open_tables(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the Parquet files of one directory."""
    at = sf_dir.rstrip("/")
    catalog = Catalog(at)
    for e in PLAIN:
        catalog.parquet(e, f"{at}/{e.table}.parquet")
    read = lambda e: spark.read.parquet(f"{at}/{e.table}.parquet")
    catalog.register(ORDERS_SD, lambda *_: read(ORDERS).withColumn("deleted_at", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))))
    catalog.register(EVENTS_T, lambda *_: read(EVENTS).withColumn("tenant_id", F.col("user_id") % 5))
    catalog.register(CUSTOMER_V, lambda *_: read(CUSTOMER).withColumn("version", F.col("c_custkey") % 3))
    return Session(spark, catalog)


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a local one where a local master has none."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise QueryError("spark.checkpoint.dir names no folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    return f"{shared.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def open_store(spark: SparkSession, sf_dir: str, *managed: Entity, **options) -> Session:
    """A session over the Parquet files and over empty tables of a new store."""
    catalog = open_tables(spark, sf_dir).catalog
    session = Session(spark, catalog, Options(store=scratch(spark), **options))
    for e in managed:
        session.managed(e)
    session.migrate()
    return session
