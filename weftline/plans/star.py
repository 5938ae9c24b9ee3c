"""The entities of the shared test tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.query import Database
from ..sources.tables import directory
from .model import Model, array, bigint, double, integer, json, real, text, timestamp


def star_model() -> Model:
    m = Model()
    m.entity("region", "r_regionkey", r_regionkey=integer(), r_name=text()).has_many("nations", "nation", "r_regionkey", "n_regionkey")
    nation = m.entity("nation", "n_nationkey", n_nationkey=integer(), n_name=text(), n_regionkey=integer())
    nation.has_one("region", "region", "n_regionkey", "r_regionkey", True)
    nation.has_many("customers", "customer", "n_nationkey", "c_nationkey").has_many("suppliers", "supplier", "n_nationkey", "s_nationkey")
    customer = m.entity("customer", "c_custkey", c_custkey=bigint(), c_name=text(), c_nationkey=integer(), c_acctbal=double(), c_mktsegment=text())
    customer.has_one("nation", "nation", "c_nationkey", "n_nationkey", True)
    customer.has_many("orders", "orders", "c_custkey", "o_custkey").has_many("events", "events", "c_custkey", "user_id")
    supplier = m.entity("supplier", "s_suppkey", s_suppkey=bigint(), s_name=text(), s_nationkey=integer(), s_acctbal=double())
    supplier.has_one("nation", "nation", "s_nationkey", "n_nationkey", True).has_many("lines", "lineitem", "s_suppkey", "l_suppkey")
    part = m.entity("part", "p_partkey", p_partkey=bigint(), p_name=text(), p_brand=text(), p_type=text(), p_size=integer(), p_retailprice=double())
    part.has_many("lines", "lineitem", "p_partkey", "l_partkey")
    orders = m.entity("orders", "o_orderkey", o_orderkey=bigint(), o_custkey=bigint(), o_orderstatus=text(), o_totalprice=double(), o_orderdate=timestamp(), o_orderpriority=text())
    orders.has_one("customer", "customer", "o_custkey", "c_custkey", True).has_many("lines", "lineitem", "o_orderkey", "l_orderkey")
    line = m.entity(
        "lineitem", (), l_orderkey=bigint(), l_partkey=bigint(), l_suppkey=bigint(), l_linenumber=integer(), l_quantity=double(), l_extendedprice=double(),
        l_discount=double(), l_tax=double(), l_returnflag=text(), l_linestatus=text(), l_shipdate=timestamp(),
    )
    line.has_one("order", "orders", "l_orderkey", "o_orderkey", True)
    line.has_one("part", "part", "l_partkey", "p_partkey", True).has_one("supplier", "supplier", "l_suppkey", "s_suppkey", True)
    events = m.entity("events", "event_id", event_id=bigint(), ts=timestamp(), user_id=bigint(), event_type=text(), value=double(), props=json())
    events.has_one("customer", "customer", "user_id", "c_custkey")
    documents = m.entity("documents", "doc_id", doc_id=bigint(), text=text(), lang=text(), source=text(), n_chars=bigint())
    documents.has_one("label", "labels", "doc_id", "doc_id")
    m.entity("labels", "doc_id", doc_id=bigint(), quality=integer(), toxic=integer())
    m.entity("conversations", ("conv_id", "turn"), conv_id=bigint(), turn=bigint(), role=text(), text=text())
    m.entity("embeddings", "vec_id", vec_id=bigint(), embedding=array(real()), label=integer())
    return m


def star(spark: SparkSession, sf_dir: str) -> Database:
    return Database(spark, star_model(), directory(spark, sf_dir))
