"""Driver tables as measurements."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import nanoseconds
from tidemark.model import Measurement


def events(spark: SparkSession, sf_dir: str) -> Measurement:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = t.select(nanoseconds(F.col("ts"), t.schema["ts"].dataType).alias("ts_ns"), "event_type", F.col("user_id").cast("string").alias("user_id"), "value", "event_id")
    return Measurement("events", df, ["event_type", "user_id"], ["event_id", "value"], ["event_id"])


def orders(spark: SparkSession, sf_dir: str) -> Measurement:
    t = spark.read.parquet(f"{sf_dir}/orders.parquet")
    df = t.select(nanoseconds(F.col("o_orderdate"), t.schema["o_orderdate"].dataType).alias("ts_ns"), "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey")
    return Measurement("orders", df, ["o_orderstatus", "o_orderpriority"], ["o_totalprice"], ["o_orderkey"])


def lineitem(spark: SparkSession, sf_dir: str) -> Measurement:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    fields = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = t.select(nanoseconds(F.col("l_shipdate"), t.schema["l_shipdate"].dataType).alias("ts_ns"), "l_returnflag", "l_linestatus", *fields, *keys)
    return Measurement("lineitem", df, ["l_returnflag", "l_linestatus"], fields, [*keys, "l_extendedprice"])


VIEWS = {"events": events, "orders": orders, "lineitem": lineitem}
