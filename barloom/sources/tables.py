"""Bar series and option chains made from the driver tables, and the same in SQL.

``bars`` has one row per symbol and hour; ``chain`` one per day, option type and strike.  Both aggregate before
anything else, so the series that later windows order are bounded by time, not by the number of raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, grain: str = "hour") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume): ``events`` by event type and ``grain``."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "value")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc(grain, "ts").cast("timestamp_ntz").alias("t")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    ).withColumnRenamed("t", "ts")


BARS_SQL = """
bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY ALL)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, expiry, strike, option_type, symbol, open, high, low, close, volume, oi): ``lineitem`` as an option chain."""
    line = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_linestatus", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    keyed = line.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("EXP"), F.year("l_shipdate").cast("string")).alias("expiry"),
        (F.col("l_linenumber") * 100.0).alias("strike"),
        F.when(F.col("l_linestatus") == "F", "PE").otherwise("CE").alias("option_type"),
        "l_extendedprice",
        "l_quantity",
    )
    cells = keyed.groupBy("ts", "expiry", "strike", "option_type").agg(
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).cast("double") / F.count(F.lit(1)) / 100).alias("close"),
        F.round(F.sum("l_quantity"), 2).alias("volume"),
        F.count(F.lit(1)).cast("double").alias("oi"),
    )
    symbol = F.concat(F.lit("IDX"), F.col("expiry"), F.col("strike").cast("int").cast("string"), F.col("option_type"))
    return cells.select("ts", "expiry", "strike", "option_type", symbol.alias("symbol"), ((F.col("high") + F.col("low")) / 2).alias("open"), "high", "low", "close", "volume", "oi")


CHAIN_SQL = """
chain AS (
  SELECT ts, expiry, strike, option_type, 'IDX' || expiry || CAST(CAST(strike AS INT) AS VARCHAR) || option_type AS symbol,
         (high + low) / 2 AS open, high, low, close, volume, oi
  FROM (
    SELECT l_shipdate AS ts, 'EXP' || CAST(year(l_shipdate) AS VARCHAR) AS expiry, l_linenumber * CAST(100 AS DOUBLE) AS strike,
           CASE WHEN l_linestatus = 'F' THEN 'PE' ELSE 'CE' END AS option_type, max(l_extendedprice) AS high,
           min(l_extendedprice) AS low,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS close, round(sum(l_quantity), 2) AS volume,
           CAST(count(*) AS DOUBLE) AS oi
    FROM lineitem GROUP BY ALL))"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cfg, day, seq, ret): orders as a ledger; the return is the price against the priority's round figure."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("cfg"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("seq"),
        F.round((F.col("o_totalprice") % 1000.0) / 100.0 - 4.9, 4).alias("ret"),
    )


TRADES_SQL = """
trades AS (
  SELECT o_orderpriority AS cfg, CAST(o_orderdate AS DATE) AS day, o_orderkey AS seq,
         round((o_totalprice % CAST(1000 AS DOUBLE)) / CAST(100 AS DOUBLE) - CAST(4.9 AS DOUBLE), 4) AS ret FROM orders)"""
