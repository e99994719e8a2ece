"""The provided tables seen as transactions, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import uniform

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FEATURES = ["days", "quantity", "amount", "discount", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a rare label that quantity and discount explain, and two scores.

    Two line items may have the same four numbers; the ship day is the last tie-break of the key.
    """
    li = table(spark, sf_dir, "lineitem")
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    u = uniform(LINE_KEY, 42)
    rare = (u < 0.0005) | ((F.col("l_quantity") >= 45) & (F.col("l_discount") >= 0.09) & (u < 0.10))
    return li.select(
        F.concat_ws("|", *LINE_KEY, days).alias("row_id"), days.cast("double").alias("days"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.when(rare, 1).otherwise(0).alias("label"), (F.col("l_extendedprice") / 105000).alias("score"),
        (F.col("l_discount") * 10).alias("tied"),
    )


TX = """
hashed AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, 42)), 1, 8))::BIGINT
    / 4294967296.0 AS u FROM lineitem),
tx AS (
  SELECT concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)) AS row_id,
    date_diff('day', TIMESTAMP '1992-01-01', l_shipdate)::DOUBLE AS days, l_quantity AS quantity,
    l_extendedprice AS amount, l_discount AS discount, l_tax AS tax, l_returnflag AS returnflag,
    l_linestatus AS linestatus,
    CASE WHEN u < 0.0005 OR (l_quantity >= 45 AND l_discount >= 0.09 AND u < 0.10) THEN 1 ELSE 0 END AS label,
    l_extendedprice / 105000 AS score, l_discount * 10 AS tied
  FROM hashed)
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow line items with many identical rows."""
    return transactions(spark, sf_dir).select(
        "row_id", "quantity", "discount", "tax", F.when(F.col("returnflag") == "R", 1).otherwise(0).alias("label")
    )


LINES = TX + """, lines AS (
  SELECT row_id, quantity, discount, tax, CASE WHEN returnflag = 'R' THEN 1 ELSE 0 END AS label FROM tx)
"""


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an upload: text cells, some of them broken, chosen by the md5 of the id."""
    ev = table(spark, sf_dir, "events")
    digit = [F.substring(F.md5(F.col("event_id").cast("string")), i, 1) for i in (1, 2)]
    amount = (
        F.when(digit[0] == "1", "abc").when(digit[0] == "2", F.lit(None)).when(digit[0] == "3", "inf")
        .when(digit[0] == "4", "-5").otherwise(F.col("value").cast("string"))
    )
    v1 = F.when(digit[1] == "1", "n/a").when(digit[1] == "3", "-inf").otherwise(F.col("user_id").cast("string"))
    return ev.select(
        "event_id", "event_type", v1.alias("V1"), amount.alias("Amount"),
        F.when(digit[1] == "7", 1).otherwise(0).alias("Class"),
    )


DIRTY = """
marked AS (SELECT *, substr(md5(event_id::VARCHAR), 1, 1) AS d1, substr(md5(event_id::VARCHAR), 2, 1) AS d2 FROM events),
dirty AS (
  SELECT event_id, event_type,
    CASE d2 WHEN '1' THEN 'n/a' WHEN '3' THEN '-inf' ELSE user_id::VARCHAR END AS v1_text,
    CASE d1 WHEN '1' THEN 'abc' WHEN '2' THEN NULL WHEN '3' THEN 'inf' WHEN '4' THEN '-5' ELSE value::VARCHAR END AS amount_text,
    CASE d2 WHEN '1' THEN NULL WHEN '3' THEN '-inf'::DOUBLE ELSE user_id::DOUBLE END AS v1,
    CASE d1 WHEN '1' THEN NULL WHEN '2' THEN NULL WHEN '3' THEN 'inf'::DOUBLE WHEN '4' THEN -5.0 ELSE value END AS amount,
    CASE d2 WHEN '7' THEN 1 ELSE 0 END AS class
  FROM marked)
"""
