"""What arrived when: event-time windows with a watermark, late rows counted instead of lost.

Rows of a window and group are summed in state, dealt over salts so that a frequent group has no task of its own.
A window is given out once, when the watermark (the latest event time less the allowed delay) has passed
its end; rows that come for it afterwards are counted as late. The sink holds partial rows, which
``monitor_table`` adds up. Rows without an event time belong to no window and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SALTS = 16
SINGLE_OPERATOR = "spark.sql.streaming.statefulOperator.allowMultiple"
#: A time after all events (the year 2200; pandas ends in 2262), in seconds.
NEVER = 7_258_118_400


def millis(df: DataFrame, time: str) -> Column:
    """Milliseconds since 1970 of a timestamp with or without a time zone, whatever the session's zone."""
    if df.schema[time].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{time}`) div 1000")
    return F.unix_millis(time)


def monitor_stream(
    stream: DataFrame, out: str, checkpoint: str, time: str = "ts", group: str = "event_type", value: str = "value",
    window_seconds: int = 86_400, delay: str = "1 hour", salts: int = SALTS, once: bool = True,
) -> StreamingQuery:
    """Write window_start (seconds), group, n, valued, total, largest and late; rows without a value count in n only."""
    length = window_seconds * 1000
    at = millis(stream, time)
    rows = stream.filter(F.col(time).isNotNull()).select(F.timestamp_millis(at).alias("at"), at.alias("ms"), F.col(group).alias("of"), F.col(value).alias("value"))
    # The state operator drops rows whose event time is behind the watermark before it can count them. A second event
    # time that never is stands in for the first; of two watermarks the lesser counts, so the first one's stays in force.
    rows = rows.withWatermark("at", delay).withColumn("never", F.timestamp_seconds(F.lit(NEVER))).withWatermark("never", "0 seconds")
    start = (F.floor(F.col("ms") / length) * length).cast("long")
    salt = F.pmod(F.xxhash64("ms", "value"), F.lit(salts)).cast("int")
    rows = rows.select(start.alias("start"), F.col("of").cast("string").alias("of"), salt.alias("salt"), F.col("value").cast("double").alias("value"), "never")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, of = int(key[0]), key[1]

        def row(n: int, valued: int, total: float, largest: float | None, late: int) -> pd.DataFrame:
            return pd.DataFrame({"window_start": [start // 1000], "group": [of], "n": [n], "valued": [valued], "total": [total], "largest": [largest], "late": [late]})

        if state.hasTimedOut:
            told = tuple(state.get)
            state.remove()
            yield row(*told, 0)
            return
        values = pd.concat([b["value"] for b in batches], ignore_index=True)
        if start + length <= state.getCurrentWatermarkMs():
            yield row(0, 0, 0.0, None, len(values))
            return
        n, valued, total, largest = state.get if state.exists else (0, 0, 0.0, None)
        top = values.max()
        if pd.notna(top):
            largest = float(top) if largest is None else max(largest, float(top))
        state.update((n + len(values), valued + int(values.notna().sum()), total + float(values.sum()), largest))
        state.setTimeoutTimestamp(start + length - 1)  # given out when the watermark is beyond

    found = rows.groupBy("start", "of", "salt").applyInPandasWithState(
        update, "window_start long, group string, n long, valued long, total double, largest double, late long",
        "n long, valued long, total double, largest double", "append", GroupStateTimeout.EventTimeTimeout)
    writer = found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer
    # Two watermarks need the rules of queries with a single stateful operator, which this is; a query keeps what it was started with.
    conf = stream.sparkSession.conf
    before = conf.get(SINGLE_OPERATOR)
    conf.set(SINGLE_OPERATOR, "false")
    try:
        return writer.start()
    finally:
        conf.set(SINGLE_OPERATOR, before)


def monitor_table(spark: SparkSession, out: str) -> DataFrame:
    """window_start, group, n, mean, largest, late of the windows given out so far, or met by late rows only."""
    sums = spark.read.parquet(out).groupBy("window_start", "group").agg(
        F.sum("n").alias("n"), F.sum("valued").alias("valued"), F.sum("total").alias("total"), F.max("largest").alias("largest"), F.sum("late").alias("late"))
    return sums.select("window_start", "group", "n", F.when(F.col("valued") > 0, F.col("total") / F.col("valued")).alias("mean"), "largest", "late")
