"""Streams over the provided events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.frames import cut_lineage, shared_folder
from ..streaming import monitor_stream, monitor_table
from ..streaming.monitor import millis
from .fixtures import table
from .registry import query, rounded

# Events arrive in four turns by time; a twentieth of them (by hash) comes one turn later than its time says.
ARRIVED = """
timed AS (SELECT *, epoch_ms(ts) AS ms FROM events),
arrived AS (SELECT *, least(4, (ms - (SELECT min(ms) FROM timed)) * 4 // (SELECT max(ms) - min(ms) + 1 FROM timed) + 1
  + CASE WHEN substr(md5(event_id::VARCHAR), 1, 2) < '0d' THEN 1 ELSE 0 END) AS part, ms // 86400000 * 86400 AS window_start FROM timed),
marks AS (SELECT part, max(max(ms)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 3600000 AS watermark FROM arrived GROUP BY part),
told AS (SELECT a.*, coalesce((window_start + 86400) * 1000 <= watermark, false) AS late FROM arrived a JOIN marks USING (part))
"""


def arrivals(events):
    """Events with the turn they arrive in."""
    timed = events.withColumn("ms", millis(events, "ts"))
    ends = timed.agg(F.min("ms").alias("lo"), F.max("ms").alias("hi")).first()
    turn = F.expr(f"(ms - {ends['lo'] or 0}) * 4 div {(ends['hi'] or 0) - (ends['lo'] or 0) + 1} + 1").cast("int")
    delayed = (F.substring(F.md5(F.col("event_id").cast("string")), 1, 2) < "0d").cast("int")
    return timed.withColumn("part", F.least(F.lit(4), turn + delayed)).drop("ms")


# Windows that the watermark has passed at the end; late rows are stated and not in the sums.
@query("event_windows", "WITH " + ARRIVED + """
SELECT window_start, event_type AS "group", count(*) FILTER (NOT late) AS n, round(avg(value) FILTER (NOT late), 6) AS mean,
  max(value) FILTER (NOT late) AS largest, count(*) FILTER (late) AS late
FROM told WHERE (window_start + 86400) * 1000 <= (SELECT max(ms) - 3600000 FROM timed) GROUP BY window_start, event_type""")
def event_windows(spark, sf):
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    arrived = cut_lineage(arrivals(table(spark, sf, "events")))
    for part in range(1, 5):
        arrived.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(arrived.drop("part").schema).parquet(f"{folder}/events")
        monitor_stream(stream, f"{folder}/windows", f"{folder}/checkpoint").awaitTermination()
    return rounded(monitor_table(spark, f"{folder}/windows"), 6)
