"""Validation, scoring and quarantine per micro-batch; no state is kept."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scoring import score_upload


def score_stream(
    stream: DataFrame, model, meta: Mapping, scored_path: str, rejected_path: str, checkpoint: str,
    amount: str = "Amount", once: bool = True,
) -> StreamingQuery:
    """Write valid rows with probability and class, and rejected rows with their reason.

    Each batch goes to its own folder, so a batch that runs again after a failure replaces
    its earlier output.
    """

    def write(batch: DataFrame, number: int) -> None:
        valid, rejected = score_upload(model, meta, batch, amount)
        valid.write.mode("overwrite").parquet(f"{scored_path}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
