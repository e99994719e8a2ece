"""Score a file of unknown layout from end to end."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import cut_lineage
from ..operators.columns import detect_schema, normalise_columns
from ..operators.scoring import evaluate_labelled, ranked_scores, score_summary, score_upload
from ..schema import LABEL_COL
from ..sources.tables import write_table
from ..sources.uploads import MALFORMED, read_upload

# Fixed value: the reason of a row that has more or fewer cells than the first line.
RAGGED = "another number of cells"


class UnsuitableSchema(ValueError):
    """The file lacks model features; ``kind`` and ``missing`` say which."""

    def __init__(self, kind: str, missing: list[str]):
        self.kind, self.missing = kind, missing
        if kind == "partial":
            text = f"Of the model's features {len(missing)} are not in the file: {', '.join(missing)}"
        else:
            text = f"The file describes transactions in other terms than the model's; it lacks {', '.join(missing)}"
        super().__init__(text)


@dataclass
class ScoredFile:
    ranked: DataFrame
    rejected: DataFrame
    summary: DataFrame
    metrics: DataFrame | None


def score_file(
    spark: SparkSession, path: str, model, meta: Mapping, out: str | None = None, label: str = LABEL_COL,
    max_rows: int | None = None, multi_line: bool = False,
) -> ScoredFile:
    """Read, name, check, score, rank and export; rejected rows keep their reason.

    Scored and rejected rows are stored once, under ``out`` or in the shared folder, so that
    ranking, metrics and summary do not score the file again. ``path`` may be a folder of part files with equal
    headers; all are read in parallel, and in pieces unless ``multi_line`` allows line breaks in cells.
    """
    df = normalise_columns(read_upload(spark, path, max_rows, keep_malformed=True, multi_line=multi_line))
    kind, missing = detect_schema(df, meta["feature_order"])
    if kind != "pca":
        raise UnsuitableSchema(kind, missing)
    ragged = None
    if MALFORMED in df.columns:
        ragged = df.filter(F.col(MALFORMED).isNotNull()).drop(MALFORMED).withColumn("reason", F.lit(RAGGED))
        df = df.filter(F.col(MALFORMED).isNull()).drop(MALFORMED)
    valid, rejected = score_upload(model, meta, df)
    rejected = rejected if ragged is None else rejected.unionByName(ragged)
    if out:
        write_table(valid, f"{out}/scored")
        write_table(rejected, f"{out}/rejected")
        valid, rejected = spark.read.parquet(f"{out}/scored"), spark.read.parquet(f"{out}/rejected")
    else:
        valid, rejected = cut_lineage(valid), cut_lineage(rejected)
    # Scores tie; all columns after them keep a sort from putting one score into one task.
    ranked = ranked_scores(valid, key=[c for c in df.columns if c in valid.columns])
    if out:
        write_table(ranked, f"{out}/ranked", "csv")
    metrics = evaluate_labelled(valid, label) if label in valid.columns else None
    return ScoredFile(ranked, rejected, score_summary(valid, rejected), metrics)
