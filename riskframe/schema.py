"""Published transaction schema and the names a file may use for it."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and their published order.
V_COLS = [f"V{i}" for i in range(1, 29)]
FEATURE_COLS = ["Time", *V_COLS, "Amount"]
LABEL_COL = "Class"
LABEL_ALIASES = {"class", "label", "isfraud", "fraud", "target"}

# Seed, split share, folds and threshold grid.
SEED = 42
TEST_SIZE = 0.20
FOLDS = 5
GRID_START, GRID_STOP, GRID_STEP = 0.05, 0.96, 0.05


def transaction_schema(with_label: bool = True) -> T.StructType:
    fields = [T.StructField(c, T.DoubleType()) for c in FEATURE_COLS]
    if with_label:
        fields.append(T.StructField(LABEL_COL, T.LongType()))
    return T.StructType(fields)
