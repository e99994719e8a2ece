"""Column functions used by the operators."""

from .frames import cut_lineage, explode_count, explode_features, join_on, one_row, shared_folder, spread
from .hashing import hash_token, row_hash, uniform
from .text import canonical_name, display_name, join_names, strip_prefix
from .values import (
    case,
    direction,
    fold_nan,
    grid,
    is_close,
    is_inf,
    is_missing,
    log1p,
    round_to,
    safe_div,
    to_double,
)

__all__ = [
    "canonical_name", "case", "cut_lineage", "direction", "display_name",
    "explode_count", "explode_features", "one_row", "shared_folder", "spread",
    "fold_nan", "grid", "hash_token", "is_close", "is_inf", "is_missing", "join_names",
    "join_on", "log1p", "round_to", "row_hash", "safe_div", "strip_prefix", "to_double",
    "uniform",
]
