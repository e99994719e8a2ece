"""Names: canonical column spellings and display forms."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import FEATURE_COLS, LABEL_ALIASES, LABEL_COL, V_COLS

# Components may be called V, PC or PCA, with the number in one digit or two.
PREFIXES = ("v", "pc", "pca")


def _spellings() -> dict[str, str]:
    known = dict.fromkeys(LABEL_ALIASES, LABEL_COL) | {c.lower(): c for c in FEATURE_COLS}
    for number, column in enumerate(V_COLS, 1):
        known |= {f"{prefix}{digits}": column for prefix in PREFIXES for digits in (str(number), f"{number:02d}")}
    return known


SPELLINGS = _spellings()
_OTHERS = {ord(c): None for c in map(chr, range(128)) if c not in string.ascii_letters + string.digits}


def canonical_name(name: str) -> str | None:
    """Model column meant by a spelling, or None when it is no model column."""
    letters = name.translate(_OTHERS).encode("ascii", "ignore").decode()
    return SPELLINGS.get(letters.lower())


def join_names(flags: Sequence[tuple[str, Column]]) -> Column:
    """Names whose flag holds, in the given order, joined by comma and space."""
    return F.concat_ws(", ", *[F.when(flag, F.lit(name)) for name, flag in flags])


def strip_prefix(c: Column, separator: str = "__") -> Column:
    """Part after the first separator, or the whole text when there is none."""
    at = F.instr(c, separator)
    return F.when(at > 0, F.substr(c, at + F.lit(len(separator)))).otherwise(c)


def display_name(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
