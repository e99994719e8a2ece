"""Operators for text corpora: counting, cleaning, deduplication, scoring and mixing.

Nothing else in the library imports this package. Functions that run in Python workers are
pickled by value, so executors need no copy of it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
