"""Scoring of arriving files with the same row rules as the batch job, and windows over event time."""

from .monitor import monitor_stream, monitor_table
from .scoring import score_stream

__all__ = ["monitor_stream", "monitor_table", "score_stream"]
