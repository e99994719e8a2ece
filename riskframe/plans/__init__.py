"""End-to-end jobs composed from the operators."""

from .cleaning import clean_and_split
from .evaluation import final_evaluation
from .explanation import explain_model
from .profiling import profile_report
from .scoring import score_file
from .selecting import compare_strategies, select_and_freeze

__all__ = [
    "clean_and_split", "compare_strategies", "explain_model", "final_evaluation", "profile_report",
    "score_file", "select_and_freeze",
]
