"""Verbosity names and their severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.text import fold

# Verbosity names a line may carry, and the rank of the ones
# that stand out. Every other name, known or not, has the lowest rank.
KNOWN_VERBOSITIES = ["fatal", "error", "warning", "display", "log", "verbose", "veryverbose"]
SEVERITY_RANKS = {"fatal": 5, "error": 4, "warning": 3, "display": 2}
LOWEST_RANK = 1


def severity_rank(verbosity: Column) -> Column:
    name = fold(verbosity)
    rank = F.lit(LOWEST_RANK)
    for known, value in SEVERITY_RANKS.items():
        rank = F.when(name == known, F.lit(value)).otherwise(rank)
    return rank


def rank_of(verbosity: str) -> int:
    """Plan-time rank of a verbosity name given by the user."""
    return SEVERITY_RANKS.get(verbosity.lower(), LOWEST_RANK)


def is_warning(verbosity: Column) -> Column:
    return fold(verbosity) == "warning"


def is_error(verbosity: Column) -> Column:
    return fold(verbosity).isin("error", "fatal")
