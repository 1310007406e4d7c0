"""Expressions on ML vector columns."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column

from evkit.functions.columns import as_col


def positive_probability(probability: str | Column = "probability") -> Column:
    """Probability of class 1."""
    return vector_to_array(as_col(probability))[1]
