"""Column expressions; all of them are built-in Spark expressions."""

from evkit.functions.columns import (
    as_col,
    contains_word,
    flag_to_label,
    opponent_of,
    over_flag,
    pct_text,
    point_value_from_type,
    point_value_from_zone,
    rounded,
    safe_ratio,
    signed_text,
    sort_keys,
    text_to_label,
)
from evkit.functions.vectors import positive_probability

__all__ = [
    "as_col",
    "contains_word",
    "flag_to_label",
    "opponent_of",
    "over_flag",
    "pct_text",
    "point_value_from_type",
    "point_value_from_zone",
    "positive_probability",
    "rounded",
    "safe_ratio",
    "signed_text",
    "sort_keys",
    "text_to_label",
]
