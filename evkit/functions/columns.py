"""Scalar expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shot type that is worth two points, and the mark of a three-point zone.
TWO_POINT_TYPE = "2PT Field Goal"
THREE_POINT_MARK = "3"
MADE_WORD = "made"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sort_keys(order: Sequence[str]) -> list[Column]:
    """Sort columns from names; a leading "-" means descending."""
    return [F.col(o[1:]).desc() if o.startswith("-") else F.col(o).asc() for o in order]


def rounded(c: Column, scale: int | None, rounding: str = "half_up") -> Column:
    """Round half up (SQL habit) or half even (data-frame habit); scale None keeps `c`."""
    if scale is None:
        return c
    if rounding not in ("half_up", "half_even"):
        raise ValueError(f"unknown rounding {rounding!r}")
    return F.round(c, scale) if rounding == "half_up" else F.bround(c, scale)


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; null when den is 0 or null."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def flag_to_label(flag: str | Column) -> Column:
    """1 for true, 0 for false or null."""
    return F.when(as_col(flag), 1).otherwise(0)


def contains_word(text: str | Column, word: str = MADE_WORD) -> Column:
    return F.contains(F.lower(as_col(text)), F.lit(word.lower()))


def text_to_label(text: str | Column, word: str = MADE_WORD) -> Column:
    """1 when the text holds `word` in any case."""
    return flag_to_label(contains_word(text, word))


def point_value_from_type(shot_type: str | Column, two: str = TWO_POINT_TYPE) -> Column:
    """2 for the two-point type, 3 for anything else, null included."""
    return F.when(as_col(shot_type) == two, 2).otherwise(3)


def point_value_from_zone(zone: str | Column, mark: str = THREE_POINT_MARK) -> Column:
    """3 for a zone whose name holds the mark, 2 for anything else, null included."""
    return F.when(as_col(zone).contains(mark), 3).otherwise(2)


def opponent_of(side: str | Column, home: str | Column, away: str | Column) -> Column:
    """The away code when `side` is at home, else the home code."""
    return F.when(as_col(side) == as_col(home), as_col(away)).otherwise(as_col(home))


def over_flag(pts: str | Column, xp: str | Column) -> Column:
    """'yes' when actual exceeds expected; ties and nulls give 'no' (B23)."""
    return F.when(as_col(pts) > as_col(xp), "yes").otherwise("no")


def pct_text(c: str | Column) -> Column:
    """71.0 -> '71.0%' (B27). For display: rank on the number, not on this text."""
    return F.concat(as_col(c).cast("string"), F.lit("%"))


def signed_text(c: str | Column, decimals: int = 1, suffix: str = "") -> Column:
    """1.23 -> '+1.2' followed by `suffix` (B28); null stays null."""
    c = as_col(c).cast("double")
    text = F.format_string(f"%+.{decimals}f{suffix.replace('%', '%%')}", c)
    return F.when(c.isNotNull(), text)
