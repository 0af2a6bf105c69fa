"""Date parsing and calendar columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ISO weekday on which the weekend starts. 5 is Friday, the source analysis' own definition; pass 6
# for Saturday and Sunday.
WEEKEND_START = 5


def parse_date(text: Column, fmt: str = "M/d/yyyy", mode: str = "strict") -> Column:
    """Date from text. ``strict`` fails the query on bad text, ``lenient`` yields NULL."""
    if mode == "strict":
        return F.to_date(text, fmt)
    if mode == "lenient":
        return F.try_to_date(text, fmt)
    raise ValueError(f"mode must be 'strict' or 'lenient', not {mode!r}")


def iso_weekday(date: Column) -> Column:
    """1 is Monday, 7 is Sunday."""
    return F.weekday(date) + F.lit(1)


def calendar_columns(date: Column, weekend_start: int = WEEKEND_START) -> dict[str, Column]:
    """Year, month, quarter, ISO weekday and weekend flag, ready for ``withColumns``."""
    weekday = iso_weekday(date)
    return {
        "year": F.year(date),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "weekday": weekday,
        "is_weekend": weekday >= F.lit(weekend_start),
    }


def quarter_label(year: Column, quarter: Column) -> Column:
    """``2022 Q1``."""
    return F.concat(year.cast("string"), F.lit(" Q"), quarter.cast("string"))
