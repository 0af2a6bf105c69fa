"""Text formatting and value mapping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_text(amount: Column) -> Column:
    """``$1,234.50``; NULL stays NULL."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def relabel(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace values found in ``labels``; others pass through unchanged.

    The map is a literal in the plan, so it suits a label list written by hand. Join a dimension
    table for anything that grows with the data.
    """
    if not labels:
        return value
    pairs = F.create_map(*[F.lit(item) for pair in labels.items() for item in pair])
    return F.coalesce(pairs[value], value)
