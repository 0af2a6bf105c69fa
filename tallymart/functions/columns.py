"""Columns by their exact names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact(name: str) -> Column:
    """A top-level column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")
