"""Column references that survive any user column name (dots, spaces, units)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def qc(name: str) -> Column:
    """Quoted column reference: ``PM2.5 (ug/m3)`` is one column, not a path."""
    return F.col("`" + name.replace("`", "``") + "`")
