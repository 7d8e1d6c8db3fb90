"""Numeric text cleaning (F1) and non-finite handling.

All of it is native Column expressions, so it stays inside whole-stage
codegen.  Plain ``cast`` is never used: under ANSI mode it throws, and its
Java-style parser accepts suffixes such as ``5d`` that the reference
rejects.  A regular expression guards ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's cleaning rules:
# every "," and every "--" is removed, and a whole cell that is one of
# NA, N/A, None, null, nan (case-sensitive, blanks around allowed) is blanked.
REMOVED_SUBSTRINGS = [",", "--"]
BLANK_CELL_PATTERN = r"^\s*(NA|N/A|None|null|nan)\s*$"

# Decimal / scientific literal accepted by the numeric parser.
DECIMAL_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITY_PATTERN = r"^(?i)[+]?(inf|infinity)$"
NEG_INFINITY_PATTERN = r"^(?i)-(inf|infinity)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Remove leading/trailing whitespace (tabs and newlines too)."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def parse_number(text: Column | str) -> Column:
    """Text -> DOUBLE: decimal/scientific literals, +-inf; anything else NULL
    (NaN spellings included, because NaN means missing everywhere here)."""
    t = _col(text)
    return (F.when(t.rlike(DECIMAL_PATTERN), t.try_cast("double"))
             .when(t.rlike(INFINITY_PATTERN), F.lit(float("inf")))
             .when(t.rlike(NEG_INFINITY_PATTERN), F.lit(float("-inf"))))


def clean_numeric(c: Column | str) -> Column:
    """reference numeric cleaning of one text column."""
    s = _col(c).cast("string")
    for token in REMOVED_SUBSTRINGS:
        s = F.replace(s, F.lit(token), F.lit(""))
    s = F.regexp_replace(s, BLANK_CELL_PATTERN, "")
    return parse_number(strip_ws(s))


def nonfinite_to_null(c: Column | str) -> Column:
    """NaN and +-inf become NULL (Spark aggregates do not skip NaN)."""
    x = _col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)
