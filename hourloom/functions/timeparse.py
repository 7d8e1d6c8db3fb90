"""Best-of-N timestamp parsing.

A candidate accepts a text by its shape: one regular expression, the
alternatives of which are the shapes of the candidate's formats.  The fields of
a text are read once, whatever the number of formats: the digit runs, the month
word and the half of the day, in the places that the family of the shape (year
first, year last, worded, compact) gives them.  Month-first and day-first
readings are then two timestamps, and a candidate is one of them where it
accepts the text.  So a scan tries some forty formats with a handful of
expressions, which Spark can compile.

One grouped aggregate measures the success rate of each candidate per series;
the winner (ties -> earliest candidate) is projected back row by row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cols import qc

# The four explicit formats of the reference, in its order
# (month-first, day-first, ISO with seconds, ISO without seconds).
EXPLICIT_FORMATS = ["M/d/yyyy H:mm", "d/M/yyyy H:mm", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm"]
# Approximation of generic inference (documented difference): common layouts
# tried in order, month-first list then day-first list.
GENERIC_COMMON = ["yyyy-M-d'T'H:mm:ss", "yyyy-M-d'T'H:mm", "yyyy-M-d H:mm:ss", "yyyy-M-d H:mm",
                  "yyyy-M-d H:mm:ss.SSSSSS", "yyyy-M-d'T'H:mm:ss.SSSSSS", "yyyy-M-d",
                  "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d"]
# 12-hour clock, month names and compact dates: the same in both lists.
GENERIC_WORDED = ["yyyy-M-d h:mm:ss a", "yyyy-M-d h:mm a", "d MMM yyyy H:mm:ss", "d MMM yyyy H:mm", "d MMM yyyy",
                  "d-MMM-yyyy H:mm:ss", "d-MMM-yyyy H:mm", "d-MMM-yyyy", "MMM d, yyyy H:mm", "MMM d, yyyy h:mm a",
                  "MMM d, yyyy", "MMMM d, yyyy H:mm", "MMMM d, yyyy", "d MMMM yyyy H:mm", "d MMMM yyyy",
                  "yyyyMMddHHmmss", "yyyyMMddHHmm", "yyyyMMdd HH:mm", "yyyyMMdd'T'HHmmss", "yyyyMMdd"]
GENERIC_MONTH_FIRST = GENERIC_COMMON + ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
                                        "M-d-yyyy H:mm:ss", "M-d-yyyy H:mm", "M-d-yyyy",
                                        "M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a"]
GENERIC_DAY_FIRST = GENERIC_COMMON + ["d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy",
                                      "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy", "d.M.yyyy H:mm:ss",
                                      "d.M.yyyy H:mm", "d.M.yyyy", "d/M/yyyy h:mm:ss a", "d/M/yyyy h:mm a"]
# A zone written after a time of day; the wall clock as written is kept.
ZONE_SUFFIX = r"^(.*\d:\d{2}(?::\d{2}(?:\.\d+)?)?)\s*(?:[Zz]|UTC|GMT|[+-]\d{2}:?\d{2})$"
MIN_SUCCESS_RATE = 0.80


# pattern letter runs -> the digits they accept
_TOKENS = [("yyyy", r"\d{4}"), ("MMMM", r"[A-Za-z]{3,9}"), ("MMM", r"[A-Za-z]{3}"), ("SSSSSS", r"\d{1,6}"), ("MM", r"\d{2}"), ("dd", r"\d{2}"), ("HH", r"\d{2}"),
           ("mm", r"\d{2}"), ("ss", r"\d{2}"), ("M", r"\d{1,2}"), ("d", r"\d{1,2}"), ("H", r"\d{1,2}"), ("hh", r"\d{2}"),
           ("h", r"\d{1,2}"), ("a", r"[AaPp][Mm]")]


def shape_regex(fmt: str) -> str:
    """A regular expression accepting exactly the strings shaped like ``fmt``
    (digit counts and separators); used to skip parse attempts that must fail."""
    out, i = ["^"], 0
    while i < len(fmt):
        if fmt[i] == "'":
            j = fmt.index("'", i + 1)
            out.append(re.escape(fmt[i + 1:j]))
            i = j + 1
            continue
        for tok, rx in _TOKENS:
            if fmt.startswith(tok, i):
                out.append(rx)
                i += len(tok)
                break
        else:
            out.append(re.escape(fmt[i]))
            i += 1
    return "".join(out) + "$"


def accepts(text: Column, formats: list[str]) -> Column:
    """Is the text shaped like one of the formats?"""
    return text.rlike("^(?:" + "|".join(shape_regex(f)[1:-1] for f in formats) + ")$")


# English month names; a name of three letters is the abbreviation.
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_OWN = ["_tp_text", "_tp_bare", "_tp_runs", "_tp_words", "_tp_family", "_tp_digits", "_tp_half", "_tp_month", "_tp_hour", "_tp_second", "_tp_mf", "_tp_df"]


def _read(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``_tp_mf`` and ``_tp_df``: the wall clock of the text's fields read
    month-first and day-first (null: no such time), and the trimmed text with
    and without its zone."""
    run = lambda i: F.get("_tp_runs", F.lit(i))
    at = lambda s, n: F.substring("_tp_digits", s, n)
    family = F.col("_tp_family")
    df = df.withColumn("_tp_text", F.regexp_replace(text, r"^\s+|\s+$", ""))
    df = df.withColumn("_tp_bare", F.regexp_replace("_tp_text", ZONE_SUFFIX, "$1"))
    df = df.withColumns({"_tp_runs": F.regexp_extract_all("_tp_bare", F.lit(r"(\d+)")), "_tp_words": F.regexp_extract_all(F.lower("_tp_bare"), F.lit("([a-z]+)"))})
    word = F.get(F.filter("_tp_words", lambda w: F.length(w) >= 3), F.lit(0))
    known = F.array(*[F.lit(m) for m in _MONTHS])
    half = F.when(F.array_contains("_tp_words", "pm"), "pm").when(F.array_contains("_tp_words", "am"), "am")
    month = F.array_position(F.transform(known, lambda m: F.left(m, F.lit(3))), F.left(word, F.lit(3)))
    first = F.length(run(0))
    df = df.withColumns({"_tp_family": F.when(word.isNotNull(), "worded").when(first >= 8, "compact").when(first == 4, "year first").otherwise("year last"),
                         "_tp_digits": F.array_join("_tp_runs", ""), "_tp_half": half,
                         "_tp_month": F.when((F.length(word) == 3) | F.array_contains(known, word), F.when(month > 0, month)).cast("int")})
    time = lambda i, s: F.when(family == "compact", F.nullif(at(s, 2), F.lit(""))).otherwise(F.when(family == "worded", run(i - 1)).otherwise(run(i)))
    hour, minute, second = (F.coalesce(time(i, s).try_cast("int"), F.lit(0)) for i, s in ((3, 9), (4, 11), (5, 13)))
    hour = F.when(F.col("_tp_half").isNull(), hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(F.col("_tp_half") == "pm", 12).otherwise(0))
    fraction = F.when(family == "year first", F.rpad(run(6), 6, "0").try_cast("int"))
    df = df.withColumns({"_tp_hour": hour, "_tp_second": F.when(second < 60, second + F.coalesce(fraction, F.lit(0)) / F.lit(1_000_000))})
    piece = lambda *by_family: F.when(family == "worded", by_family[0]).when(family == "compact", by_family[1]).when(
        family == "year first", by_family[2]).otherwise(by_family[3]).try_cast("int")
    year = piece(run(1), at(1, 4), run(0), run(2))
    clock = [F.col("_tp_hour"), minute, F.col("_tp_second").cast("decimal(16,6)")]
    named = F.col("_tp_month").cast("string")
    return df.withColumns({"_tp_mf": F.try_make_timestamp_ntz(year, piece(named, at(5, 2), run(1), run(0)), piece(run(0), at(7, 2), run(2), run(1)), *clock),
                           "_tp_df": F.try_make_timestamp_ntz(year, piece(named, at(5, 2), run(1), run(1)), piece(run(0), at(7, 2), run(2), run(0)), *clock)})


def candidates(df: DataFrame, text: Column) -> tuple[DataFrame, list[Column]]:
    """The frame with the fields read, and the six candidates over it as
    TIMESTAMP_NTZ columns in order of priority."""
    whole, bare, mf, late = (F.col(c) for c in ("_tp_text", "_tp_bare", "_tp_mf", "_tp_df"))
    order = [mf, late, mf, mf]
    found = [F.when(accepts(whole, [f]), v) for f, v in zip(EXPLICIT_FORMATS, order, strict=True)]
    found.append(F.when(accepts(bare, GENERIC_MONTH_FIRST + GENERIC_WORDED), mf))
    found.append(F.when(accepts(bare, GENERIC_DAY_FIRST + GENERIC_WORDED), late))
    return _read(df, text), found


def best_of_n_parse(df: DataFrame, text_col: str, series_col: str = "series_id", out_col: str = "ts",
                    keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Add ``out_col`` parsed with the per-series best candidate.

    Returns (rows, report) where report has one row per series with the
    winning candidate index and its success rate (gate: >= 0.80).  ``keep`` may
    land the report (one row per series), which the rows are joined with.

    The parsed time leaves a generator of one element: a filter on it stays
    above it.  Over a plain projection Spark rewrites such a filter in terms of
    the raw text, each field's reading written out wherever it is used, and
    reads every text hundreds of times.
    """
    text = qc(text_col)
    read, cands = candidates(df.select(series_col, text.alias("_tp_in")), F.col("_tp_in"))
    rates = read.groupBy(series_col).agg(
        *[F.avg(c.isNotNull().cast("double")).alias(f"_rate{i}") for i, c in enumerate(cands)])
    rate_cols = [F.col(f"_rate{i}") for i in range(len(cands))]
    best = F.greatest(*rate_cols)
    # first candidate whose rate equals the max -> ties go to the earliest
    winner = F.coalesce(*[F.when(rc == best, F.lit(i)) for i, rc in enumerate(rate_cols)])
    report = keep(rates.select(series_col, winner.alias("format_index"), best.alias("parse_rate"),
                               (best >= F.lit(MIN_SUCCESS_RATE)).alias("parse_passed")))
    chosen = df.join(report.select(series_col, F.col("format_index").alias("_tp_pick")), [series_col])
    read, cands = candidates(chosen, text)
    pick = F.coalesce(*[F.when(F.col("_tp_pick") == i, c) for i, c in enumerate(cands)])
    return read.withColumn(out_col, F.explode(F.array(pick))).drop("_tp_pick", *_OWN), report
