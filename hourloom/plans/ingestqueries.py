"""Registered ingest queries (F1, P1, P4, P7) and their DuckDB oracles.

The driver tables carry typed columns, so each query first renders text the
way a messy sensor export would (thousands separators, ``--``, ``NA``,
padded blanks, Java-suffix traps, several date layouts, junk stamps) from
integer-valued columns, so both engines build identical text; then it runs
the library operator on that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions.names import normalize_name_col
from ..functions.numeric import nonfinite_to_null
from ..functions.timecols import ts_text
from ..functions.timeparse import EXPLICIT_FORMATS, GENERIC_DAY_FIRST, GENERIC_MONTH_FIRST, best_of_n_parse
from ..operators.ingest import ingest, numeric_fractions
from ..sources.tables import table
from .catalog import rnd
from .oracle import r6

# ------------------------------------------------------------ text builders


def _messy_number(k: Column) -> Column:
    """Seven text renderings of an integer key, cycled by ``k % 7``."""
    v = k * 37
    grouped = F.concat((F.floor(v / 1000)).cast("string"), F.lit(","), F.lpad((v % 1000).cast("string"), 3, "0"))
    return (F.when(k % 7 == 0, F.concat(v.cast("string"), F.lit("--")))
             .when(k % 7 == 1, F.lit("NA"))
             .when(k % 7 == 2, F.concat(F.lit("  "), v.cast("string"), F.lit(" ")))
             .when(k % 7 == 3, grouped)
             .when(k % 7 == 4, F.concat(v.cast("string"), F.lit("e2")))
             .when(k % 7 == 5, F.concat(v.cast("string"), F.lit("d")))
             .otherwise(F.concat(F.lit("-"), v.cast("string"), F.lit(".5"))))


_MESSY_SQL = """CASE WHEN k % 7 = 0 THEN CAST(k * 37 AS VARCHAR) || '--'
     WHEN k % 7 = 1 THEN 'NA'
     WHEN k % 7 = 2 THEN '  ' || CAST(k * 37 AS VARCHAR) || ' '
     WHEN k % 7 = 3 THEN CAST(CAST(floor(k * 37 / 1000) AS BIGINT) AS VARCHAR) || ',' || lpad(CAST((k * 37) % 1000 AS VARCHAR), 3, '0')
     WHEN k % 7 = 4 THEN CAST(k * 37 AS VARCHAR) || 'e2'
     WHEN k % 7 = 5 THEN CAST(k * 37 AS VARCHAR) || 'd'
     ELSE '-' || CAST(k * 37 AS VARCHAR) || '.5' END"""


def clean_numeric_sql(x: str) -> str:
    """F1 in DuckDB SQL."""
    s = f"regexp_replace(replace(replace(CAST({x} AS VARCHAR), ',', ''), '--', ''), '^\\s*(NA|N/A|None|null|nan)\\s*$', '')"
    t = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    return (f"(CASE WHEN regexp_full_match({t}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') THEN TRY_CAST({t} AS DOUBLE) "
            f"WHEN regexp_full_match(lower({t}), '[+]?(inf|infinity)') THEN 'inf'::DOUBLE "
            f"WHEN regexp_full_match(lower({t}), '-(inf|infinity)') THEN '-inf'::DOUBLE END)")


def q_numeric_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 on customer: keyed messy text -> DOUBLE."""
    c = table(spark, sf_dir, "customer")
    t = c.select("c_custkey", _messy_number(F.col("c_custkey")).alias("raw"))
    return t.select("c_custkey", "raw", rnd(num.clean_numeric(F.col("raw")), "value"))


def sql_numeric_clean() -> str:
    return f"""WITH t AS (SELECT c_custkey, {_MESSY_SQL.replace('k ', 'c_custkey ').replace('(k', '(c_custkey')} AS raw FROM customer)
SELECT c_custkey, raw, {r6(clean_numeric_sql('raw'))} AS value FROM t"""


# ------------------------------------------------------------ P1

def _decorated_name(name: Column, key: Column) -> Column:
    return (F.when(key % 3 == 0, F.concat(F.lit("  "), name, F.lit(" (µg/m³) ")))
             .when(key % 3 == 1, F.concat(name, F.lit("_μg--Level#1")))
             .otherwise(F.upper(name)))


def q_normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 over decorated customer names (whole table)."""
    c = table(spark, sf_dir, "customer")
    d = c.select("c_custkey", _decorated_name(F.col("c_name"), F.col("c_custkey")).alias("raw"))
    return d.select("c_custkey", "raw", normalize_name_col(F.col("raw")).alias("normalized"))


def sql_normalize_names() -> str:
    raw = ("CASE WHEN c_custkey % 3 = 0 THEN '  ' || c_name || ' (µg/m³) ' "
           "WHEN c_custkey % 3 = 1 THEN c_name || '_μg--Level#1' ELSE upper(c_name) END")
    norm = ("regexp_replace(regexp_replace(translate(lower(regexp_replace(raw, '^\\s+|\\s+$', '', 'g')), 'µμ', 'uu'), "
            "'[^a-z0-9.]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')")
    return f"WITH d AS (SELECT c_custkey, {raw} AS raw FROM customer)\nSELECT c_custkey, raw, {norm} AS normalized FROM d"


# ------------------------------------------------------------ P4

# Per order priority, the layout in which o_orderdate is rendered.
_LAYOUTS = {"1-URGENT": ("MM/dd/yyyy HH:mm", "%m/%d/%Y %H:%M"),
            "2-HIGH": ("dd/MM/yyyy HH:mm", "%d/%m/%Y %H:%M"),
            "3-MEDIUM": ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
            "4-NOT SPECIFIED": ("yyyy-MM-dd HH:mm", "%Y-%m-%d %H:%M"),
            "5-LOW": ("yyyy-MM-dd'T'HH:mm:ss", "%Y-%m-%dT%H:%M:%S")}


def _stamp_text(o: DataFrame) -> DataFrame:
    txt = F.lit(None).cast("string")
    for prio, (fmt, _) in _LAYOUTS.items():
        txt = F.when(F.col("o_orderpriority") == prio, F.date_format("o_orderdate", fmt)).otherwise(txt)
    junk = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(txt)
    return o.select("o_orderkey", F.col("o_orderpriority").alias("series_id"), junk.alias("stamp"))


def _parsed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority",
                                              F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    return best_of_n_parse(_stamp_text(o), "stamp", "series_id")


def q_parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 winner and success rate per series (order priority)."""
    _, report = _parsed(spark, sf_dir)
    return report.select("series_id", F.col("format_index").cast("int").alias("format_index"),
                         rnd("parse_rate"), "parse_passed")


def q_parsed_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4 + P5: rows whose stamp parsed with their series' winning format."""
    rows, _ = _parsed(spark, sf_dir)
    return rows.where(F.col("ts").isNotNull()).select("o_orderkey", "series_id", ts_text("ts").alias("ts"))


def _spark_to_strptime(p: str) -> str:
    out = p.replace("'T'", "T").replace(".SSSSSS", ".%f").replace("yyyy", "%Y").replace("mm", "%M")
    out = out.replace("ss", "%S").replace("H", "%H").replace("M", "%m").replace("d", "%d")
    return out.replace("%%m", "%M").replace("%%H", "%H")


def _cands_sql() -> list[str]:
    c = [f"try_strptime(t, '{_spark_to_strptime(f)}')" for f in EXPLICIT_FORMATS]
    digits = [[f for f in lst if " a" not in f] for lst in (GENERIC_MONTH_FIRST, GENERIC_DAY_FIRST)]  # the rendered text has no 12-hour clock
    for lst in digits:
        c.append("coalesce(" + ", ".join(f"try_strptime(t, '{_spark_to_strptime(f)}')" for f in lst) + ")")
    return c


def _parse_ctes(junk: str = "o_orderkey % 10 = 0") -> str:
    stamp = "CASE " + " ".join(f"WHEN o_orderpriority = '{p}' THEN strftime(o_orderdate, '{s}')"
                               for p, (_, s) in _LAYOUTS.items()) + " END"
    cands = ", ".join(f"{c} AS c{i}" for i, c in enumerate(_cands_sql()))
    rates = ", ".join(f"avg(CAST(c{i} IS NOT NULL AS DOUBLE)) AS r{i}" for i in range(6))
    best = "greatest(" + ", ".join(f"r{i}" for i in range(6)) + ")"
    win = "CASE " + " ".join(f"WHEN r{i} = {best} THEN {i}" for i in range(6)) + " END"
    return f"""s AS (SELECT o_orderkey, o_orderpriority AS series_id,
              CASE WHEN {junk} THEN 'n/a' ELSE {stamp} END AS stamp FROM orders),
c AS (SELECT o_orderkey, series_id, regexp_replace(stamp, '^\\s+|\\s+$', '', 'g') AS t FROM s),
cc AS (SELECT o_orderkey, series_id, {cands} FROM c),
rr AS (SELECT series_id, {rates} FROM cc GROUP BY series_id),
rep AS (SELECT series_id, CAST({win} AS INTEGER) AS format_index, {best} AS parse_rate FROM rr)"""


def sql_parse_report() -> str:
    return f"WITH {_parse_ctes()}\nSELECT series_id, format_index, {r6('parse_rate')} AS parse_rate, parse_rate >= 0.8 AS parse_passed FROM rep"


def sql_parsed_timestamps() -> str:
    pick = "CASE " + " ".join(f"WHEN r.format_index = {i} THEN cc.c{i}" for i in range(6)) + " END"
    return f"""WITH {_parse_ctes()},
p AS (SELECT cc.o_orderkey, cc.series_id, {pick} AS ts FROM cc JOIN rep r ON cc.series_id = r.series_id)
SELECT o_orderkey, series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM p WHERE ts IS NOT NULL"""


# ------------------------------------------------------------ P7

def _gate_text(c: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return c.select(
        F.col("c_name").alias("name_text"),
        _messy_number(k).alias("balance_text"),
        F.col("c_mktsegment").alias("segment_text"),
        F.when(k % 3 == 0, k.cast("string")).otherwise(F.lit("--")).alias("sparse_text"),
        F.when(k % 5 == 0, k.cast("string")).otherwise(F.lit("None")).alias("rare_text"))


def q_numeric_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parseable share per text column and the 0.25 keep decision."""
    t = _gate_text(table(spark, sf_dir, "customer"))
    f = numeric_fractions(t, t.columns)
    return f.select("column", rnd("fraction"), (F.col("fraction") >= F.lit(0.25)).alias("kept"))


def sql_numeric_gate() -> str:
    messy = _MESSY_SQL.replace("k ", "c_custkey ").replace("(k", "(c_custkey")
    cols = {"name_text": "c_name", "balance_text": messy, "segment_text": "c_mktsegment",
            "sparse_text": "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '--' END",
            "rare_text": "CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'None' END"}
    t = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    parts = [f"SELECT '{n}' AS \"column\", avg(CAST({clean_numeric_sql(n)} IS NOT NULL AS DOUBLE)) AS f FROM t" for n in cols]
    return (f"WITH t AS (SELECT {t} FROM customer), u AS ({' UNION ALL '.join(parts)})\n"
            f"SELECT \"column\", {r6('f')} AS fraction, f >= 0.25 AS kept FROM u")


# ------------------------------------------------------------ the whole of ingest()

_BAD_SERIES = "o_orderkey % 10 = 0 OR (o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0)"


def _raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a sensor export would have them: names to be resolved, one
    series with too few readable stamps, text and sparse columns, infinities."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority",
                                              F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    stamps = _stamp_text(o).select("o_orderkey", "stamp")
    k, prio = F.col("o_orderkey"), F.col("o_orderpriority")
    target = F.when(k % 97 == 0, F.lit("inf")).otherwise(_messy_number(k))
    rare = F.when((prio == "1-URGENT") | (k % 50 == 0), F.col("o_custkey").cast("string")).otherwise(F.lit("None"))
    stamp = F.when(F.expr(_BAD_SERIES), F.lit("n/a")).otherwise(F.col("stamp"))
    return o.join(stamps, "o_orderkey").select(
        prio.alias("station"), prio.alias(" Note "), stamp.alias("Recorded At"), _messy_number(F.col("o_custkey")).alias("Temp"),
        target.alias(" PM 2.5 (µg/m³)"), rare.alias("Rare"))


def q_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2-P8, F1 and the parse gate: raw strings to observations."""
    ing = ingest(_raw_orders(spark, sf_dir), series_col="station", on_fail="exclude")
    value = lambda c: rnd(nonfinite_to_null(F.col(f"`{c}`")), c.strip())
    return ing.observations.select("series_id", ts_text("ts").alias("ts"), value(ing.target).alias("target"),
                                   *[value(c) for c in sorted(ing.predictors)])


def sql_ingest() -> str:
    pick = "CASE " + " ".join(f"WHEN r.format_index = {i} THEN cc.c{i}" for i in range(6)) + " END"
    messy = lambda col: "(SELECT " + _MESSY_SQL + f" FROM (SELECT {col} AS k))"
    finite = lambda x: f"(CASE WHEN isfinite({x}) THEN {x} END)"
    return f"""WITH {_parse_ctes(_BAD_SERIES)},
p AS (SELECT cc.o_orderkey, cc.series_id, {pick} AS ts FROM cc JOIN rep r ON cc.series_id = r.series_id WHERE r.parse_rate >= 0.8),
x AS (SELECT p.series_id, p.ts, CASE WHEN o.o_orderkey % 97 = 0 THEN 'inf' ELSE {messy('o.o_orderkey')} END AS target, {messy('o.o_custkey')} AS temp,
      CASE WHEN o.o_orderpriority = '1-URGENT' OR o.o_orderkey % 50 = 0 THEN CAST(o.o_custkey AS VARCHAR) ELSE 'None' END AS rare
      FROM p JOIN orders o ON o.o_orderkey = p.o_orderkey WHERE p.ts IS NOT NULL),
n AS (SELECT series_id, ts, {clean_numeric_sql('target')} AS target, {clean_numeric_sql('temp')} AS temp, {clean_numeric_sql('rare')} AS rare FROM x),
g AS (SELECT series_id, avg(CAST(rare IS NOT NULL AS DOUBLE)) AS f FROM n GROUP BY series_id)
SELECT n.series_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, {r6(finite('target'))} AS target,
       {r6(finite('(CASE WHEN g.f >= 0.25 THEN rare END)'))} AS "Rare", {r6(finite('temp'))} AS "Temp"
FROM n JOIN g ON n.series_id = g.series_id"""


def registered() -> dict:
    return {"numeric_clean_customer": q_numeric_clean, "normalize_names_customer": q_normalize_names,
            "parse_report_orders": q_parse_report, "parsed_timestamps_orders": q_parsed_timestamps,
            "numeric_gate_customer": q_numeric_gate, "ingest_orders": q_ingest}


def registered_sql() -> dict:
    return {"numeric_clean_customer": sql_numeric_clean(), "normalize_names_customer": sql_normalize_names(),
            "parse_report_orders": sql_parse_report(), "parsed_timestamps_orders": sql_parsed_timestamps(),
            "numeric_gate_customer": sql_numeric_gate(), "ingest_orders": sql_ingest()}
