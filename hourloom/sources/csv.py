"""Headered sensor CSV scan.

Every column is read as a string (no schema inference: cleaning is textual)
and header names are trimmed.  A scan takes one header for all its files, so
files are grouped by their header line first.  Spark lists the files (any path,
folder or glob) without reading them, tasks read the first bytes of each file
up to its first line end (``first_line``), and only the list of files with
their headers reaches the driver, as Spark's own file listing does.  Files in a
store or compression that Arrow does not open are scanned by Spark instead.  Where the groups name their timestamp or
target differently, each group's columns are resolved (P2, P3) and renamed to
common names before the union.

``series_id`` is the file's path below the folder that all files share,
without its extensions: files of one folder are named by their base names, and
equal names in different folders stay apart.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from typing import IO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import CANONICAL_TARGET, CANONICAL_TIME, target_column, timestamp_column
from ..operators.evaluate import union_all

_BOM = "\ufeff"
_EXTENSIONS = r"(\.(csv|txt|tsv|gz|bz2|zst|deflate|snappy|lz4))+$"


_CHUNK = 1 << 16
# Compressions by extension that Arrow decompresses (its names).
_CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}


def first_line(stream: IO[bytes], chunk: int = _CHUNK) -> str | None:
    """The first line of a stream without its end (``\\n``, ``\\r`` or both),
    reading no further than the chunk it ends in; null for an empty stream."""
    head = b""
    while piece := stream.read(chunk):
        found = re.search(rb"[\r\n]", piece)
        head += piece[: found.start()] if found else piece
        if found:
            return head.decode("utf-8", "replace")
    return head.decode("utf-8", "replace") if head else None


def _open(path: str) -> IO[bytes]:
    """The file's bytes, decompressed as its extension says."""
    scheme, _, rest = path.partition(":")
    uri = {"file": f"file:///{quote(rest.lstrip('/'))}", "s3a": f"s3:{rest}", "s3n": f"s3:{rest}"}.get(scheme, path)
    system, inside = fs.FileSystem.from_uri(uri)
    raw = system.open_input_stream(inside, compression=None, buffer_size=None)
    codec = _CODECS.get(path.rsplit(".", 1)[-1])
    return pa.CompressedInputStream(raw, codec) if codec else raw


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per file its header, or that it was not opened here."""
    for b in batches:
        lines, opened = [], []
        for path in b.column("path").to_pylist():
            try:
                with _open(path) as stream:
                    lines.append(first_line(stream))
                opened.append(True)
            except (OSError, pa.ArrowException):
                lines.append(None)
                opened.append(False)
        yield pa.RecordBatch.from_arrays([b.column("f"), b.column("path"), pa.array(lines, pa.string()), pa.array(opened, pa.bool_())], names=["f", "path", "h", "opened"])


def _scanned(spark: SparkSession, files: list[str]) -> DataFrame:
    """First lines by a text scan of whole files."""
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                                          F.monotonically_increasing_id().alias("i"), "value")
    return lines.groupBy("f").agg(F.min_by("value", F.struct("b", "i")).alias("h"))  # partial minima, one row per file


def _header_groups(spark: SparkSession, patterns: list[str]) -> dict[str, list[str]]:
    """Files by header line (byte-order mark and blanks trimmed); files without
    a line have none."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(patterns)  # content is not read
    listed = listed.where("length > 0").select(F.col("_metadata.file_path").alias("f"), "path")
    known = ~F.lower("path").rlike(r"\.(deflate|snappy|lz4)$")
    heads = listed.where(known).mapInArrow(_first_lines, "f string, path string, h string, opened boolean")
    heads = heads.unionByName(listed.where(~known).withColumns({"h": F.lit(None).cast("string"), "opened": F.lit(False)}))
    found, rest = {}, []
    for r in heads.toLocalIterator():
        if not r["opened"]:
            rest.append(r["path"])
        elif r["h"] is not None:
            found[r["f"]] = r["h"]
    if rest:
        found |= {r["f"]: r["h"] for r in _scanned(spark, rest).toLocalIterator()}
    groups: dict[str, list[str]] = {}
    for f in sorted(found):
        groups.setdefault(found[f].lstrip(_BOM).strip(), []).append(f)
    return groups


def series_root(files: list[str]) -> str:
    """The folder that all files share, with its final slash."""
    folders = [posixpath.dirname(f) for f in files]
    root = posixpath.commonpath([re.sub(r"^[a-z0-9]+:/*", "/", f) for f in folders])
    prefix = re.match(r"^([a-z0-9]+:/*)?", files[0]).group(0)
    return (prefix.rstrip("/") + root if prefix.count("/") < 2 else prefix + root.lstrip("/")).rstrip("/") + "/"


def _renamed(df: DataFrame, names: set[tuple[str, str]], found: tuple[str, str] | None) -> DataFrame:
    if found is None or len(names) < 2:
        return df
    new = {found[0]: CANONICAL_TIME, found[1]: CANONICAL_TARGET}
    return df.toDF(*[new.get(c, c) for c in df.columns])


def read_sensor_csv(spark: SparkSession, paths: str | list[str], series_from_file: bool = True,
                    timestamp_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """Read headered CSV files as strings: paths, folders (searched below) or globs.

    ``series_from_file`` adds ``series_id``; without it a station column of the
    files is expected.  If files resolve to different timestamp or target
    columns, those are renamed to common names (unless given by name); a file
    in which none is found raises, naming its columns."""
    patterns = [paths] if isinstance(paths, str) else list(paths)
    groups = _header_groups(spark, patterns)
    if not groups:
        raise FileNotFoundError(f"no lines in {patterns}")
    root = series_root([f for files in groups.values() for f in files])
    frames, found = [], []
    for files in groups.values():
        df = (spark.read.option("header", True).option("inferSchema", False).option("multiLine", False)
              .option("mode", "PERMISSIVE").csv(files))
        df = df.toDF(*[c.lstrip(_BOM).strip() for c in df.columns])
        if len(groups) > 1:
            found.append((timestamp_col or timestamp_column(df.columns), target_col or target_column(df.columns)))
        if series_from_file:
            path = F.col("_metadata.file_path")
            name = F.regexp_replace(F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(path), _EXTENSIONS, "")
            df = df.withColumn("series_id", name)
        frames.append(df)
    names = set(found)
    return union_all([_renamed(df, names, found[i] if found else None) for i, df in enumerate(frames)])
