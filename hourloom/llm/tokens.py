"""Token ids of whole texts by a public tokenizer, and the digest cache of counts.

``TextTokenizer`` gives the same ids as the library on the whole text.  The
byte-level pre-tokenizer of the vocabulary always starts a new piece at an
ASCII blank that follows a non-blank, whatever came before, and looks ahead
only within a run of blanks; so a text falls apart into units (blanks, then
non-blanks) whose ids can be looked up, and the library encodes each distinct
unit once.  A text with any other Unicode white space goes to the library
whole, as does every text when the tokenizer is not of that kind.

The digest cache joins (digest of the normalised content, digest of the
tokenizer's file and library version) to stored counts; only distinct digests
that it lacks are encoded, and the new counts are appended to it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import land, replaced, sized
from hourloom.session import ensure_checkpoint_dir

#: Unicode white space beside space, \t, \n and \r: such texts are encoded whole (a plain search for each is faster than a class).
_ODD_BLANKS = tuple(map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNIT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Blanks that need the pattern above; without them a text is split at its spaces and line ends.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
_FIRST = "\x1f"  # marks a unit that is meant as it is; one without it, or a line end in front, has a space before it
_BLANKS = ("", " ", "\t", "\n", "\r")
#: Units kept per worker, and the characters of the longest that is kept (a longer one is encoded with its text): some
#: 150 MB when full, as a usual unit takes 210 bytes; then the cache is emptied.
CACHE_UNITS, UNIT_CHARS = 700_000, 64
_JOINED = 2_000  # new units that are encoded as one text


class _Numbers(dict):
    """Numbers keys in order of arrival and remembers the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.refused = False  # a key was too long to be kept

    def __missing__(self, key: str) -> int:
        if len(key) > UNIT_CHARS:
            self.refused = True
            return -1
        n = self[key] = len(self)
        self.fresh.append(key)
        return n


def resolved(tokenizer: str) -> str:
    """File of a tokenizer given by path, or by the name of a public one, which
    is looked up where it is used (executors may keep it elsewhere)."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def tokenizer_digest(tokenizer: str) -> str:
    """Names the tokenizer: its file's content and the library's version."""
    import tokenizers

    with open(resolved(tokenizer), "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class TextTokenizer:
    """Ids of texts, without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and not spec.get("normalizer") and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"])
                                                                   for t in spec.get("added_tokens", [])))
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
        self.bytes_of = np.array([len(special[i].encode()) if i in special else len(self.library.id_to_token(i) or "")
                                  for i in range(self.library.get_vocab_size())], np.int64)  # a byte-level token has a character per byte
        self._clear()

    def _clear(self) -> None:
        self.index = _Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.used = 0

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keeps the ids of units, laid one after the other."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(ids)] = ids
        self.size[numbers] = sizes
        self.at[numbers] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def _learn(self) -> None:
        """Encodes the fresh units.  Those that begin with a blank and end with
        none follow one another in one text, whose ids are dealt back by the
        units' byte lengths; the others are encoded one by one."""
        keys, base = self.index.fresh, len(self.index) - len(self.index.fresh)
        self.index.fresh = []
        while len(self.index) > len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        units = [k[1:] if k[0] == _FIRST else k if k[0] == "\n" else " " + k for k in keys]
        joins = np.array([u[0] in " \n" and u[-1] not in " \n\t\r" for u in units], bool)
        chain = np.flatnonzero(joins)
        parts = [chain[s:s + _JOINED] for s in range(0, len(chain), _JOINED)]
        texts = ["".join([units[i] for i in part]) for part in parts]
        for part, e in zip(parts, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(self.bytes_of[ids])
            last = np.searchsorted(ends, np.cumsum([len(units[i].encode()) for i in part]), side="left") + 1
            self._store(base + part, ids, np.diff(last, prepend=0))
        rest = np.flatnonzero(~joins)
        for i, e in zip(rest, self.library.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            self._store(base + np.array([i]), np.array(e.ids, np.uint32), np.array([len(e.ids)]))

    def _numbers(self, units: list[str]) -> np.ndarray | None:
        found = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if self.index.refused:
            self.index.refused = False
            return None
        return found

    def _units(self, texts: list[str]) -> list[np.ndarray | None]:
        """Unit numbers of each text; None: to be encoded whole."""
        if not self.by_unit:
            return [None] * len(texts)
        if len(self.index) > CACHE_UNITS:
            self._clear()
        out: list[np.ndarray | None] = []
        for t in texts:
            if any(x in t for x in _ODD_BLANKS):
                out.append(None)
            elif not t:
                out.append(np.zeros(0, np.int64))
            elif t[0] in " \n" or t[-1] in " \n" or any(x in t for x in _RUNS):
                s = [u[1:] if u[0] == " " and u[1:2] not in _BLANKS else u if u[0] == "\n" else _FIRST + u for u in _UNIT.findall(t)]
                out.append(self._numbers(s))
            else:
                s = t.replace("\n", " \n").split(" ")  # the pieces stand for their text with the space before it
                s[0] = _FIRST + s[0]
                out.append(self._numbers(s))
        self._learn()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.library.encode(t, add_special_tokens=False).ids) if u is None else int(self.size[u].sum())
                for t, u in zip(texts, self._units(texts), strict=True)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for t, u in zip(texts, self._units(texts), strict=True):
            if u is None:
                out.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32))
                continue
            n = self.size[u]
            first = np.repeat(self.at[u] - (np.cumsum(n) - n), n)
            out.append(self.flat[first + np.arange(len(first))])
        return out


_LOADED: dict[str, TextTokenizer] = {}


def loaded(tokenizer: str) -> TextTokenizer:
    """The worker's tokenizer."""
    if tokenizer not in _LOADED:
        _LOADED[tokenizer] = TextTokenizer(resolved(tokenizer))
    return _LOADED[tokenizer]


def strings(batch: pa.RecordBatch, col: str) -> list[str]:
    return [x or "" for x in batch.column(col).to_pylist()]


def _cached(docs: DataFrame, path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; none stored yet: empty."""
    spark = docs.sparkSession
    try:
        rows = spark.read.schema("digest string, version string, n_tokens long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).select(F.lit("").alias("digest"), F.lit(0).cast("long").alias("n_tokens"))
    return rows.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text_col: str = "text",
                 normalise: Column | None = None) -> DataFrame:
    """The operator: input rows without the text plus ``n_bytes`` and ``n_tokens``.

    ``cache``: folder of the stored counts (parquet, appended to); None: a new
    one in the shared checkpoint folder.  ``normalise``: content that is
    digested and encoded; by default the text itself, null as empty.

    A job that fails before its append leaves the cache as it was; the same
    digest stored twice by two runs at once is read once.
    """
    spark = docs.sparkSession
    cache = cache or f"{ensure_checkpoint_dir(spark).rstrip('/')}/hourloom/llm-token-cache-{uuid.uuid4().hex[:12]}"
    version = tokenizer_digest(tokenizer)
    keep = [c for c in replaced(docs, ["n_bytes", "n_tokens"]) if c != text_col]
    content = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if normalise is None else normalise
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], content.alias("_c_text")).withColumn("_c_digest", F.sha2("_c_text", 256))
    known = _cached(docs, cache, version).withColumnRenamed("digest", "_c_digest")
    distinct = rows.groupBy("_c_digest").agg(F.first("_c_text").alias("_c_text"))  # copies collapse before the shuffle
    misses = distinct.join(known, "_c_digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(tokenizer)
        for b in sized(batches, "_c_text"):
            n = tok.counts(strings(b, "_c_text"))
            yield pa.RecordBatch.from_arrays([b.column("_c_digest"), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["digest", "version", "n_tokens"])

    misses.select("_c_digest", "_c_text").mapInArrow(encode, "digest string, version string, n_tokens long").write.mode("append").parquet(cache)
    counts = land(_cached(docs, cache, version).withColumnRenamed("digest", "_c_digest").withColumnRenamed("n_tokens", "_c_n"), "token-counts")
    # a plain table, so that the join's exchanges can be split where one text is very frequent
    return (rows.select(*[F.col(f"`{c}`") for c in keep], F.octet_length("_c_text").cast("long").alias("n_bytes"), "_c_digest")
            .join(counts, "_c_digest").select(*[F.col(f"`{c}`") for c in keep], "n_bytes", F.col("_c_n").alias("n_tokens")))
