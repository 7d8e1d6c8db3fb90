import random
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, kept string, digest string, n_words string, lo string, u string"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    out = []
    for i in range(n):
        out.append("w%dx" % r.randrange(vocabulary) + ("." if i % 9 == 8 else ""))
        out.append("\n" if i % 23 == 22 else " ")
    return "".join(out).strip()


def odd_rows() -> list[tuple]:
    """(doc_id, text, lang, source): nulls, blanks, copies, near copies, shared
    passages, a very long text, repeated rows, several scripts."""
    base, passage = prose(1, 120), prose(2, 70)
    near = base.replace(" ", " extra ", 1)
    rows = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, near, "en", "src1"), (4, None, "en", "src1"), (5, "", None, None), (6, " \t\n\x0b ", "de", "src2"),
        (7, "one", "en", "src0"), (8, "One two  three\tfour", "en", "src0"), (9, prose(3, 60) + " " + passage + " " + prose(4, 40), "fr", "src3"),
        (10, passage + "\n" + prose(5, 30), "es", "src4"), (11, "ab " * 400, "en", "src0"), (12, "x" * 1500, "de", "src5"),
        (13, "Grüße aus Köln – 東京 и Москва. " * 30, "de", "src5"), (14, prose(6, 30_000, 3_000), "en", "src0"), (15, prose(7, 13), "fr", ""),
        (16, "fin<|endoftext|>ish <|endoftext|> it  now  a\x1cb  !  ", "en", "src0"), (None, prose(8, 90), "en", "src0"), (None, None, "en", "src0"),
        (17, base[:300] + " " + base[:300], "en", "src9"), (18, "a#*$%&|<>b\nsame line\nsame line\n\n\n \nsame line", "en", "src0"), (-5, base, "en", "src0"),
    ]
    rows += [(20, prose(9, 80), "en", "src0")] * 3  # repeated rows
    rows += [(21, prose(10, 80), "en", "src0"), (21, prose(11, 80), "en", "src7")]  # one id, two texts
    rows += [(100 + i, "hot " + passage + f" tail{i}", "en", "src0") for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, la, s, None if t is None else len(t), "k", "s", "x", "d", "nw", "l", "u") for i, t, la, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def table(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
