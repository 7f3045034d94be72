"""A corpus small enough for brute force, with what usually breaks: nulls, blanks, ties, copies, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("block", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("copies", T.StringType()),
    ]
)


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = make(60), make(120)
    texts = [make(rng.randint(1, 160)) for _ in range(30)]
    texts += [base, base, base.upper(), base.replace(" ", "\n", 3), base + " end", "x " + base]
    texts += [" ".join(rng.choice(words) if rng.random() < 0.01 else w for w in base.split()) for _ in range(25)]
    texts += [make(20) + " " + passage + "\n" + make(rng.randint(0, 30)) for _ in range(12)]
    texts += [None, "", " \t\n ", "one", "one", "a b c d", "A B c D", "a b c", "be " * 300, "be " * 300, "line one\nline two\nline one\n\n\nline one", "#$% & |x|", "!!!", "  nbsp em", passage]
    texts += [make(3000) + " " + passage, "y" * 20000]
    rows = [(i, t, ("en", "fr", None)[i % 3], ("src1", "src0", None, "zz")[i % 4] if i % 2 else "src0", len(t or ""), "b", None, "c") for i, t in enumerate(texts)]
    return [*rows, (None, base, None, None, 0, None, None, None), rows[40], (41, "another text of the same id", "en", "src1", 0, None, None, None)]


# More names that operators use or used themselves.
EXTRA = ("tie", "row", "rows", "copy", "rest", "stratum", "part", "class", "_tie", "_first", "_row", "_copies")


def clashing(frame):
    return frame.withColumns({c: F.concat(F.lit("x"), F.col("doc_id").cast("string")) for c in EXTRA})


@pytest.fixture(scope="session")
def docs(spark):
    return clashing(spark.createDataFrame(corpus(), SCHEMA)).repartition(3).cache()


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def empty(spark):
    return clashing(spark.createDataFrame([], SCHEMA))
