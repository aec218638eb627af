"""Small documents with what tables can hold: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta omega kappa sigma lambda epsilon zeta theta iota rho tau phi chi psi nu mu xi".split()


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(40)) for _ in range(n))


def awkward_rows():
    base = prose(1, 120)
    long = prose(2, 6000)
    return [
        (1, base), (2, base), (3, base + " tail"), (4, "Start " + base), (5, prose(3, 90)), (5, prose(3, 90)),
        (6, None), (7, ""), (8, " \n\t "), (9, "one"), (10, "one two three four"), (11, "One Two THREE four"),
        (12, long), (13, long[: len(long) // 2] + " Ünï çödé 日本 " + long[len(long) // 2 :]), (None, base), (None, None),
        (14, "x" * 9000), (15, "0" * 3000), (16, "é" * 400), (17, prose(5, 40) + "\n" + prose(1, 60)),
        (-3, prose(6, 30)), (1 << 40, prose(6, 30)),
    ]


def with_clashes(df):
    """Extra columns whose names the operators use inside."""
    for name in ("score", "piece", "start", "length", "rank", "bucket", "chunk", "node", "component", "size", "u", "v", "run", "_gone", "_again", "_hit_id", "_hit_text", "_pii", "_toxicity", "key", "n", "id"):
        df = df.withColumn(name, F.lit("extra"))
    return df.withColumn("_toxicity_note", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def awkward(spark):
    return with_clashes(spark.createDataFrame(awkward_rows(), "doc_id long, text string")).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
