from __future__ import annotations

import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])
WORDS = {"en": "the of and to in is that it was for on are with as be at by this have from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split()}


def prose(rng: random.Random, lang: str, words: int) -> str:
    out = []
    for i in range(words):
        out.append(rng.choice(WORDS[lang]) + (rng.choice(WORDS[lang]) if rng.random() < 0.4 else ""))
        if rng.random() < 0.05:
            out.append("\n")
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Documents with nulls, empty and very long texts, ties and repeated rows."""
    rng = random.Random(7)
    rows: list[tuple] = [(i, prose(rng, lang, rng.randint(1, 300)), lang, f"src{i % 3}", None) for i, lang in enumerate(["en", "de"] * 20)]
    rows += [(100, None, "en", "src0", 0), (101, "", None, "src0", 0), (102, " \n\t ", "de", None, 4), (None, "no id here at all", "en", "src1", 17), (103, rows[0][1], "en", "src0", None), rows[1], rows[1]]
    rows += [(104, "word " * 60_000, "en", "src2", 300_000), (105, "ÀÉÎ ß Ω 日本語 😀 \x1c \x0b #$%", "de", "src2", 20), (106, "1234 5678 !!!", "en", "src1", 13)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, odd_rows):
    """The odd documents, with an extra column whose name clashes with names used inside."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("h", F.lit("x"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
