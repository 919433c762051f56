from __future__ import annotations

import random

import __spark_entry__
import corpus_pipeline
from tests.llm.conftest import SCHEMA, prose


def test_every_operator_has_its_query():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_stages_keep_columns_and_take_effect(spark, odd_rows, tmp_path):
    rows = [*odd_rows, (500, "my password=hunter22 " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)), "en", "src0", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, "")
        assert kept.columns == docs.columns, name
        path = str(tmp_path / name)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
    found = {r.doc_id: r for r in kept.collect()}
    assert {100, 101, 102, 106}.isdisjoint(found) and "hunter22" not in found[500].text
    assert len(found) == kept.count() and not {0, 103} <= set(found)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    assert {r.doc_id for r in pieces} == set(found)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_what_the_stages_catch(spark):
    """Copies, near copies, boilerplate, junk and secrets among clean documents, all with production parameters."""
    rng = random.Random(21)
    clean = [(i, prose(rng, lang, 260), lang, "a", 0) for i, lang in enumerate(["en", "de"] * 30)]
    clean = [(i, t.replace("\n", " "), *rest) for i, t, *rest in clean]
    footer = "all rights reserved by the editors of this site"
    rows = [(i, f"{t}\n{footer}" if i < 40 else t, *rest) for i, t, *rest in clean]
    copies = [(100 + i, clean[i % 3][1], "en", "b", 0) for i in range(9)]

    def edited(text: str) -> str:
        words = text.split(" ")
        words[rng.randrange(len(words))] = "changed"
        return " ".join(words)

    near = [(200 + i, edited(clean[5 + i % 3][1]), "de", "c", 0) for i in range(9)]
    junk = [(300, "too short", "en", "a", 0), (301, "spam spam spam " * 60, "en", "a", 0), (302, "1234 !! " * 60, "en", "a", 0), (303, f"{footer}\n" * 30, "en", "a", 0)]
    secret = [(400, clean[59][1].replace("e", "o") + "\npassword=hunter22secret", "en", "d", 0)]
    docs, kept = spark.createDataFrame(rows + copies + near + junk + secret, SCHEMA), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), SCHEMA)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    first = kept["quality_rules"]
    assert {300, 301, 303}.isdisjoint(first) and set(range(60)) <= set(first) and set(range(100, 109)) <= set(first)
    assert not any(footer in t for t in first.values()) and first[0].rstrip("\n") == clean[0][1].rstrip("\n")
    assert 302 not in kept["language_id"] and set(range(60)) <= set(kept["language_id"])
    alone = kept["near_duplicates"]
    assert set(range(60)) <= set(alone) and set(range(100, 109)).isdisjoint(alone) and len(set(range(200, 209)) & set(alone)) <= 1
    last = kept["secret_scan"]
    assert set(last) == set(alone) and "hunter22" not in last[400] and all(last[i] == alone[i] for i in range(58))
