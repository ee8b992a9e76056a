"""The pipeline's stages against plain versions, on small tables written where the test may write."""

import random

import pytest

import corpus_pipeline
from weeklark.llm import queries

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def sf(spark, tmp_path):
    r = random.Random(11)
    words = [f"wort{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    item = " ".join(r.choices(words, k=20))
    line = "this very line stands in many documents and is long enough"
    docs = []
    for i in range(40):
        text = " ".join(r.choices(words, k=60))
        if i % 3 == 0:
            text += "\n" + line
        docs.append((i, text, "de" if i % 2 else "en", "s", len(text)))
    near = docs[1][1].rsplit(" ", 1)[0] + " anders"
    docs += [(100, near, "de", "s", len(near)), (101, "see: " + item, "en", "s", 0), (102, None, None, None, None), (103, "12345", "en", "s", 5), (104, docs[2][1], "en", "s", 0)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "contamination", "pack"]
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language"](spark, docs, sf)
    assert spoken.columns == columns
    ids = {r["doc_id"] for r in spoken.collect()}
    assert ids == {*range(40), 100, 101, 104}
    lined = stages["lines"](spark, spoken, sf)
    after = {r["doc_id"]: r for r in lined.collect()}
    assert set(after) == ids and lined.columns == columns
    held = [i for i in after if "this very line" in after[i]["text"]]
    assert held == [39] and after[0]["n_chars"] == len(after[0]["text"])
    unique = stages["near_duplicates"](spark, lined, sf)
    assert {r["doc_id"] for r in unique.collect()} == ids - {100, 104} and unique.columns == columns
    clean = stages["contamination"](spark, unique, sf)
    assert {r["doc_id"] for r in clean.collect()} == ids - {100, 104, 101} and clean.columns == columns
    assert {r["doc_id"] for r in stages["pack"](spark, clean, sf).collect()} == ids - {100, 104, 101}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()} == ids - {100, 104, 101}


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_all_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11))
