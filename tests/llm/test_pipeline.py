"""Every stage on planted and odd rows, and the chain against brute force."""

import random

import pytest

import corpus_pipeline
from faultline.llm.support import materialise

WORDS = "abcdefgh"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    choose = random.Random(12)
    prose = lambda n: " ".join("".join(choose.choice(WORDS) for _ in range(choose.randint(3, 8))) for _ in range(n))
    items = [(i, prose(20)) for i in range(5)]
    clean = [(i, prose(choose.randint(60, 200)), "en", f"s{i % 5}") for i in range(200)]
    junk = [(300 + i, prose(70).replace(" ", "### "), "en", "s1") for i in range(10)] + [(320, "too short", "en", "s1"), (321, None, None, None), (322, "", "en", None)]
    copies = [(400 + i, clean[i][1], "en", "s2") for i in range(20)] + [(430 + i, clean[50][1] + f" end{i}", "en", "s2") for i in range(30)]
    leaks = [(500 + i, f"{prose(60)} {item} {prose(20)}", "en", "s3") for i, item in items]
    private = [(600, f"{prose(60)} me@x.org and +1 (555) 010-7788 {prose(5)}", "en", "s4"), (None, prose(80), "en", "s4")]
    rows = clean + junk + copies + leaks + private
    folder = str(tmp_path_factory.mktemp("tables"))
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], columns).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, int(not 300 <= i < 330), 0) for i, *_ in rows if i is not None and i % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_decisions_take_effect(spark, planted):
    docs, seen = spark.read.parquet(f"{planted}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, planted), name)
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    ids = {name: {r.doc_id for r in table.select("doc_id").collect()} for name, table in seen.items()}
    clean = {*range(200), None, 600}
    assert ids["quality_rules"] == clean | {*range(400, 420), *range(430, 460), *range(500, 505)}
    assert ids["near_duplicates"] == clean | {*range(500, 505)}
    assert ids["decontamination"] == clean == ids["personal_data"] == ids["packing"]
    text = {r.doc_id: r for r in seen["personal_data"].collect()}
    assert "<email> and <phone>" in text[600].text and text[600].n_chars == len(text[600].text)
    assert seen["packing"].groupBy("bin_id").agg({"n_tokens": "sum"}).where("`sum(n_tokens)` > 4096").isEmpty()
    whole = corpus_pipeline.run(spark, planted)
    assert {r.doc_id for r in whole.select("doc_id").collect()} == clean


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_odd_tables(spark, planted, name, stage):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "", "", 0), (2, "word " * 300, "en", "s", 1500), (2, "word " * 300, "en", "s", 1500), (3, "x" * 300_000, None, "s", 3), (4, " ".join(f"w{i}" for i in range(90)), "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'a' as kept", "'b' as text_key", "'c' as id_key", "'d' as n_tokens", "1 as size")
    got = stage(spark, docs, planted)
    assert name == "packing" or got.columns == docs.columns
    assert 4 in {r.doc_id for r in got.collect()}
    assert stage(spark, docs.limit(0), planted).count() == 0


def test_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{n}_" for n in range(1, 11))} <= {x if x == "pipeline" else x.split("_")[0] + "_" for x in entry.queries()}
