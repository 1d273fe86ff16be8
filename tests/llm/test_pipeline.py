"""The pipeline's stages over the small tables: each one's decisions take effect."""

import corpus_pipeline
from kinfold.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0
    last = corpus_pipeline.encoded(spark, docs, SF)
    assert last.count() == counts[-1]


def test_one_of_each_group_stays(spark):
    said = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6)]
    rows = [(5, said[0], "en", "s", 1), (3, said[0], "en", "s", 2), (7, said[1], "en", "s", 3), (7, said[2], "en", "s", 4), (7, said[2] + " more", "en", "s", 5), (7, said[1], "de", "s", 6), (None, said[3], "en", "s", 7), (None, said[0], "en", "s", 8), (8, "", "en", "s", 9), (9, None, "en", "s", 10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    want = {(3, said[0]), (7, said[1]), (None, said[3]), (8, ""), (9, None)}
    for order in (rows, rows[::-1]):
        got = corpus_pipeline.deduplicated(spark, spark.createDataFrame(order, schema), SF).collect()
        third = [r for r in got if r["doc_id"] == 7 and r["text"].startswith(said[2])]
        assert len(third) == 1 and {(r["doc_id"], r["text"]) for r in got} - {(7, third[0]["text"])} == want and len(got) == 6
        assert next(r["n_chars"] for r in got if r["text"] == said[1]) == 3 or next(r["lang"] for r in got if r["text"] == said[1]) == "de"
    alone = [r for r in rows if r[0] in (3, 5, 8)]
    assert {r["doc_id"] for r in corpus_pipeline.deduplicated(spark, spark.createDataFrame(alone, schema), SF).collect()} == {3, 8}


def test_empty_and_nulls(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, SF).count() <= 2, name


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]
