"""The corpus pipeline: every stage on its own input, and tables that are empty or full of nulls."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from panelwise.llm.common import stored  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = [{r[0] for r in docs.select("doc_id").collect()}]
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert docs.columns == pipeline.COLUMNS
        ids.append({r[0] for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2] and ids[-1]
    judged = [(labels[i], i in ids[1]) for i in ids[0] if i in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    assert ids[4] == ids[5]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "", "en", None, 0), (2, "same words here", "en", "s", 5), (2, "same words here", "en", "s", 5)]])
def test_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
    assert docs.count() == 0 or docs.agg(F.max("size")).first()[0] == 3


def test_mixing_keeps_null_and_repeated_ids(spark):
    text = {i: f"text{i} " * 40 for i in range(30)}
    rows = [(None if i < 10 else 7 if i < 20 else i, text[i], "en", "ab"[i % 2], 1) for i in range(30)]
    docs = stored(spark.createDataFrame(rows, DOCS), "docs")
    got = [r["text"] for r in pipeline.mixing_stage(spark, docs, SF).collect()]
    sizes = stored(docs.select("text", "doc_id", "source", F.lit(40).cast("long").alias("size")), "sizes")
    taken = {r["source"]: r["n"] for r in pipeline.mixing.mix(sizes).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    for source in "ab":
        mine = [t for t in got if t in {text[i] for i in range(30) if "ab"[i % 2] == source}]
        assert abs(40 * len(mine) - taken[source]) <= 40
    # every row gets its own number of copies, the null ids among them
    assert {text[i] for i in range(10)} & set(got) and len(got) > len(set(got))
