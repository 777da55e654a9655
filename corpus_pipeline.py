"""From raw documents to packed training batches: five stages, each written as a table and read by the next.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept and returns a DataFrame; all but the last return the columns of
documents. Null and empty texts go at the language stage, whatever their
quality score; an empty table passes through every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import langid, mixing, neardup, packing, quality
from panelwise.llm.common import stored, word_count
from panelwise.session import drop_tables, tables_made

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_QUALITY = 0.7
LEAST_SHARE = 0.4
#: Rows of the mix's plan that are sent to every task.
BROADCAST_ROWS = 2_000_000


#: Intermediate tables of the last stage that ran.
_last: list[str] = []


def _stage(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first drops the intermediate tables of the stage before it, whose output, which it reads, has been written."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_tables(spark, _last, docs.inputFiles())
        before = set(tables_made())
        out = function(spark, docs, sf_dir)
        _last[:] = [t for t in tables_made() if t not in before]
        return out

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on all labels, scores at least 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(quality.measured(docs, ["doc_id"]), labels)
    if model is None:
        return docs.select(COLUMNS)
    return quality.score(docs, model, threshold=LEAST_QUALITY).where("predicted = 1").select(COLUMNS)


@_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language that at least 0.4 of their letters belong to; texts without letters go."""
    model = langid.train(docs)
    found = langid.identify(docs, model).where((F.col("language.lang") != langid.UNKNOWN) & (F.col("language.score") >= LEAST_SHARE))
    return found.select(COLUMNS)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, width=5, percent=80).select(COLUMNS)


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of every row (hash of its file, number in it) as ``_file`` and ``_row``: ids may be null or repeated.

    Documents that are no Parquet files read as they are become such first.
    """
    if "_metadata" in docs.columns:
        docs = stored(docs.select(COLUMNS), "mix-rows")
    place = [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        return docs.select(*COLUMNS, *place)
    except AnalysisException:
        return stored(docs.select(COLUMNS), "mix-rows").select(*COLUMNS, *place)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: whole copies, the words taken over the size, rounded."""
    rows = _with_row_key(docs)
    sizes = stored(rows.select("_file", "_row", "doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    copies = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    plan = stored(mixing.mix(sizes).where("taken > 0").select("_file", "_row", copies.alias("copies")).where("copies > 0"), "copies")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)  # 20 bytes a row; beyond, texts and plan are shuffled
    return rows.join(plan, ["_file", "_row"]).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of the mixed documents."""
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    return packing.pack(sizes, "size").select("doc_id", "source", "size", "bucket", "bucket_length", "batch", "slot", "padding")


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("source mix", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the fitted models and hashes. The operators have tests or SQL of their own; the tests of the stages are invariants
#: (columns, kept documents, agreement with the labels, words taken), no brute force of the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        read = tables_made()[-1:] if i else []
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{i}")
            drop_tables(spark, read, [])  # the stage's input, now that its output is written
    return docs
