"""From raw documents to training sequences: quality rules, line and near-duplicate removal, mixing and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again
before the next one; all but the last keep the columns of documents, further ones included, whatever they are called.

Nulls, ties and odd rows: documents without text, or with an empty one, fail the quality rules; those without doc_id pass
line dedup as the last ones, have no near copies, are mixed and packed like all others; rows that repeat a doc_id go
or stay together in the n-gram join and count once each elsewhere; very long texts are taken whole and packed in several
pieces.  Without labels nothing but empty texts is rejected, and all domains count as equally likely.  An empty table gives
no rows at any stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.line_dedup import line_dedup
from webloom.llm.mixing import mixed, repeated
from webloom.llm.ngram_join import keep_one
from webloom.llm.packing import best_fit_packing
from webloom.llm.quality import quality_rules
from webloom.llm.queries import BUDGET, TARGETS, VOCABULARY
from webloom.session import delete, prepare, scratch, shared_dir, spread, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


_OWN = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _keeping(stage: Stage) -> Stage:
    """The stage with the columns of its input, none of which can clash with those that it works with."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner = docs.toDF(*[c if c in _OWN else f"__wl_kept_{i}" for i, c in enumerate(docs.columns)])
        return stage(spark, inner, sf_dir).select(*inner.columns).toDF(*docs.columns)

    return run


@_keeping
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a quality rule go."""
    return quality_rules(docs, _labels(spark, sf_dir)).where("not rejected")


@_keeping
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that occur more than six times stay only where they occur first."""
    return line_dedup(docs, max_count=6)


@_keeping
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest doc_id stays."""
    return keep_one(docs, n=5, threshold=0.4)


@_keeping
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated until the domains have their target shares of tokens."""
    return repeated(mixed(docs, _labels(spark, sf_dir), TARGETS, VOCABULARY, BUDGET))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens."""
    return best_fit_packing(docs, VOCABULARY, capacity=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]

#: Fitting the classifier and packing have no SQL; tests/llm/test_pipeline.py holds run() against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences; what a stage leaves in the shared folder goes as soon as its result is written there."""
    docs, last = spread(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")), None
    for _, stage in STAGES[:-1]:
        path = shared_dir(spark)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), path)
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
