"""The corpus pipeline: documents to packed training sequences.

``STAGES`` are applied in order, each to the rows that the one before kept,
written as Parquet and read again (a stage
begins by removing what the one before has saved on its way): documents of poor quality and of no clear
language go, of near copies one stays, secrets are blanked out, and what is
left is packed.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailfold.llm import jaccard_join, language_id, packing, quality, secrets
from trailfold.llm.common import fresh, recorded, remove, saved, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def tidy(stage: Stage) -> Stage:
    """``stage``, after the tables that the stage before has saved on its way are removed: its rows are written by now."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _left.pop(spark.sparkContext.applicationId, []))
        with recorded() as paths:
            out = stage(spark, docs, sf_dir)
        _left[spark.sparkContext.applicationId] = paths
        return out

    return run_stage


@tidy
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = fresh("score", docs.columns)
    return quality.score(docs, model, out=score).filter(F.col(score) >= quality.KEEP).select(*docs.columns)


@tidy
def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is predicted clearly."""
    model = language_id.fit(docs, ~language_id.held_out(docs["doc_id"]))
    pred, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = language_id.identify(docs, model, keep=tuple(docs.columns), pred=pred, score=score)
    return (found.filter((F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= language_id.CLEAR))
            .select(*docs.columns))


@tidy
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a similarity of 0.8 in five-word shingles."""
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


@tidy
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted anew."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


@tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", clear_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]
#: Stages that fit models have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
