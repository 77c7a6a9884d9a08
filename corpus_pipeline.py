"""The corpus pipeline: quality classifier, line dedup, near-duplicate dedup, source mixing, packing.

Every stage keeps the defined results of its operator for null, empty, very long and repeated rows; an empty table
passes through as one; further columns of ``documents``, whatever their names, come out as they went in (up to
packing, which returns its own).
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import line_dedup, mixing, near_dedup, packing, quality_classifier
from weftline.llm.common import Cuts, Scratch, table

_last = threading.local()


def _stage(f: Callable) -> Callable:
    """Frees what the stage before in this thread wrote on its way: its result, this one's ``docs``, is stored by now."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = getattr(_last, "scratch", None)
        if before is not None and f is not quality.__wrapped__:
            before.free()
        with Scratch(spark) as _last.scratch:
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier predicts to be good. It learns as op1 does, from this input.

    Null and empty texts are scored as a text of no words; equal texts share their fate."""
    rows = quality_classifier.remainder(F.col("doc_id"), 3) != 1
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), rows)
    return docs.where(quality_classifier.scorer(model)(F.col("text")) >= 0.5)


@_stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated runs of lines; documents left without a word are copies and go. Null, empty and
    wordless texts stay as they are."""
    return line_dedup.dedup_lines(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the one of least doc_id (null first; of repeated rows, one).
    Null, empty and wordless texts are classes of their own and stay."""
    return near_dedup.keep_one(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their targets; a document may come twice, and one per source and epoch in part. Texts
    without a word are never taken; a null source is one of its own."""
    return mixing.mix_documents(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all words into sequences of the permitted lengths: one row per piece of a document."""
    return packing.pack_documents(docs).drop("row_key", "copy")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near),
    ("source mixing", mix),
    ("best-fit packing", pack),
]

#: The classifier and the hashed orders of mixing and packing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and the one before
    it is deleted once it has been read for the last time."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        cuts = Cuts(spark, f"pipeline-{name.replace(' ', '-')}")
        docs = cuts.cut(stage(spark, docs, sf_dir))
        if before is not None:
            before[0].drop(before[1])
        before = (cuts, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
