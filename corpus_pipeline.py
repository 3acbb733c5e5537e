"""The corpus pipeline: documents without toxic ones, near copies and benchmark passages, encoded to piece ids.

Every stage works on all rows that its predecessor kept and returns the columns of documents; the last adds the ids.
Other columns of the input pass through all stages; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontam, neardup, spm, toxicity
from barloom.llm.common import Scratch, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold.

    Null and empty texts are scored as texts without evidence; repeated rows are judged alike; labels without both
    classes reject nothing.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays, of rows that repeat it any one.  Null and empty texts are no copies of one another, and rows
    with a null doc_id all stay.
    """
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs; null and empty texts hold none; an empty benchmark rejects nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, token count, digest and the round-trip and parity flags.

    Null text counts as empty: no ids, both flags true.  Columns of the input with one of these five names are replaced.
    """
    made = ("ids", "n_tokens", "ids_sha256", "round_trip", "parity")
    rows = spm.annotate(docs, into="__pieces")
    return rows.select(*[c for c in docs.columns if c not in made], *[F.col("__pieces")[n].alias(n) for n in made])


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontamination", decontaminated), ("sentencepiece", encoded)]

#: toxicity and piece ids have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's table is deleted once the next one is written.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
