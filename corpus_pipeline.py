"""A cleaning pipeline over `documents`: each stage works on what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents; the last returns the mixture, a row for each time that a document is taken, with its shard,
turn and place.

All stages take nulls in any column, empty texts, repeated rows, an empty table and further columns, whatever they are
called; what each makes of them stands with it. An empty table gives an empty one everywhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import decontam, mixing, neardup, pii, quality
from tidemill.llm.common import free_name, read, remove, shared_dir
from tidemill.llm.queries import held_out


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier doesn't reject. Null and empty texts are scored by statistics of 0; rows
    that repeat each other are judged alike; without labels of both kinds, all or none stay, by the share of label 1."""
    names = (free_name(docs.columns, "score"), free_name(docs.columns, "predicted"))
    labels = read(spark, sf_dir, "labels").where(~held_out())
    scored = quality.score(docs, labels, keep_text=True, names=names)
    return scored.where(f"`{names[1]}` = 1").select(*(f"`{c}`" for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id, null ids last; among rows that repeat an
    id and its words, that with the smallest hash. Texts without words, null ones too, are no copies of each other unless they
    share their id."""
    return neardup.deduplicate(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts stay; each row is judged by itself."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars following the new text. Null and empty texts stay as they
    are."""
    return pii.scrub(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of what is left, by target weights of the sources; rows without a source are one, the last. Null and empty
    texts have size 0 and come with their block. Rows that repeat each other are taken one by one."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the stages; they are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{base}/{name}")
        if before:  # nothing reads it any more
            remove(spark, before)
        before = f"{base}/{name}"
    return docs
