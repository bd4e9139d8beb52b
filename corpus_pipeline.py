"""Corpus pipeline: each stage is one operator, works on all that its predecessor kept, and its decisions take effect.

All stages but the last return the columns of documents. A stage judges rows, not ids: quality, contamination and
personal data depend on a row's text alone, and near-duplicates give each row a key of its own, so rows without an id
and different rows with one id are filtered like any other.

Nulls: a row without a text is judged as an empty one; it is near to nothing and holds nothing. Ties: of a group of
near-duplicates the row with the smallest id stays, then rows without an id follow, in the order of a hash of all
columns. Repeated rows are copies of each other: those with a text leave one, those without a text stay. Very long
texts are read whole. Empty tables go through every stage. Without labels every row scores the same and stays; without
benchmark items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.llm.decontam import drop_contaminated
from lotlens.llm.near_dedup import near_duplicates
from lotlens.llm.packing import pack
from lotlens.llm.pii import redact_pii
from lotlens.llm.quality_classifier import keep_good
from lotlens.llm.queries import held_out, tokenizer_added, tokenizer_json, tokenizer_path
from lotlens.llm.spark_util import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; labels that are held out are never learnt."""
    labels = table(spark, sf_dir, "labels")
    return keep_good(docs, labels.filter(~held_out(F.col("doc_id"))))


def row_key(docs: DataFrame) -> Column:
    """Ordered by id, rows without one last; equal for equal rows alone, but for a chance of 2^-128 a pair."""
    parts = [x for c in docs.columns for x in (docs[c], docs[c].isNull())]
    return F.struct(docs["doc_id"].isNull().alias("no_id"), docs["doc_id"].alias("id"), F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest key.

    The similarity is 0.8, as for near-duplicates in general; the query of the operator alone takes the 0.85 of its
    contract. A row without words is in no group and stays.
    """
    keyed = docs.select(row_key(docs).alias("_key"), *docs.columns)
    found = near_duplicates(keyed.select("_key", "text"), id_col="_key", percent=80).filter("kept")
    # a key counts more than once only where rows are equal in all columns
    kept = materialize(found.groupBy(F.col("doc_id").alias("_key")).agg(F.when(F.max("n_shingles") > 0, F.count("*")).otherwise(1).alias("_n")))
    once = keyed.join(kept.filter("_n = 1").select("_key"), "_key", "left_semi").select(*docs.columns)
    again = kept.filter("_n > 1").select("_key")
    if again.limit(1).count() == 0:
        return once
    # partial aggregates leave one of a task's copies before anything is exchanged
    firsts = keyed.dropDuplicates(["_key"]).join(again, "_key", "left_semi").select(*docs.columns)
    return once.union(firsts)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind, their lengths counted anew."""
    return redact_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequences; repeated rows are packed one by one."""
    return pack(docs, tokenizer_path(), added=tokenizer_added(), json_path=tokenizer_json())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near-duplicates", dedup),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("packing", packing),
]

#: A trained network, a randomised join and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is evaluated once: its rows are checkpointed before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
