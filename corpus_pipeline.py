"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import decontaminate, linededup, minhash, packing, toxicity
from folio.llm.queries import table, tokenizer_path
from folio.llm.ship import ship
from folio.llm.store import discard, kept, kept_alone


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the model is fitted on labelled documents.

    Null and empty texts have the score of the bias and stay where that is low;
    repeated rows share their fate; an empty table stays empty; other columns
    are kept as they are.
    """
    ship(spark)
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template recurs; ``n_chars`` follows the text.

    Every row stays, also one that loses all its lines; null texts stay null;
    other columns are kept as they are; an empty table stays empty.
    """
    out = linededup.without_recurring_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id.

    Rows are told apart by id and text: of rows that share an id each follows
    the group of its own text. Null, empty and blank texts are in no group and
    stay, as do rows with a null id; an empty table stays empty; other columns
    are kept as they are.
    """
    ship(spark)
    groups = minhash.near_duplicates(docs, width=5, percent=80)
    lost = kept(groups.where(~F.col("kept")).select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h")).distinct(), "pipeline-lost")
    return docs.join(lost, (docs["doc_id"] == lost["i"]) & (F.xxhash64(docs["text"]) == lost["h"]), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; repeated rows share their fate; an
    empty table, or an empty benchmark, changes nothing.
    """
    ship(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens.

    Null and empty texts have one token, the closing 0; repeated rows are packed
    again; an empty table gives no sequence.
    """
    ship(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_recurring_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: Models and tokenisation have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again but the last.

    What a stage has kept for its result, and the table that it read, go as soon
    as its own table is written.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, kept_alone(partial(stage, spark, docs, sf_dir), "pipeline")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
