"""Toxicity scores from averaged subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import sample, subword

#: Labelled documents that the model is fitted on at most, each with its whole text.
FIT_ROWS = 15_000

#: A row is predicted toxic from this score on.
THRESHOLD = 0.3

#: Sizes of the n-grams in bytes, and bits of their buckets.
SIZES, BITS = (3, 4, 5), 18

#: Width of the embeddings, epochs at most, and epochs without gain on rows that took no part after which the fit ends.
WIDTH, EPOCHS, PATIENCE = 16, 40, 3


def fit(
    docs: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, held_out: int = 2, key: str = "doc_id", text: str = "text", label: str = "toxic"
) -> subword.Model:
    """Fit on at most ``rows`` whole labelled documents with crc32(id) mod 4 other than ``held_out``.

    Labels are sampled before they meet the documents, so the join is with a
    table of bounded size and texts aren't shuffled. Of an id's texts one is
    used, that with the smallest hash, so an id that very many rows share counts
    once. An id with several labels counts as toxic if one says so; null labels
    and ids are left out.
    """
    able = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.pmod(sample.crc_of_id(key), F.lit(4)) != held_out))
    able = able.groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = F.broadcast(sample.evenly(able, rows, "id").select("id", "y"))
    own = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(chosen, "id")
    own = own.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("x"))
    return subword.fitted(own.select("y", "x.t"), sizes=SIZES, bits=BITS, width=WIDTH, epochs=EPOCHS, patience=PATIENCE)


def toxic_share(model: subword.Model, column: pa.Array) -> np.ndarray:
    scores = model.scores(column)
    return scores[:, model.classes.index("1")] if "1" in model.classes else np.zeros(len(scores))


def score(docs: DataFrame, model: subword.Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted`` from the whole text.

    Only the text takes part in a score. Defined cases: null, empty and
    letterless texts get the score of the bias; a null id is not held out (it
    counts as the empty text, with crc32 0); repeated rows are scored alike; a
    very long text is scored whole, in pieces; other columns are ignored; an
    empty table gives an empty result. A model fitted without toxic rows scores 0.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(toxic_share(model, batch.column(2)), pa.float64())],
                names=["doc_id", "held_out", "score"],
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.pmod(sample.crc_of_id(key), F.lit(4)) == 2).alias("held_out"), F.col(text).alias("text")
    )
    out = rows.mapInArrow(each, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: subword.Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns.

    Defined cases: null, empty and letterless texts have the score of the bias,
    as in ``score``; repeated rows share their fate; any other columns are kept
    as they are; an empty table gives an empty result.
    """
    schema = docs.schema
    at = docs.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(toxic_share(model, batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(each, schema)
