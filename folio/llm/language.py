"""Language identification by averaged subword embeddings with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import sample, subword

#: Rows that the model is fitted on at most, each with its whole text; and those that each language has, if it has so many.
FIT_ROWS, FIT_LEAST = 5000, 100

SIZES, BITS = (1, 2, 3, 4), 17

#: The answer for a text that holds no letter.
UNDETERMINED = "und"


def fit(docs: DataFrame, *, rows: int = FIT_ROWS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> subword.Model:
    """Fit on whole texts of documents with a language and crc32(id) mod 5 other than 0.

    At most ``rows`` of them are drawn evenly from all, and ``FIT_LEAST`` from
    each language, so that a rare language is learned at every size. Which ones
    follows from hashes of id and text alone.
    """
    able = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & (F.pmod(sample.crc_of_id(key), F.lit(5)) != 0))
    able = able.select(F.col(lang).cast("string").alias("y"), F.xxhash64(F.col(key), F.col(text)).alias("own"), F.col(text).alias("t"))
    first = Window.partitionBy("y").orderBy(F.xxhash64("own", F.lit(13)), "own")
    counts = able.groupBy("y").agg(F.count("*").alias("n"))
    # a language with n rows keeps about twice those it needs before they are ranked
    rare = able.select("y", "own").join(F.broadcast(counts), "y").where(F.pmod(F.xxhash64("own"), F.lit(1 << 20)) < (1 << 20) * F.lit(2.0 * FIT_LEAST + 100) / F.col("n"))
    least = rare.select("y", "own").distinct().withColumn("at", F.row_number().over(first)).where(F.col("at") <= FIT_LEAST).select("y", "own")
    evenly = sample.evenly(able.select("y", "own"), rows, "y", "own")
    chosen = evenly.union(least).distinct()
    found = able.join(F.broadcast(chosen), ["y", "own"]).dropDuplicates(["y", "own"])
    return subword.fitted(found.select("y", "t"), sizes=SIZES, bits=BITS)


def identify(docs: DataFrame, model: subword.Model, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, held_out, lang_pred, score, rejected`` from the whole text.

    ``score`` is the calibrated probability of ``lang_pred``; ``rejected`` marks
    those under the level at which rows kept out of the fit are right in 0.98 of
    all cases. Defined cases: null and letterless texts give ``und`` with score
    0, rejected; a null id counts as the empty text, whose crc32 is 0, and so is
    held out; repeated rows are answered alike; a very long text is read whole; other columns are ignored; an empty table gives an empty
    result.
    """
    classes = np.array(model.classes, dtype=object)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.scores(batch.column(3))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
            able = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = np.where(able, classes[best], UNDETERMINED) if len(p) else []
            sure = np.where(able, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(list(names), pa.string()), pa.array(sure, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.pmod(sample.crc_of_id(key), F.lit(5)) == 0).alias("held_out"), body.rlike(r"\p{L}").alias("able"), body.alias("text")
    )
    out = rows.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")
    return out.withColumn("rejected", (F.col("score") < model.level) | (F.col("lang_pred") == UNDETERMINED))
