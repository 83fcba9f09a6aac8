"""Word counts of a stream of documents, as an incremental form of the batch frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textlex.functions import text as T


def word_counts(docs: DataFrame) -> DataFrame:
    """Running token counts of a stream; the state is one row for each word."""
    return docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("token_count"))


def accumulate(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's counts under its number, so that a repeated batch replaces itself; `total` sums them."""

    def put(batch: DataFrame, number: int) -> None:
        words = batch.select("document_id", F.explode(T.tokens(F.col("text"))).alias("word"))
        each = words.groupBy("word", "document_id").agg(F.count(F.lit(1)).alias("n"))
        each.groupBy("word").agg(F.sum("n").alias("token_count"), F.count(F.lit(1)).alias("document_count")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total(counts: DataFrame) -> DataFrame:
    """Sums over batches; documents don't span batches."""
    return counts.groupBy("word").agg(F.sum("token_count").alias("token_count"), F.sum("document_count").alias("document_count"))
