"""Contiguous shards of nearly equal byte sizes, by global prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import with_prefix_sums


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the documents, in the order of their ids, into contiguous shards at equal byte targets.

    A document's size is its UTF-8 length plus 1 (a null text has length 0 and crc 0). It goes to the
    shard in whose n-th part of all bytes its middle byte lies, so that a shard differs from an equal
    share by at most the sizes of the documents at its two ends. Null ids come first; rows that
    repeat an id are ordered by crc and size, and rows alike in all three may exchange places. An
    empty table gives no rows. Other columns of docs are ignored, whatever their names are.

    Returns id, size, text_crc32, law, shard, slot (0, 1, … in the shard's order), grown_shard (null).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text).cast("long") + 1).alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("_crc"),
    )
    order = [F.col("_id").asc_nulls_first(), F.col("_crc").asc(), F.col("_size").asc()]
    summed = with_prefix_sums(rows, order, "_size")
    shard = F.least(F.lit(n_shards - 1), F.expr(f"(2 * _before + _size) * {n_shards} div (2 * _total)")).cast("int")
    placed = summed.withColumn("_shard", shard)
    firsts = placed.groupBy("_shard").agg(F.min("_index").alias("_lowest"))  # a row per shard
    return placed.join(F.broadcast(firsts), "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_index") - F.col("_lowest")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_shards=8)
