"""Numbers in JSON documents, which has no infinities: written as marks, and read from VARIANT columns at any path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How documents spell numbers that are not finite.
MARKS = {"__inf__": float("inf"), "__-inf__": float("-inf"), "__nan__": float("nan")}


def marked(value: Column) -> Column:
    """A double as JSON: the number, a mark for one that is not finite, null."""
    out = F.when(value.isNull(), "null").when(F.isnan(value), '"__nan__"')
    out = out.when(value == float("inf"), '"__inf__"').when(value == float("-inf"), '"__-inf__"')
    return out.otherwise(value.cast("string"))


def number_at(document: Column, path: str) -> Column:
    """The double at a path ($.a.b[0]) of a VARIANT: a number, or what a mark stands for; null for null, for what is missing, and for any other text."""
    text = F.try_variant_get(document, path, "string")
    out = F.when(text.isNull(), F.lit(None).cast("double"))
    for mark, value in MARKS.items():
        out = out.when(text == mark, value)
    return out.otherwise(F.try_variant_get(document, path, "double"))


def text_at(document: Column, path: str) -> Column:
    """The text at a path; null for null and for what is missing."""
    return F.try_variant_get(document, path, "string")


def leaves(rows: DataFrame, key: str, document: str, depth: int = 8) -> DataFrame:
    """key, path, text, number: every value of every document that is neither object nor array, with its path. An error where a document is nested deeper than depth. Empty objects and arrays have none."""
    spark = rows.sparkSession
    level, out = rows.select(F.col(key).alias("_key"), F.lit("$").alias("_path"), F.col(document).alias("_doc")), None
    nested = F.schema_of_variant("_doc").rlike("^(OBJECT|ARRAY)<")
    for k in range(depth + 1):
        flat = level.where(F.col("_doc").isNotNull() & ~nested)
        found = flat.select(F.col("_key").alias(key), F.col("_path").alias("path"), text_at(F.col("_doc"), "$").alias("text"), number_at(F.col("_doc"), "$").alias("number"))
        out = found if out is None else out.unionByName(found)
        inner = level.where(nested)
        if k == depth:
            deeper = inner.select(F.raise_error(F.concat(F.lit("nested too deep: "), "_path")).cast("string").alias("_e"))
            return out.unionByName(deeper.select(F.lit(None).cast(rows.schema[key].dataType).alias(key), F.col("_e").alias("path"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("double").alias("number")))
        parts = inner.lateralJoin(spark.tvf.variant_explode(F.col("_doc").outer()))
        step = F.when(F.col("key").isNotNull(), F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = parts.select("_key", F.concat("_path", step).alias("_path"), F.col("value").alias("_doc"))
    return out
