"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks. DataFrame functions only.

A source's documents stand in a seeded order and are cut into blocks of equally many words. Shards take their quotas of a source's
blocks one after the other, in that order; when all blocks are taken, the next seats go round once more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.llm.common import with_prefix_sums, written

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """weights: by the rank of the source, repeating. total: what all targets add up to, in sizes of the whole input.
    most: a source's target in sizes of the source, at most. block_words: words in a block at most; the block
    shrinks until the smallest target holds 256 blocks. n_shards: shards that get quotas of their own."""

    weights: tuple[float, ...] = (3, 1, 2)
    total: float = 1.5
    most: float = 2.0
    block_words: int = 128
    n_shards: int = 8
    seed: int = 20240601


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: _source, _size, _start (words of all sources before it), _target, _words (in a block), _blocks, _all (targets' sum).

    Targets are filled like water: sources in the order of cap / weight; those whose cap lies below the
    level keep the cap, the others get weight times level. Ranks and levels are windows over a row per source, not per document.
    """
    by_source = Window.orderBy(F.col("_source").asc_nulls_last())
    before = by_source.rowsBetween(Window.unboundedPreceding, -1)
    weights = F.array(*[F.lit(float(w)) for w in mix.weights])
    s = sizes.groupBy("_source").agg(F.sum("_size").alias("_size"))
    s = s.select("_source", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.element_at(weights, F.pmod(F.row_number().over(by_source) - 1, F.lit(len(mix.weights))).cast("int") + 1).alias("_w"))
    s = s.withColumn("_cap", mix.most * F.col("_size"))
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rising = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    lower = rising.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_all", mix.total * F.sum("_size").over(whole)).withColumn("_rank", F.row_number().over(rising))
    level = (F.col("_all") - F.coalesce(F.sum("_cap").over(lower), F.lit(0.0))) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(lower), F.lit(0.0)))
    s = s.withColumn("_level", level)
    s = s.withColumn("_open", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_rank", "_level")))
    s = s.withColumn("_target", F.least("_cap", F.coalesce(F.min("_open").over(whole)["_level"] * F.col("_w"), F.col("_cap"))))
    smallest = F.min(F.when(F.col("_target") > 0, F.col("_target"))).over(whole)
    words = F.greatest(F.lit(1), F.least(F.lit(mix.block_words), F.floor(smallest / 256).cast("int"))).cast("long")
    s = s.withColumn("_words", F.coalesce(words, F.lit(1)))
    return s.select("_source", "_size", "_start", "_target", "_all", "_words", F.expr("(_size + _words - 1) div _words").alias("_blocks"))


def block_quotas(targets: DataFrame, mix: Mix) -> DataFrame:
    """Integer quotas of blocks by Sainte-Laguë, one row per source and shard: _source, _shard, _quota, _given (in this and all earlier shards).

    Seat j of a source has the quotient target / (2 j - 1), and the highest quotients win. The method is
    house-monotone, so that a shard's quotas are what the seats up to it give beyond the seats up to the
    shard before. Rounding by any divisor d gives each source target / d within one half, and a d that
    fits the number of seats lies within half a seat per source of total / seats; so all but a few
    candidates per source are decided beforehand, and only those few are ranked.
    """
    n_sources = F.count(F.when(F.col("_target") > 0, 1)).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    t = targets.withColumn("_m", n_sources).where("_target > 0")
    t = t.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(mix.n_shards - 1))))
    t = t.withColumn("_seats", F.expr(f"cast(round(_all / _words) as bigint) * (_shard + 1) div {mix.n_shards}"))
    t = t.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_target") * (F.col("_seats") - F.col("_m") / 2) / F.col("_all") - 0.5)).cast("long"))
    t = t.withColumn("_most", F.floor(F.col("_target") * (F.col("_seats") + F.col("_m") / 2) / F.col("_all") + 0.5).cast("long") + 1)
    t = t.withColumn("_left", F.col("_seats") - F.sum("_sure").over(Window.partitionBy("_shard")))
    seats = t.withColumn("_j", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
    best = Window.partitionBy("_shard").orderBy((F.col("_target") / (2 * F.col("_j") - 1)).desc(), F.col("_source").asc_nulls_last(), "_j")
    won = seats.withColumn("_won", (F.row_number().over(best) <= F.col("_left")).cast("long"))
    given = won.groupBy("_source", "_shard").agg((F.first("_sure") + F.sum("_won")).alias("_given"), F.first("_blocks").alias("_blocks"))
    given = given.withColumn("_given", F.least("_given", F.floor(mix.most * F.col("_blocks")).cast("long")))
    return given.select("_source", "_shard", "_given", (F.col("_given") - F.coalesce(F.lag("_given").over(Window.partitionBy("_source").orderBy("_shard")), F.lit(0))).alias("_quota"))


def source_plan(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: targets, blocks, _seats (in all shards) and _bounds (seats in each shard and all before it, an entry per shard)."""
    targets = source_targets(sizes, mix)
    quotas = block_quotas(targets, mix).groupBy("_source").agg(F.array_sort(F.collect_list(F.struct("_shard", "_quota"))).alias("_q"))
    bounds = F.transform("_q", lambda at: F.aggregate(F.filter("_q", lambda x: x["_shard"] <= at["_shard"]), F.lit(0).cast("long"), lambda total, x: total + x["_quota"]))
    quotas = quotas.select(F.col("_source").alias("_s"), bounds.alias("_bounds"))
    plan = targets.join(quotas, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.withColumn("_bounds", F.coalesce("_bounds", F.array_repeat(F.lit(0).cast("long"), mix.n_shards))).withColumn("_blocks", F.greatest("_blocks", F.lit(1)))
    return plan.withColumn("_seats", F.element_at("_bounds", -1))


def placed_documents(rows: DataFrame, mix: Mix, carry: tuple[str, ...] = ()) -> DataFrame:
    """Every one of rows (_id, _source, _size, and what is carried) with the words before it in its source's seeded order (_at) and its source's plan."""
    rows = rows.select("_id", "_source", "_size", *carry).withColumn("_key", F.xxhash64(F.lit(mix.seed), F.col("_id")))
    order = [F.col("_source").asc_nulls_last(), F.col("_key").asc(), F.col("_id").asc_nulls_first(), F.col("_size").asc()]
    summed = with_prefix_sums(rows, order, "_size").drop("_total")
    plan = written(source_plan(summed.select("_source", "_size"), mix).withColumnRenamed("_size", "_source_size"), "mix").withColumnRenamed("_source", "_s")
    joined = summed.join(plan, F.col("_source").eqNullSafe(F.col("_s")))
    return joined.withColumn("_at", F.col("_before") - F.col("_start"))


#: Of a document in its source: in round t (0, 1, ...) its words stand _at words behind t times the source; seat j begins j * _words words behind.
_SEAT_PARTS = """filter(flatten(transform(sequence(0L, (_seats + _blocks - 1) div _blocks - 1), t -> transform(_bounds, (upto, k) -> named_struct(
    'round', t, 'shard', k,
    'from', greatest(0L, (if(k = 0, 0L, _bounds[k - 1]) - t * _blocks) * _words - _at),
    'to', least(_size, (upto - t * _blocks) * _words - _at))))), x -> x.to > x.from)"""


def _parts() -> Column:
    """Which words of the document go to which shard: round, shard, from, to."""
    return F.when((F.col("_seats") > 0) & (F.col("_size") > 0), F.expr(_SEAT_PARTS))


def _words_of(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Says for every document how many of its words the mix takes, repeats counted, and how many go to each shard (shard_words).

    Seats for blocks go to sources by Sainte-Laguë, per shard; a source with more seats than blocks takes each block once or twice. A
    document takes the words that it has in chosen blocks. Null sources form the last source; null or blank texts have no
    words and take none; an empty table gives no rows. Repeated rows count as documents of their own; null ids are ids
    like any other. Other columns of docs are ignored, whatever their names are.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), _words_of(text_col).alias("_size"))
    d = placed_documents(rows, mix).withColumn("_parts", _parts())
    shard_words = F.expr(f"transform(sequence(0, {mix.n_shards - 1}), k -> aggregate(filter(coalesce(_parts, array()), x -> x.shard = k), 0L, (n, x) -> n + x.to - x.from))")
    return d.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias("source"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_words").alias("block_words"),
        F.expr("coalesce(aggregate(_parts, 0L, (n, x) -> n + x.to - x.from), 0L)").alias("taken"),
        shard_words.alias("shard_words"),
    )


def mix_documents(docs: DataFrame, mix: Mix = Mix(), text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", shard_col: str | None = None) -> DataFrame:
    """The mix itself: a row for each part of a document that goes to a shard, with the text cut down to it; most documents go whole, or not at all.

    What is taken twice is a second row. Cut texts keep the white space between their words. Documents of which nothing is taken,
    and so those without words, are gone; all other columns stay as they are, whatever their names are. shard_col adds the shard.
    Repeated rows and rows that repeat an id count as documents of their own.
    """
    marked = written(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_mark"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), _words_of(text_col).alias("_size")), "to-mix")
    plan = placed_documents(marked, mix, carry=("_mark",)).withColumn("_part", F.explode(_parts()))
    whole = F.col("_row")[text_col]
    d = marked.select("_mark", "_row", "_size").join(plan.select("_mark", "_part"), "_mark")
    spaced = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
    cut = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(spaced), F.lit(0)), F.col("_part.from").cast("int") + 1, (F.col("_part.to") - F.col("_part.from")).cast("int")), "")
    text = F.when(F.col("_part.to") - F.col("_part.from") == F.col("_size"), whole).otherwise(cut)
    shard = [] if shard_col is None else [F.col("_part.shard").alias(shard_col)]
    return d.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns], *shard)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
