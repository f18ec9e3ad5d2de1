"""Scenario files and result documents."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a scenario file holds; fields that are missing are null.
SCENARIO = """name string, subsystems array<struct<name:string, mass_kg:double, category:string, producible_locally:boolean, processes:array<string>, energy_to_produce_kwh_per_kg:double>>,
    replication struct<seed_mass_kg:double, local_build_rate_kg_per_day:double, vitamin_resupply_mass_kg:double, resupply_cadence_days:double, available_power_kw:double, target_output_kg_per_day:double, duration_days:int, dt_days:double>"""


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """A row per JSON file at the path (a file, a folder or a pattern). A malformed file fails the read."""
    return spark.read.schema(SCENARIO).option("multiLine", True).option("mode", "FAILFAST").json(path)


def parts(found: DataFrame) -> DataFrame:
    """scenario, position (equal masses keep the file's order), and the fields of each part."""
    return found.select(F.col("name").alias("scenario"), F.posexplode("subsystems").alias("position", "part")).select("scenario", "position", "part.*")


def write_results(rows: DataFrame, path: str, generator: str, version: int = 1) -> None:
    """Result rows as JSON lines, each with the version of their schema and what made them; a rerun replaces what is there."""
    rows.select(F.lit(version).alias("schema_version"), F.lit(generator).alias("generator"), F.struct(*rows.columns).alias("data")).write.mode("overwrite").json(path)


def unfinished(planned: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """Planned runs of which there is no result yet."""
    return planned.join(finished.select(key).distinct(), key, "left_anti")


def with_defaults(runs: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """Missing columns and nulls get the defaults."""
    return runs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in runs.columns else F.lit(v) for k, v in defaults.items()})


#: A block's own row: what the block was made with; the rows of results follow under `data`.
HEADER = "header"


def write_block(rows: DataFrame, path: str, block: str, generator: str, config: dict[str, Any] | None = None, version: int = 1) -> None:
    """Result rows as one block of the document at the path. A block that is there is replaced as a whole when the job ends, the others stay as they are, byte for byte.

    Tasks write beside the document and are moved in by the commit, so a task that is lost is run again, and a job that fails or is run again leaves the block either old or new.
    A block without rows is written too: it has its header. Only the first block may be written where there is no document yet: see write_companion.
    """
    spark = rows.sparkSession
    meta = f"schema_version int, generator string, config string, kind string, data {rows.schema.simpleString()}"
    header = spark.createDataFrame([(version, generator, json.dumps(config or {}, sort_keys=True), HEADER, None)], meta)
    data = rows.select(F.lit(version).alias("schema_version"), F.lit(generator).alias("generator"), F.lit(None).cast("string").alias("config"), F.lit("row").alias("kind"), F.struct(*rows.columns).alias("data"))
    both = header.unionByName(data).withColumn("block", F.lit(block))
    both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").json(path)


def write_companion(rows: DataFrame, path: str, block: str, generator: str, config: dict[str, Any] | None = None, version: int = 1) -> None:
    """write_block for a document that must be there already."""
    if not blocks(rows.sparkSession, path):
        raise FileNotFoundError(f"no results at {path} to add the block {block} to")
    write_block(rows, path, block, generator, config, version)


def blocks(spark: SparkSession, path: str) -> list[str]:
    """Names of the document's blocks; none where there is no document."""
    try:
        d = spark.read.schema("kind string, block string").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["block"] for r in d.where(F.col("kind") == HEADER).select("block").collect())  # a row per block


def read_block(spark: SparkSession, path: str, block: str, schema: str) -> DataFrame:
    """Rows of a block. schema: of its results."""
    d = spark.read.schema(f"kind string, data struct<{schema}>, block string").json(path)
    return d.where((F.col("block") == block) & (F.col("kind") != HEADER)).select("data.*")
