"""Sessions and table loading."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that suit any cluster; sizes stay with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(app: str = "kelpforge", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and bench.py; on a cluster the launcher makes the session."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.driver.memory", "8g")
    return b.config(map=SETTINGS | {"spark.sql.shuffle.partitions": str(partitions)}).getOrCreate()


def with_checkpoints(spark: SparkSession) -> None:
    """Where no folder for checkpoints is named, a temporary one is, if the session runs on one machine (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kelpforge-"))


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A path of its own below the folder for checkpoints, which all machines share."""
    with_checkpoints(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
