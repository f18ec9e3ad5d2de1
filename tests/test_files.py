"""Scenario files of both formats, and result documents whose blocks are replaced one by one."""

import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from kelpforge.operators import bom
from kelpforge.sources.files import scenario_files
from kelpforge.sources.scenarios import blocks, parts, read_block, scenarios, write_block, write_companion

SEED = {
    "name": "Seed: a #1", "notes": "unknown fields are left out",
    "subsystems": [{"name": "frame (cast)", "mass_kg": 4000, "category": "structure", "producible_locally": True, "processes": ["casting", "machining"], "energy_to_produce_kwh_per_kg": 5.0}, {"name": "chips", "mass_kg": 90.5, "producible_locally": False}],
    "replication": {"seed_mass_kg": 12000, "duration_days": 14600, "dt_days": 1.0},
}
YAML = """
# a comment
name: "Seed: a #1"
notes: unknown fields are left out

subsystems:
  - name: frame (cast)
    mass_kg: 4000          # whole
    category: structure
    producible_locally: true
    processes: [casting, machining]
    energy_to_produce_kwh_per_kg: 5.0

  - name: chips
    mass_kg: 90.5
    producible_locally: false
replication:
  seed_mass_kg: 12000
  duration_days: 14600
  dt_days: 1.0
"""


def test_both_formats_give_equal_rows(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "seed.yaml").write_text(YAML)
    (tmp_path / "a" / "seed.yml").write_text(YAML)
    (tmp_path / "a" / "seed.json").write_text(json.dumps(SEED, indent=1))
    (tmp_path / "a" / "other.txt").write_text("no scenario")
    got = scenario_files(spark, str(tmp_path / "a"))
    assert got.rdd.getNumPartitions() == 3 and len(got.collect()) == 3 and got.distinct().count() == 1
    assert got.first() == scenarios(spark, str(tmp_path / "a" / "seed.json")).first()
    one = scenario_files(spark, f"file://{tmp_path}/a/seed.yaml")
    closure = bom.closure(parts(one).withColumnRenamed("producible_locally", "local"), ["scenario"], "mass_kg").first()
    assert closure["closure"] == pytest.approx(4000 / 4090.5)


@pytest.mark.parametrize(
    ("name", "text", "says"),
    [
        ("a.yaml", "name: [", "a.yaml"), ("b.json", '{"name": ', "b.json"), ("c.yaml", "subsystems: 5", "subsystems must be a list"), ("d.yaml", "name: x\nsubsystems:\n - mass_kg: heavy", r"subsystems\[0\].mass_kg must be double"),
        ("e.yml", "replication: {duration_days: 1.5}", "duration_days must be int"), ("f.yaml", "", "empty"), ("g.json", "[1]", "must be a mapping"), ("h.yaml", "subsystems: [{producible_locally: 1}]", "must be boolean"),
    ],
)
def test_malformed_files_fail_with_their_path(spark, tmp_path, name, text, says):
    (tmp_path / name).write_text(text)
    with pytest.raises(Exception, match=says) as e:
        scenario_files(spark, str(tmp_path / name)).collect()
    assert name in str(e.value)


def test_missing_path(spark, tmp_path):
    with pytest.raises(Exception, match="no scenario at"):
        scenario_files(spark, str(tmp_path / "none.yaml")).collect()
    assert scenario_files(spark, str(tmp_path)).collect() == []


def files(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("part-*")}


def test_blocks(spark, tmp_path):
    doc, rows = tmp_path / "doc", spark.createDataFrame([(1, 0.5), (2, 1.5)], "run long, share double")
    with pytest.raises(FileNotFoundError):
        write_companion(rows, str(doc), "p2", "test")
    assert blocks(spark, str(doc)) == []
    write_block(rows, str(doc), "main", "test", {"n": 2})
    before = files(doc)
    write_companion(rows.where("run = 2"), str(doc), "p2", "test", {"n": 1})
    write_companion(rows.where("run = 1").withColumn("more", F.lit("x")), str(doc), "p2", "test", {"n": 1})  # a rerun, of other columns
    assert blocks(spark, str(doc)) == ["main", "p2"]
    assert {k: v for k, v in files(doc).items() if k.startswith("block=main")} == before
    assert [tuple(r) for r in read_block(spark, str(doc), "p2", "run:long, share:double, more:string").collect()] == [(1, 0.5, "x")]
    assert sorted(tuple(r) for r in read_block(spark, str(doc), "main", "run:long, share:double").collect()) == [(1, 0.5), (2, 1.5)]
    # a job that fails leaves the block as it was
    kept = files(doc)
    with pytest.raises(Exception, match="broken"):
        write_companion(rows.withColumn("share", F.when(F.col("run") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("share"))), str(doc), "p2", "test")
    assert files(doc) == kept
    write_companion(rows.limit(0), str(doc), "p2", "test")  # no results are a block too
    assert blocks(spark, str(doc)) == ["main", "p2"] and read_block(spark, str(doc), "p2", "run:long").count() == 0


LOST = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from kelpforge.sources.scenarios import read_block, write_block, write_companion
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def dies_at_first(batches):
    for b in batches:
        yield b
    if TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("this task is lost")
rows = spark.range(100, numPartitions=4)
write_block(rows, sys.argv[1], "main", "test")
write_companion(rows.mapInArrow(dies_at_first, "id long"), sys.argv[1], "p2", "test")
for name in ("main", "p2"):
    assert sorted(r["id"] for r in read_block(spark, sys.argv[1], name, "id:long").collect()) == list(range(100))
print("whole")
"""


def test_lost_tasks_write_nothing_twice(tmp_path):
    done = subprocess.run([sys.executable, "-c", LOST, str(tmp_path / "doc")], capture_output=True, text=True, timeout=300, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]
