import json

import pytest

from kelpforge.sources.scenarios import parts, scenarios, unfinished, write_results


def test_scenarios(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "subsystems": [{"name": "x", "mass_kg": 2.0, "producible_locally": True}, {"name": "y", "mass_kg": 1.0}]}, indent=1))
    got = parts(scenarios(spark, str(tmp_path / "a.json"))).orderBy("position").collect()
    assert [(r.scenario, r.position, r.name, r.mass_kg, r.producible_locally) for r in got] == [("a", 0, "x", 2.0, True), ("a", 1, "y", 1.0, None)]
    (tmp_path / "b.json").write_text('{"name": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        scenarios(spark, str(tmp_path / "b.json")).collect()


def test_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "run long, share double")
    write_results(rows, str(tmp_path / "r"), "test")
    back = spark.read.json(str(tmp_path / "r"))
    assert sorted((r.data.run, r.data.share, r.generator) for r in back.collect()) == [(1, 0.5, "test"), (2, 1.5, "test")]
    assert [r.run for r in unfinished(spark.createDataFrame([(1,), (3,)], "run long"), rows, "run").collect()] == [3]
