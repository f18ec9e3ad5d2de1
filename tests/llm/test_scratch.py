"""Intermediate tables go at the end of their block."""

from pathlib import Path

import pytest

from kelpforge.llm.collocations import Mining, collocations
from kelpforge.llm.common import fresh_dir, scratch, shared_dir


def folders(spark):
    return {p.name for p in Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")).iterdir()}


def test_scratch(spark, tmp_path):
    docs = spark.createDataFrame([("en", "a b c. " * 40)], "lang string, text string")
    kept = fresh_dir(spark, "kept")
    docs.write.parquet(kept)
    before = folders(spark)
    with scratch(spark):
        found = collocations(docs, Mining(least=3))
        assert len(folders(spark)) > len(before)
        found.write.parquet(str(tmp_path / "out"))
    assert folders(spark) == before and spark.read.parquet(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError), scratch(spark):
        docs.write.parquet(fresh_dir(spark, "gone"))
        raise ValueError
    assert folders(spark) == before
