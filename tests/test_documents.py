"""Numbers that JSON does not have, there and back."""

import math

import pytest
from pyspark.sql import functions as F

from kelpforge.functions.documents import leaves, marked, number_at, text_at


def test_round_trip(spark):
    values = [0.0, -0.5, 1e300, 5e-324, 0.1, float("inf"), float("-inf"), float("nan"), None]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    doc = F.parse_json(F.concat(F.lit('{"a": [1, {"b": '), marked(F.col("v")), F.lit("}]}")))
    got = [r[0] for r in d.select("i", doc.alias("doc")).orderBy("i").select(number_at(F.col("doc"), "$.a[1].b")).collect()]
    assert all(g == v or g is not None and v is not None and math.isnan(g) and math.isnan(v) for g, v in zip(got, values, strict=True))


def test_other_values(spark):
    d = spark.createDataFrame([('{"a": "limited", "b": true, "c": "12"}',)], "j string").select(F.parse_json("j").alias("j"))
    r = d.select(number_at(F.col("j"), "$.a").alias("a"), text_at(F.col("j"), "$.a").alias("t"), number_at(F.col("j"), "$.x.y[3]").alias("x"), text_at(F.col("j"), "$.x").alias("n")).first()
    assert (r["a"], r["t"], r["x"], r["n"]) == (None, "limited", None, None)


def test_leaves(spark):
    docs = [(1, '{"a": {"b": [1, "__inf__", {"c": "__nan__"}]}, "d": "x", "e": null, "f": [], "g": {}}'), (2, "3.5"), (3, None), (4, "[[2]]")]
    d = spark.createDataFrame(docs, "i int, j string").select("i", F.parse_json("j").alias("doc"))
    got = {(r["i"], r["path"]): (r["text"], r["number"]) for r in leaves(d, "i", "doc", 4).collect()}
    assert math.isnan(got.pop((1, "$.a.b[2].c"))[1])
    null = got.pop((1, "$.e"), (None, None))
    assert null == (None, None)
    assert got == {(1, "$.a.b[0]"): ("1", 1.0), (1, "$.a.b[1]"): ("__inf__", math.inf), (1, "$.d"): ("x", None), (2, "$"): ("3.5", 3.5), (4, "$[0][0]"): ("2", 2.0)}
    with pytest.raises(Exception, match="nested too deep"):
        leaves(d, "i", "doc", 1).collect()
