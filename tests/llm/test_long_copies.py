"""Near copies of very long documents, whose signatures are full, against brute force."""

import pytest

from kelpforge.llm.jaccard import _may_link, jaccard_components


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_long_near_copies(spark, ansi):
    words = [f"w{i}" for i in range(20_000)]
    texts = [words, words[:-40] + [f"x{i}" for i in range(40)], words[:-6000] + [f"y{i}" for i in range(6000)], [f"z{i}" for i in range(20_000)], [f"z{i}" for i in range(200, 20_200)]]
    sets = [shingles(t) for t in texts]
    near = {(i, j) for i in range(5) for j in range(i) if 100 * (k := len(sets[i] & sets[j])) >= 75 * (len(sets[i]) + len(sets[j]) - k)}
    assert near == {(1, 0), (4, 3)}  # so the components below are brute force's
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert got == {i: (len(s), root) for i, (s, root) in enumerate(zip(sets, [0, 0, 2, 3, 3], strict=True))}


def test_filters_of_huge_sets_do_not_overflow(spark):
    rows = spark.createDataFrame([(30_000_000, 29_000_000, 5, 5)], "n int, n_b int, at int, at_b int")
    assert rows.where(_may_link("n", "n_b", "at", "at_b", 75)).count() == 1
