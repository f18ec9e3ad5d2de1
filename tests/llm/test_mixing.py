"""Quotas per shard against plain Sainte-Laguë, and the mixed texts against the plan."""

import re
from collections import Counter, defaultdict

import pytest

from kelpforge.llm.mixing import Mix, block_quotas, mix_documents, mix_sources, source_targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def seats(targets: dict, n: int) -> Counter:
    """The n highest quotients target / (2 j - 1); ties by source, null last."""
    order = sorted(((-t / (2 * j - 1), s is None, s or "", j, s) for s, t in targets.items() for j in range(1, n + 2)), key=lambda x: x[:4])
    return Counter(x[4] for x in order[:n])


@pytest.mark.parametrize("sizes", [{"a": 5000, "b": 5000, None: 777}, {"a": 90_000, "b": 300, "c": 301, "d": 40_000, "e": 7}, {"only": 4096}])
def test_quotas_are_sainte_lague(spark, sizes):
    mix = Mix(n_shards=5)
    targets = source_targets(spark.createDataFrame(list(sizes.items()), "_source string, _size long"), mix)
    known = {r["_source"]: r for r in targets.collect()}
    words = known[next(iter(sizes))]["_words"]
    all_seats = round(1.5 * sum(sizes.values()) / words)
    got = {(r["_source"], r["_shard"]): r["_quota"] for r in block_quotas(targets, mix).collect()}
    before = Counter()
    for k in range(5):
        upto = seats({s: r["_target"] for s, r in known.items()}, all_seats * (k + 1) // 5)
        upto = Counter({s: min(n, 2 * known[s]["_blocks"]) for s, n in upto.items()})
        assert {s: got[s, k] for s in sizes} == {s: upto[s] - before[s] for s in sizes}
        before = upto


def test_shards_take_their_quotas(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix_sources(docs).collect()
    assert all(sum(r["shard_words"]) == r["taken"] for r in rows)
    by_shard = [sum(r["shard_words"][k] for r in rows) for k in range(8)]
    # seats differ by one at most, and the last block of each of 20 sources may be short, in each round
    assert max(by_shard) - min(by_shard) <= (1 + 2 * 20) * rows[0]["block_words"]
    # the mixed texts are what the plan says, word for word, and whole but where a shard or the mix ends within a document
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got, cut = defaultdict(Counter), 0
    for r in mix_documents(docs, shard_col="shard").collect():
        assert r["text"] in texts[r["doc_id"]]
        got[r["doc_id"]][r["shard"]] += len(WORD.findall(r["text"]))
        cut += r["text"] != texts[r["doc_id"]]
    assert {i: dict(c) for i, c in got.items()} == {r["doc_id"]: {k: n for k, n in enumerate(r["shard_words"]) if n} for r in rows if r["taken"]}
    assert cut <= 2 * 20 * (8 + 1)  # two parts at each end of a shard, and where a source ends or begins anew


def test_clashing_names_repeats_and_nulls(spark):
    kinds = "doc_id long, text string, source string, _size string, _row int, _part int, _mark int, _words int, `a.b` int"
    texts = [(1, "one two three", "s"), (1, "one two three", "s"), (1, "four five", None), (None, "six seven eight", "t"), (2, None, "t"), (3, " ", "t")]
    docs = spark.createDataFrame([(*t, "z", 1, 2, 3, 4, 5) for t in texts], kinds)
    plan = mix_sources(docs).collect()
    got = mix_documents(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert sum(len(WORD.findall(r["text"])) for r in rows) == sum(r["taken"] for r in plan) > 0
    assert all((r["_size"], r["_row"], r["_part"], r["_mark"], r["_words"], r["a.b"]) == ("z", 1, 2, 3, 4, 5) for r in rows)
    assert mix_documents(docs.limit(0)).collect() == []
