"""op10 where every split is entered: crowded shingles, families in many blocks, few sets at a time; held against comparing all pairs."""

import random

import pytest

from kelpforge.llm.jaccard import Join, jaccard_components


def plain(rows):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return sorted((rows[i][0], len(sets[i]), rows[root(i)][0]) for i in range(len(rows)))


@pytest.mark.parametrize("how", [Join(), Join(hot=7, crowd=3, block=1500, sets=5), Join(hot=2, crowd=1, block=100, sets=1), Join(hot=5, crowd=2, sketch_bits=4)])
def test_crowds(spark, how):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    texts = [None, "", "one two", "One two"]
    for g in range(12):
        base = common[:25] + [f"g{g}w{i}" for i in range(30)]
        for _ in range(20):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
            texts.append(" ".join(w))
    texts += [" ".join(common)] * 30 + [" ".join(common[: 40 - i]) for i in range(6)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in jaccard_components(d, how).select("doc_id", "n_shingles", "component_id").collect()) == plain(rows)
