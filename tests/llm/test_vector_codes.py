"""op13 against a plain version in Python's integers: on the smallest tables, on awkward rows, and on numbers that 64 bits do not hold."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from kelpforge.llm.vector_codes import SUM_BITS, Coding, compressed, exact_dot, nearest_entries, split_sum

SMALL = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (id, label, vector)."""
    sound = [(i, lab, [math.floor(Fraction(c) * 4096) for c in v]) for i, lab, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not sound:
        return []
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(sound[0][2]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, _, v in sound]
    books = [[cut[e][p] for e in range(min(entries, len(sound)))] for p in range(parts)]

    def assign(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[assign(c[p], books[p])[0]].append(c[p])
            books[p] = [[sum(col) // len(own[e]) for col in zip(*own[e], strict=True)] if e in own else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], defaultdict(int)
    for (i, lab, _), c in zip(sound, cut, strict=True):
        found = [assign(c[p], books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for k, _ in found), sum(d for _, d in found)))
        by[lab] += out[-1][3]
    fit = lambda v: v if v < 1 << 63 else None
    return [(i, c, fit(e), fit(by[lab]), digest) for i, lab, c, e in out]


def found(df):
    return [tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


def test_small(spark):
    want = plain([(r["vec_id"], r["label"], r["embedding"]) for r in pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()])
    assert ordered(found(compressed(spark.read.parquet(f"{SMALL}/embeddings.parquet")))) == ordered(want)


ROWS = [
    *[(i, i % 3 or None, [((i * 37 + k * 11) % 23 - 11) / 7 for k in range(16)]) for i in range(40)],
    (40, 1, None), (41, 1, [None] * 16), (42, None, [float("nan")] * 16), (43, 2, [float("inf")] * 16), (44, 2, [0.0] * 16), (None, None, [1.0] * 16), (None, None, [1.0] * 16), (7, 5, [0.5] * 16), (7, 5, [0.25] * 16),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, _id string, _v int")


def test_awkward(spark):
    assert ordered(found(compressed(frame(spark, ROWS)))) == ordered(plain(ROWS))


def test_fewer_vectors_than_entries_and_ties(spark):
    rows = [(i, None, [float(i // 2)] * 8) for i in range(5)]
    assert ordered(found(compressed(frame(spark, rows)))) == ordered(plain(rows))


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30, 1e300])
def test_large_numbers(spark, scale):
    rows = [(i, i % 2, [((i * 5 + k * 3) % 11 - 5) * (scale if i % 7 == 0 else 1.0) for k in range(8)]) for i in range(30)]
    assert ordered(found(compressed(frame(spark, rows)))) == ordered(plain(rows))


def test_other_lengths_and_empty(spark):
    rows = [(0, 1, [1.0] * 8), (1, 1, [2.0] * 16), (2, 1, [])]
    got = {r[0]: r for r in found(compressed(frame(spark, rows)))}
    assert got[0][1:4] == ("00" * 8, 0, 0) and got[1][1:4] == got[2][1:4] == (None, None, 0)
    assert found(compressed(frame(spark, []))) == []
    assert found(compressed(frame(spark, [(1, 1, None)]))) == []
    with pytest.raises(ValueError, match="equal parts"):
        compressed(frame(spark, [(0, 1, [1.0] * 9)]))


def test_exact_arithmetic():
    rng = np.random.default_rng(3)
    for bits in (5, 26, 31, 45, 61):
        a, b = (rng.integers(-(1 << bits), 1 << bits, s) for s in ((7, 12), (12, 5)))
        want = a.astype(object) @ b.astype(object)
        assert (exact_dot(a, b) == want).all()
        code, d = nearest_entries(a, b.T)
        plain_d = [[sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) for q in b.T.tolist()] for p in a.tolist()]
        assert code.tolist() == [r.index(min(r)) for r in plain_d] and d.tolist() == [min(r) for r in plain_d]
    for v in (0, -1, 1 << 39, 1 << 40, -(1 << 40), -(1 << 40) - 1, -(3 << 100) + 17):
        assert sum(x << (SUM_BITS * k) for k, x in enumerate(split_sum(v))) == v


def test_many_labels(spark, monkeypatch):
    """More labels than are broadcast, one of which has a third of all rows."""
    monkeypatch.setattr("kelpforge.llm.vector_codes.FEW_LABELS", 5)
    rows = [(i, 1 if i % 3 == 0 else None if i % 3 == 1 else i, [float((i * 7 + k) % 13) for k in range(8)]) for i in range(90)]
    assert ordered(found(compressed(frame(spark, rows), Coding()))) == ordered(plain(rows))
