"""How many pairs just above the threshold the embedding search finds: over a table, and by the bands' shape at larger sizes."""

import numpy as np
import pytest

from kelpforge.llm.embeddings import Search, band_keys, band_shape, near_copies


def planted(rng, n, low, high, dim=64):
    """n unit vectors, and for each another at a cosine between low and high."""
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    off = rng.normal(size=(n, dim))
    off -= (off * a).sum(axis=1)[:, None] * a
    off /= np.linalg.norm(off, axis=1)[:, None]
    cos = rng.uniform(low, high, n)[:, None]
    return a, cos * a + np.sqrt(1 - cos**2) * off


def test_planted_pairs(spark):
    n = 2000
    a, b = planted(np.random.default_rng(5), n, 0.9501, 0.96)
    rows = [(i, v) for i, v in enumerate(np.concatenate([a, b]).tolist())]
    found = near_copies(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = np.concatenate([a, b])
    cosines = x @ x.T
    np.fill_diagonal(cosines, 0)
    truth = (cosines >= 0.95).sum(axis=1)
    assert len(found) == 2 * n
    assert all(r["n_links"] <= truth[r["vec_id"]] for r in found)
    recall = sum(r["n_links"] for r in found) / truth.sum()
    print("recall of planted pairs:", recall)
    assert recall >= 0.9


@pytest.mark.parametrize("dim", [64, 256])
@pytest.mark.parametrize("size", [500, 5 * 10**4, 10**6, 10**8, 10**9, 10**10])
def test_bands_of_large_tables(size, dim):
    """Share of pairs at the threshold itself that meet in some band of the shape that so many vectors get."""
    how = Search()
    width, bands = band_shape(size, how)
    met = 0
    for seed in range(2):
        a, b = planted(np.random.default_rng(seed), 5000, how.threshold, how.threshold, dim)
        met += int((band_keys(a, how, width, bands) == band_keys(b, how, width, bands)).any(axis=1).sum())
    print(size, dim, "recall at the threshold:", met / 10000)
    assert met / 10000 >= 0.95


def test_null_ids_and_repeated_ones(spark):
    """A vector without an id has no links; rows that repeat an id are vectors of their own and one node."""
    v, w = [1.0, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, 0.5]
    rows = [(None, v), (None, v), (1, v), (2, v), (2, w), (3, w), (4, None)]
    d = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, _id string, component_id int")
    got = sorted(map(repr, (tuple(r) for r in near_copies(d).select("vec_id", "n_links", "component_id", "kept").collect())))
    assert got == sorted(map(repr, [(None, 0, None, None), (None, 0, None, None), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]))
