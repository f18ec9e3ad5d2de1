"""Co-training over all unlabelled rows: none is left out, and sums in tasks give what one machine gives."""

import numpy as np
import pytest

from kelpforge.llm import quality
from kelpforge.llm.quality import BINS, CoTraining, Pool, cut, logistic, minimised, unlabelled, _loss


def test_every_unlabelled_row_is_in_the_pool(spark):
    ids = [*range(9000), None, 5, 5]
    docs = spark.createDataFrame([(i, f"text {k}", "en", "s") for k, i in enumerate(ids)], "doc_id long, text string, lang string, source string")
    labelled = spark.createDataFrame([(i, 1.0) for i in range(1000, 1500)], "_label_id long, _y double")
    pool = Pool(unlabelled(quality._shown(docs, "doc_id"), labelled, CoTraining()))
    assert pool.total(lambda t, m, u: np.array([len(u), t.shape[1], 0.0]))[0] == len(ids) - 500


def test_pseudo_labels_come_from_all_rows(spark, monkeypatch):
    """Two kinds of pages, 9,000 unlabelled: in the first round each view labels a tenth of them all, not of a sample."""
    docs = spark.createDataFrame([(i, ("good clean prose " if i % 2 else "buy now $$$ !!! ") * (5 + i % 7), "en", "book" if i % 2 else "spam") for i in range(9200)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen = []
    real = Pool.total
    monkeypatch.setattr(Pool, "total", lambda self, f: seen.append(real(self, f)) or seen[-1])
    model = quality.fit(docs, labels, CoTraining(rounds=1, confident=0.6))
    assert seen[0][0] == 9000 and all(sizes.sum() > 3000 for sizes in seen[0][1:].reshape(4, BINS))
    assert {r["doc_id"] for r in quality.score(docs, model).where("keep").collect()} == set(range(1, 9200, 2))


@pytest.mark.parametrize("want", [0, 1, 7, 40, 99, 100, 500])
def test_cut_takes_as_many_as_wanted(want):
    sizes = np.bincount(np.random.default_rng(3).integers(0, 30, 100), minlength=BINS)
    at, share = cut(sizes, want)
    assert sizes[at + 1 :].sum() + (share * sizes[at] if at >= 0 else 0) == pytest.approx(min(want, 100))


def test_steps_with_far_rows_reach_newtons_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 20))
    y = (x @ rng.normal(size=20) + rng.normal(size=3000) > 0).astype(float)
    run = minimised(x[:200], y[:200], np.zeros(20), 1.0)
    w = next(run)
    with pytest.raises(StopIteration) as done:
        while True:
            w = run.send(_loss(x[200:], y[200:], w))
    assert np.abs(done.value.value - logistic(x, y, 1.0)).max() < 0.02


def test_quality_on_documents_that_were_never_used(spark):
    """Held-out accuracy and AUC at sf0.1: the labels of ids divisible by 4 are kept from fitting."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 4 != 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 4 = 0"), "doc_id").select("score", "text_score", "keep", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1].to_numpy(), rows.score[rows.quality == 0].to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    kept = rows.keep[rows.quality == 1].mean()
    print(f"held out: {len(rows)} documents, AUC {auc:.4f}, accuracy {(rows.keep == (rows.quality == 1)).mean():.4f}, good ones kept {kept:.4f}")
    assert auc > 0.97 and kept > 0.97 and (rows.keep == (rows.quality == 1)).mean() > 0.95
