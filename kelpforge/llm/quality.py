"""Quality classification by co-training: a classifier on the text and one on the page's metadata teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import give_back, lean, written

TEXT_DIM = 1024
SOURCES, LANGS, LENGTHS = 64, 16, 32
META_DIM = SOURCES + LANGS + LENGTHS + 1
#: Log-odds of pseudo-labels are told apart in so many steps, up to the last.
BINS, LAST = 4096, 35.0
#: What a pass over the pool adds up for a view, before the gradient: log-loss, its curvature, rows.
SUMS = 3


@dataclass(frozen=True)
class CoTraining:
    """max_labelled: labelled documents that fitting uses at most, those of the smallest hashed ids; everything else covers all rows.
    confident: a pseudo-label's least probability. per_round: share of the pool that each classifier may label in a round."""

    max_labelled: int = 6000
    rounds: int = 4
    confident: float = 0.98
    per_round: float = 0.1
    held_out: float = 0.25
    keep_from: float = 0.5
    ridge: float = 1.0
    seed: int = 7


def text_counts(text: str) -> np.ndarray:
    """Hashed counts of byte trigrams of the whole text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(TEXT_DIM, np.int64)
    for i in range(0, max(0, len(raw) - 2), 1 << 16):  # a bounded piece at a time; neighbours overlap by two bytes
        b = raw[i : i + (1 << 16) + 2].astype(np.uint32)
        h = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(22)
        counts += np.bincount(h.view(np.int32), minlength=TEXT_DIM)
    return counts


_LOG = np.log1p(np.arange(256, dtype=np.float32))


def dampened(counts: np.ndarray) -> np.ndarray:
    """Rows of counts, dampened and of length 1, as 32-bit floats."""
    v = _LOG[counts] if counts.dtype == np.uint8 else np.log1p(counts, dtype=np.float32)
    return v / np.maximum(np.float32(1e-9), np.sqrt(np.einsum("ij,ij->i", v, v)))[:, None]


def meta_places(lang: str | None, source: str | None, n_chars: int | None) -> bytes:
    """What the page's metadata say, and nothing of its text: hashed source, hashed language, and the length that is recorded of it, by powers of two."""
    return bytes((zlib.crc32((source or "").encode()) % SOURCES, zlib.crc32((lang or "").encode()) % LANGS, min(LENGTHS - 1, max(0, n_chars or 0).bit_length())))


def meta_view(places: list[bytes]) -> np.ndarray:
    at = np.frombuffer(b"".join(places), np.uint8).reshape(-1, 3).astype(np.int64) + (0, SOURCES, SOURCES + LANGS)
    v = np.zeros((len(at), META_DIM), np.float32)
    np.put_along_axis(v, at, 1, axis=1)
    v[:, -1] = 1
    return v


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid((x @ w.astype(x.dtype)).astype(float))
        h = ((x * (p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ x).astype(float) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y).astype(x.dtype) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Weights of both views; platt: slope and offset that calibrate each view's log-odds; views: weights of the calibrated log-odds in their sum, and its offset."""

    text: np.ndarray
    meta: np.ndarray
    platt: np.ndarray
    views: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self.calibrated(text, meta)
        return sigmoid(z[0]), sigmoid(z[1]), sigmoid(self.views[:2] @ z + self.views[2])

    def calibrated(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return np.stack([text @ self.text, meta @ self.meta]) * self.platt[:, :1] + self.platt[:, 1:]


#: What sums over the pool take: both views of some rows, and a number in 0..1 of each that breaks ties.
Block = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


class Pool:
    """All unlabelled rows (_u, _t, _m), which stay in tasks: only sums of a fixed size come to the driver."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.many = rows.rdd.getNumPartitions() > 64

    def total(self, f: Block) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    some = batch.slice(at, 512)
                    found = f(*_decoded(some["_t"].to_pylist(), some["_m"].to_pylist()), some["_u"].to_numpy())
                    out = found if out is None else out + found
            if out is not None:
                yield pa.RecordBatch.from_pydict({"_s": pa.array([out.tobytes()], pa.binary())})

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                for x in batch["_s"]:
                    found = np.frombuffer(x.as_py())
                    out = found if out is None else out + found
            if out is not None:
                yield pa.RecordBatch.from_pydict({"_s": pa.array([out.tobytes()], pa.binary())})

        sums = self.rows.mapInArrow(lean(part), "_s binary")
        if self.many:  # sums of sums, so that what the driver gets does not grow with the input
            sums = sums.repartition(32).mapInArrow(lean(added), "_s binary")
        found = [np.frombuffer(r["_s"]) for r in sums.collect()]
        return np.sum(found, axis=0) if found else f(np.zeros((0, TEXT_DIM)), np.zeros((0, META_DIM)), np.zeros(0))


@dataclass
class Turn:
    """How the views label the pool in a round: their weights, and for each view and side (0, 1) the bin of the least sure and the share of that bin that counts."""

    weights: Sequence[np.ndarray]
    cuts: Sequence[Sequence[tuple[int, float]]]


def _bins(z: np.ndarray, confident: float) -> np.ndarray:
    """Bin of log-odds; -1 is not confident."""
    least = float(np.log(confident / (1 - confident)))
    return np.where(z >= least, np.clip((z - least) / (LAST - least) * BINS, 0, BINS - 1), -1).astype(np.int64)


def cut(sizes: np.ndarray, want: float) -> tuple[int, float]:
    """The bin down to which as many as wanted are taken, from the surest, and the share of that bin that still counts."""
    above = np.cumsum(sizes[::-1])[::-1]
    if above[0] <= want:
        return -1, 0.0
    at = int(np.flatnonzero(above > want)[-1])
    return at, float((want - (above[at] - sizes[at])) / sizes[at])


def pseudo_labels(turns: Sequence[Turn], views: Sequence[np.ndarray], u: np.ndarray, how: CoTraining) -> np.ndarray:
    """What each view has got from the other, the first label of each row; NaN is none."""
    got = np.full((2, len(u)), np.nan)
    for turn in turns:
        for view, x in enumerate(views):
            z, to = x @ turn.weights[view], got[1 - view]
            for side in (1, 0):
                at, share = turn.cuts[view][side]
                b = _bins(z if side else -z, how.confident)
                to[np.isnan(to) & ((b > at) | ((b == at) & (b >= 0) & (u < share)))] = side
    return got


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Log-loss, its curvature, rows, and the gradient, summed over the rows."""
    z = (x @ w.astype(x.dtype)).astype(float)
    p = sigmoid(z)
    return np.concatenate([[np.sum(np.logaddexp(0, z) - y * z), np.sum(p * (1 - p)), len(y)], x.T @ (p - y).astype(x.dtype)])


def minimised(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float, enough: float = 2e-6) -> Generator[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression over rows at hand and others that are far: yields weights and is sent the others' _loss at them.

    Limited-memory quasi-Newton steps from the Hessian of the rows at hand, until about so much of the mean loss is left to gain.
    """

    def whole(w: np.ndarray, far: np.ndarray) -> tuple[float, np.ndarray]:
        all_ = _loss(x, y, w) + far
        return float(all_[0] + ridge / 2 * w @ w), all_[SUMS:] + ridge * w

    far = yield w
    value, g = whole(w, far)
    p = sigmoid(x @ w)
    curved = p * (1 - p) + 1e-6
    inverse = np.linalg.inv(((x * (curved * (1 + far[1] / curved.sum()))[:, None].astype(x.dtype)).T @ x).astype(float) + ridge * np.eye(len(w)))
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(100):
        q, used = g.copy(), []
        for s, d in reversed(past):
            used.append(s @ q / (s @ d))
            q -= used[-1] * d
        q = inverse @ q
        for (s, d), a in zip(past, reversed(used), strict=True):
            q += (a - d @ q / (s @ d)) * s
        gain = g @ q
        if gain < 2 * enough * (len(y) + far[2]):
            break
        step = 1.0
        while True:
            far = yield w - step * q
            new, g_new = whole(w - step * q, far)
            if new <= value - 1e-4 * step * gain or step < 1e-6:
                break
            step = max(step / 10, min(step / 2, step * step * gain / (2 * (new - value + step * gain))))
        s, d = -step * q, g_new - g
        past = [*past, (s, d)][-20:] if s @ d > 0 else past
        w, value, g = w + s, new, g_new
    return w


def _fitted(runs: Sequence[Generator[np.ndarray, np.ndarray, np.ndarray]], far: Callable[[list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """Lets the fits take their steps together, so that both need one pass over the pool."""
    at, open_ = [next(r) for r in runs], set(range(len(runs)))
    while open_:
        found = far(at)
        for i in sorted(open_):
            try:
                at[i] = runs[i].send(found[i])
            except StopIteration as done:
                at[i] = done.value
                open_.discard(i)
    return at


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool | None, how: CoTraining) -> Model:
    """y: 0 or 1. Part of the labelled rows is held out of all training and calibrates the views. All rows of the pool may be labelled in every round."""
    rng = np.random.default_rng(how.seed)
    order = rng.permutation(len(y))
    n_held = int(len(y) * how.held_out)
    held, fit = order[:n_held], order[n_held:]
    own = (text, meta)
    weights = [logistic(x[fit], y[fit], how.ridge) for x in own]
    turns: list[Turn] = []
    share = y[fit].mean()
    for _ in range(how.rounds if pool else 0):

        def sure(t: np.ndarray, m: np.ndarray, u: np.ndarray, weights: list[np.ndarray] = weights) -> np.ndarray:
            z = (t @ weights[0], m @ weights[1])
            return np.concatenate([[len(u)], *(np.bincount(_bins(s * x, how.confident) + 1, minlength=BINS + 1)[1:] for x in z for s in (-1, 1))]).astype(float)

        found = pool.total(sure)
        if not found[0]:
            break
        sizes = found[1:].reshape(2, 2, BINS)
        want = [np.ceil(how.per_round * found[0] * part) for part in (1 - share, share)]  # as many of each class as the labels have
        turns.append(Turn(weights, [[cut(sizes[view, side], want[side]) for side in (0, 1)] for view in (0, 1)]))

        def far(at: list[np.ndarray]) -> list[np.ndarray]:
            def block(t: np.ndarray, m: np.ndarray, u: np.ndarray) -> np.ndarray:
                got = pseudo_labels(turns, (t, m), u, how)
                return np.concatenate([_loss(x[k], labels[k], w) for x, labels, w, k in zip((t, m), got, at, ~np.isnan(got), strict=True)])

            return np.split(pool.total(block), [SUMS + TEXT_DIM])

        weights = _fitted([minimised(x[fit], y[fit], w, how.ridge) for x, w in zip(own, weights, strict=True)], far)
    # one half of what is held out calibrates each view, the other weighs the views
    tune, weigh = held[: n_held // 2], held[n_held // 2 :]
    model = Model(*weights, np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([0.5, 0.5, 0.0]))
    if len(set(y[tune])) < 2 or len(set(y[weigh])) < 2:
        return model
    for view, (x, w) in enumerate(zip(own, weights, strict=True)):
        a, b = logistic(np.column_stack([x[tune] @ w, np.ones(len(tune))]), y[tune], 1e-3)
        if a > 0:
            model.platt[view] = a, b
        else:  # no help from this view: the share of good ones
            model.platt[view] = 0.0, np.log(y[tune].mean() / (1 - y[tune].mean()))
    z = np.column_stack([*model.calibrated(text[weigh], meta[weigh]), np.ones(len(weigh))])
    views = np.array([*logistic(z[:, :2], y[weigh], 1e-2), 0.0])
    if (views[:2] < 0).any():  # a view that speaks against itself is left out
        one = int(np.argmax(views[:2]))
        views = np.zeros(3)
        views[one] = 1.0
    model.views = views
    return model


def _packed(counts: np.ndarray) -> bytes:
    """In the least width that holds the largest."""
    return counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def _decoded(t: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if all(len(x) == TEXT_DIM for x in t):
        counts = np.frombuffer(b"".join(t), np.uint8).reshape(-1, TEXT_DIM)
    else:
        width = {TEXT_DIM: np.uint8, 2 * TEXT_DIM: np.uint16, 4 * TEXT_DIM: np.uint32}
        counts = np.stack([np.frombuffer(x, width[len(x)]).astype(np.uint32) for x in t])
    return dampened(counts), meta_view(m)


def _views(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
    """Both views of each row, packed: of _text, and of _lang, _source, _chars."""
    texts = [_packed(text_counts(t.as_py() or "")) for t in batch["_text"]]
    return texts, [meta_places(*x) for x in zip(*(batch[c].to_pylist() for c in ("_lang", "_source", "_chars")), strict=True)]


def _shown(docs: DataFrame, id_col: str) -> DataFrame:
    """_id and what the views see. A table without n_chars is one where it is null."""
    chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return docs.select(F.col(id_col).alias("_id"), F.col("text").alias("_text"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), chars.cast("long").alias("_chars"))


def _features(rows: DataFrame, carry: str) -> DataFrame:
    """carry and both views: _t the packed counts, _m the places."""

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                t, m = _views(part)
                yield pa.RecordBatch.from_arrays([part[carry], pa.array(t, pa.binary()), pa.array(m, pa.binary())], names=[carry, "_t", "_m"])

    return rows.select(carry, "_text", "_lang", "_source", "_chars").mapInArrow(lean(views), f"{carry} {dict(rows.dtypes)[carry]}, _t binary, _m binary")


def unlabelled(docs: DataFrame, labelled: DataFrame, how: CoTraining) -> DataFrame:
    """_u, _t, _m of every row of docs (as _shown) whose id has no label, a null id's too, as a table. Texts are read once and not shuffled, their views are."""
    rows = _features(docs, "_id").join(labelled, F.col("_id") == F.col("_label_id"), "left_anti")
    u = F.pmod(F.xxhash64(F.lit(how.seed), "_id", "_t", "_m"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return written(rows.select(u.alias("_u"), "_t", "_m"), "pool")


def fit(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining(), id_col: str = "doc_id") -> Model | None:
    """The model from labels (doc_id, quality 0 or 1), or None if they do not have both classes.

    At most max_labelled labelled documents come to the driver, as feature vectors, one row of each id; unlabelled ones all take part and stay
    in tasks. A document with labels of both classes counts for the one that most have; null labels and labels of other documents are passed over.
    """
    view = _shown(docs, id_col)
    labelled = labels.where("quality is not null").groupBy(F.col("doc_id").alias("_label_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("_y"))
    known = view.select("_id").distinct().join(labelled, F.col("_id") == F.col("_label_id")).select(F.col("_id").alias("_want"), "_y").orderBy(F.xxhash64(F.lit(how.seed), "_want"), "_want").limit(how.max_labelled)
    # bounded by the limit above
    rows = view.join(F.broadcast(known), F.col("_id") == F.col("_want")).groupBy("_want", "_y").agg(F.min(F.struct("_text", "_lang", "_source", "_chars")).alias("_r"))
    found = _features(rows.select("_want", "_y", "_r.*").withColumn("_k", F.struct("_want", "_y")), "_k").select("_k.*", "_t", "_m").toArrow()
    found = found.sort_by("_want")  # results do not depend on the order of arrival
    y = found["_y"].to_numpy()
    if len(set(y)) < 2:
        return None
    pool = Pool(unlabelled(view, labelled, how))
    views = _decoded(found["_t"].to_pylist(), found["_m"].to_pylist())
    del found
    model = co_train(*views, y, pool, how)
    del views
    give_back()  # the driver's process goes on with other stages
    return model


def score(docs: DataFrame, model: Model | None, how: CoTraining = CoTraining(), id_col: str = "doc_id") -> DataFrame:
    """id, text_score, meta_score, score (probabilities that quality is 1) and keep of every document.

    Without a model all are kept, with null scores. A null or empty text is scored by what else is known; null lang and source
    count as empty. Repeated rows get equal scores; an empty table gives no rows. Other columns of docs are ignored.
    """
    view = _shown(docs, id_col)
    if model is None:
        none = F.lit(None).cast("double")
        return view.select(F.col("_id").alias(id_col), none.alias("text_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("keep"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                t, m, s = model.scores(*_decoded(*_views(part)))
                yield pa.RecordBatch.from_arrays([part["_id"], *map(pa.array, (t, m, s, s >= how.keep_from))], names=[id_col, "text_score", "meta_score", "score", "keep"])

    kind = dict(docs.dtypes)[id_col]
    return view.mapInArrow(lean(scored), f"{id_col} {kind}, text_score double, meta_score double, score double, keep boolean")


def keep_good(docs: DataFrame, model: Model | None, how: CoTraining = CoTraining()) -> DataFrame:
    """The rows of docs that the model keeps, with their columns, in one pass."""
    if model is None:
        return docs
    place = {f"_{k}": docs.columns.index(c) for k, c in (("text", "text"), ("lang", "lang"), ("source", "source"))}
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = pa.nulls(part.num_rows, pa.int64()) if chars is None else part.column(chars)
                seen = pa.RecordBatch.from_arrays([*(part.column(p) for p in place.values()), n], names=[*place, "_chars"])
                s = model.scores(*_decoded(*_views(seen)))[2]
                yield part.filter(pa.array(s >= how.keep_from))

    return docs.mapInArrow(lean(kept), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
