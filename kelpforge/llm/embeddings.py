"""Near copies among embeddings, by randomly rotated binary codes with correction factors.

A unit vector is padded, rotated and kept as the signs of its coordinates, together with its inner product with that code. From the
code, the inner product with any other vector is estimated without bias, within a bound that holds with high confidence; only
pairs whose bound reaches the threshold are computed exactly. Vectors meet where some band of their codes' bits agrees.
Crowded buckets are cut into blocks, and every two blocks meet, so that no task holds more than two blocks of a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import lean, written
from kelpforge.llm.components import Forest, connected_components


@dataclass(frozen=True)
class Search:
    """threshold: least cosine. bits: of a code, at least as many as a vector has components. recall: of pairs at the threshold, by which the
    number of bands is chosen; pairs above it are found more often. bound: how many standard errors the bound takes. block: rows of a block."""

    threshold: float = 0.95
    bits: int = 256
    recall: float = 0.97
    bound: float = 4.0
    block: int = 512
    seed: int = 11


@lru_cache(64)
def rotation(dim: int, bits: int, seed: int) -> np.ndarray:
    """bits x dim with orthonormal columns: padding with zeros and a random rotation in one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))
    return np.ascontiguousarray((q * np.sign(np.diag(r)))[:, :dim])


def band_shape(n: int, how: Search) -> tuple[int, int]:
    """(bits of a band, bands): bands so wide that unlike vectors rarely meet, and so many that like ones do."""
    width = min(48, max(8, math.ceil(math.log2(max(2, n))) + 2))
    agree = (1 - math.acos(how.threshold) / math.pi) ** width
    return width, math.ceil(math.log(1 - how.recall) / math.log(1 - agree))


@lru_cache(4)
def _bands(bits: int, width: int, bands: int, seed: int) -> list[tuple[int, np.ndarray]]:
    """For each rotation that the bands need (its number, from 0), bits x bands: powers of two at the bits that a band takes. No two bands share a bit: where the bits of the code do
    not last, those of further rotations follow, so bands are as independent as they are few or many."""
    rng = np.random.default_rng(seed + 1)
    turns = -(-width * bands // bits)
    order = np.concatenate([t * bits + rng.permutation(bits) for t in range(turns)])[: width * bands].reshape(bands, width)
    out = []
    for t in range(turns):
        w = np.zeros((bits, bands))
        band, place = np.nonzero((order >= t * bits) & (order < (t + 1) * bits))
        w[order[band, place] - t * bits, band] = 2.0**place
        out.append((t, w))
    return out


def band_keys(u: np.ndarray, how: Search, width: int, bands: int) -> np.ndarray:
    """Of unit vectors, a number for each band: the bits that it takes, of signs after rotations."""
    keys = np.zeros((len(u), bands))
    for t, w in _bands(how.bits, width, bands, how.seed):
        keys += ((u @ rotation(u.shape[1], how.bits, how.seed + 1000 * t).T) > 0) @ w  # below 2^48, so sums are exact
    return keys.astype(np.int64)


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def encoded(u: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs, and the factors: inner products of vectors with their codes, which are of length 1."""
    r = u @ rotation(u.shape[1], how.bits, how.seed).T
    return np.packbits(r > 0, axis=1), np.abs(r).sum(axis=1) / math.sqrt(how.bits)


def estimate(codes: np.ndarray, factors: np.ndarray, queries: np.ndarray, how: Search) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of coded vectors (rows) with queries (columns), and the bound on each row's error."""
    signs = (2.0 * np.unpackbits(codes, axis=1).astype(np.float32) - 1) / np.float32(math.sqrt(how.bits))
    got = signs @ (queries @ rotation(queries.shape[1], how.bits, how.seed).T).astype(np.float32).T
    error = np.sqrt(np.maximum(0, 1 - factors**2)) / factors * how.bound / math.sqrt(how.bits - 1)
    return got / factors[:, None].astype(np.float32), error


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """_id and _vec: the components as doubles, or null where the vector can have no links."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch["_v"]:
                x = None if not v.is_valid or v.values is None or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), "<f8")
                out.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else (x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(out, pa.binary())], names=["_id", "_vec"])

    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v")).mapInArrow(lean(prepare), "_id long, _vec binary")


def _coded(classes: DataFrame, how: Search, width: int, bands: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim in sorted({len(v.as_py()) for v in batch["_vec"]}):
                part = batch.filter(pa.array([len(v.as_py()) == dim for v in batch["_vec"]]))
                u = unit(part["_vec"].to_pylist())
                codes, factors = encoded(u, how)
                keys = band_keys(u, how, width, bands)
                yield pa.RecordBatch.from_arrays([*part.select(["_rep", "_w", "_vec"]).columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factors), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["_rep", "_w", "_vec", "_code", "_factor", "_keys"])

    return classes.select("_rep", "_w", "_vec").mapInArrow(lean(code), "_rep long, _w long, _vec binary, _code binary, _factor double, _keys array<long>")


class _Linker:
    """Compares the rows of one bucket (or of two of its blocks) and gathers links."""

    def __init__(self, how: Search, width: int, bands: int):
        self.how, self.width, self.bands = how, width, bands
        self.counts: dict[int, int] = {}
        self.forest, self.edges = Forest(), []

    def run(self, band: int, split: bool, rows: pa.RecordBatch) -> None:
        raw = rows["_vec"].to_pylist()
        if len({len(r) for r in raw}) > 1:  # vectors of different lengths do not link
            for n in {len(r) for r in raw}:
                self.run(band, split, rows.filter(pa.array([len(r) == n for r in raw])))
            return
        rep, w, side = (rows[c].to_numpy() for c in ("_rep", "_w", "_side"))
        codes = np.frombuffer(b"".join(rows["_code"].to_pylist()), np.uint8).reshape(len(rep), -1)
        u, factor = unit(raw), rows["_factor"].to_numpy()
        step = self.how.block
        keys = band_keys(u, self.how, self.width, self.bands)
        for i in range(0, len(rep), step):
            for j in range(i, len(rep), step):
                a, b = slice(i, i + step), slice(j, j + step)
                guess, error = estimate(codes[a], factor[a], u[b], self.how)
                maybe = guess + error[:, None] >= self.how.threshold
                if split:  # rows of the same block meet elsewhere
                    maybe &= side[a][:, None] != side[b][None, :]
                if i == j:
                    maybe = np.triu(maybe, 1)
                x, y = np.nonzero(maybe)
                if len(x) * 4 > maybe.size:
                    exact = (u[a] @ u[b].T)[x, y]
                else:
                    exact = np.einsum("ij,ij->i", u[a][x], u[b][y])
                hit = exact >= self.how.threshold
                self._links(band, rep, w, keys, x[hit] + i, y[hit] + j)

    def _links(self, band: int, rep: np.ndarray, w: np.ndarray, keys: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        for at in range(0, len(x), 1 << 16):
            p, q = x[at : at + (1 << 16)], y[at : at + (1 << 16)]
            first = (keys[p] == keys[q]).argmax(axis=1) == band  # a pair counts in the first band where it meets
            p, q = p[first], q[first]
            for one, other in ((p, q), (q, p)):
                total = np.bincount(one, weights=w[other], minlength=0)
                for k in np.flatnonzero(total).tolist():
                    r = int(rep[k])
                    self.counts[r] = self.counts.get(r, 0) + int(total[k])
            for r, s in zip(rep[p].tolist(), rep[q].tolist(), strict=True):
                if self.forest.join(r, s):
                    self.edges.append((r, s))

    def taken(self) -> pa.RecordBatch:
        """Counts (_b null) and edges (_n null) so far."""
        a = [*self.counts, *(r for r, _ in self.edges)]
        b = [None] * len(self.counts) + [s for _, s in self.edges]
        n = [*self.counts.values()] + [None] * len(self.edges)
        self.counts, self.edges = {}, []
        if len(self.forest.up) > 500_000:
            self.forest = Forest()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["_a", "_b", "_n"])


def _compared(met: DataFrame, how: Search, width: int, bands: int) -> DataFrame:
    """_a, _b of links that keep components together, and _a, _n: links that a vector has. met: sorted by _band, _key, _lo, _hi."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held = _Linker(how, width, bands), None
        for batch in batches:
            batch = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            x = np.stack([batch[c].to_numpy() for c in ("_band", "_key", "_lo", "_hi")])
            cut = np.flatnonzero((x[:, 1:] != x[:, :-1]).any(axis=0)) + 1
            starts = [0, *cut.tolist()]
            for i, j in zip(starts, starts[1:], strict=False):
                if j - i > 1:
                    linker.run(int(x[0, i]), x[2, i] != x[3, i], batch.slice(i, j - i))
            held = batch.slice(starts[-1])
            yield linker.taken()
        if held is not None and held.num_rows > 1:
            linker.run(held["_band"][0].as_py(), held["_lo"][0] != held["_hi"][0], held)
            yield linker.taken()

    return met.mapInArrow(lean(compare), "_a long, _b long, _n long")


def near_copies(vectors: DataFrame, how: Search = Search(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept of every vector.

    Vectors that are null, empty, zero, or hold a null or a number that is not finite have no links; nor do vectors of different lengths.
    Equal vectors are one class and are linked with each other. Rows that repeat an id count as vectors of their own but are one node. An
    empty table gives no rows. Other columns are ignored. A vector whose id is null is no node: it has no links, and its component_id and kept are null. Of pairs at the threshold,
    about how.recall are found, of closer ones more, however large the table is: see tests/llm/test_recall.py.
    """
    prepared = written(_prepared(vectors, id_col, vector_col).withColumn("_class", F.md5("_vec")), "vectors")
    classes = written(prepared.where("_class is not null and _id is not null").groupBy("_class").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_w"), F.first("_vec").alias("_vec")), "classes")
    width, bands = band_shape(classes.count(), how)
    codes = written(_coded(classes, how, width, bands), "codes")
    narrow = codes.select("_rep", F.posexplode("_keys").alias("_band", "_key"))
    buckets = narrow.groupBy("_band", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.expr(f"(_n + {how.block} - 1) div {how.block}")
    met = narrow.join(buckets, ["_band", "_key"]).withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("_rep", "_band"), "_blocks"))
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    met = met.select("_rep", "_band", "_key", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"))
    met = met.join(codes.drop("_keys"), "_rep")
    place = ["_band", "_key", "_lo", "_hi"]
    links = written(_compared(met.repartition(*place).sortWithinPartitions(*place), how, width, bands), "links")
    counts = links.where("_n is not null").groupBy(F.col("_a").alias("_rep")).agg(F.sum("_n").alias("_links"))
    ids = prepared.where("_class is not null and _id is not null").select("_id", "_class").distinct()
    several = ids.groupBy("_id").count().where("count > 1").select("_id")  # ids of different vectors, which they join
    joined = ids.join(several, "_id").join(classes.select("_class", "_rep"), "_class").select(F.col("_rep").alias("_a"), F.col("_id").alias("_b"))
    roots = connected_components(links.where("_b is not null").select("_a", "_b").unionByName(joined))
    named = classes.select("_class", "_rep", "_w").join(counts, "_rep", "left").join(roots, F.col("_rep") == F.col("_node"), "left")
    named = named.select("_class", (F.coalesce("_links", F.lit(0)) + F.col("_w") - 1).alias("_n_links"), F.coalesce("_root", "_rep").alias("_component"))
    out = prepared.select("_id", "_class").join(named, "_class", "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.when(F.col("_id").isNull(), 0).otherwise(F.coalesce("_n_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("_id")).alias("kept"))


def op3_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
