"""Vectors as short codes: integers cut into parts, each part named by the nearest entry of its codebook.

All arithmetic is exact. Dot products of integers are broken into limbs so small that float64 products of matrices stay below 2^53;
they are put together again in 64-bit integers, or in Python's where these would not hold them.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import lean, unused, written

ROWS_AT_ONCE = 8192
#: Sums leave a task in limbs of so many bits, so that Spark adds them without overflow.
SUM_BITS = 40
#: Distinct labels up to which their totals (a label and a number) are broadcast; beyond it, labels of more than a 10,000th of all rows are.
FEW_LABELS = 10_000


@dataclass(frozen=True)
class Coding:
    """scale: a power of two by which components are multiplied before they are rounded down. parts: of a vector. entries: of a part's codebook. rounds: in which entries move."""

    scale: float = 4096.0
    parts: int = 8
    entries: int = 16
    rounds: int = 6


def most(x: np.ndarray) -> int:
    """The largest magnitude."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays of magnitude below 2^bits, lowest first, with x = sum of limb k times 2^(bits k); all but the last are not negative."""
    out = []
    while most(x) >= 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of integers (64-bit, or Python's in object arrays), exactly: 64-bit where every result surely fits, else an object array."""
    inner = max(1, a.shape[1])
    bits = (53 - (inner - 1).bit_length()) // 2  # inner products of limbs, each below 2^(2 bits), add up to less than 2^53
    fits = inner * most(a) * most(b) < 1 << 62
    total: np.ndarray | int = 0
    for i, p in enumerate(limbs(a, bits)):
        for j, q in enumerate(limbs(b, bits)):
            product = (p @ q).astype(np.int64)
            total = total + ((product if fits else product.astype(object)) << (bits * (i + j)))
    return total


def squares(x: np.ndarray) -> np.ndarray:
    """Squared lengths of rows; an object array if 64 bits might not hold them."""
    wide = max(1, x.shape[1]) * most(x) ** 2 >= 1 << 62
    x = x.astype(object) if wide else x
    return (x * x).sum(axis=1)


def nearest_entries(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry (the first of those that tie) and the squared distance."""
    wide = max(1, x.shape[1]) * (most(x) + most(codebook)) ** 2 >= 1 << 62
    x, codebook = (x.astype(object), codebook.astype(object)) if wide else (x, codebook)
    d = squares(x)[:, None] - 2 * exact_dot(x, codebook.T) + squares(codebook)[None, :]
    first = d.argmin(axis=1)
    return first, d[np.arange(len(d)), first]


def entry_sums(x: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of each entry, and how many they are."""
    chosen = (code[None, :] == np.arange(entries)[:, None]).astype(np.int64)
    return exact_dot(chosen, x), chosen.sum(axis=1)


def whole_numbers(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale x), 64-bit, or Python's integers if one of them is too large for that."""
    with np.errstate(over="ignore"):
        y = np.floor(flat * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    return np.array([math.floor(Fraction(v) * Fraction(scale)) for v in flat.tolist()], object)


def _integers(vectors: pa.Array, dim: int, how: Coding) -> tuple[np.ndarray, np.ndarray]:
    """A row of integers for each vector of dim components, and which vectors these are."""
    there = pc.equal(pc.fill_null(pc.list_value_length(vectors), -1), dim).to_numpy(zero_copy_only=False)
    flat = vectors.filter(pa.array(there)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole_numbers(flat, how.scale).reshape(-1, dim), there


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield batch.slice(at, ROWS_AT_ONCE)


def split_sum(v: int) -> list[int]:
    """Limbs of SUM_BITS bits, lowest first, the last one signed."""
    out = []
    while not -(1 << SUM_BITS) <= v < 1 << SUM_BITS:
        out.append(v & ((1 << SUM_BITS) - 1))
        v >>= SUM_BITS
    return [*out, v]


def _sums(vectors: DataFrame, books: np.ndarray, how: Coding) -> DataFrame:
    """_part, _entry, _at, _limb, _v: limbs of sums over the rows that a task has assigned; at -1, how many they are."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for rows in _slices(batch):
                x, _ = _integers(rows["_v"], parts * width, how)
                for p in range(parts if len(x) else 0):
                    own = x[:, p * width : (p + 1) * width]
                    s, n = entry_sums(own, nearest_entries(own, books[p])[0], entries)
                    sums[p] += s.astype(object)
                    counts[p] += n
        out = [(p, e, -1, 0, int(counts[p, e])) for p in range(parts) for e in range(entries) if counts[p, e]]
        out += [(p, e, i, k, v) for p, e, *_ in list(out) for i in range(width) for k, v in enumerate(split_sum(int(sums[p, e, i])))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["_part", "_entry", "_at", "_limb", "_v"])

    rows = vectors.select("_v").mapInArrow(lean(add), "_part int, _entry int, _at int, _limb int, _v long")
    return rows.groupBy("_part", "_entry", "_at", "_limb").agg(F.sum(F.col("_v").cast("decimal(20,0)")).alias("_v"))


def _moved(books: np.ndarray, found: list) -> np.ndarray:
    """Codebooks whose entries are the means (rounded down) of the parts that chose them; unused ones stay."""
    sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
    for r in found:
        if r["_at"] < 0:
            counts[r["_part"], r["_entry"]] = int(r["_v"])
        else:
            sums[r["_part"], r["_entry"], r["_at"]] += int(r["_v"]) << (SUM_BITS * r["_limb"])
    out = books.astype(object)
    for p, e in zip(*np.nonzero(counts), strict=True):
        out[p, e] = [s // counts[p, e] for s in sums[p, e]]
    return narrowed(out)


def narrowed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if most(x) < 1 << 62 else x


def _kept(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    sound = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(sound).withColumnsRenamed({id_col: "_id", vector_col: "_v"})


def fit_codebooks(vectors: DataFrame, how: Coding = Coding(), id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray | None:
    """parts x entries x components integers, fitted on all vectors that are sound; None where there is none.

    A round is one pass over the vectors: tasks assign and add up, Spark adds the tasks' sums, and the driver gets parts x entries x components of them.
    """
    return _fit(_kept(vectors.select(id_col, vector_col), id_col, vector_col), how)


def _fit(sound: DataFrame, how: Coding) -> np.ndarray | None:
    first = sound.where(F.size("_v") > 0).select("_id", "_v").orderBy(F.col("_id").asc_nulls_last(), "_v").limit(how.entries).collect()
    dim = len(first[0]["_v"]) if first else 0
    if dim % how.parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {how.parts} equal parts")
    first = [r["_v"] for r in first if len(r["_v"]) == dim]
    if not first:
        return None
    start = whole_numbers(np.array(first, np.float64).ravel(), how.scale).reshape(len(first), how.parts, dim // how.parts)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    for _ in range(how.rounds):
        books = _moved(books, _sums(sound, books, how).collect())
    return books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components, as decimal numbers between commas, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, books: np.ndarray, how: Coding = Coding(), id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns in keep, code (two hex digits for each part) and error (squared distance of the vector to what its code stands for)."""
    kept = vectors.select(id_col, vector_col, *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)])
    out = _encoded(_kept(kept, id_col, vector_col), books, how, [f"_keep{i}" for i in range(len(keep))])
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], F.col("_code").alias("code"), F.col("_error").alias("error"))


def _encoded(sound: DataFrame, books: np.ndarray, how: Coding, keep: list[str]) -> DataFrame:
    parts, _, width = books.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                x, there = _integers(rows["_v"], parts * width, how)
                codes, apart = np.zeros((len(x), parts), np.uint8), []
                for p in range(parts if len(x) else 0):
                    codes[:, p], d = nearest_entries(x[:, p * width : (p + 1) * width], books[p])
                    apart.append(d)
                wide = any(most(d) * parts >= 1 << 62 for d in apart)
                error = sum(d.astype(object) if wide else d for d in apart).tolist() if apart else []
                code, errors = [None] * len(rows), [None] * len(rows)
                for at, c, e in zip(np.flatnonzero(there).tolist(), codes, error, strict=True):
                    code[at], errors[at] = c.tobytes().hex(), e if e < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in ("_id", *keep)], pa.array(code, pa.string()), pa.array(errors, pa.int64())], names=["_id", *keep, "_code", "_error"])

    kinds = dict(sound.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in ("_id", *keep)] + ["_code string", "_error long"])
    return sound.select("_id", *keep, "_v").mapInArrow(lean(encode), schema)


def _with_totals(rows: DataFrame, label: str) -> DataFrame:
    """rows with _total: of _error, over rows of the same label, nulls together; null where one of them has passed 64 bits. Few labels are broadcast; of many, those that a 10,000th of all rows have (10,000 at most)."""
    marks = [F.isnull(label).alias("_none"), F.coalesce(F.col(label), _zero(rows, label)).alias("_label")]
    marked = rows.select("*", *marks)
    passed = F.col("_code").isNotNull() & F.col("_error").isNull()
    totals = written(marked.groupBy("_none", "_label").agg(F.when(~F.bool_or(passed), F.coalesce(F.sum(F.col("_error").cast("decimal(20,0)")), F.lit(0))).alias("_total"), F.count(F.lit(1)).alias("_n")), "labels")
    size = totals.agg(F.count(F.lit(1)), F.sum("_n")).first()
    on = ["_none", "_label"]
    if size[0] <= FEW_LABELS:
        return marked.join(F.broadcast(totals.drop("_n")), on)
    limit = size[1] // FEW_LABELS
    found = marked.join(F.broadcast(totals.where(F.col("_n") > limit).select(*on, F.col("_total").alias("_hot"), F.lit(True).alias("_is_hot"))), on, "left")
    hot = found.where("_is_hot").withColumn("_total", F.col("_hot"))
    rest = found.where("_is_hot is null").join(totals.where(F.col("_n") <= limit).drop("_n"), on)
    return hot.select(*rows.columns, "_total").unionByName(rest.select(*rows.columns, "_total"))


def _zero(rows: DataFrame, label: str) -> Column:
    """What stands beside the mark of a null label."""
    kind = dict(rows.dtypes)[label]
    return F.lit("").cast(kind) if kind == "string" else F.lit(0).cast(kind)


def compressed(vectors: DataFrame, how: Coding = Coding(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error (errors summed over rows of the same label, nulls together) and codebooks_sha256 of every sound vector.

    Vectors that are null, or hold a null or a number that is not finite, are dropped. The first vectors (smallest ids, null ids last, ties by components) start the
    codebooks; where there are fewer than entries, codebooks have as many. Rows that repeat an id, null ids and equal vectors count one by one. A vector whose length
    is not that of the first has null code and error. Components may be as large as doubles are; an error or a sum of errors that passes 64 bits is null. An
    empty table gives no rows. Vectors that cannot be cut into equal parts are an error. Other columns are ignored.
    """
    label = unused(vectors.select(id_col, vector_col), "_label_of")
    sound = _kept(vectors.select(id_col, vector_col, F.col(label_col).alias(label)), id_col, vector_col)
    books = _fit(sound, how)
    if books is None:
        books = np.zeros((how.parts, 1, 1), np.int64)
    rows = written(_encoded(sound, books, how, [label]), "codes")
    out = _with_totals(rows, label)
    return out.select(F.col("_id").alias(id_col), F.col("_code").alias("code"), F.col("_error").alias("error"), F.col("_total").try_cast("long").alias("label_error"), F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
