"""Documents packed into sequences of one width, as a cutting-stock problem solved by column generation.

Documents longer than a sequence are cut into whole sequences and a rest. How often each length occurs is all that the linear program sees: a
column is a pattern of lengths that fill a sequence; a knapsack prices columns by the program's dual values. Patterns are rounded down,
what is left over is filled greedily, and pieces, ranked within their length, are dealt out to the patterns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.llm.common import lean, written
from kelpforge.llm.token_files import _encoder, _runs


#: Numbers of tasks and lengths (24 bytes each) that are broadcast; more are joined by a shuffle.
MOST_STARTS = 500_000


@dataclass(frozen=True)
class Packing:
    """width: tokens of a sequence; one whose tokens are a power of two is not padded. gap: of the linear program's cost over its bound, at which it ends. pivots: at most.
    waste, few: a pattern that pads by more than so many tokens, and is used at most so often, is rather filled by cutting pieces."""

    width: int = 1024
    gap: float = 0.001
    pivots: int = 1500
    waste: int = 4
    few: int = 64


def costs(width: int) -> np.ndarray:
    """What a sequence of so many tokens takes with its padding."""
    c = np.full(width + 1, float(width))
    c[0] = 0
    powers = [1 << k for k in range(width.bit_length()) if 1 << k <= width]
    c[powers] = powers
    return c


class Knapsack:
    """The most valuable patterns of every total, where a length is taken at most as often as it occurs; lengths are offered in bundles of 1, 2, 4, ..."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, width: int):
        self.width, self.bundles = width, []
        for i in np.argsort(-lengths).tolist():
            left, k = int(min(demand[i], width // lengths[i])), 1
            while left:
                k = min(k, left)
                self.bundles.append((i, k, k * int(lengths[i])))
                left -= k
                k *= 2

    def solve(self, duals: np.ndarray) -> np.ndarray:
        """best[c]: value of the best pattern of exactly c tokens; -inf where there is none."""
        best = np.full(self.width + 1, -np.inf)
        best[0] = 0
        self.taken = np.zeros((len(self.bundles), self.width + 1), bool)
        for s, (i, k, size) in enumerate(self.bundles):
            if duals[i] > 0:
                with_it = best[: self.width + 1 - size] + k * duals[i]
                np.greater(with_it, best[size:], out=self.taken[s, size:])
                np.maximum(best[size:], with_it, out=best[size:])
        return best

    def pattern(self, total: int) -> dict[int, int]:
        """Index of a length -> how often, of the pattern found for the total."""
        out: dict[int, int] = {}
        for s in range(len(self.bundles) - 1, -1, -1):
            if total and self.taken[s, total]:
                i, k, size = self.bundles[s]
                out[i] = out.get(i, 0) + k
                total -= size
        return out


def fill(lengths: list[int], left: list[int], room: int) -> list[int]:
    """Indexes of lengths, none more often than left says, that together come as near to the room as any do; large ones first. Sums are bits of whole numbers."""
    steps, reach = [], 1
    mask = (1 << (room + 1)) - 1
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        k, n = 1, min(left[i], room // lengths[i])
        while n:
            k = min(k, n)
            steps.append((i, k, reach))
            reach |= (reach << (k * lengths[i])) & mask
            n -= k
            k *= 2
    total, out = reach.bit_length() - 1, []
    for i, k, before in reversed(steps):
        if total >= k * lengths[i] and before >> (total - k * lengths[i]) & 1:
            out += [i] * k
            total -= k * lengths[i]
    return out


def first_patterns(lengths: np.ndarray, demand: np.ndarray, how: Packing) -> list[dict[int, int]]:
    """A pattern for each length, of lengths that are left when it is made: the largest of them, and what fills the room best. It is used until one length is used up; so no
    later pattern has that length, and together they are a basis."""
    left, sizes, basis = demand.copy(), lengths.tolist(), []
    open_ = list(range(len(sizes)))
    while open_:
        i = open_[-1]
        there = [max(1, int(left[j])) for j in open_]
        there[-1] -= 1
        some = [i, *(open_[j] for j in fill([sizes[j] for j in open_], there, how.width - sizes[i]))]
        p = {j: some.count(j) for j in sorted(set(some))}
        done = min(p, key=lambda j: left[j] / p[j])
        step = left[done] / p[done]
        for j, k in p.items():
            left[j] = max(0.0, left[j] - step * k)
        basis.append(p)
        open_.remove(done)
    return basis


def matrix_of(basis: list[dict[int, int]]) -> np.ndarray:
    matrix = np.zeros((len(basis), len(basis)))
    for j, p in enumerate(basis):
        matrix[list(p), j] = list(p.values())
    return matrix


def column_generation(lengths: np.ndarray, demand: np.ndarray, how: Packing) -> list[tuple[dict[int, int], float]]:
    """Patterns (index of a length -> how often) and how often each is used, in fractions, so that all lengths are covered at a cost within the gap of the least possible."""
    n, cost = len(lengths), costs(how.width)
    if not n:
        return []
    nudged = demand * (1 + 0.01 * np.random.default_rng(1).random(n))  # so that no two ratios tie and no step is empty; goes again at the end
    basis = first_patterns(lengths, nudged, how)
    inverse = np.linalg.inv(matrix_of(basis))
    x = np.maximum(inverse @ nudged, 0)
    price = np.array([cost[sum(k * int(lengths[i]) for i, k in p.items())] for p in basis])
    duals = price @ inverse
    sack, bound, pivots = Knapsack(lengths, demand, how.width), float(lengths @ nudged), 0
    totals = np.arange(1, how.width + 1)
    costs_so_far = [float(price @ x)]
    while pivots < how.pivots:
        best = sack.solve(duals)
        bound = max(bound, float(duals.clip(0) @ nudged) / max(1.0, float((best[1:] / cost[1:]).max())))
        if costs_so_far[-1] - bound <= how.gap * bound or len(costs_so_far) > 60 and costs_so_far[-60] - costs_so_far[-1] <= how.gap * bound / 10:
            break
        gain = best[1:] - cost[1:]
        wanted = totals[np.argsort(-gain)[:24]]
        pool = [(p, float(cost[c])) for c in wanted.tolist() if gain[c - 1] > 1e-9 and (p := sack.pattern(c))]
        moved = False
        while pool:
            worth = [sum(k * duals[i] for i, k in p.items()) - c for p, c in pool]
            at = int(np.argmax(worth))
            if worth[at] <= 1e-9:
                break
            p, c = pool.pop(at)
            column = inverse[:, list(p)] @ np.array(list(p.values()), float)
            positive = column > 1e-6
            if not positive.any():
                continue
            ratio = np.full(n, np.inf)
            ratio[positive] = x[positive] / column[positive]
            r = int(ratio.argmin())
            step = ratio[r]
            row = inverse[r] / column[r]
            x -= step * column
            x[r] = step
            np.maximum(x, 0, out=x)
            duals = duals - worth[at] * row
            touched = np.flatnonzero(np.abs(column) > 1e-14)
            inverse[touched] -= column[touched, None] * row[None, :]
            inverse[r] = row
            basis[r], price[r], moved = p, c, True
            pivots += 1
            if pivots % 200 == 0:  # rounding errors go
                inverse = np.linalg.inv(matrix_of(basis))
                x, duals = np.maximum(inverse @ nudged, 0), price @ inverse
        if not moved:
            break
        costs_so_far.append(float(price @ x))
    return list(zip(basis, (inverse @ demand).clip(0).tolist(), strict=True))


@dataclass
class Plan:
    """Where pieces go, by length and by rank within the length. A row of `rows` deals count ranks from first on to patterns that take `each` of them a sequence, from a
    sequence and an offset on. Ranks from `stream_first` on stand one behind the other in a stream of stream_total tokens, which is cut into whole sequences; the last ones begin at `stream_tail`."""

    rows: np.ndarray  # length, first, count, each, sequence, offset
    stream_first: np.ndarray
    stream_at: np.ndarray
    stream_total: int
    stream_tail: list[int]
    stream_sequence: int

    def dealt(self, pieces: DataFrame, width: int) -> DataFrame:
        """pieces (_length, _rank) with _from, length, sequence_id, offset: of every piece, or of what it is cut into. The plan, which is no larger than a few rows for each length, is broadcast."""
        spark = pieces.sparkSession
        rows = spark.createDataFrame(self.rows.tolist(), "_l long, _first long, _count long, _each long, _sequence long, _offset long")
        cut = [(k, int(f), int(self.stream_at[k])) for k, f in enumerate(self.stream_first.tolist()) if f < np.iinfo(np.int64).max]
        stream = spark.createDataFrame(cut, "_cut_length long, _cut_first long, _cut_at long")
        d = pieces.join(F.broadcast(rows), (F.col("_length") == F.col("_l")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count")), "left")
        d = d.join(F.broadcast(stream), F.col("_length") == F.col("_cut_length"), "left")
        kind = "_from: bigint, length: bigint, sequence_id: bigint, offset: bigint"
        k = F.col("_rank") - F.col("_first")
        whole = F.array(F.struct(F.lit(0).cast("long"), F.col("_length"), F.col("_sequence") + F.floor(k / F.col("_each")), F.col("_offset") + k % F.col("_each") * F.col("_length")))
        at, last = F.col("_at"), F.col("_at") + F.col("_length")
        full = self.stream_total // width
        tail = F.array(*map(F.lit, [*self.stream_tail, self.stream_total])).cast("array<bigint>")
        index = lambda p: F.when(p < full * width, F.floor(p / width)).otherwise(full + F.size(F.filter(tail, lambda t: t <= p)) - 1)
        begin = lambda i: F.when(i < full, i * width).otherwise(F.try_element_at(tail, (i - full + 1).cast("int")))

        def part(i: Column) -> Column:
            low = F.greatest(at, begin(i))
            return F.struct(low - at, F.least(last, begin(i + 1)) - low, F.lit(self.stream_sequence) + i, low - begin(i))

        parts = F.transform(F.sequence(index(at), index(last - 1)), part)
        d = d.withColumn("_at", F.col("_cut_at") + (F.col("_rank") - F.col("_cut_first")) * F.col("_length"))
        found = F.when(F.col("_first").isNotNull(), whole.cast(f"array<struct<{kind}>>")).otherwise(parts.cast(f"array<struct<{kind}>>"))
        return d.select(*pieces.columns, F.inline(found))


def plan(counts: dict[int, int], how: Packing = Packing()) -> Plan:
    """counts: length (1 to width) -> pieces."""
    width = how.width
    lengths = np.array(sorted(k for k, n in counts.items() if n and k < width), np.int64)
    demand = np.array([counts[k] for k in lengths.tolist()], np.int64)
    left, sizes = demand.tolist(), lengths.tolist()
    used: list[tuple[dict[int, int], int]] = []

    def use(p: dict[int, int], n: int) -> None:
        n = min(n, *(left[i] // k for i, k in p.items()))
        if n > 0:
            used.append((p, n))
            for i, k in p.items():
                left[i] -= k * n

    fits = lambda total: width - total <= how.waste or total & (total - 1) == 0
    found = column_generation(lengths, demand.astype(float), how)
    for p, x in sorted(found, key=lambda f: -f[1]):
        if fits(sum(k * sizes[i] for i, k in p.items())) or x > how.few:
            use(p, int(x + 1e-6))
    for p, _ in sorted(found, key=lambda f: -(f[1] % 1)):
        if fits(sum(k * sizes[i] for i, k in p.items())):
            use(p, 1)
    stream: dict[int, int] = {}
    for i in range(len(sizes) - 1, -1, -1):
        while left[i]:
            left[i] -= 1
            some = [i, *fill(sizes, left, width - sizes[i])]
            left[i] += 1
            total = sum(sizes[j] for j in some)
            p = {j: some.count(j) for j in set(some)}
            if fits(total):
                use(p, left[i])  # as often as it fits
            else:
                for j, k in p.items():
                    left[j] -= k
                    stream[j] = stream.get(j, 0) + k
    rows, next_rank, sequence = [], [0] * len(sizes), 0
    if counts.get(width):
        rows.append((width, 0, counts[width], 1, 0, 0))
        sequence = counts[width]
    for p, n in used:
        offset = 0
        for i in sorted(p, reverse=True):
            rows.append((sizes[i], next_rank[i], n * p[i], p[i], sequence, offset))
            next_rank[i] += n * p[i]
            offset += sizes[i] * p[i]
        sequence += n
    first, at, total = np.full(width + 1, np.iinfo(np.int64).max), np.zeros(width + 1, np.int64), 0
    for j in sorted(stream, reverse=True):
        first[sizes[j]], at[sizes[j]] = next_rank[j], total
        total += stream[j] * sizes[j]
    tail, here = [], total - total % width
    while here < total:  # the last ones are powers of two
        tail.append(here)
        here += 1 << ((total - here).bit_length() - 1)
    return Plan(np.array(sorted(rows), np.int64).reshape(-1, 6), first, at, total, tail, sequence)


def _pieces(docs: DataFrame, tokenizer: str, end_id: int | None, id_col: str, text_col: str, width: int, specials_as_text: bool) -> DataFrame:
    """_part, _k (number within the part and the length), _id, _begin, _length, _tokens (of the document), ids: documents in pieces of at most a sequence."""
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(width + 1, np.int64)
        for batch in batches:
            for run in _runs(batch):
                ids, counts = _encoder(tokenizer, specials_as_text).texts(pc.fill_null(run["_text"], ""), [] if end_id is None else [end_id])
                many = -(-counts // width)
                of = np.repeat(np.arange(len(counts)), many)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * width
                length = np.minimum(width, counts[of] - start)
                order = np.argsort(length, kind="stable")
                k = np.empty(len(of), np.int64)
                k[order] = np.arange(len(of)) - np.searchsorted(length[order], length[order])
                k += seen[length]
                seen += np.bincount(length, minlength=width + 1)
                ends = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(ids, "<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), part)), pa.array(k), run["_id"].take(pa.array(of)), pa.array(start), pa.array(length), pa.array(counts[of]), data], names=["_part", "_k", "_id", "_begin", "_length", "_tokens", "ids"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(lean(cut), f"_part long, _k long, _id {kind}, _begin long, _length long, _tokens long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 0, how: Packing = Packing(), id_col: str = "doc_id", text_col: str = "text", specials_as_text: bool = False) -> DataFrame:
    """id, start, length, ids (little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset: every piece, and where it stands in which sequence.

    tokenizer: a file of the tokenizers library, of the byte-level kind, at the same path on all machines. end_id ends each document. A document of at most a sequence stays
    whole, but for some that fill the last sequences: those that no pattern takes, the fewer for each sequence the larger the table is. Sequences are numbered from 0 without gaps. A null text is an empty one, of which end_id
    is all (without one it has no pieces); null ids and rows that repeat are documents of their own; an empty table gives no rows. Other columns are ignored.

    Pieces of a length are ranked by their place in the table: by task, and within a task. The driver gets one number for each length, width of them at most. Ids are written once, and
    are not shuffled unless there are more tasks and lengths than are broadcast.
    """
    pieces = written(_pieces(docs, tokenizer, end_id, id_col, text_col, how.width, specials_as_text), "pieces")
    per_part = written(pieces.groupBy("_part", "_length").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    found = per_part.groupBy("_length").agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_parts")).collect()  # a row per length
    made = plan({r["_length"]: r["_n"] for r in found}, how)
    earlier = Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("_part", "_length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if sum(r["_parts"] for r in found) <= MOST_STARTS:
        starts = F.broadcast(starts)
    d = pieces.join(starts, ["_part", "_length"]).withColumn("_rank", F.col("_before") + F.col("_k"))
    d = made.dealt(d, how.width)
    ids = F.when(F.col("length") == F.col("_length"), F.col("ids")).otherwise(F.expr("substring(ids, cast(4 * _from + 1 as int), cast(4 * length as int))"))
    return d.select(F.col("_id").alias(id_col), (F.col("_begin") + F.col("_from")).alias("start"), "length", ids.alias("ids"), F.col("_tokens").alias("doc_tokens"), "sequence_id", "offset")


def op12_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    d = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
    return d.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
