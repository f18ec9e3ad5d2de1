"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, each pair verified once.

1. Texts become sets of shingles; equal sets become one class. How many texts hold a shingle is counted, over all texts, in a
   sketch of fixed size. Any order of shingles would give right results; this one puts rare shingles first.
2. Each class sends its prefix: of n shingles, the n - ceil(t n) + 1 rarest. Two sets of similarity t share one at least.
3. Classes that share a shingle meet. A run of them is not paired off at once: each is tested against the first of its run of
   fitting lengths, which links most near copies. Classes so linked need no more tests among each other; what is left are
   pairs across components, and those are all tested, so that components are exact: pair by pair where few classes share a shingle,
   and in blocks of families where many do, without a row for each pair.
4. A pair is verified by the whole texts of one document of each class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kelpforge.llm.common import give_back, lean, written
from kelpforge.llm.components import Forest, connected_components, forest_edges
from kelpforge.llm.shingles import class_of, mixed, shingle_sets

#: Places in the signature that the suffix filter compares.
BUCKETS = 64
#: The sketch is summed up in so many parts.
CHUNKS = 64
#: Nodes that a task remembers before it forgets which links it has passed on.
FOREST = 500_000


@dataclass(frozen=True)
class Join:
    """percent: 100 * intersection >= percent * union links two sets. sketch_bits: the sketch has 2 ** sketch_bits counters of four bytes,
    which every task gets. hot: classes that share a shingle, by the sketch, beyond which their run is split. crowd: classes that share a shingle, up to which
    they are paired off; beyond, they are compared in blocks of so many shingles each (block)."""

    percent: int = 75
    sketch_bits: int = 21
    hot: int = 20_000
    crowd: int = 64
    block: int = 400_000
    sets: int = 3000


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of at least this similarity shares with one of n."""
    return -(-percent * n // 100)


def _sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for at in range(0, batch.num_rows, 200):  # not all texts of a batch at once
        yield from shingle_sets(batch["_text"].slice(at, 200).cast(pa.binary()).to_pylist())


def _signature(s: np.ndarray) -> bytes:
    """How many shingles fall in each of the buckets, at 255 at most."""
    return np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes()


def described(docs: DataFrame, how: Join) -> tuple[DataFrame, np.ndarray]:
    """A table of _id, _class, _n, _signature of every document, and the sketch."""
    bits = how.sketch_bits

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        waiting: list[np.ndarray] = []
        seen: set[int] = set()

        def count() -> None:
            if waiting:
                at, n = np.unique(np.concatenate(waiting), return_counts=True)
                counts[at] += n.astype(np.uint32)
                waiting.clear()

        held = 0
        for batch in batches:
            ids, classes, sizes, signatures = batch["_id"], [], [], []
            for s in _sets(batch):
                c = class_of(s) if len(s) else None
                classes.append(c)
                sizes.append(len(s))
                signatures.append(_signature(s))
                if c is not None and c not in seen:  # copies count once per task
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen.add(c)
                    waiting.append((s >> np.uint64(64 - bits)).astype(np.uint32))
                    held += len(s)
                    if held > 1 << 18:
                        count()
                        held = 0
            nothing = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays([ids, pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(signatures, pa.binary()), nothing.cast(pa.int32()), nothing.cast(pa.binary())], names=NAMES)
        count()
        if seen:
            step = (1 << bits) // CHUNKS
            chunks = [c for c in range(CHUNKS) if counts[c * step : (c + 1) * step].any()]
            data = [zlib.compress(counts[c * step : (c + 1) * step].tobytes(), 1) for c in chunks]
            nothing = pa.nulls(len(chunks))
            yield pa.RecordBatch.from_arrays([nothing.cast(pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.int64()), nothing.cast(pa.binary()), pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], names=NAMES)

    NAMES = ["_id", "_class", "_n", "_signature", "_chunk", "_counts"]
    both = written(docs.mapInArrow(lean(describe), "_id long, _class long, _n long, _signature binary, _chunk int, _counts binary"), "sets")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # at most the whole sketch
        for batch in batches:
            for c, data in zip(batch["_chunk"].to_pylist(), batch["_counts"], strict=True):
                part = np.frombuffer(zlib.decompress(data.as_py()), np.uint32)
                sums[c] = sums[c] + part if c in sums else part
        yield pa.RecordBatch.from_pydict({"_chunk": pa.array(list(sums), pa.int32()), "_counts": pa.array([v.tobytes() for v in sums.values()], pa.binary())})

    total = both.where("_chunk is not null").select("_chunk", "_counts").repartition(CHUNKS, "_chunk").mapInArrow(lean(summed), "_chunk int, _counts binary")
    sketch = np.zeros(1 << bits, np.uint32)
    step = (1 << bits) // CHUNKS
    for c, data in total.toLocalIterator():  # a row per chunk, of a fixed size
        sketch[c * step : (c + 1) * step] = np.frombuffer(data, np.uint32)
    give_back()
    return both.where("_chunk is null").select("_id", "_class", "_n", "_signature"), sketch


def prefixes(docs: DataFrame, sketch: np.ndarray, how: Join) -> DataFrame:
    """_token, _salt (-1: the shingle's run is not split), _class, _n, _at (place in the class's order) of every class's prefix. A class may come from several tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 2 ** sketch_bits counters, however large the input is
    usual = 2 * int(sketch.mean())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, shift, seen = shared.value, np.uint64(64 - how.sketch_bits), set()
        for batch in batches:
            parts: list[tuple] = []
            held = 0
            for s in _sets(batch):
                if not len(s):
                    continue
                c = class_of(s)
                if c in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(c)
                n = len(s)
                k = n - least_overlap(n, how.percent) + 1
                often = counts[(s >> shift).astype(np.int64)]
                order = np.lexsort((s, often))[:k]  # ties by the hash: one order for all sets
                salts = np.maximum(often[order].astype(np.int64) - usual, 0) // how.hot + 1
                salt = (mixed(s[order] ^ np.uint64(c & (1 << 64) - 1)) >> np.uint64(1)).astype(np.int64) % salts
                parts.append((s[order].view(np.int64), np.where(salts > 1, salt, -1).astype(np.int32), np.full(k, c), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
                held += k
                if held > 1 << 18:
                    yield as_batch(parts)
                    parts, held = [], 0
            if parts:
                yield as_batch(parts)

    def as_batch(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["_token", "_salt", "_class", "_n", "_at"])

    return docs.mapInArrow(lean(send), "_token long, _salt int, _class long, _n int, _at int")


def runs(sent: DataFrame, how: Join) -> DataFrame:
    """What is left of the prefixes where two classes or more share a shingle, with the class that leads the run: _class_b, _n_b, _at_b.

    Each partition is sorted by shingle, size and place, and read as a stream; a leader holds for the sizes that fit its own. Of equal
    sizes the one with the fewest rarer shingles leads: it is likely to be the original of its copies.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cut_run = None, None
        for batch in batches:
            x = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("_token", "_salt", "_n", "_at", "_class")])
            x = x if held is None else np.concatenate([held, x], axis=1)
            # the last run may go on, so it waits for the next batch; a very long one is led in pieces
            change = np.flatnonzero((x[:2, 1:] != x[:2, :-1]).any(axis=0)) + 1
            cut = int(change[-1]) if len(change) else 0
            whole = x.shape[1] - cut <= 1 << 17
            cut = cut if whole else x.shape[1] - 1
            held = x[:, cut:]
            if cut:
                yield led(x[:, :cut], cut_run)
                cut_run = None if whole else tuple(held[:2, 0])
        if held is not None:
            yield led(held, cut_run)

    def led(x: np.ndarray, cut_run: tuple | None) -> pa.RecordBatch:
        same = np.zeros(x.shape[1], bool)
        same[1:] = (x[:, 1:] == x[:, :-1]).all(axis=0)
        x = x[:, ~same]  # a class that came from several tasks
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, x.shape[1]))
        shared = (length > 1) | (x[1, start] >= 0)  # of a split run, others may be elsewhere
        shared[0] |= cut_run == tuple(x[:2, 0])
        keep = np.repeat(shared, length)
        x, new = x[:, keep], new[keep]
        place = np.arange(x.shape[1])
        leader = np.maximum.accumulate(np.where(new, place, 0))
        while True:  # sizes rise within a run: where one no longer fits the leader, the next leader begins
            off = x[2][leader] * 100 < how.percent * x[2]
            if not off.any():
                break
            first = off.copy()
            first[1:] &= ~(off[:-1] & (leader[1:] == leader[:-1]))
            leader = np.where(off, np.maximum.accumulate(np.where(first, place, 0)), leader)
        b = x[:, leader]
        return pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[4]), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32)), pa.array(b[4]), pa.array(b[2].astype(np.int32)), pa.array(b[3].astype(np.int32))], names=["_token", "_class", "_n", "_at", "_class_b", "_n_b", "_at_b"])

    order = ["_token", "_salt", "_n", "_at", "_class"]
    return sent.repartition("_token", "_salt").sortWithinPartitions(*order).mapInArrow(lean(lead), "_token long, _class long, _n int, _at int, _class_b long, _n_b int, _at_b int")


def _may_link(n: str, n_b: str, at: str, at_b: str, percent: int) -> Column:
    """Length and positional filters for two sets that share a shingle at these places: what may lie before and behind it bounds the intersection."""
    fits = f"100L * least({n}, {n_b}) >= {percent}L * greatest({n}, {n_b})"
    most = f"least({at}, {at_b}) + 1 + least({n} - {at}, {n_b} - {at_b}) - 1"
    return F.expr(f"{fits} and {100 + percent}L * ({most}) >= {percent} * (cast({n} as bigint) + {n_b})")


def _pairs(candidates: DataFrame, percent: int) -> DataFrame:
    """Each pair once, with the first place where it meets: from there the positional filter is strict."""
    first = candidates.groupBy("_class", "_class_b").agg(F.min(F.struct("_at", "_at_b", "_n", "_n_b")).alias("_f"))
    first = first.select("_class", "_class_b", "_f.*")
    return first.where(f"{100 + percent}L * (1 + least(_n - _at, _n_b - _at_b) - 1) >= {percent} * (cast(_n as bigint) + _n_b)").select("_class", "_class_b", "_n", "_n_b")


@F.arrow_udf(LongType())
def _bound(a: pa.Array, b: pa.Array) -> pa.Array:
    """Suffix filter: the intersection is at most what both signatures have in each bucket; full buckets may hold any number, which the caller bounds by the sets' sizes."""
    x, y = (np.frombuffer(b"".join(s.to_pylist()), np.uint8).reshape(-1, BUCKETS) for s in (a, b))
    low = np.minimum(x, y).astype(np.int64)
    return pa.array(np.where((low == 255).any(axis=1), np.int64(2**62), low.sum(axis=1)))


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """Links _a, _b (documents that stand for their classes) among the pairs (_class, _class_b, _n, _n_b): suffix filter, then the whole texts. Enough links to connect all that is linked."""
    known = classes.select("_class", "_rep", "_signature")
    p = pairs.join(known, "_class").withColumnsRenamed({"_rep": "_a", "_signature": "_sa"})
    p = p.join(known.withColumnsRenamed({"_class": "_class_b", "_rep": "_b", "_signature": "_sb"}), "_class_b")
    most = F.least(_bound("_sa", "_sb"), F.col("_n").cast("long"), F.col("_n_b").cast("long"))  # no intersection is larger than the smaller set
    p = p.where((100 + how.percent) * most >= how.percent * (F.col("_n").cast("long") + F.col("_n_b")))
    p = p.select("_a", "_b", "_class", "_class_b")
    p = p.join(docs.select(F.col("_id").alias("_a"), F.col("_text").alias("_ta")), "_a")
    p = p.join(docs.select(F.col("_id").alias("_b"), F.col("_text").alias("_tb")), "_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()  # links that close a circle are not needed
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, keep = batch.slice(at, 500), []
                if len(forest.up) > FOREST:
                    forest = Forest()
                left, right = (shingle_sets([t.as_py().encode() for t in part[c]]) for c in ("_ta", "_tb"))
                named = (part[k].to_pylist() for k in ("_class", "_class_b", "_a", "_b"))
                for c, d, a, b, x, y in zip(*named, left, right, strict=True):
                    # a row that repeats an id may have another text
                    both = np.intersect1d(x, y, assume_unique=True).size if class_of(x) == c and class_of(y) == d else 0
                    keep.append(both > 0 and 100 * both >= how.percent * (len(x) + len(y) - both) and forest.join(a, b))
                yield part.select(["_a", "_b"]).filter(pa.array(keep, pa.bool_()))

    return p.mapInArrow(lean(verify), "_a long, _b long")


def undecided(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of shingles whose classes lie in different components, with _root, and for each shingle _size (its rows) and _lead (one of its classes). roots: _class, _root of all classes."""
    s = shared.select("_token", "_class", "_n", "_at").join(roots, "_class")
    mixed_ = s.groupBy("_token").agg(F.min("_root").alias("_lo"), F.max("_root").alias("_hi"), F.count(F.lit(1)).alias("_size"), F.min("_class").alias("_lead")).where("_lo != _hi")
    mixed_ = written(mixed_.select("_token", "_size", "_lead"), "mixed")  # a table, so that the join can split a shingle that many share
    return written(s.join(mixed_, "_token"), "undecided")


def across(s: DataFrame, how: Join) -> DataFrame:
    """All pairs of classes of different components that share a shingle with few others: a row gives rise to how.crowd pairs at most."""
    s = s.where(F.col("_size") <= how.crowd).select("_token", "_class", "_n", "_at", "_root")
    b = s.select("_token", *[F.col(c).alias(f"{c}_b") for c in ("_class", "_n", "_at", "_root")])
    ordered = F.expr("_root != _root_b and (_n_b < _n or (_n_b = _n and _class_b < _class))")
    return s.join(b, "_token").where(ordered & _may_link("_n", "_n_b", "_at", "_at_b", how.percent)).select("_class", "_class_b", "_n", "_n_b", "_at", "_at_b")


def within_families(s: DataFrame, classes: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """Links _a, _b between components among classes that share a shingle with many others.

    Classes that crowded shingles connect are one family. A family is dealt out into blocks, every two blocks meet once, and overlaps
    of all their sets are counted by matrix products; only links that join components leave the task.
    """
    crowded = s.where(F.col("_size") > how.crowd)
    family = connected_components(forest_edges(crowded.select(F.col("_class").alias("_a"), F.col("_lead").alias("_b")))).withColumnRenamed("_root", "_family")
    m = crowded.select("_class", "_n", "_root").distinct().join(family, F.col("_class") == F.col("_node")).drop("_node")
    m = written(m, "families")
    sizes = written(m.groupBy("_family").agg(F.expr(f"(sum(_n) + {how.block} - 1) div {how.block}").alias("_blocks")), "sizes")
    m = m.join(sizes, "_family").withColumn("_own", F.pmod(F.xxhash64("_class"), "_blocks"))
    m = m.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    m = m.select("_family", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "_class", "_root")
    m = m.join(classes.select("_class", "_rep"), "_class").join(docs.select(F.col("_id").alias("_rep"), "_text"), "_rep")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, ["_family", "_lo", "_hi"]):
            sets = list(_sets(rows))
            ok = np.array([class_of(x) == c for x, c in zip(sets, rows["_class"].to_pylist(), strict=True)])  # a row that repeats an id may have another text
            at = np.flatnonzero(ok)
            rep, root, side = (rows[c].to_numpy()[at] for c in ("_rep", "_root", "_side"))
            first, second = (at[side == 0], at[side == 1]) if rows["_lo"][0] != rows["_hi"][0] else (at, at)
            for i in range(0, len(first), how.sets):
                for j in range(i if first is second else 0, len(second), how.sets):  # so that matrices stay small, however short the texts are
                    a, b = first[i : i + how.sets], second[j : j + how.sets]
                    near = _linked([sets[k] for k in a], [sets[k] for k in b], how.percent)
                    yield _spanning(near, *(x[np.searchsorted(at, some)] for some in (a, b) for x in (rep, root)))

    place = ["_family", "_lo", "_hi"]
    return m.repartition(*place).sortWithinPartitions(*place).mapInArrow(lean(link), "_a long, _b long")


def _whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of equal keys, one run after the other, from sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        x = np.stack([batch[k].to_numpy() for k in keys])
        starts = [0, *(np.flatnonzero((x[:, 1:] != x[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for i, j in zip(starts, starts[1:], strict=False):
            part = batch.slice(i, j - i)
            if held and part.num_rows and any(held[0][k][0] != part[k][0] for k in keys):
                yield _joined(held)
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _linked(one: list[np.ndarray], other: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of one and other are linked: shingles that many sets have are counted by a matrix product, others set by set."""
    sizes = [np.array([len(s) for s in some]) for some in (one, other)]
    flat, counts = np.unique(np.concatenate([*one, *other]), return_counts=True)
    often = flat[counts > 32]
    both = np.zeros((len(one), len(other)), np.float32)
    for at in range(0, len(often), 2048):
        some = often[at : at + 2048]
        left, right = (np.stack([np.isin(some, s, assume_unique=True) for s in part]).astype(np.float32) for part in (one, other))
        both += left @ right.T
    few = flat[(counts <= 32) & (counts > 1)]
    where = [[], []]
    for side, part in enumerate((one, other)):
        for i, s in enumerate(part):
            k = np.searchsorted(few, s)
            k = k[few[np.minimum(k, len(few) - 1)] == s] if len(few) else k[:0]
            where[side].append(np.stack([k, np.full(len(k), i)]))
    (lk, li), (rk, ri) = (np.concatenate(w, axis=1) for w in where)
    order, start = np.argsort(rk, kind="stable"), None
    rk, ri = rk[order], ri[order]
    start, end = np.searchsorted(rk, lk), np.searchsorted(rk, lk, "right")
    n = end - start
    a = np.repeat(li, n)
    b = ri[np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    np.add.at(both, (a, b), 1)
    return 100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both)


def _spanning(near: np.ndarray, rep: np.ndarray, root: np.ndarray, rep_b: np.ndarray, root_b: np.ndarray) -> pa.RecordBatch:
    """Links between different roots, as many as keep what they connect together: each row with its first link to each root, once per pair of roots."""
    a, b = np.nonzero(near & (root[:, None] != root_b[None, :]))
    forest, keep = Forest(), []
    pairs, first = np.unique(np.stack([root[a], root_b[b]]), axis=1, return_index=True)
    for (x, y), i in zip(pairs.T.tolist(), first.tolist(), strict=True):
        if forest.join(x, y):
            keep.append(i)
    return pa.RecordBatch.from_arrays([pa.array(rep[a[keep]], pa.int64()), pa.array(rep_b[b[keep]], pa.int64())], names=["_a", "_b"])


def jaccard_components(docs: DataFrame, how: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id that links reach, its own included) of every document.

    A document whose text is null or has no words has no shingles and no links. Documents with equal sets are linked. Rows that
    repeat an id are one node, whatever their texts are, and are returned each. A null id is linked with nothing but equal
    sets. An empty table gives no rows. Other columns of docs are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sets, sketch = described(rows, how)
    classes = written(sets.where("_class is not null").groupBy("_class").agg(F.min("_id").alias("_rep"), F.first("_signature").alias("_signature")), "classes")
    shared = written(runs(prefixes(rows, sketch, how), how), "shared")
    led = shared.where("_class != _class_b").where(_may_link("_n", "_n_b", "_at", "_at_b", how.percent)).select("_class", "_class_b", "_n", "_n_b", "_at", "_at_b")
    first = written(_pairs(led, how.percent), "pairs")
    links = written(verified(first, classes, rows, how), "links")

    found = connected_components(links)
    roots = written(classes.select("_class", "_rep").join(found, F.col("_rep") == F.col("_node"), "left").select("_class", "_rep", F.coalesce("_root", "_rep").alias("_root")), "roots")
    open_ = undecided(shared, roots.select("_class", "_root"))
    rest = _pairs(across(open_, how), how.percent)
    rest = written(rest.join(first.select("_class", "_class_b"), ["_class", "_class_b"], "left_anti"), "pairs")
    more = verified(rest, classes, rows, how).unionByName(within_families(open_, classes, rows, how))
    # what is linked later joins components: only their roots are followed further
    for end in ("_a", "_b"):
        more = more.join(roots.select(F.col("_rep").alias(end), F.col("_root").alias(f"{end}_root")), end).drop(end)
    joined = written(connected_components(more.select(F.col("_a_root").alias("_a"), F.col("_b_root").alias("_b"))).withColumnsRenamed({"_node": "_old", "_root": "_new"}), "joined")
    named = roots.join(joined, F.col("_root") == F.col("_old"), "left").select("_class", F.coalesce("_new", "_root").alias("_root"))
    return sets.join(named, "_class", "left").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("_root", "_id").alias("component_id"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
