"""Phrases whose words stand together more often than their parts would: counts of frequent word sequences, by tiles of pairs of ranks.

Words that occur often enough are ranked by frequency. Every text becomes a sequence of ranks, and pairs of neighbours are counted: pairs of
low ranks fall into few tiles that are counted by direct address, the others are sorted coordinates. Frequent pairs are ranked in turn; in a
sequence of their ranks, neighbours are phrases of one word more. So each level is a pass over what the level before it has left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.llm.common import fresh_dir, lean, open_store, with_prefix_sums, written
from kelpforge.llm.shingles import BYTES_AT_ONCE, _powers_to, mixed

#: Bytes that end words (1), and those that end pieces too (2); A-Z are lower-cased.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Mining:
    """least: occurrences of a candidate. longest: words of one. covered: percentage of a phrase's occurrences within a longer one at which it is dropped. top: phrases of a language.
    entries: of a dictionary that a task holds (16 bytes each); larger dictionaries are applied in bands, one pass each. The rest bounds a task's memory and does not
    change results: bytes of text tokenised at a time, ids in a row of a sequence, different words held, pairs counted at a time, different pairs held; tile: its side in
    ranks (a tile of at least a fourth as many pairs as it has cells is counted by direct address); direct: ranks below which a pair's own rank is found so."""

    least: int = 30
    longest: int = 4
    covered: int = 80
    top: int = 2000
    entries: int = 4_000_000
    run_bytes: int = BYTES_AT_ONCE
    row_ids: int = 2048
    words_held: int = 150_000
    pairs_at_once: int = 1 << 20
    pairs_held: int = 1 << 21
    tile: int = 128
    direct: int = 1024


@lru_cache(4)
def _weights(seed: int) -> np.ndarray:
    """Two odd numbers for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def find_words(flat: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """Of all words: start, end, hash, second hash, whether a piece ends between it and what is before it; and whether a piece ends after the last."""
    kind = KIND[flat]
    edge = np.flatnonzero(np.diff(kind == 0, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    ended = np.concatenate([[0], np.cumsum(kind == 2)])
    after = ended[ends]
    broken = ended[starts] > np.concatenate([[0], after[:-1]])[: len(starts)]
    powers, inverse = _powers_to(len(flat))
    hashes = []
    for w in _weights(seed):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(w[flat] * powers[: len(flat)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
    return starts, ends, *hashes, broken, bool(ended[-1] > (after[-1] if len(after) else 0))


def _segments(text: bytes, size: int) -> Iterator[bytes]:
    """A long text in segments of about that size, cut behind a byte that ends a word."""
    at = 0
    while len(text) - at > size:
        window = np.frombuffer(text, np.uint8, offset=at + size)
        stop = len(text)
        for i in range(0, len(window), 1 << 16):  # the next such byte
            there = np.flatnonzero(KIND[window[i : i + (1 << 16)]])
            if len(there):
                stop = at + size + i + int(there[0]) + 1
                break
        yield text[at:stop]
        at = stop
    yield text[at:]


class _Tokens:
    """Gathers counts of words, and texts as sequences of hashes; 0 stands where a piece ends."""

    def __init__(self, seed: int):
        self.seed = seed
        self.counts: dict[int, int] = {}
        self.names: dict[int, tuple[str, bytes]] = {}
        self.conflicts: list[tuple[int, str, bytes]] = []
        self.rows: list[bytes] = []

    def run(self, texts: list[bytes], langs: list[str], carried: bool = True) -> bool:
        """carried: whether a piece has ended before the first word. Returns whether one has ended after the last."""
        flat = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
        starts, ends, h, check, broken, tail = find_words(flat, self.seed)
        if not len(starts):
            return carried or tail
        limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        which = np.searchsorted(limits, starts, "right")
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], np.uint64)
        h = mixed(h ^ salt[which])
        h[h == 0] = 1
        broken[0] |= carried
        order = np.argsort(h, kind="stable")
        s, c = h[order], check[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        name = lambda i: (langs[which[i]], flat[starts[i] : ends[i]].tobytes())
        same = np.concatenate([[True], (c[1:] == c[:-1]) | (s[1:] != s[:-1])])
        for at in np.flatnonzero(~same).tolist():
            self.conflicts.append((int(s[at].view(np.int64)), *name(order[at - 1])))
            self.conflicts.append((int(s[at].view(np.int64)), *name(order[at])))
        signed = h.view(np.int64)
        for i, n in zip(order[first].tolist(), np.diff(first, append=len(s)).tolist(), strict=True):
            k = int(signed[i])
            if k not in self.counts:
                self.counts[k], self.names[k] = 0, name(i)
            self.counts[k] += n
        seq = np.zeros(len(h) + int(broken.sum()), np.int64)
        seq[np.arange(len(h)) + np.cumsum(broken)] = signed
        self.rows.append(seq.tobytes())
        return tail

    def sequences(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(rows, pa.binary())], names=["_h", "_lang", "_word", "_n", "_keys"])

    def words(self) -> pa.RecordBatch:
        h = [*self.counts, *(c[0] for c in self.conflicts)]
        names = [*self.names.values(), *(c[1:] for c in self.conflicts)]
        n = [*self.counts.values()] + [0] * len(self.conflicts)
        self.counts, self.names, self.conflicts = {}, {}, []
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array([x for x, _ in names], pa.string()), pa.array([w.decode() for _, w in names], pa.string()), pa.array(n, pa.int64()), pa.nulls(len(h), pa.binary())], names=["_h", "_lang", "_word", "_n", "_keys"])


def _tokenised(docs: DataFrame, seed: int, how: Mining) -> DataFrame:
    """Words with counts (_h, _lang, _word, _n) and sequences of hashes (_keys); a row has the one or the other."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Tokens(seed)
        texts, langs, size = [], [], 0
        for batch in batches:
            for text, lang in zip(batch["_text"], batch["_lang"], strict=True):
                raw = text.as_buffer()
                if raw.size > how.run_bytes:
                    ended, before = True, len(found.rows)
                    for segment in _segments(raw.to_pybytes(), how.run_bytes):
                        ended = found.run([segment], [lang.as_py()], ended)
                    found.rows[before:] = [b"".join(found.rows[before:])]  # a text is never cut between rows
                else:
                    if size + raw.size > how.run_bytes or len(texts) >= 4096:
                        found.run(texts, langs)
                        texts, langs, size = [], [], 0
                    texts.append(raw.to_pybytes())
                    langs.append(lang.as_py())
                    size += raw.size + 1
                if len(found.rows):
                    yield cut_rows(found)
                if len(found.counts) > how.words_held:
                    yield found.words()
        if texts:
            found.run(texts, langs)
            yield cut_rows(found)
        yield found.words()

    def cut_rows(found: _Tokens) -> pa.RecordBatch:
        found.rows = [r for row in found.rows for r in cut_at_breaks(np.frombuffer(row, np.int64), 0, how.row_ids)]
        return found.sequences()

    rows = docs.select(F.coalesce("_lang", F.lit("und")).alias("_lang"), F.encode(F.coalesce("_text", F.lit("")), "UTF-8").alias("_text"))
    return rows.mapInArrow(lean(tokenise), "_h long, _lang string, _word string, _n long, _keys binary")


def cut_at_breaks(seq: np.ndarray, mark: int, size: int) -> Iterator[bytes]:
    """Rows of about that many ids, each from a mark to before a later one."""
    marks = np.flatnonzero(seq == mark)
    at = 0
    while at < len(seq):
        later = np.searchsorted(marks, at + size)
        stop = int(marks[later]) if later < len(marks) else len(seq)
        yield seq[at:stop].tobytes()
        at = stop


class Lookup:
    """Ranks of keys, out of those that a file of (_key, _id) has between two ranks."""

    def __init__(self, path: str, lo: int, hi: int):
        import pyarrow.dataset as ds

        store, inside = open_store(path)
        t = ds.dataset(inside, filesystem=store, format="parquet").to_table(columns=["_key", "_id"], filter=(ds.field("_id") >= lo) & (ds.field("_id") < hi))
        keys, ids = t["_key"].to_numpy(), t["_id"].to_numpy()
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """-1 where a key is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], -1)


class PairLookup(Lookup):
    """Ranks of pairs of ranks below m, given as first times m plus second. Pairs of low ranks are found by direct address."""

    def __init__(self, path: str, lo: int, hi: int, m: int, direct: int):
        super().__init__(path, lo, hi)
        self.m, self.side = m, min(m, direct)
        a, b = self.keys // m, self.keys % m
        low = (a < self.side) & (b < self.side)
        self.direct = np.full(self.side * self.side, -1)
        self.direct[a[low] * self.side + b[low]] = self.ids[low]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1)
        low = (a >= 0) & (b >= 0) & (a < self.side) & (b < self.side)
        out[low] = self.direct[a[low] * self.side + b[low]]
        rest = (a >= 0) & (b >= 0) & ~low
        out[rest] = self.find(a[rest] * self.m + b[rest])
        return out


_held: dict[tuple, Lookup] = {}


def _lookup(path: str, lo: int, hi: int, m: int | None, direct: int) -> Lookup:
    """One at a time per Python process."""
    if (path, lo) not in _held:
        _held.clear()
        _held[path, lo] = Lookup(path, lo, hi) if m is None else PairLookup(path, lo, hi, m, direct)
    return _held[path, lo]


def count_pairs(a: np.ndarray, b: np.ndarray, m: int, edge: int = Mining.tile) -> tuple[np.ndarray, np.ndarray]:
    """Keys (a m + b) of different pairs and how often each occurs."""
    side = -(-m // edge)
    tile = (a // edge) * side + b // edge
    if side * side <= 1 << 22:
        n = np.bincount(tile, minlength=1)
        dense = np.flatnonzero(n >= edge * edge // 4)
    else:
        found, n = np.unique(tile, return_counts=True)
        dense = found[n >= edge * edge // 4]
    keys, counts = [], []
    rest = np.ones(len(a), bool)
    if len(dense):
        slot = np.minimum(np.searchsorted(dense, tile), len(dense) - 1)
        rest = dense[slot] != tile
        inside = ~rest
        cell = slot[inside] * (edge * edge) + (a[inside] % edge) * edge + b[inside] % edge
        n = np.bincount(cell, minlength=len(dense) * edge * edge)
        there = np.flatnonzero(n)
        where, at = dense[there // (edge * edge)], there % (edge * edge)
        keys.append(((where // side) * edge + at // edge) * m + (where % side) * edge + at % edge)
        counts.append(n[there])
    sparse, n = np.unique(a[rest] * m + b[rest], return_counts=True)
    return np.concatenate([*keys, sparse]), np.concatenate([*counts, n])


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Pairs:
    """Counts of pairs that a task has seen."""

    def __init__(self, m: int, how: Mining):
        self.m, self.how, self.waiting, self.n_waiting = m, how, [], 0
        self.keys, self.counts = [], []

    def add(self, seq: np.ndarray) -> None:
        both = (seq[:-1] >= 0) & (seq[1:] >= 0)
        self.waiting.append((seq[:-1][both], seq[1:][both]))
        self.n_waiting += int(both.sum())
        if self.n_waiting >= self.how.pairs_at_once:
            self._count()

    def _count(self) -> None:
        if self.n_waiting:
            k, n = count_pairs(np.concatenate([a for a, _ in self.waiting]), np.concatenate([b for _, b in self.waiting]), self.m, self.how.tile)
            self.keys.append(k)
            self.counts.append(n)
            self.waiting, self.n_waiting = [], 0

    def taken(self, last: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What is to be given out: at the end everything, before it what has become too much."""
        if last:
            self._count()
        if last or sum(map(len, self.keys)) > self.how.pairs_held:
            k, n = merged(np.concatenate([np.empty(0, np.int64), *self.keys]), np.concatenate([np.empty(0, np.int64), *self.counts]))
            self.keys, self.counts = [k], [n]
            if last or len(k) > self.how.pairs_held // 2:
                self.keys, self.counts = [], []
                for at in range(0, len(k), 1 << 16):
                    yield k[at : at + (1 << 16)], n[at : at + (1 << 16)]


def thinned(seq: np.ndarray) -> np.ndarray:
    """Runs of -1 as one, one at the start, none at the end."""
    seq = np.concatenate([[-1], seq])
    keep = seq >= 0
    keep[:-1] |= keep[1:]
    return seq[keep]


def _ranked(rows: DataFrame, path: str, n: int, m: int | None, how: Mining, count: bool) -> DataFrame:
    """Sequences (_keys) of ranks in place of hashes (m None) or of neighbours' ranks (each below m); and counts (_key, _n) of their own pairs.

    n: ranks in the dictionary at path. One of more than how.entries is applied in bands, each over the whole table.
    """
    bands = list(range(0, n, how.entries))

    def rank(lo: int, last: bool):
        hi = min(n, lo + how.entries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, pairs = _lookup(path, lo, hi, m, how.direct), _Pairs(n, how)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    keys = part["_keys"].to_pylist()
                    before = np.frombuffer(b"".join(keys), np.int64)
                    got = table.find(before) if m is None else table.pairs(before, np.append(before[1:], -1))
                    if part["_ids"].null_count == 0:  # what earlier bands have found
                        got = np.maximum(got, np.frombuffer(b"".join(part["_ids"].to_pylist()), np.int64))
                    if last:
                        if count:
                            pairs.add(got)
                        rows = list(cut_at_breaks(thinned(got), -1, how.row_ids))
                        yield as_rows(rows)
                    else:
                        ends = np.cumsum([len(k) // 8 for k in keys])
                        yield as_rows(keys, [got[i - len(k) // 8 : i].tobytes() for i, k in zip(ends.tolist(), keys, strict=True)])
                    for found in pairs.taken(False):
                        yield as_counts(*found)
            for found in pairs.taken(True):
                yield as_counts(*found)

        return run

    def as_rows(keys: list, ids: list | None = None) -> pa.RecordBatch:
        k = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.nulls(k, pa.binary()) if ids is None else pa.array(ids, pa.binary()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=["_keys", "_ids", "_key", "_n"])

    def as_counts(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        k = len(keys)
        return pa.RecordBatch.from_arrays([pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["_keys", "_ids", "_key", "_n"])

    rows = rows.where("_keys is not null").select("_keys", F.lit(None).cast("binary").alias("_ids"))
    for lo in bands:
        last = lo == bands[-1]
        rows = written(rows.select("_keys", "_ids").mapInArrow(lean(rank(lo, last)), "_keys binary, _ids binary, _key long, _n long"), "ranked")
    return rows


def _dictionary(level: DataFrame, key: str) -> str:
    path = fresh_dir(level.sparkSession, "dictionary")
    level.select(F.col(key).alias("_key"), "_id").write.parquet(path)
    return path


def _words(docs: DataFrame, how: Mining) -> tuple[DataFrame, DataFrame]:
    """Tokens, and words (_h, _lang, _word, _f). Words are told apart by their hashes; should two share one, all are hashed anew."""
    for seed in range(8):
        found = written(_tokenised(docs, seed, how), "tokens")
        words = written(found.where("_h is not null").groupBy("_h", "_lang", "_word").agg(F.sum("_n").alias("_f")), "words")
        if words.groupBy("_h").count().where("count > 1").isEmpty():
            return found, words
    raise RuntimeError("words share hashes with every seed")


def _next_level(found: DataFrame, level: DataFrame, m: int, how: Mining) -> DataFrame:
    """Phrases of one word more, ranked by frequency: of the pairs counted, those that occur often enough."""
    frequent = written(found.where("_key is not null").groupBy("_key").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= how.least), "pairs")
    pairs = frequent.select("_key", "_n", F.expr(f"_key div {m}").alias("_a"), F.expr(f"_key % {m}").alias("_b"))
    side = lambda c, *columns: level.select(F.col("_id").alias(c), *columns)
    left = side("_a", F.col("_lang"), F.col("_ws").alias("_ws_a"), F.col("_pre").alias("_pre_a"))
    right = side("_b", F.element_at("_ws", -1).alias("_w_b"), F.col("_suf").alias("_suf_b"))
    if m <= 100_000:  # rows of at most three short arrays
        left, right = F.broadcast(left), F.broadcast(right)
    d = pairs.join(left, "_a").join(right, "_b")
    one = F.array("_n")
    d = d.select("_key", "_a", "_b", "_n", "_lang", F.concat("_ws_a", F.array("_w_b")).alias("_ws"), F.concat("_pre_a", one).alias("_pre"), F.concat(one, "_suf_b").alias("_suf"))
    return _with_ranks(d, [F.col("_n").desc(), F.col("_key").asc()])


def _with_ranks(rows: DataFrame, order: list) -> DataFrame:
    d = with_prefix_sums(rows.withColumn("_one", F.lit(1).cast("long")), order, "_one")
    return written(d.select(F.col("_index").alias("_id"), *rows.columns), "level")


def collocations(docs: DataFrame, how: Mining = Mining(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of each language that hold together best.

    A-Z are lower-cased; pieces lie between any of .,;:!? and the characters 0A to 0D, words between spaces and tabs. A null text is an empty one, a null
    language is `und`; empty tables, and languages without phrases, give no rows. Texts that repeat count each time. Other columns are ignored.
    Memory of a task grows with its longest text only. All counts are exact.
    """
    found, words = _words(docs.select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")), how)
    frequent = words.where(F.col("_f") >= how.least)
    level = _with_ranks(frequent, [F.col("_f").desc(), F.col("_lang").asc(), F.col("_word").asc()])
    names = level.select("_id", "_word")
    f = F.array("_f")
    level = level.select("_id", "_h", F.col("_f").alias("_n"), "_lang", F.array("_id").alias("_ws"), f.alias("_pre"), f.alias("_suf"))
    m, levels, path, before = level.count(), [], None, None
    for width in range(2, how.longest + 1):
        if not m:
            break
        path = _dictionary(level, "_h" if width == 2 else "_key")
        found = _ranked(found, path, m, before, how, True)
        following = _next_level(found, level, m, how)
        levels.append(following)
        before, m, level = m, following.count(), following
    if not levels:
        levels = [level.select("_id", F.lit(0).cast("long").alias("_a"), F.lit(0).cast("long").alias("_b"), "_n", "_lang", "_ws", "_pre", "_suf").limit(0)]
    parts = []
    for k, level in enumerate(levels):
        d = level
        if k + 1 < len(levels):
            nxt = levels[k + 1]
            over = nxt.select(F.col("_a").alias("_id"), F.col("_n").alias("_over")).unionByName(nxt.select(F.col("_b").alias("_id"), F.col("_n").alias("_over")))
            d = d.join(over.groupBy("_id").agg(F.max("_over").alias("_over")), "_id", "left")
            # a phrase within one two words longer lies within one between them, which occurs at least as often
            d = d.where(F.expr(f"_over is null or cast(_over as decimal(20,0)) * 100 < cast(_n as decimal(20,0)) * {how.covered}"))
        parts.append(d.select("_lang", "_n", "_ws", "_pre", "_suf"))
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    cuts = "transform(sequence(1, size(_ws) - 1), k -> struct(cast(_n as decimal(20,0)) * 2000000 div (cast(_pre[k - 1] as decimal(20,0)) + _suf[k]) as score, k as k, _pre[k - 1] as l, _suf[k] as r))"
    d = d.withColumn("_cut", F.expr(f"array_min({cuts})"))
    best = Window.partitionBy("_lang").orderBy(F.col("_cut.score").desc(), F.col("_n").desc())
    d = written(d.withColumn("_rank", F.rank().over(best)).where(F.col("_rank") <= how.top).withColumn("_row", F.monotonically_increasing_id()), "best")  # and all that tie with the last
    spelled = d.select("_row", F.posexplode("_ws").alias("_at", "_id")).join(names, "_id").groupBy("_row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda x: x["_word"]), " ").alias("phrase"))  # longest words at most
    totals = words.groupBy("_lang").agg(F.sum("_f").alias("n"))
    d = d.join(spelled, "_row").join(totals, "_lang")
    order = Window.partitionBy("_lang").orderBy(F.col("_cut.score").desc(), F.col("_n").desc(), F.col("phrase").asc())
    d = d.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= how.top)
    return d.select(F.col("_lang").alias("lang"), F.col("_rank").cast("long").alias("rank"), "phrase", F.col("_n").alias("a"), F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
