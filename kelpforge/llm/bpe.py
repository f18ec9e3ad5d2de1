"""Byte-level BPE by length-bucketed matrices: every row merges its leftmost pair of lowest rank, round by round."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import lean
from kelpforge.llm.chunks import Memo, grouped

NONE = np.int32(2**31 - 1)
#: Bytes of the widest rows: a row takes as many rounds as it has merges, and each round goes over the row, so that longer pieces (a few KB without a
#: break) would take time that grows with the square; these go through merge_long, which does the same merges in a linked row. Cells of a matrix at a time.
LONGEST_ROW = 4096
CELLS = 1 << 20


class PairTable:
    """Rank of a pair of ids, by open addressing in two arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(2 * len(pairs)).bit_length())) - 1)
        self.shift = np.uint64(64 - int(self.mask).bit_length())
        self.keys = np.full(int(self.mask) + 1, np.uint64(2**64 - 1))
        self.ranks = np.full(int(self.mask) + 1, NONE, np.int32)
        slot, left = self._slot(pairs), np.arange(len(pairs))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            at, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[at], self.ranks[at] = pairs[put], ranks[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair has no rank, or either id is negative (padding)."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        out = np.full(left.size, NONE, np.int32)
        todo = np.nonzero((left >= 0) & (right >= 0))[0]
        pairs = (left[todo].astype(np.uint64) << np.uint64(32)) | right[todo].astype(np.uint64)
        slot = self._slot(pairs)
        while len(todo):
            found = self.keys[slot]
            hit = found == pairs
            out[todo[hit]] = self.ranks[slot[hit]]
            more = ~hit & (found != np.uint64(2**64 - 1))
            todo, pairs, slot = todo[more], pairs[more], (slot[more] + np.uint64(1)) & self.mask
        return out.reshape(shape)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def bucket_of(n: int) -> int:
    """Width of the matrix for pieces of n bytes."""
    step = 4 if n <= 32 else 32 if n <= 256 else 256 if n <= 1024 else 1024
    return -(-n // step) * step


class Vocabulary:
    """Ranks of tokens, and of pairs that merge into one."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        pairs, ranks = [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs.append(left << 32 | right)
                    ranks.append(rank)
        self.pairs = PairTable(np.array(pairs, np.uint64), np.array(ranks, np.int32))
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """ids of each piece, as little-endian 32-bit numbers. A piece that is a token is that token."""
        out: list[bytes] = [b""] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(p) > LONGEST_ROW:
                out[i] = self.merge_long(p)
            elif p:
                buckets.setdefault(bucket_of(len(p)), []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                some = members[at : at + step]
                for i, ids in zip(some, self.merge_rows([pieces[i] for i in some], width), strict=True):
                    out[i] = ids
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        column = np.arange(width)
        ids = np.where(column < length[:, None], self.bytes[flat], np.int32(-1))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(pieces))
        done_ids, done_rows = [], []
        while len(rows):
            at = ranks.argmin(axis=1)
            k = np.arange(len(rows))
            best = ranks[k, at]
            active = best != NONE
            if not active.all():  # finished rows leave the matrix
                done_ids.append(ids[~active])
                done_rows.append(rows[~active])
                ids, ranks, rows, at, best, length = ids[active], ranks[active], rows[active], at[active], best[active], length[active]
                k = np.arange(len(rows))
                if not len(rows):
                    break
            ids[k, at] = best
            # what stands behind the merged pair moves one place to the left
            source = column[None, :-1] + (column[None, :-1] > at[:, None])
            ids[:, :-1] = np.take_along_axis(ids, source, 1)
            ids[:, -1] = -1
            ranks[:, :-1] = np.take_along_axis(ranks, source[:, :-1], 1)
            ranks[:, -1] = NONE
            inner = at < width - 1
            ranks[k[inner], at[inner]] = self.pairs(ids[k[inner], at[inner]], ids[k[inner], at[inner] + 1])
            before = at > 0
            ranks[k[before], at[before] - 1] = self.pairs(ids[k[before], at[before] - 1], ids[k[before], at[before]])
        out: list[bytes] = [b""] * len(pieces)
        for some, which in zip(done_ids, done_rows, strict=True):
            for i, n, row in zip(which.tolist(), (some >= 0).sum(axis=1).tolist(), some, strict=True):
                out[i] = row[:n].astype("<u4").tobytes()
        return out

    def merge_long(self, piece: bytes, block: int = 512) -> bytes:
        """The same merges for one long row: ids keep their places, links skip what was merged away, and minima are kept per block."""
        ids = self.bytes[np.frombuffer(piece, np.uint8)].copy()
        n = len(ids)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        padded = -(-n // block) * block
        ranks = np.full(padded, NONE, np.int32)
        ranks[: n - 1] = self.pairs(ids[:-1], ids[1:])
        lowest = ranks.reshape(-1, block).min(axis=1)
        while True:
            b = int(lowest.argmin())
            if lowest[b] == NONE:
                break
            i = b * block + int(ranks[b * block : (b + 1) * block].argmin())
            j = int(nxt[i])
            ids[i], ids[j] = ranks[i], -1
            nxt[i] = nxt[j]
            ranks[j] = NONE
            if nxt[i] < n:
                prv[nxt[i]] = i
                ranks[i] = self.pairs(ids[i : i + 1], ids[nxt[i] : nxt[i] + 1])[0]
            else:
                ranks[i] = NONE
            touched = {i // block, j // block}
            if (h := int(prv[i])) >= 0:
                ranks[h] = self.pairs(ids[h : h + 1], ids[i : i + 1])[0]
                touched.add(h // block)
            for t in touched:
                lowest[t] = ranks[t * block : (t + 1) * block].min()
        return ids[ids >= 0].astype("<u4").tobytes()


_tokens: dict[str, list[bytes]] = {}


def decode_ids(ids: bytes, path: str) -> bytes:
    """What little-endian unsigned 32-bit ids stand for. The tokens are loaded once per Python process."""
    if path not in _tokens:
        ranks = read_ranks(path)
        _tokens[path] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            _tokens[path][rank] = token
    return b"".join(map(_tokens[path].__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], tuple[Vocabulary, Memo]] = {}


def _vocabulary(path: str, pattern: str) -> tuple[Vocabulary, Memo]:
    """Once per Python process."""
    if (path, pattern) not in _loaded:
        import regex

        v, find = Vocabulary(path), regex.compile(pattern).findall

        def encode(texts: list[str]) -> list[bytes]:
            pieces = [find(t) for t in texts]
            unique = list({p for some in pieces for p in some})
            ids = dict(zip(unique, v.encode([p.encode() for p in unique]), strict=True))
            return [b"".join(map(ids.__getitem__, some)) for some in pieces]

        _loaded[path, pattern] = v, Memo(encode)
    return _loaded[path, pattern]


def encode_bpe(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id and ids (binary: little-endian unsigned 32-bit numbers) of every whole text; with decoded, what decode_bpe adds too, in the same pass.

    ranks: a .tiktoken file at the same path on all machines. pattern: finds the pieces that are merged separately; it must give a
    space to the piece behind it, as the public patterns for such files do. A null text is an empty one and has no ids; rows that
    repeat stay as they are; an empty table gives no rows. Other columns of docs are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            for run in grouped(v.as_py() or "" for v in batch["_text"]):
                got = _vocabulary(ranks, pattern)[1].texts(run)
                back = [pa.array([decode_ids(x, ranks) for x in got], pa.binary())] * decoded
                yield pa.RecordBatch.from_arrays([batch["_id"].slice(k, len(got)), pa.array(got, pa.binary()), *back], names=[id_col, "ids", *["decoded"] * decoded])
                k += len(got)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(encode), f"{id_col} {kind}, ids binary" + ", decoded binary" * decoded)


def decode_bpe(encoded: DataFrame, ranks: str, id_col: str = "doc_id") -> DataFrame:
    """Adds decoded (binary) to what encode_bpe returns."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [decode_ids(x.as_py(), ranks) for x in part["ids"]]
                yield pa.RecordBatch.from_arrays([part[id_col], part["ids"], pa.array(got, pa.binary())], names=[id_col, "ids", "decoded"])

    kind = dict(encoded.dtypes)[id_col]
    return encoded.select(id_col, "ids").mapInArrow(lean(decode), f"{id_col} {kind}, ids binary, decoded binary")


def digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """n_tokens and digests of the ids and of what they decode to."""
    if ranks is None or pattern is None:
        import public_tokenizers as public

        ranks, pattern = ranks or public.path("byte_bpe_multi_50k.tiktoken"), pattern or public.PATTERN
    d = encode_bpe(docs, ranks, pattern, decoded=True)
    return d.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
