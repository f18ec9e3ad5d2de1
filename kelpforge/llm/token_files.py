"""Token ids in files of fixed-width packed bits with block offsets.

A file is: the packed blocks; the table of documents (ids, then token counts, 64-bit); the blocks' offsets
(64-bit, one more than there are blocks); and a tail of fixed size: bits, block_ids, n_docs, n_tokens, n_blocks (64-bit each) and the mark.
All numbers are little-endian. A block holds block_ids ids of `bits` bits each, the last one what is left.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpforge.llm.chunks import split_parts
from kelpforge.llm.common import fresh_dir, lean, open_store, written

MARK = b"KFBITS01"
TAIL = struct.Struct("<5q8s")
BLOCK_IDS = 8192
#: Parts encoded in one string, bytes of what is remembered, and bytes of text encoded at a time.
JOINED = 1024
MEMO_BYTES = 64 << 20
RUN_BYTES = 3 << 20


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    rows = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(rows[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    rows = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = rows
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes ids in whole blocks; holds what is left of a block and the table of documents."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.doc_ids, self.counts, self.offsets = array("q"), array("q"), array("q", [0])
        self.rest, self.n_tokens = np.empty(0, "<u4"), 0

    def add(self, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """ids: of some documents, one after the other, as many of each as counts says."""
        self.doc_ids.frombytes(np.ascontiguousarray(doc_ids, "<i8").tobytes())
        self.counts.frombytes(np.ascontiguousarray(counts, "<i8").tobytes())
        self.n_tokens += len(ids)
        ids = np.concatenate([self.rest, ids])
        full = len(ids) // self.block_ids * self.block_ids
        if full:
            data = pack(ids[:full], self.bits)  # a block has whole bytes: block_ids is a multiple of 8
            size = self.block_ids * self.bits // 8
            self.stream.write(data)
            self.offsets.extend(range(self.offsets[-1] + size, self.offsets[-1] + len(data) + 1, size))
        self.rest = ids[full:].copy()

    def close(self) -> None:
        if len(self.rest):
            data = pack(self.rest, self.bits)
            self.stream.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        for numbers in (self.doc_ids, self.counts, self.offsets):
            self.stream.write(np.asarray(numbers, "<i8").tobytes())
        self.stream.write(TAIL.pack(self.bits, self.block_ids, len(self.doc_ids), self.n_tokens, len(self.offsets) - 1, MARK))


class Reader:
    """Random access: only the tail, the table and the blocks asked for are read."""

    def __init__(self, stream, size: int):
        self.stream = stream
        tail = self._at(size - TAIL.size, TAIL.size)
        self.bits, self.block_ids, self.n_docs, self.n_tokens, n_blocks, mark = TAIL.unpack(tail)
        if mark != MARK:
            raise ValueError("not a file of packed ids")
        n = 2 * self.n_docs + n_blocks + 1
        table = np.frombuffer(self._at(size - TAIL.size - 8 * n, 8 * n), "<i8")
        self.doc_ids, self.counts, self.offsets = table[: self.n_docs], table[self.n_docs : 2 * self.n_docs], table[2 * self.n_docs :]
        self.ends = np.cumsum(self.counts)

    def _at(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        return self.stream.read(n)

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """ids start to stop (not included) of the file."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        # every block but the last of the file has whole bytes: block_ids is a multiple of 8
        n = min((last + 1) * self.block_ids, self.n_tokens) - first * self.block_ids
        return unpack(data, self.bits, n)[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.ends[i] - self.counts[i]), int(self.ends[i]))

    def documents(self, run: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of all documents, about `run` ids read at a time."""
        i = 0
        while i < self.n_docs:
            start = int(self.ends[i] - self.counts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, start + run, "right")))
            ids = self.tokens(start, int(self.ends[j - 1]))
            for k in range(i, j):
                a = int(self.ends[k] - self.counts[k])
                yield int(self.doc_ids[k]), a, ids[a - start : a - start + int(self.counts[k])]
            i = j


#: In the classes of the library's pattern, white space behind a space; there a text cannot be cut at every space.
WIDE = r" [\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class Encoder:
    """ids of many texts at a time. Texts are cut before spaces, where no token reaches across; each different part is encoded once per run, and the ids of parts
    are remembered in flat arrays until these take MEMO_BYTES."""

    def __init__(self, path: str, specials_as_text: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.size = self.tokenizer.get_vocab_size()
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)  # a character for each byte
        self._remember(pa.array([], pa.string()), np.empty(0, "<u4"), np.empty(0, np.int64))

    def _remember(self, words: pa.StringArray, flat: np.ndarray, counts: np.ndarray) -> None:
        self.words, self.flat, self.counts = words, flat, counts
        self.at = np.cumsum(counts) - counts

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_parts(self, parts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """ids of parts, each with the space before it that it has lost. They may be encoded in one string, since they are cut where tokens end; the ids are dealt out by the bytes they stand for."""
        flat, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        for at in range(0, len(parts), JOINED):
            some = parts.slice(at, JOINED)
            texts = some.to_pylist()
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
            ends, bounds = np.cumsum(self.n_bytes[ids]), np.cumsum(pc.binary_length(some).to_numpy().astype(np.int64) + 1)
            cuts = np.searchsorted(ends, bounds)
            if len(ends) and cuts[-1] == len(ends) - 1 and (ends[cuts] == bounds).all():
                flat.append(ids)
                counts.append(np.diff(cuts, prepend=-1))
            else:  # not a vocabulary of bytes
                for got, into in zip(self._encode([" " + t for t in texts]), (flat, counts), strict=True):
                    into.append(got)
        return np.concatenate(flat), np.concatenate(counts)

    def _places(self, parts: pa.StringArray) -> np.ndarray:
        """Where the ids of different parts are remembered."""
        place = pc.fill_null(pc.index_in(parts, self.words), -1).to_numpy().astype(np.int64)
        new = place < 0
        if new.any():
            words = parts.filter(pa.array(new))
            flat, counts = self._encode_parts(words)
            place[new] = len(self.words) + np.arange(len(words))
            self._remember(pa.concat_arrays([self.words, words]), np.concatenate([self.flat, flat]), np.concatenate([self.counts, counts]))
        return place

    def texts(self, texts: pa.StringArray, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after the other, each followed by the ids in end, and how many each has."""
        if pc.any(pc.match_substring_regex(texts, WIDE)).as_py():
            split = pa.array([split_parts(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            split = pc.split_pattern(texts, " ")
        starts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        heads, parts = starts[:-1], split.flatten()
        coded = parts.dictionary_encode()
        code = coded.indices.to_numpy()
        tail = np.ones(len(code), bool)
        tail[heads] = False
        used = np.zeros(len(coded.dictionary), bool)
        used[code[tail]] = True  # and not what only begins texts
        place = np.zeros(len(used), np.int64)
        place[used] = self._places(coded.dictionary.filter(pa.array(used)))
        first, n_first = self._encode(parts.take(pa.array(heads)).to_pylist())
        flat = np.concatenate([self.flat, first, np.array(end, "<u4")])
        at = np.concatenate([self.at, len(self.flat) + np.cumsum(n_first) - n_first, [len(flat) - len(end)]])
        counts = np.concatenate([self.counts, n_first, [len(end)]])
        which = place[code]
        which[heads] = len(self.counts) + np.arange(len(heads))
        which = np.insert(which, starts[1:], len(counts) - 1)
        many = counts[which]
        ids = flat[np.repeat(at[which] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        if self.words.nbytes + self.flat.nbytes + 2 * self.counts.nbytes > MEMO_BYTES:  # go on with what this run has had
            kept = np.unique(place[used])
            n = self.counts[kept]
            self._remember(self.words.take(pa.array(kept)), self.flat[np.repeat(self.at[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n)
        return ids, np.add.reduceat(many, heads + np.arange(len(heads)))


_encoders: dict[tuple[str, bool], Encoder] = {}


def _encoder(path: str, specials_as_text: bool) -> Encoder:
    """Once per Python process."""
    if (path, specials_as_text) not in _encoders:
        _encoders[path, specials_as_text] = Encoder(path, specials_as_text)
    return _encoders[path, specials_as_text]


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of _id and _text of about RUN_BYTES, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch["_text"]), 0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, specials_as_text: bool = False) -> DataFrame:
    """Encodes every text and writes packed files in ascending order of ids, one per range of ids.

    tokenizer: a file of the tokenizers library, of the byte-level kind, at the same path on all machines. end_id is appended to each document.
    The name of a special token in a text is that token, as the library has it by default; with specials_as_text it is text like any other.
    A null text is an empty one; a null id is written as -1 and comes first; rows that repeat an id stand next to each
    other, ordered by a hash of their texts; an empty table gives no files. Other columns of docs are ignored.
    A task that runs again writes a file of another name; only files in the returned table count.

    Returns part (files in order), path, n_docs, n_tokens, start (tokens in all earlier files).
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = out = None
        for batch in batches:
            if batch.num_rows and writer is None:
                encoder = _encoder(tokenizer, specials_as_text)
                store, inside = open_store(folder)
                store.create_dir(inside, recursive=True)
                part = TaskContext.get().partitionId()
                name = f"part-{part:06d}-{uuid.uuid4().hex}.bits"
                out = store.open_output_stream(f"{inside}/{name}", compression=None)
                writer = Writer(out, bits_for(max(encoder.size, (end_id or 0) + 1)))
            for run in _runs(batch):
                ids, counts = encoder.texts(pc.fill_null(run["_text"], ""), [] if end_id is None else [end_id])
                writer.add(pc.fill_null(run["_id"], -1).to_numpy(), counts, ids)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.n_tokens]})

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text").asc()]
    files = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(write), "part long, path string, n_docs long, n_tokens long")
    files = written(files, "token-files")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


def read_token_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before it), n_tokens and ids (64-bit array) of every document, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                store, inside = open_store(f["path"])
                with store.open_input_file(inside) as stream:
                    rows, held = [], 0
                    for doc_id, at, ids in Reader(stream, stream.size()).documents():
                        rows.append((doc_id, f["start"] + at, len(ids), ids.tobytes()))
                        held += len(ids)
                        if held > 1 << 21:
                            yield as_batch(rows)
                            rows, held = [], 0
                    yield as_batch(rows)

    def as_batch(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=[id_col, "start", "n_tokens", "ids"])

    dealt = files.select("path", "start").repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.mapInArrow(lean(read), f"{id_col} long, start long, n_tokens long, ids binary")


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids)


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
    return read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
