"""Progressive JPEG as a media column: bytes stored in coefficients, scans accumulated, tensors of full resolution made in numpy.

A payload byte is one coefficient of an 8x8 block, the unit that JPEG stores without loss: 0..127 are -129..-2 and 128..255 are
2..129, so that no coefficient vanishes when its lowest bit is left to a later scan. Blocks fill Y (two thirds), Cb and Cr (a sixth
each, at half resolution both ways). The scans: DC of all components without the lowest bit; AC of Y in two bands, of Cb and of Cr,
all without the lowest bit; the AC bits; the DC bits. Huffman code lengths are chosen so that code and
extra bits of any coefficient take equally many bits together, which lets numpy read whole scans at once. Scans of
other files (zero runs, other tables, restarts) are read symbol by symbol.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm.common import lean, written

#: Payloads are filled up with bytes 255 to a multiple of this.
UNIT = 576
#: Coefficients packed at a time, a multiple of 8; blocks transformed at a time.
PACK = 1 << 16
BLOCKS = 1 << 12

#: Place in the 8x8 block of each coefficient in zigzag order.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


@lru_cache(None)
def _transform() -> np.ndarray:
    """Inverse DCT of coefficients in zigzag order, in whole numbers of 2**-16: sums are exact in double precision, whatever their order."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= math.sqrt(2)
    return np.rint(np.kron(c, c)[ZIGZAG] * 65536)


class Code:
    """A Huffman table: symbols in the order of their codes, counts of codes by length 1 to 16."""

    def __init__(self, counts: list[int], symbols: bytes):
        self.counts, self.symbols, self.codes = counts, symbols, {}
        code = k = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[symbols[k]] = code, length
                code, k = code + 1, k + 1
            code <<= 1
        self.read = {(length, code): s for s, (code, length) in self.codes.items()}

    @classmethod
    def of_lengths(cls, lengths: dict[int, int]) -> Code:
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        return cls([sum(n == i for n in lengths.values()) for i in range(1, 17)], bytes(order))

    def uniform(self, sizes_only: bool) -> int:
        """Bits that code and extra bits of any symbol take together, if that is one number and no symbol stands for a zero run; else 0."""
        if sizes_only and any(s >> 4 or not s for s in self.codes):
            return 0
        total = {length + (s & 15) for s, (_, length) in self.codes.items()}
        return total.pop() if len(total) == 1 else 0


DC_CODE = Code.of_lengths({s: 10 - s for s in range(9)})
AC_CODE = Code.of_lengths({s: 9 - s for s in range(1, 8)})
EOB_CODE = Code.of_lengths({r << 4: 4 for r in range(15)})


def _bits_of(code: Code, least: int, most: int, width: int) -> np.ndarray:
    """Row v - least: the bits of value v, code and extra bits."""
    out = np.zeros((most - least + 1, width), np.uint8)
    for v in range(least, most + 1):
        s = abs(v).bit_length()
        if s in code.codes:
            c, length = code.codes[s]
            word = c << s | (v if v >= 0 else v + (1 << s) - 1)
            out[v - least] = [word >> (length + s - 1 - i) & 1 for i in range(width)]
    return out


def _values_of(code: Code, width: int) -> np.ndarray:
    """The value behind every word of so many bits; -32768 where the word begins with no code."""
    out = np.full(1 << width, -32768, np.int16)
    for s, (c, length) in code.codes.items():
        for extra in range(1 << s):
            out[c << s | extra] = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
    return out


_DC_BITS, _AC_BITS = _bits_of(DC_CODE, -255, 255, 10), _bits_of(AC_CODE, -127, 127, 9)


def _packed(values: np.ndarray, table: np.ndarray, least: int) -> bytes:
    values = values.ravel()
    return b"".join(np.packbits(table[values[i : i + PACK] - least]).tobytes() for i in range(0, len(values), PACK))


def _close(data: bytes, n_bits: int) -> bytes:
    """Ones up to the byte's end, and a zero byte behind each byte of ones."""
    if n_bits % 8:
        data = data[:-1] + bytes([data[-1] | (1 << (8 - n_bits % 8)) - 1])
    return data.replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _scan(components: str, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    ids = [1 + "YBR".index(c) for c in components]
    head = bytes([len(ids)]) + b"".join(bytes([i, 0x00]) for i in ids) + bytes([first, last, high << 4 | low])
    return _segment(0xDA, head) + data


def _interleaved(planes: list[np.ndarray], wide: int, high: int) -> np.ndarray:
    """One value per block and component, (blocks of a unit) x (units): four of Y, one of Cb, one of Cr in each unit."""
    y = planes[0].reshape(high, 2, wide, 2).transpose(0, 2, 1, 3).reshape(-1, 4)
    return np.column_stack([y, planes[1], planes[2]])


def _refined(bits: np.ndarray) -> bytes:
    """A correction scan over blocks whose coefficients are all known to be other than 0: runs of ends of block, then a bit for each."""
    parts, n = [], 0
    for i in range(0, len(bits), 32767):
        run = min(32767, len(bits) - i)
        r = run.bit_length() - 1
        code, length = EOB_CODE.codes[r << 4]
        head = code << r | run - (1 << r)
        parts += [np.array([head >> (length + r - 1 - k) & 1 for k in range(length + r)], np.uint8), bits[i : i + run].ravel()]
        n += length + r + 63 * run
    return _close(np.packbits(np.concatenate(parts)).tobytes(), n)


@lru_cache(None)
def _tables() -> tuple[bytes, bytes, bytes, bytes]:
    """One quantisation step everywhere, and the three Huffman tables' segments."""
    dht = lambda where, code: _segment(0xC4, bytes([where, *code.counts]) + code.symbols)
    return _segment(0xDB, b"\0" + b"\1" * 64), dht(0x00, DC_CODE), dht(0x10, AC_CODE), dht(0x10, EOB_CODE)


def encode_jpeg(payload: bytes) -> bytes:
    """A progressive JPEG that holds the payload, whose length is a positive multiple of 64."""
    units = -(-len(payload) // 384)
    wide = math.isqrt(units - 1) + 1
    high = -(-units // wide)
    units = wide * high
    raw = np.zeros(units * 384, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    v = raw.astype(np.int16)
    v += np.where(raw < 128, np.int16(-129), np.int16(-126))
    v = v.reshape(-1, 64)
    planes = v[: 4 * units], v[4 * units : 5 * units], v[5 * units :]
    quant, dc_table, ac_table, eob_table = _tables()
    size = (16 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big")
    out = [b"\xff\xd8", _segment(0xFE, b"payload=%d" % len(payload)), quant, _segment(0xC2, b"\x08" + size + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])), dc_table, ac_table]
    dc = _interleaved([p[:, 0] >> 1 for p in planes], wide, high)
    steps = np.empty_like(dc)
    for cut in (slice(0, 4), slice(4, 5), slice(5, 6)):
        steps[:, cut] = np.diff(dc[:, cut].ravel(), prepend=np.int16(0)).reshape(steps[:, cut].shape)
    out.append(_scan("YBR", 0, 0, 0, 1, _close(_packed(steps, _DC_BITS, -255), 10 * steps.size)))
    for name, plane, bands in zip("YBR", planes, (((1, 5), (6, 63)), ((1, 63),), ((1, 63),)), strict=True):
        for first, last in bands:
            half = plane[:, first : last + 1]
            half = np.sign(half) * (np.abs(half) >> 1)
            out.append(_scan(name, first, last, 0, 1, _close(_packed(half, _AC_BITS, -127), 9 * half.size)))
    out.append(eob_table)
    for name, plane in zip("YBR", planes, strict=True):
        out.append(_scan(name, 1, 63, 1, 0, _refined((np.abs(plane[:, 1:]) & 1).astype(np.uint8))))
    low = _interleaved([p[:, 0] & 1 for p in planes], wide, high)
    out.append(_scan("YBR", 0, 0, 1, 0, _close(np.packbits(low.astype(np.uint8).ravel()).tobytes(), low.size)))
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """Bits of a scan's part between restarts, for reading symbol by symbol."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        word = 0
        for b in self.bits[self.at : self.at + n].tolist():
            word = word << 1 | b
        self.at += n
        return word

    def symbol(self, code: Code) -> int:
        word = length = 0
        while (length, word) not in code.read:
            if length == 16 or self.at >= len(self.bits):
                raise ValueError("no such Huffman code")
            word, length = word << 1 | int(self.bits[self.at]), length + 1
            self.at += 1
        return code.read[length, word]

    def value(self, size: int) -> int:
        v = self.take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


class Component:
    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant


class Decoder:
    """Accumulates the scans of one progressive JPEG in coefficient arrays (components' .blocks, zigzag order)."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.code: dict[int, Code] = {}
        self.components: dict[int, Component] = {}
        self.comment, self.restart = b"", 0
        at = 2
        while True:
            marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xD9:
                break
            body, at = data[at + 4 : at + 2 + n], at + 2 + n
            if marker == 0xDB:
                while body:
                    wide, step = body[0] >> 4, 1 + (body[0] >> 4)
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * step], ">u2" if wide else np.uint8).astype(np.int32)
                    body = body[1 + 64 * step :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.code[body[0]] = _code(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only progressive JPEG with Huffman codes is read")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                end = _NEXT.search(data, at).start()
                self._scan(body, [p.replace(b"\xff\x00", b"\xff") for p in _RESTART.split(data[at:end])])
                at = end

    def _frame(self, body: bytes) -> None:
        self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
        for i in range(body[5]):
            c = body[6 + 3 * i : 9 + 3 * i]
            self.components[c[0]] = Component(c[1] >> 4, c[1] & 15, c[2])
        self.h, self.v = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        self.wide, self.high = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        for c in self.components.values():
            c.blocks = np.zeros((self.high * c.v, self.wide * c.h, 64), np.int16)
            c.rows, c.cols = -(-self.height * c.v // (8 * self.v)), -(-self.width * c.h // (8 * self.h))

    def _scan(self, head: bytes, parts: list[bytes]) -> None:
        some = [(self.components[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(head[0])]
        first, last, high, low = *head[-3:-1], head[-1] >> 4, head[-1] & 15
        if len(parts) == 1 and self._whole(some, first, last, high, low, parts[0]):
            return
        units = list(self._units(some))
        for i, part in enumerate(parts):
            step = self.restart or len(units)
            self._part(units[i * step : (i + 1) * step], first, last, high, low, Bits(part))

    def _units(self, some: list) -> Iterator[list]:
        """For each unit of the scan, (component, tables, row, column) of its blocks."""
        if len(some) == 1:
            c, t = some[0]
            yield from ([(c, t, y, x)] for y in range(c.rows) for x in range(c.cols))
        else:
            yield from ([(c, t, my * c.v + y, mx * c.h + x) for c, t in some for y in range(c.v) for x in range(c.h)] for my in range(self.high) for mx in range(self.wide))

    def _whole(self, some: list, first: int, last: int, high: int, low: int, data: bytes) -> bool:
        """Reads the scan at once if each value has the same number of bits; says whether it could."""
        if len(some) == 1 and (some[0][0].rows, some[0][0].cols) != some[0][0].blocks.shape[:2]:
            return False
        if first == 0:
            codes = {t >> 4 for _, t in some}
            width = 1 if high else self.code[codes.pop()].uniform(False) if len(codes) == 1 else 0
            if not width or width > 16:
                return False
            per = [c.h * c.v if len(some) > 1 else 1 for c, _ in some]
            units = self.wide * self.high if len(some) > 1 else some[0][0].rows * some[0][0].cols
            got = _strided(data, units * sum(per), width)
            got = (got if high else _dc_values(self.code[some[0][1] >> 4], width)[got]).reshape(units, -1)
            at = 0
            for (c, _), n in zip(some, per, strict=True):
                v = got[:, at : at + n].ravel().astype(np.int32)
                at += n
                v = v << low if high else np.cumsum(v) << low
                if len(some) > 1:
                    v = v.reshape(self.high, self.wide, c.v, c.h).transpose(0, 2, 1, 3)
                v = v.reshape(c.blocks.shape[:2]).astype(np.int16)
                c.blocks[:, :, 0] = c.blocks[:, :, 0] | v if high else v
            return True
        c, t = some[0]
        band = c.blocks[:, :, first : last + 1]
        if high:
            if not band.all():
                return False
            bits, n, at, left = np.unpackbits(np.frombuffer(data, np.uint8)), last + 1 - first, 0, c.rows * c.cols
            found, reader = [], Bits(b"")
            reader.bits = bits
            while left:
                reader.at = at
                s = reader.symbol(self.code[0x10 | t & 15])
                if s & 15 or s >> 4 == 15:
                    return False
                run = min(left, (1 << (s >> 4)) + reader.take(s >> 4))
                found.append(bits[reader.at : reader.at + run * n])
                at, left = reader.at + run * n, left - run
            step = (np.concatenate(found).reshape(band.shape).astype(np.int16)) << low
            band += np.sign(band) * step
            return True
        code = self.code[0x10 | t & 15]
        width = code.uniform(True)
        if not width or width > 16:
            return False
        band[:] = (_dc_values(code, width)[_strided(data, band.size, width)] << low).reshape(band.shape)
        return True

    def _part(self, units: list, first: int, last: int, high: int, low: int, bits: Bits) -> None:
        before, run = {}, 0
        for unit in units:
            for c, t, y, x in unit:
                block = c.blocks[y, x]
                if first == 0:
                    if high:
                        block[0] |= bits.take(1) << low
                    else:
                        before[id(c)] = before.get(id(c), 0) + bits.value(bits.symbol(self.code[t >> 4]))
                        block[0] = before[id(c)] << low
                else:
                    run = (self._correct if high else self._fill)(block, self.code[0x10 | t & 15], first, last, low, run, bits)

    @staticmethod
    def _fill(block: np.ndarray, code: Code, k: int, last: int, low: int, run: int, bits: Bits) -> int:
        """First scan of a band. run: blocks, with this one, that have no more values; returns those after it."""
        while not run and k <= last:
            s = bits.symbol(code)
            zeros, size = s >> 4, s & 15
            if size:
                k += zeros
                block[k] = bits.value(size) << low
                k += 1
            elif zeros == 15:
                k += 16
            else:
                run = (1 << zeros) + bits.take(zeros)
        return max(0, run - 1)

    @staticmethod
    def _correct(block: np.ndarray, code: Code, k: int, last: int, low: int, run: int, bits: Bits) -> int:
        """Later scan of a band: a bit for each value passed that is not 0, and new values of one step."""
        while k <= last:
            zeros, new = last + 1, 0
            if not run:
                s = bits.symbol(code)
                if s & 15:
                    zeros, new = s >> 4, (1 if bits.take(1) else -1) << low
                elif s >> 4 == 15:
                    zeros = 15
                else:
                    run = (1 << (s >> 4)) + bits.take(s >> 4)
            while k <= last:
                if block[k]:
                    if bits.take(1):
                        block[k] += (1 if block[k] > 0 else -1) << low
                elif not zeros:
                    break
                else:
                    zeros -= 1
                k += 1
            if k <= last:
                block[k] = new
                k += 1
        return max(0, run - 1)

    def payload(self) -> bytes | None:
        """What encode_jpeg stored; None of other files."""
        if not self.comment.startswith(b"payload="):
            return None
        v = np.concatenate([c.blocks.reshape(-1, 64) for c in self.components.values()])
        return (v + np.where(v < 0, np.int16(129), np.int16(126))).astype(np.uint8).tobytes()[: int(self.comment[8:])]

    def rgb(self) -> np.ndarray:
        """height x width x 3, 8-bit: transform, chroma repeated up to full resolution, colours by integer arithmetic. One component gives grey."""
        planes = []
        for c in self.components.values():
            blocks, rows = c.blocks.reshape(-1, 64), c.blocks.shape[0]
            quant = self.quant[c.quant]
            out = np.empty(blocks.shape, np.uint8)
            for i in range(0, len(blocks), BLOCKS):
                x = (blocks[i : i + BLOCKS] * quant).astype(np.float64) @ _transform()
                out[i : i + BLOCKS] = np.clip(np.floor((x + 32768) / 65536) + 128, 0, 255)
            plane = out.reshape(rows, -1, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, -1)
            if (c.v, c.h) != (self.v, self.h):
                plane = plane.repeat(self.v // c.v, 0).repeat(self.h // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, 2)
        y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
        half = 32768  # of 2**-16; the factors are 1.402, 0.344136, 0.714136 and 1.772
        out = np.empty((*y.shape, 3), np.uint8)
        out[:, :, 0] = np.clip(y + ((91881 * cr + half) >> 16), 0, 255)
        out[:, :, 1] = np.clip(y + ((-22554 * cb - 46802 * cr + half) >> 16), 0, 255)
        out[:, :, 2] = np.clip(y + ((116130 * cb + half) >> 16), 0, 255)
        return out


_NEXT = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


@lru_cache(256)
def _code(counts: bytes, symbols: bytes) -> Code:
    return Code(list(counts), symbols)


@lru_cache(64)
def _dc_values(code: Code, width: int) -> np.ndarray:
    return _values_of(code, width)


def _strided(data: bytes, n: int, width: int) -> np.ndarray:
    """The first n numbers of so many bits."""
    raw, weights = np.frombuffer(data, np.uint8), (1 << np.arange(width - 1, -1, -1)).astype(np.float32)
    out = np.empty(n, np.uint16)
    for i in range(0, n, PACK):
        m = min(PACK, n - i)
        bits = np.unpackbits(raw[i * width // 8 :], count=m * width).reshape(m, width) if width > 1 else np.unpackbits(raw[i // 8 :], count=m)
        out[i : i + m] = bits if width == 1 else bits.astype(np.float32) @ weights
    return out


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length, and the bytes filled up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (unpadded) and media (the JPEG) of every whole text. A null text is an empty one, which is one unit of bytes 255;
    rows that repeat stay as they are; an empty table gives no rows. Other columns of docs are ignored. Equal texts have equal media."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = [padded(t.as_py()) for t in batch["_text"].slice(at, 256)]
                media = pa.array([encode_jpeg(p) for _, p in made], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["_id"].slice(at, 256), pa.array([n for n, _ in made], pa.int64()), media], names=[id_col, "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(lean(encode), f"{id_col} {kind}, n_bytes long, media binary")


def feature_of(rgb: np.ndarray) -> str:
    """Height x width, mean of each channel, and the start of the tensor's digest."""
    means = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (rgb.size // 3)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{','.join(f'{m:.3f}' for m in means)}:{hashlib.sha256(rgb).hexdigest()[:16]}"


def decode_media(stored: DataFrame, id_col: str = "doc_id", tensors: bool = True) -> DataFrame:
    """Adds payload (null of files that encode_jpeg did not make), height, width, feature and, if asked for, rgb (binary: height x width x 3, 8-bit) to id, n_bytes and media. A null medium has nulls."""

    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.string(), pa.binary())[: 5 if tensors else 4]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, held = 0, [], 0
            for k, m in enumerate(batch["media"], 1):
                if (data := m.as_py()) is None:
                    rows.append((None,) * len(kinds))
                else:
                    d = Decoder(data)
                    rgb = d.rgb()
                    rows.append((d.payload(), *rgb.shape[:2], feature_of(rgb), *([rgb.tobytes()] if tensors else [])))
                    held += rgb.size
                if held > 1 << 22 or k == batch.num_rows:  # tensors of a few MB at a time
                    part = batch.slice(at, k - at)
                    made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "payload", "height", "width", "feature", *["rgb"] * tensors])
                    at, rows, held = k, [], 0

    kind = dict(stored.dtypes)[id_col]
    schema = f"{id_col} {kind}, n_bytes long, media binary, payload binary, height int, width int, feature string" + ", rgb binary" * tensors
    return stored.select(id_col, "n_bytes", "media").mapInArrow(lean(decode), schema)


def op2_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is a table in the shared folder; what is read from it gives payloads, features and the tensors (rgb), which the result carries."""
    stored = written(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return decode_media(stored).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb",
    )
