"""op2's tensors against a plain inverse transform of the coefficients, chroma repeated and colours converted in floating point."""

import math

import numpy as np
import pytest

from kelpforge.llm.jpeg import Decoder, encode_jpeg, padded


#: Row and column of each coefficient as files have them: along the diagonals, in turns.
ORDER = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))


def plain_block(coefficients):
    """8 x 8 samples of 64 dequantised coefficients, by the defining sum."""
    c = [math.sqrt(0.5)] + [1.0] * 7
    basis = [[c[u] * math.cos((2 * x + 1) * u * math.pi / 16) / 2 for u in range(8)] for x in range(8)]
    f = np.zeros((8, 8))
    for (y, x), v in zip(ORDER, coefficients, strict=True):
        f[y, x] = v
    b = np.array(basis)
    return b @ f @ b.T + 128


@pytest.mark.parametrize("text", ["", "short", "mixed ünïcödé 😀 text " * 60, "x" * 3000, "".join(chr(33 + i * i % 90) for i in range(2500))])
def test_tensor(text):
    payload = padded(text)[1]
    d = Decoder(encode_jpeg(payload))
    assert d.payload() == payload
    planes = []
    for c in d.components.values():
        rows, quant = c.blocks.shape[0], np.asarray(d.quant[c.quant], float).reshape(64)
        blocks = c.blocks.reshape(-1, 64)
        plane = np.zeros((rows * 8, len(blocks) // rows * 8))
        for i, b in enumerate(blocks):
            y, x = divmod(i, len(blocks) // rows)
            plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = plain_block(b * quant)
        plane = np.clip(plane, 0, 255)
        up, across = d.v // c.v, d.h // c.h
        full = np.array([[plane[i // up, j // across] for j in range(d.width)] for i in range(d.height)])
        planes.append(full)
    y, cb, cr = planes
    want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2).clip(0, 255)
    got = d.rgb()
    assert got.shape == (d.height, d.width, 3) and got.dtype == np.uint8
    assert np.abs(got.astype(float) - want).max() <= 2.5  # samples are rounded before colours are converted
    assert want.std() > 1 or not text
