"""Baseline JPEG encoding of image tiles (grey or colour), for readers that want JPEG rather than PNG.

Quantisers grow with frequency by a rule; Huffman codes are of one length per table (4 bits for DC categories, 8 for AC
symbols), which every decoder reads; files are somewhat larger than with tuned tables.
"""

from __future__ import annotations

import struct

import numpy as np

#: Coefficients in coding order: along anti-diagonals, turning at the borders.
ORDER = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
AC_SYMBOLS = [0x00, 0xF0, *((run << 4) | size for run in range(16) for size in range(1, 11))]
AC_CODE = {symbol: code for code, symbol in enumerate(AC_SYMBOLS)}


def quantiser(quality: int) -> np.ndarray:
    """Steps in natural order, from fine to coarse with the frequency; `quality` 1 to 100."""
    u = np.arange(8)
    return np.clip(np.rint((1 + (u[:, None] + u[None, :]) * 2) * (101 - quality) / 12), 1, 255).astype(np.int64)


def basis() -> np.ndarray:
    u = np.arange(8)
    return np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]


def blocks_of(plane: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Quantised coefficients of a plane's blocks in coding order, (down, across, 64); borders are repeated to whole blocks."""
    rows, cols = plane.shape
    padded = np.pad(plane, ((0, -rows % 8), (0, -cols % 8)), mode="edge").astype(float) - 128
    cells = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8)
    waves = np.einsum("ui,yixj,vj->yxuv", basis(), cells, basis())
    return np.rint(waves / steps).astype(np.int64).reshape(*waves.shape[:2], 64)[:, :, ORDER]


class Writer:
    def __init__(self):
        self.parts, self.hold, self.n = bytearray(), 0, 0

    def put(self, value: int, n: int) -> None:
        self.hold, self.n = (self.hold << n) | value, self.n + n
        while self.n >= 8:
            self.n -= 8
            byte = (self.hold >> self.n) & 255
            self.parts += b"\xff\0" if byte == 255 else bytes([byte])
        self.hold &= (1 << self.n) - 1

    def number(self, value: int, size: int) -> None:
        if size:
            self.put(value if value > 0 else value + (1 << size) - 1, size)

    def done(self) -> bytes:
        if self.n:
            self.put((1 << (8 - self.n)) - 1, 8 - self.n)
        return bytes(self.parts)


def put_block(out: Writer, block: list[int], before: int) -> None:
    step = block[0] - before
    size = abs(step).bit_length()
    out.put(size, 4)
    out.number(step, size)
    run = 0
    last = max((i for i in range(1, 64) if block[i]), default=0)
    for value in block[1 : last + 1]:
        if not value:
            run += 1
            continue
        while run > 15:
            out.put(AC_CODE[0xF0], 8)
            run -= 16
        size = abs(value).bit_length()
        out.put(AC_CODE[(run << 4) | size], 8)
        out.number(value, size)
        run = 0
    if last < 63:
        out.put(AC_CODE[0x00], 8)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg(pixels: np.ndarray, quality: int = 95) -> bytes:
    """A JPEG of (rows, cols, bands) 8-bit pixels: grey from one or two bands, else colour from the first three."""
    rows, cols, bands = pixels.shape
    steps = quantiser(quality)
    if bands < 3:
        planes = [pixels[:, :, 0].astype(float)]
    else:
        r, g, b = (pixels[:, :, i].astype(float) for i in range(3))
        luma = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [luma, (b - luma) / 1.772 + 128, (r - luma) / 1.402 + 128]
    coded = [blocks_of(p, steps) for p in planes]
    n = len(planes)
    out, before = Writer(), [0] * n
    for y in range(coded[0].shape[0]):
        for x in range(coded[0].shape[1]):
            for k in range(n):
                block = coded[k][y, x].tolist()
                put_block(out, block, before[k])
                before[k] = block[0]
    frame = struct.pack(">BHHB", 8, rows, cols, n) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n))
    scan = bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + bytes([0, 63, 0])
    dc = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    ac = bytes([0] * 7 + [len(AC_SYMBOLS)] + [0] * 8) + bytes(AC_SYMBOLS)
    return (
        b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, b"\0" + bytes(steps.ravel()[ORDER].tolist())) + segment(0xC0, frame)
        + segment(0xC4, b"\0" + dc) + segment(0xC4, b"\x10" + ac) + segment(0xDA, scan) + out.done() + b"\xff\xd9"
    )
