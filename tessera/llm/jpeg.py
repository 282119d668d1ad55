"""Baseline JPEG with numpy: a lossless block form for bytes, and a general decoder for intra frames.

Lossless form: each payload byte is one 8x8 block of that grey value.  With a DC quantiser of 8 and level shift 128 the
DC coefficient of such a block is exactly byte - 128, and all AC coefficients are zero, so a standard decoder gives the
bytes back.  The frame's own DC Huffman table gives category c a code of 9 - c bits, so that every difference takes 9 bits
in all (the code lengths fill the tree up to the one all-ones code that the standard forbids), and the one AC symbol, end
of block, takes 1 bit: 10 bits a byte, which numpy packs and unpacks without a loop.
"""

from __future__ import annotations

import struct

import numpy as np

#: Order in which a block's coefficients are coded: along the anti-diagonals of the 8x8 grid, turning at the borders.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
DC_LENGTHS = bytes([1] * 9 + [0] * 7)
DC_SYMBOLS = bytes(range(8, -1, -1))
#: Codes of the categories 8, 7, ... 0: 0, 10, 110, ...
DC_CODES = {8 - k: (((1 << k) - 1) << 1, k + 1) for k in range(9)}


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def head(rows: int, cols: int) -> bytes:
    """Everything before the entropy-coded data of a grey frame of rows x cols blocks."""
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\x00" + bytes([8] + [1] * 63))
        + segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, cols * 8, 1, 1, 0x11, 0))
        + segment(0xC4, b"\x00" + DC_LENGTHS + DC_SYMBOLS)
        + segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00")
        + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def code_table() -> np.ndarray:
    """10-bit code (difference and end of block) by difference + 255."""
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code, _ = DC_CODES[c]
        value = d if d >= 0 else d + (1 << c) - 1
        out[d + 255] = ((code << c) | value) << 1
    return out


CODES = code_table()
DIFFERENCES = np.full(512, 0, np.int16)
DIFFERENCES[CODES >> 1] = np.arange(-255, 256)


def encode_bytes(samples: np.ndarray, cols: int = 64) -> bytes:
    """A grey JPEG whose blocks, row by row, are the samples; their number is a multiple of `cols`."""
    values = samples.astype(np.int16)
    codes = CODES[np.diff(values, prepend=np.int16(128)) + 255].astype(np.uint64)
    quads = codes.reshape(-1, 4)
    packed = (quads[:, 0] << np.uint64(30)) | (quads[:, 1] << np.uint64(20)) | (quads[:, 2] << np.uint64(10)) | quads[:, 3]
    body = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    return head(len(samples) // cols, cols) + body.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


class Frame:
    """A parsed baseline frame: tables, geometry and unstuffed scan data."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.quant, self.huffman, self.components, self.restart, at = {}, {}, [], 0, 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("broken marker in a JPEG frame")
            marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide, n = body[0] >> 4, 128 if body[0] >> 4 else 64
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[1 + n :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0 or marker == 0xC1:
                _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                self.components = [[c[0], c[1] >> 4, c[1] & 15, c[2], 0, 0] for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(n))]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                for i in range(body[0]):
                    for c in self.components:
                        if c[0] == body[1 + 2 * i]:
                            c[4], c[5] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                break
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("only baseline JPEG frames are decoded")
        end = data.rfind(b"\xff\xd9")
        self.scan = data[at : end if end >= at else len(data)]

    @property
    def block_form(self) -> bool:
        """Whether the frame is of the lossless block form."""
        return len(self.components) == 1 and not self.restart and self.huffman.get(0) == (DC_LENGTHS, DC_SYMBOLS) and self.huffman.get(0x10) == (bytes([1] + [0] * 15), b"\x00") and self.quant[self.components[0][3]][0] == 8

    def samples(self) -> np.ndarray:
        """The payload bytes of a frame of the lossless block form."""
        raw = np.frombuffer(self.scan.replace(b"\xff\x00", b"\xff"), np.uint8)
        n = (self.height // 8) * (self.width // 8)
        wide = np.zeros((n // 4, 8), np.uint8)
        wide[:, 3:] = raw[: n // 4 * 5].reshape(-1, 5)
        packed = wide.view(">u8").ravel().astype(np.uint64)
        codes = np.stack([(packed >> np.uint64(s)) & np.uint64(1023) for s in (30, 20, 10, 0)], axis=1).ravel()
        return (np.cumsum(DIFFERENCES[codes >> np.uint64(1)].astype(np.int64)) + 128).astype(np.uint8)

    def luma(self) -> np.ndarray:
        """The first component's pixels, height x width, of any baseline frame (Huffman decoding, dequantising, IDCT)."""
        if self.block_form:
            return np.kron(self.samples().reshape(self.height // 8, self.width // 8), np.ones((8, 8), np.uint8))
        return decode_first(self)


def lookup(table: tuple[bytes, bytes]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(table[0], 1):
        for _ in range(n):
            out[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.hold, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            self.hold = (self.hold << 8) | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at, self.n = self.at + 1, self.n + 8
        self.n -= n
        out = self.hold >> self.n
        self.hold &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = (code << 1) | self.take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("broken Huffman code in a JPEG frame")

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def decode_first(frame: Frame) -> np.ndarray:
    """Decode every component's blocks in scan order and build the first one's pixels."""
    tables = {k: lookup(v) for k, v in frame.huffman.items()}
    hmax, vmax = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    single = len(frame.components) == 1
    if single:
        hmax = vmax = frame.components[0][1] = frame.components[0][2] = 1
    across, down = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
    first = frame.components[0]
    blocks = np.zeros((down * first[2], across * first[1], 64))
    units, order = restart_parts(frame.scan, frame.restart), ZIGZAG
    bits, left, before = Bits(next(units)), frame.restart, [0] * len(frame.components)
    for mcu in range(across * down):
        if frame.restart and not left:
            bits, left, before = Bits(next(units)), frame.restart, [0] * len(frame.components)
        left -= 1
        for k, (_, h, v, q, dc, ac) in enumerate(frame.components):
            for y in range(v):
                for x in range(h):
                    block = np.zeros(64)
                    before[k] += bits.signed(bits.symbol(tables[dc]))
                    block[0] = before[k] * frame.quant[q][0]
                    i = 1
                    while i < 64:
                        symbol = bits.symbol(tables[0x10 | ac])
                        run, size = symbol >> 4, symbol & 15
                        if not size and run != 15:
                            break
                        i += run
                        if size and i < 64:
                            block[order[i]] = bits.signed(size) * frame.quant[q][i]
                        i += 1
                    if not k:
                        blocks[mcu // across * v + y, mcu % across * h + x] = block
    u = np.arange(8)
    basis = np.cos((2 * u[None, :] + 1) * u[:, None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)[:, None]
    pixels = np.einsum("ui,yxuv,vj->yixj", basis, blocks.reshape(*blocks.shape[:2], 8, 8), basis)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    return pixels[: -(-frame.height * first[2] // vmax), : -(-frame.width * first[1] // hmax)]


def restart_parts(scan: bytes, restart: int):
    """The scan's parts between restart markers."""
    start = at = 0
    while restart and (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            yield scan[start:at]
            start = at + 2
        at += 2
    yield scan[start:]
