"""Progressive JPEG: a reader into coefficients, pixels and features, and a lossless store.

The reader accumulates spectral-selection and successive-approximation scans
(ITU-T T.81, annex G, Huffman-coded) into coefficient arrays, inverts the
transform in numpy, upsamples chroma and gives full-resolution RGB tensors.

The store keeps a payload byte as a coefficient, 64 a block: byte b is 256 + b
for the block's DC and b - 255 (b < 128) or b for its 63 ACs. Quantisation is 1,
so the coefficients come back exactly. All ACs then have one magnitude category,
and so have the DCs, which are written with a restart after each block; one-bit
codes suffice, every coefficient takes a fixed number of bits, and numpy reads
such scans as arrays. Files of any other shape are read bit by bit.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orbweave.llm.common import map_columns, texts

#: The zigzag order of an 8 x 8 block: by antidiagonal, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
#: Bands of the first AC scans.
BANDS = ((1, 5), (6, 63))
#: Sampling factors of Y, Cb and Cr in the store.
SAMPLING = ((2, 2), (1, 1), (1, 1))

_BASIS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])
#: From coefficients in zigzag order to pixels of a block.
_INVERSE = np.einsum("ux,vy->uvxy", _BASIS, _BASIS).reshape(64, 64)[ZIGZAG].astype(np.float32)


# --- writing -------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(data: np.ndarray) -> bytes:
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def encode(payload: bytes) -> bytes:
    """A progressive JPEG that keeps the payload, whose length is a positive multiple of 64."""
    blocks = len(payload) // 64
    mcus = -(-blocks // 6)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    data = np.zeros((6 * wide * high, 64), np.uint8)
    data[:blocks] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    n = wide * high
    planes = (data[: 4 * n], data[4 * n : 5 * n], data[5 * n :])
    frame = struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"".join(bytes([c + 1, h << 4 | v, 0]) for c, (h, v) in enumerate(SAMPLING))
    one_code = lambda kind, symbol: bytes([kind, 1, *[0] * 15, symbol])
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload" + struct.pack(">Q", len(payload))),
        _segment(0xDB, bytes([0]) + bytes([1]) * 64),
        _segment(0xC2, frame),
        _segment(0xC4, one_code(0x00, 9) + one_code(0x10, 0x07) + one_code(0x11, 0x00)),
        _segment(0xDD, struct.pack(">H", 1)),
    ]

    def scan(c: int, table: int, band: tuple[int, int], approx: int, body: bytes) -> None:
        out.append(_segment(0xDA, bytes([1, c + 1, table, *band, approx])) + body)

    for c, plane in enumerate(planes):
        value = plane[:, 0].astype(np.uint16) + 256
        pairs = np.stack([(value >> 2).astype(np.uint8), ((value << 6) | 63).astype(np.uint8)], 1)
        # Each block: 0, nine bits, ones up to the byte; then a restart marker but after the last.
        full = np.zeros((len(plane), 5), np.uint8)
        full[:, :2], full[:, 3], full[:, 4] = pairs, 0xFF, 0xD0 | np.arange(len(plane)) % 8
        keep = np.ones((len(plane), 5), bool)
        keep[:, 2] = full[:, 1] == 0xFF
        keep[-1, 3:] = False
        scan(c, 0x00, (0, 0), 0, full[keep].tobytes())
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    signs = [plane[:, 1:] for plane in planes]
    for c, b in enumerate(signs):
        # Magnitude / 2 with its sign, as category 7: the value itself, or less 1 when negative.
        first = (b >> 1).astype(np.uint8)
        first[b < 128] = (127 - ((255 - b[b < 128].astype(np.int16)) >> 1)).astype(np.uint8)
        for low, high_ in BANDS:
            scan(c, 0x00, (low, high_), 0x01, first[:, low - 1 : high_].tobytes())
    for c, b in enumerate(signs):
        last = np.where(b < 128, ~b, b) & 1
        bits = np.zeros((len(b), 64), np.uint8)
        bits[:, 1:] = last
        scan(c, 0x01, (1, 63), 0x10, _stuffed(np.packbits(bits, axis=1)))
    return b"".join([*out, b"\xff\xd9"])


# --- reading -------------------------------------------------------------


class _Component:
    def __init__(self, h: int, v: int, quant: int):
        self.h, self.v, self.quant = h, v, quant


class _Bits:
    """Bits of one restart interval, stuffing removed; ones after the end."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data + b"\xff" * 4, "big"), 8 * len(data) + 32

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise ValueError("the scan's data ends early")
        return (self.value >> self.left) & ((1 << n) - 1)


class _Codes:
    def __init__(self, counts: bytes, symbols: bytes):
        self.symbols, self.by_code, code, at = symbols, {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.by_code[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        self.only = (next(iter(self.by_code))[0], symbols[0]) if len(symbols) == 1 else None

    def read(self, bits: _Bits) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits.take(1)
            found = self.by_code.get((length, code))
            if found is not None:
                return found
        raise ValueError("no such Huffman code")


def _signed(bits: int, size: int) -> int:
    return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


class Image:
    """A progressive JPEG's coefficients (zigzag order, one row a block), and what follows from them."""

    def __init__(self, data: bytes):
        self.payload_bytes: int | None = None
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, _Codes] = {}
        self.components: dict[int, _Component] = {}
        self.restart = 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while True:
            while data[at] == 0xFF and data[at + 1] == 0xFF:
                at += 1
            marker = data[at + 1]
            if marker == 0xD9:
                return
            size = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xFE and body[:7] == b"payload":
                self.payload_bytes = struct.unpack(">Q", body[7:])[0]
            elif marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._frame(body)
            elif marker == 0xDA:
                at = self._scan(data, at, body)
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a progressive Huffman-coded JPEG")

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            n = 64 * (1 + wide)
            self.quant[name] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.int32)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            n = sum(counts)
            self.codes[body[at]] = _Codes(counts, body[at + 17 : at + 17 + n])
            at += 17 + n

    def _frame(self, body: bytes) -> None:
        _, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        for i in range(n):
            name, factors, quant = body[6 + 3 * i : 9 + 3 * i]
            self.components[name] = _Component(factors >> 4, factors & 15, quant)
        self.hmax, self.vmax = max(c.h for c in self.components.values()), max(c.v for c in self.components.values())
        self.mcus = (-(-self.height // (8 * self.vmax)), -(-self.width // (8 * self.hmax)))
        for c in self.components.values():
            c.rows, c.cols = self.mcus[0] * c.v, self.mcus[1] * c.h
            # What a scan of this component alone covers.
            c.own = (-(-(-(-self.height * c.v // self.vmax)) // 8), -(-(-(-self.width * c.h // self.hmax)) // 8))
            c.coefficients = np.zeros((c.rows * c.cols, 64), np.int16)

    def _scan(self, data: bytes, at: int, body: bytes) -> int:
        n = body[0]
        names, tables = [body[1 + 2 * i] for i in range(n)], [body[2 + 2 * i] for i in range(n)]
        low, high, approx = body[1 + 2 * n : 4 + 2 * n]
        before, bit = approx >> 4, approx & 15
        end = at
        while True:  # data ends at a marker that is neither stuffing nor a restart
            end = data.index(b"\xff", end)
            if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
                break
            end += 2
        coded = data[at:end]
        if not (n == 1 and self._fixed(self.components[names[0]], tables[0], low, high, before, bit, coded)):
            self._bitwise(names, tables, low, high, before, bit, coded)
        return end

    def _fixed(self, c: _Component, table: int, low: int, high: int, before: int, bit: int, coded: bytes) -> bool:
        """Read a scan in which every coefficient takes as many bits; False if it isn't one."""
        n, band = len(c.coefficients), high - low + 1
        if c.own != (c.rows, c.cols):
            return False
        codes = self.codes.get(table >> 4) if low == 0 else self.codes.get(0x10 | (table & 15))
        if codes is None or codes.only is None or codes.only[0] != 1:
            return False
        size = codes.only[1]
        raw = np.frombuffer(coded, np.uint8)
        if low == 0 and high == 0 and not before and self.restart == 1 and 0 < size <= 15:
            marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7))
            keep = np.ones(len(raw), bool)
            keep[marks] = keep[marks + 1] = False
            stuffing = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
            keep[stuffing] = False
            width = (1 + size + 7) // 8
            if len(marks) != n - 1 or int(keep.sum()) != width * n:
                return False
            value = np.zeros(n, np.int64)
            for column in raw[keep].reshape(n, width).T:
                value = value << 8 | column
            value = (value >> (8 * width - 1 - size)) & ((1 << size) - 1)
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
            c.coefficients[:, 0] = value << bit
            return True
        if self.restart:
            return False
        if low and not before and size == 7 and len(raw) == n * band and not (raw & 0x80).any():
            value = raw.reshape(n, band).astype(np.int16)
            value -= np.where(value < 64, np.int16(127), np.int16(0))
            c.coefficients[:, low : high + 1] = value << bit
            return True
        if low == 1 and high == 63 and before == bit + 1 and size == 0 and (c.coefficients[:, 1:] != 0).all():
            keep = np.ones(len(raw), bool)
            keep[1:] = ~((raw[:-1] == 0xFF) & (raw[1:] == 0))
            raw = raw[keep]
            if len(raw) != 8 * n:
                return False
            more = np.unpackbits(raw.reshape(n, 8), axis=1)[:, 1:].astype(np.int16) << bit
            own = c.coefficients[:, 1:]
            own += np.where(own > 0, more, -more)
            return True
        return False

    def _bitwise(self, names: list[int], tables: list[int], low: int, high: int, before: int, bit: int, coded: bytes) -> None:
        intervals, start, at = [], 0, coded.find(b"\xff")
        while at >= 0:
            if coded[at + 1] != 0:
                intervals.append(coded[start:at].replace(b"\xff\x00", b"\xff"))
                start = at + 2
            at = coded.find(b"\xff", at + 2)
        intervals.append(coded[start:].replace(b"\xff\x00", b"\xff"))
        own = [self.components[x] for x in names]
        if len(own) == 1:
            rows, cols = own[0].own
            units = [[(0, y * own[0].cols + x)] for y in range(rows) for x in range(cols)]
        else:
            units = [
                [(i, (my * c.v + y) * c.cols + mx * c.h + x) for i, c in enumerate(own) for y in range(c.v) for x in range(c.h)]
                for my in range(self.mcus[0])
                for mx in range(self.mcus[1])
            ]
        each = self.restart or len(units)
        for k, interval in enumerate(intervals):
            bits, last, run = _Bits(interval), [0] * len(own), 0
            for unit in units[k * each : (k + 1) * each]:
                for i, block in unit:
                    coefficients = own[i].coefficients[block]
                    if low == 0:
                        if before:
                            coefficients[0] |= bits.take(1) << bit
                        else:
                            size = self.codes[tables[i] >> 4].read(bits)
                            last[i] += _signed(bits.take(size), size)
                            coefficients[0] = last[i] << bit
                    elif before:
                        run = self._refine(bits, self.codes[0x10 | (tables[i] & 15)], coefficients, low, high, bit, run)
                    else:
                        run = self._first(bits, self.codes[0x10 | (tables[i] & 15)], coefficients, low, high, bit, run)

    @staticmethod
    def _first(bits: _Bits, codes: _Codes, out: np.ndarray, low: int, high: int, bit: int, run: int) -> int:
        """One block of a first AC scan; `run` blocks are empty, this one included if it's positive."""
        if run:
            return run - 1
        k = low
        while k <= high:
            zeros, size = divmod(codes.read(bits), 16)
            if size:
                k += zeros
                out[k] = _signed(bits.take(size), size) << bit
                k += 1
            elif zeros == 15:
                k += 16
            else:
                return (1 << zeros) + bits.take(zeros) - 1
        return 0

    @staticmethod
    def _refine(bits: _Bits, codes: _Codes, out: np.ndarray, low: int, high: int, bit: int, run: int) -> int:
        """One block of a refining AC scan."""
        step = 1 << bit

        def correct(k: int) -> None:
            if bits.take(1):
                out[k] += step if out[k] > 0 else -step

        k = low
        if not run:
            while k <= high:
                zeros, size = divmod(codes.read(bits), 16)
                value = 0
                if size:
                    value = step if bits.take(1) else -step
                elif zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                while k <= high:
                    if out[k]:
                        correct(k)
                    elif zeros == 0:
                        break
                    else:
                        zeros -= 1
                    k += 1
                if value and k <= high:
                    out[k] = value
                k += 1
        if run:
            for j in range(k, high + 1):
                if out[j]:
                    correct(j)
            run -= 1
        return run

    def payload(self) -> bytes:
        """What the store kept."""
        if self.payload_bytes is None:
            raise ValueError("this image isn't a stored payload")
        parts = []
        for c in self.components.values():
            data = np.empty(c.coefficients.shape, np.uint8)
            data[:, 0] = c.coefficients[:, 0] - 256
            ac = c.coefficients[:, 1:]
            data[:, 1:] = ac + np.where(ac < 0, np.int16(255), np.int16(0))
            parts.append(data)
        return np.concatenate(parts).tobytes()[: self.payload_bytes]

    def rgb(self) -> np.ndarray:
        """The pixels: height x width x 3, 8-bit."""
        planes = []
        for c in self.components.values():
            blocks = (c.coefficients * self.quant[c.quant].astype(np.int32)).astype(np.float32) @ _INVERSE
            plane = blocks.reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.cols)
            plane = np.clip(np.rint(plane) + 128, 0, 255)
            plane = plane.repeat(self.vmax // c.v, 0).repeat(self.hmax // c.h, 1)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            return np.repeat(planes[0].astype(np.uint8)[:, :, None], 3, 2)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, channel in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[:, :, i] = np.clip(np.rint(channel), 0, 255)
        return out


def feature(rgb: np.ndarray) -> str:
    """Size, and each channel's mean and quartile counts, from the tensor's integers alone."""
    n = rgb.shape[0] * rgb.shape[1]
    parts = [f"{rgb.shape[1]}x{rgb.shape[0]}"]
    for i in range(3):
        counts = np.bincount(rgb[:, :, i].ravel(), minlength=256)
        parts.append(f"{int(counts @ np.arange(256)) / n:.4f}:" + "/".join(map(str, counts.reshape(4, 64).sum(1).tolist())))
    return ";".join(parts)


# --- columns -------------------------------------------------------------


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 with zeros up to a positive multiple of 64, and its length without them."""
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 if raw else 64), len(raw)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """Store whole texts as progressive JPEGs and read them back.

    One row for each input row, repeated ones too: the id column, n_bytes,
    payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature, all but n_bytes and media_* from the bytes read back; with `media`
    also media (binary, the JPEG). A null text counts as empty and is stored as
    64 zeros; a null id stays null; other columns are ignored. Equal texts give
    equal values.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            rows: list[tuple] = []
            for text in texts(batch, text_col):
                payload, n = padded(text)
                stored = encode(payload)
                image = Image(stored)
                back = image.payload()
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image.rgb()), stored if media else None))
            names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media")
            return {id_col: batch.column(id_col)} | {c: list(v) for c, v in zip(names, zip(*rows, strict=True), strict=True)}

        return step

    return map_columns(docs.select(id_col, text_col), make, schema, text_col)


def decode_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """All columns but the media, and height, width and rgb (binary, row-major 8-bit
    triples). Null media give nulls; bytes that aren't a progressive Huffman-coded
    JPEG fail with a ValueError. Columns of those names are replaced."""
    kept = df.drop("height", "width", "rgb")
    names = [c for c in kept.columns if c != media_col]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != media_col)

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            tensors = [None if m is None else Image(m).rgb() for m in batch.column(media_col).to_pylist()]
            got = {
                "height": [None if t is None else t.shape[0] for t in tensors],
                "width": [None if t is None else t.shape[1] for t in tensors],
                "rgb": [None if t is None else t.tobytes() for t in tensors],
            }
            return {c: batch.column(c) for c in names} | got

        return step

    return map_columns(kept, make, f"{out}, height int, width int, rgb binary", None)
