"""Media columns: progressive JPEG, written and read with numpy.

Reading accumulates the scans (spectral selection and successive approximation) into arrays of
quantised DCT coefficients, applies the inverse transform as one matrix product, upsamples the
chroma and converts to a full-resolution RGB tensor. Any progressive Huffman-coded JPEG of 8 bits
with 1 or 3 components is read. Scans whose symbols all have the same length, as written here, are
unpacked at once; other scans are read bit by bit.

`store_payload` keeps bytes losslessly as coefficients, 64 bytes a block of 4:2:0 YCbCr. A byte b
at AC positions is the coefficient b (128 and up) or b - 255, whose magnitude always has 8 bits, so
that its first scan (all but the lowest bit) is one byte holding b >> 1, and its refinement one bit.

Null text counts as empty; every row yields one row, repeated ones equal values; columns other than
doc_id and text are not read. A text may have up to 2 GB less what a JPEG's 16-bit sides allow.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def zigzag_order() -> np.ndarray:
    """Row-major place of the k-th coefficient of a scan."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = zigzag_order()


def inverse_dct_matrix() -> np.ndarray:
    """64 x 64: row-major coefficients of a block times this are its samples, row-major, less 128."""
    k = np.arange(8)
    one = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    return np.kron(one, one).T.astype(np.float32)


IDCT = inverse_dct_matrix()


@dataclass
class Component:
    ident: int
    h: int
    v: int
    table: int
    blocks: np.ndarray | None = None  # rows x columns x 64 coefficients, in zigzag order
    wide: int = 0  # blocks in a row, and rows of them, without those that only fill MCUs
    high: int = 0


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)


# Writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _stuffed(data: np.ndarray) -> bytes:
    raw = data.tobytes()
    return raw.replace(b"\xff", b"\xff\x00")


def _packed(bits: np.ndarray) -> bytes:
    """Bits as bytes, the last filled with ones."""
    fill = -len(bits) % 8
    return _stuffed(np.packbits(np.concatenate((bits, np.ones(fill, np.uint8))) if fill else bits))


def _scan(components: list[int], tables: int, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components), *(x for c in components for x in (c, tables)), first, last, high << 4 | low]))


#: Fixed-length Huffman tables: class and number, then lengths and symbols.
_DC_TABLE = _segment(0xC4, bytes([0x00, 1, *[0] * 15, 7]))
_AC_TABLE = _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0x07]))
_EOB_TABLE = _segment(0xC4, bytes([0x11, 0, 0, 0, 15, *[0] * 12, *(r << 4 for r in range(15))]))
_QUANT = _segment(0xDB, bytes([0, *[1] * 64]))


def _runs(blocks: int) -> list[int]:
    out = []
    while blocks:
        out.append(min(blocks, 32767))
        blocks -= out[-1]
    return out


def _bits(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


def _grid(blocks: int) -> tuple[int, int]:
    """MCUs in a row, and rows, for so many 4:2:0 MCUs."""
    wide = max(1, min(4095, int(np.ceil(np.sqrt(blocks)))))
    return wide, -(-blocks // wide)


def store_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients are the bytes of the payload, whose length is a positive multiple of 64."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload's length must be a positive multiple of 64")
    used = len(payload) // 64
    mcus = -(-used // 6)
    wide, high = _grid(mcus)
    if high > 4095:
        raise ValueError("the payload is too long for one JPEG")
    total = wide * high * 6
    data = np.zeros((total, 64), np.uint8)
    data[:used] = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    luma = wide * high * 4
    parts = {1: data[:luma], 2: data[luma : luma + wide * high], 3: data[luma + wide * high :]}
    frame = struct.pack(">BHHB", 8, high * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    out = [b"\xff\xd8", _segment(0xFE, f"payload={len(payload)}".encode()), _QUANT, _segment(0xC2, frame), _DC_TABLE, _AC_TABLE, _EOB_TABLE]
    # DC, all but the lowest bit: each block is an interval of its own, so that its difference is its value
    out.append(_segment(0xDD, struct.pack(">H", 1)))
    for c, part in parts.items():
        n = len(part)
        body = np.empty((n, 3), np.uint8)
        body[:, 0] = part[:, 0] >> 1
        body[:, 1] = 0xFF
        body[:, 2] = 0xD0 + np.arange(n) % 8
        out += [_scan([c], 0x00, 0, 0, 0, 1), body.tobytes()[:-2]]
    out.append(_segment(0xDD, struct.pack(">H", 0)))
    # AC, all but the lowest bit, in two bands
    for first, last in ((1, 5), (6, 63)):
        for c, part in parts.items():
            out += [_scan([c], 0x00, first, last, 0, 1), (part[:, first : last + 1] >> 1).tobytes()]
    # lowest bits: of DC, then of AC, whose blocks belong to runs of "no new coefficient"
    for c, part in parts.items():
        out += [_scan([c], 0x00, 0, 0, 1, 0), _packed(part[:, 0] & 1)]
    for c, part in parts.items():
        # a correction bit is the lowest bit of the magnitude, which is 255 - b below 128
        low = (part[:, 1:] & 1) ^ (part[:, 1:] < 128)
        bits, at = [], 0
        for n in _runs(len(part)):
            r = n.bit_length() - 1
            bits += [np.array(_bits(r, 4) + _bits(n - (1 << r), r), np.uint8), low[at : at + n].ravel()]
            at += n
        out += [_scan([c], 0x01, 1, 63, 1, 0), _packed(np.concatenate(bits))]
    return b"".join([*out, b"\xff\xd9"])


# Reading


class _Huffman:
    def __init__(self, lengths: bytes, symbols: bytes):
        self.symbols, self.codes = symbols, {}
        code, at = 0, 0
        for n, count in enumerate(lengths, 1):
            for s in symbols[at : at + count]:
                self.codes[n, code] = s
                code += 1
            at += count
            code <<= 1
        self.fixed = next((n for n, c in enumerate(lengths, 1) if c), 0) if sum(c > 0 for c in lengths) == 1 else 0

    def only(self) -> int | None:
        """The symbol of a table that has one symbol, whose code is one bit."""
        return self.symbols[0] if len(self.symbols) == 1 and self.fixed == 1 else None


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | int(b)
        self.at += n
        return value

    def symbol(self, table: _Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (found := table.codes.get((n, code))) is not None:
                return found
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        value = self.take(n)
        return value if value >> (n - 1) else value - (1 << n) + 1


def read_coefficients(data: bytes) -> Image:
    """The quantised coefficients of a progressive JPEG, with all its scans accumulated."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, image, dc, ac, interval = 2, None, {}, {}, 0
    quant: dict[int, np.ndarray] = {}
    comments: list[bytes] = []
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        marker = data[at + 1]
        if marker == 0xD9:
            break
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            while body:
                wide, which = body[0] >> 4, body[0] & 15
                n = 128 if wide else 64
                quant[which] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                lengths, n = body[1:17], sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _Huffman(lengths, body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xC2:
            precision, height, width, n = struct.unpack(">BHHB", body[:6])
            if precision != 8 or n not in (1, 3):
                raise ValueError("only 8 bits and 1 or 3 components are read")
            found = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            most_h, most_v = max(c.h for c in found), max(c.v for c in found)
            for c in found:
                columns, rows = -(-width // (8 * most_h)) * c.h, -(-height // (8 * most_v)) * c.v
                c.blocks = np.zeros((rows, columns, 64), np.int16)
                c.wide, c.high = -(-(-(-width * c.h // most_h)) // 8), -(-(-(-height * c.v // most_v)) // 8)
            image = Image(width, height, found, quant, comments)
        elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a progressive Huffman-coded JPEG")
        elif marker == 0xDA:
            at = _read_scan(image, body, data, at, dc, ac, interval)
    return image


def _entropy_end(data: bytes, at: int) -> int:
    """Where the next marker other than a restart begins."""
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1] != 0 and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _read_scan(image: Image, head: bytes, data: bytes, at: int, dc: dict, ac: dict, interval: int) -> int:
    n = head[0]
    chosen = [(next(c for c in image.components if c.ident == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(n)]
    first, last, high, low = head[1 + 2 * n], head[2 + 2 * n], head[3 + 2 * n] >> 4, head[3 + 2 * n] & 15
    end = _entropy_end(data, at)
    if n == 1 and _read_at_once(chosen[0], data[at:end], dc, ac, interval, first, last, high, low):
        return end
    pieces, begin = [], at
    while begin < end:  # restart markers part the scan into pieces
        stop = begin
        while True:
            stop = data.find(b"\xff", stop, end)
            if stop < 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                break
            stop += 2
        stop = end if stop < 0 else stop
        pieces.append(data[begin:stop].replace(b"\xff\x00", b"\xff"))
        begin = stop + 2
    _read_bits(chosen, pieces, dc, ac, interval, first, last, high, low)
    return end


def _read_at_once(chosen, data: bytes, dc, ac, interval, first, last, high, low) -> bool:
    """Reads a scan whose symbols have a fixed length; False if it isn't one."""
    component, tables = chosen
    own = component.blocks[: component.high, : component.wide]
    n = component.wide * component.high
    if first == 0 and not high:
        table = dc.get(tables >> 4)
        if interval != 1 or table is None or table.only() != 7 or len(data) != 3 * n - 2:
            return False
        raw = np.frombuffer(data + b"\xff\xd0", np.uint8).reshape(n, 3)
        value = (raw[:, 0] & 0x7F).astype(np.int16)
        own[..., 0] = (np.where(value >= 64, value, value - 127) << low).reshape(own.shape[:2])
        return True
    if interval:
        return False
    if first == 0:
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8))[:n]
        own[..., 0] |= (bits.astype(np.int16) << low).reshape(own.shape[:2])
        return True
    table = ac.get(tables & 15)
    width = last - first + 1
    if not high:
        if table is None or table.only() != 7 or len(data) != n * width or b"\xff" in data:
            return False
        value = np.frombuffer(data, np.uint8).astype(np.int16)
        own[..., first : last + 1] = (np.where(value >= 64, value, value - 127) << low).reshape(*own.shape[:2], width) if low == 0 else _shifted(value, low).reshape(*own.shape[:2], width)
        return True
    before = own[..., first : last + 1].reshape(n, width)
    if table is None or table.fixed != 4 or not before.all():
        return False
    bits, at, done = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)), 0, 0
    more = np.empty((n, width), np.uint8)
    take = lambda k: int("".join(map(str, bits[at : at + k])), 2) if k else 0
    while done < n:
        symbol = table.codes[4, take(4)]
        if symbol & 15 or symbol >> 4 == 15:
            return False
        at += 4
        run = (1 << (symbol >> 4)) + take(symbol >> 4)
        at += symbol >> 4
        more[done : done + run] = bits[at : at + run * width].reshape(run, width)
        at, done = at + run * width, done + run
    step = more.astype(np.int16) << low
    own[..., first : last + 1] = np.where(before < 0, before - step, before + step).reshape(*own.shape[:2], width)
    return True


def _shifted(value: np.ndarray, low: int) -> np.ndarray:
    """Magnitudes of 7 bits, as coded, times 2 ** low."""
    return np.where(value >= 64, value, value - 127) * np.int16(1 << low)


def _read_bits(chosen, pieces, dc, ac, interval, first, last, high, low) -> None:
    alone = len(chosen) == 1
    if alone:
        c, t = chosen[0]
        units = [[(c, t, r, k)] for r in range(c.high) for k in range(c.wide)]
    else:
        rows, columns = chosen[0][0].blocks.shape[0] // chosen[0][0].v, chosen[0][0].blocks.shape[1] // chosen[0][0].h
        units = [[(c, t, r * c.v + y, k * c.h + x) for c, t in chosen for y in range(c.v) for x in range(c.h)] for r in range(rows) for k in range(columns)]
    step = interval or len(units)
    for piece, begin in zip(pieces, range(0, len(units), step), strict=False):
        bits, predicted, run = _Bits(piece), {}, 0
        for unit in units[begin : begin + step]:
            for c, t, r, k in unit:
                block = c.blocks[r, k]
                if first == 0 and high:
                    block[0] |= bits.take(1) << low
                elif first == 0:
                    predicted[c.ident] = predicted.get(c.ident, 0) + bits.signed(bits.symbol(dc[t >> 4]))
                    block[0] = predicted[c.ident] << low
                elif high:
                    run = _refine(bits, block, ac[t & 15], first, last, low, run)
                else:
                    run = _first(bits, block, ac[t & 15], first, last, low, run)


def _first(bits: _Bits, block, table, first, last, low, run) -> int:
    if run:
        return run - 1
    k = first
    while k <= last:
        symbol = bits.symbol(table)
        zeros, size = symbol >> 4, symbol & 15
        if size:
            k += zeros
            block[k] = bits.signed(size) * (1 << low)
            k += 1
        elif zeros == 15:
            k += 16
        else:
            return (1 << zeros) + bits.take(zeros) - 1
    return 0


def _refine(bits: _Bits, block, table, first, last, low, run) -> int:
    def correct(k):
        if bits.take(1):
            block[k] += (1 << low) if block[k] > 0 else -(1 << low)

    k = first
    if not run:
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if not size and zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            value = ((1 << low) if bits.take(1) else -(1 << low)) if size else 0
            while k <= last:
                if block[k]:
                    correct(k)
                elif zeros:
                    zeros -= 1
                else:
                    block[k] = value
                    k += 1
                    break
                k += 1
    if run:
        for j in range(k, last + 1):
            if block[j]:
                correct(j)
        return run - 1
    return 0


def payload_of(image: Image) -> bytes:
    """The bytes that store_payload kept."""
    n = next(int(c[8:]) for c in image.comments if c.startswith(b"payload="))
    flat = np.concatenate([c.blocks.reshape(-1, 64) for c in image.components])[: n // 64]
    out = np.where(flat < 0, flat + 255, flat).astype(np.uint8)
    dc = flat[:, 0]
    high = dc >> 1
    out[:, 0] = np.where(high < 0, high + 127, high) << 1 | dc & 1
    return out.tobytes()


def samples(image: Image) -> list[np.ndarray]:
    """Each component's samples, 0 to 255 as float32, at its own resolution."""
    out = []
    for c in image.components:
        rows, columns = c.blocks.shape[:2]
        scaled = np.empty((rows * columns, 64), np.float32)
        scaled[:, ZIGZAG] = c.blocks.reshape(-1, 64) * image.quant[c.table]
        plane = (scaled @ IDCT).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        plane += 128
        out.append(np.clip(np.rint(plane, out=plane), 0, 255, out=plane))
    return out


def rgb(image: Image) -> np.ndarray:
    """Height x width x 3, uint8; chroma is upsampled by repetition."""
    planes, most_h, most_v = samples(image), max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, p in zip(image.components, planes, strict=True):
        if (most_v, most_h) != (c.v, c.h):
            p = np.repeat(np.repeat(p, most_v // c.v, axis=0), most_h // c.h, axis=1)
        full.append(p[: image.height, : image.width])
    if len(full) == 1:
        return np.repeat(full[0].astype(np.uint8)[..., None], 3, axis=2)
    y, cb, cr = full
    cb, cr = cb - 128, cr - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for i, plane in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
        out[..., i] = np.clip(np.rint(plane, out=plane), 0, 255, out=plane)
    return out


def feature(tensor: np.ndarray) -> str:
    """Size, then mean and mean square of each channel, in exact integers: height x width : sums : sums of squares."""
    flat = tensor.reshape(-1, 3)
    sums = flat.sum(axis=0, dtype=np.int64)
    squares = [int(np.dot(p := flat[:, i].astype(np.float64), p)) for i in range(3)]
    return f"{tensor.shape[0]}x{tensor.shape[1]}:{','.join(map(str, sums))}:{','.join(map(str, squares))}"


def media_columns(docs: DataFrame, *, tensors: bool = False) -> DataFrame:
    """The digest columns of each row's stored JPEG; tensors=True adds the JPEG, and the RGB tensor as bytes with its height and width."""
    more = ", media binary, tensor binary, height int, width int" if tensors else ""

    def one(text: str | None):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = store_payload(payload)
        image = read_coefficients(media)
        back = payload_of(image)
        tensor = rgb(image)
        row = [len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(tensor)]
        return row + [media, tensor.tobytes(), *tensor.shape[:2]] if tensors else row

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())] + ([("media", pa.binary()), ("tensor", pa.binary()), ("height", pa.int32()), ("width", pa.int32())] if tensors else []))
    step = 16 if tensors else 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = [one(t) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, schema.field(i).type) for i, x in enumerate(zip(*rows, strict=True), 1))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA + more)
