"""Media columns in TIFF: writing a byte payload as an image, and reading images back, one row per page.

The reader walks the chain of image directories in either byte order, decodes strips or tiles stored plain,
with PackBits, LZW or deflate, undoes the horizontal and the floating-point predictor, and gives each page's
samples in row order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, quoted, tune

#: Fixed values of the TIFF 6.0 format: tags, field types (code: struct letter) and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
FIELD_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
LZW_CLEAR, LZW_END = 256, 257

#: Bytes that one stored byte can stand for at most, by scheme: a repeat of 128 for two, a longest table entry for nine
#: bits, 258 for two bits.
EXPANSION = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}


class TiffError(ValueError):
    """The bytes are not a TIFF file that this reader knows."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 1 + (n > 128)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as a repeat, all else as literals of up to 128 bytes."""
    a = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    out, literal = bytearray(), bytearray()

    def flush() -> None:
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(a)].tolist() if len(a) else []):
        if hi - lo < 3:
            literal += data[lo:hi]
            continue
        flush()
        while hi - lo:
            n = min(128, hi - lo)
            out += bytes([257 - n if n > 1 else 0, data[lo]])
            lo += n
    flush()
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first; the width grows one code early, as the format has it."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, last = bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == LZW_END:
            break
        if code == LZW_CLEAR:
            del table[258:]
            width, last = 9, b""
            continue
        if not last:
            if code >= len(table):
                raise TiffError("LZW code out of range")
            last = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            last = now
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += last
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes: dict[bytes, int] = {}
    out, held, bits, width, now = bytearray(), 0, 0, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def reset() -> None:
        nonlocal codes, width
        put(LZW_CLEAR)
        codes, width = {bytes([i]): i for i in range(256)}, 9

    reset()
    for byte in data:
        longer = now + bytes([byte])
        if longer in codes:
            now = longer
            continue
        put(codes[now])
        codes[longer] = len(codes) + 2
        now = longer[-1:]
        if len(codes) + 2 >= 4094:
            reset()
        elif len(codes) + 3 > 1 << width:
            width += 1
    if now:
        put(codes[now])
        codes[b""] = 0
        if len(codes) + 3 > 1 << width and width < 12:
            width += 1
    put(LZW_END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def inflate(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == PLAIN:
        return data[:size]
    if scheme == PACKBITS:
        return unpack_bits(data, size)
    if scheme == LZW:
        return lzw_decode(data, size)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise TiffError(f"compression {scheme} is not known")


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples, in the file's byte order."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "ui":
        native = block.astype(block.dtype.newbyteorder("="))
        return np.cumsum(native, axis=1, dtype=native.dtype).astype(block.dtype)
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        raw = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, -1, samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, block.dtype.itemsize, columns * samples)
        return np.ascontiguousarray(raw.transpose(0, 2, 1)).view(f">f{block.dtype.itemsize}").reshape(block.shape).astype(block.dtype)
    raise TiffError(f"predictor {predictor} is not known for these samples")


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    pixels: np.ndarray


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and fields of each directory in the chain; a chain that turns back on itself ends."""
    if len(data) < 8 or data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack(order + "I", data[4:8])[0], set()
    try:
        while at and at not in seen:
            seen.add(at)
            n, fields = struct.unpack_from(order + "H", data, at)[0], {}
            for k in range(at + 2, at + 2 + 12 * n, 12):
                tag, kind, count = struct.unpack_from(order + "HHI", data, k)
                letter = FIELD_TYPES.get(kind)
                if letter:
                    form = f"{order}{count}{letter}"
                    place = k + 8 if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, k + 8)[0]
                    fields[tag] = struct.unpack_from(form, data, place)
            yield order, fields
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
    except struct.error as e:
        raise TiffError(f"broken directory: {e}") from e


def read_page(data: bytes, order: str, fields: dict[int, tuple]) -> Page:
    def many(tag: int) -> tuple:
        values = fields.get(tag) or ()
        if not all(isinstance(v, int) and v >= 0 for v in values):
            raise TiffError(f"field {tag} is no whole number")
        return values

    def one(tag: int, default: int = 0) -> int:
        values = many(tag)
        if len(set(values)) > 1:
            raise TiffError(f"the samples differ in field {tag}")
        return values[0] if values else default

    width, height, samples, bits, scheme = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1), one(COMPRESSION, PLAIN)
    kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
    if min(width, height, samples) < 1 or bits not in (8, 16, 32, 64) or kind is None or (kind == "f" and bits < 32):
        raise TiffError("size or sample form is missing or not known")
    if one(PLANAR, 1) != 1 and samples > 1:
        raise TiffError("planes stored apart are not known")
    dtype, predictor = np.dtype(f"{order}{kind}{bits // 8}"), one(PREDICTOR, 1)
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    starts, counts = (many(TILE_OFFSETS), many(TILE_COUNTS)) if tiled else (many(STRIP_OFFSETS), many(STRIP_COUNTS))
    if not across or not down or not starts or not counts or len(starts) != len(counts):
        raise TiffError("strips or tiles are missing")
    per_row = -(-width // across)
    number = per_row * -(-height // down)
    if len(starts) < number:
        raise TiffError("strips or tiles are missing")
    if scheme not in EXPANSION:
        raise TiffError(f"compression {scheme} is not known")
    # what the stored bytes cannot hold is refused before room is made for it
    stored, block_bytes = counts[:number], down * across * samples * dtype.itemsize
    if sum(stored) > len(data) or block_bytes > max(stored) * EXPANSION[scheme] or height * width * samples * dtype.itemsize > sum(stored) * EXPANSION[scheme]:
        raise TiffError("the stored bytes are too few for the size")
    pixels = np.zeros((height, width, samples), dtype)
    for k in range(per_row * -(-height // down)):
        top, left = k // per_row * down, k % per_row * across
        rows = down if tiled else min(down, height - top)
        size = rows * across * samples * dtype.itemsize
        try:
            raw = inflate(data[starts[k] : starts[k] + counts[k]], scheme, size)
        except zlib.error as e:
            raise TiffError(f"broken deflate data: {e}") from e
        if len(raw) < size:
            raise TiffError("a strip or tile is short")
        block = undo_predictor(np.frombuffer(raw, dtype).reshape(rows, across, samples), predictor, order)
        pixels[top : top + down, left : left + across] = block[: height - top, : width - left]
    return Page(width, height, samples, bits, scheme, pixels)


def read_pages(data: bytes) -> Iterator[Page]:
    for order, fields in directories(data):
        yield read_page(data, order, fields)


def write_page(payload: bytes, width: int, rows_per_strip: int, compression: int = DEFLATE, predictor: int = 2) -> bytes:
    """One grey page of 8-bit samples, little-endian; the payload's length is a multiple of the width."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, width)
    height = len(image)
    if predictor == 2:
        image = np.diff(image, axis=1, prepend=np.uint8(0))
    pack = {PLAIN: bytes, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    strips = [pack(image[k : k + rows_per_strip].tobytes()) for k in range(0, height, rows_per_strip)]
    body, offsets, at = b"".join(strips), [], 8
    for s in strips:
        offsets.append(at)
        at += len(s)
    extra, entries, at = b"", [], at + at % 2
    numbers = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (STRIP_OFFSETS, 4, offsets), (SAMPLES, 3, [1]),
        (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, [len(s) for s in strips]), (PREDICTOR, 3, [predictor]),
    ]
    for tag, kind, values in numbers:
        packed = struct.pack(f"<{len(values)}{FIELD_TYPES[kind]}", *values)
        if len(packed) > 4:
            packed, extra = struct.pack("<I", at + len(extra)), extra + packed
        entries.append(struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0"))
    head = b"II*\0" + struct.pack("<I", at + len(extra)) + body
    return head.ljust(at, b"\0") + extra + struct.pack("<H", len(entries)) + b"".join(entries) + b"\0\0\0\0"


def describe(page: Page) -> str:
    """Features of a page's samples: shape, sum, sum of squares, steps between neighbours, and 16 equal value bins."""
    flat = page.pixels.reshape(-1)
    if flat.dtype != np.uint8:
        return f"{page.width}x{page.height}x{page.samples}/{page.bits}"
    count = np.bincount(flat, minlength=256)
    value = np.arange(256)
    bins = ",".join(map(str, count.reshape(16, 16).sum(1).tolist()))
    steps = int(np.abs(np.diff(flat.astype(np.int16))).sum())
    return f"{page.width}x{page.height}x{page.samples}/{page.bits};sum={int(count @ value)};squares={int(count @ value**2)};steps={steps};bins={bins}"


def tiff_encode(df: DataFrame, payload_col: str, media_col: str = "media", width: int = 64, rows_per_strip: int = 1024) -> DataFrame:
    """df with a binary column of one-page TIFF files that hold the payload column as 8-bit samples; no shuffle.

    The payload (binary) gets bytes 0 up to a positive multiple of the width; null counts as empty. A column
    named media_col is replaced, all others pass through; an empty table gives an empty table.
    """
    tune(df.sparkSession)

    def make():
        def store(raw: bytes | None) -> bytes:
            raw = raw or b""
            return write_page(raw.ljust(max(width, -(-len(raw) // width) * width), b"\0"), width, rows_per_strip)

        return lambda batch: [pa.array([store(x) for x in batch.column(payload_col).to_pylist()], pa.binary())]

    return add_columns(df, [payload_col], [T.StructField(media_col, T.BinaryType(), False)], make)


PAGE_FIELDS = [
    T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("bits", T.IntegerType()),
    T.StructField("compression", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType()),
]


def tiff_pages(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each TIFF file: the columns of df, then PAGE_FIELDS; page counts from 0; no shuffle.

    pixels are the samples in row order, in the file's byte order. Null or broken media give, after any pages
    before the fault, one row with page null and the reason in error; a file without pages gives no row.
    Columns of df with the names of PAGE_FIELDS are replaced; repeated rows are read each on its own.
    """
    tune(df.sparkSession)
    names = [f.name for f in PAGE_FIELDS]
    kept = [f for f in df.schema.fields if f.name not in names]
    kept_names = [f.name for f in kept]
    wanted = kept_names + ([media_col] if media_col not in kept_names else [])

    def pages(data: bytes | None) -> list[tuple]:
        out: list[tuple] = []
        try:
            if data is None:
                raise TiffError("no media")
            for p in read_pages(data):
                out.append((len(out), p.width, p.height, p.samples, p.bits, p.compression, p.pixels.tobytes(), describe(p), None))
        except TiffError as e:
            out.append((*[None] * 8, str(e)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            found = [pages(x) for x in batch.column(media_col).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = [p for x in found for p in x]
            new = [pa.array([p[k] for p in flat], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in kept_names] + new, names=kept_names + names)

    return df.select(*[quoted(c) for c in wanted]).mapInArrow(run, T.StructType(kept + PAGE_FIELDS))
