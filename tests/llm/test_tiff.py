import struct
import zlib

import numpy as np
import pytest

from pulsegrid.llm import tiff
from pulsegrid.llm.tiff import DEFLATE, LZW, PACKBITS, PLAIN


def payloads():
    rng = np.random.default_rng(1)
    return [b"\0" * 64, b"the of and " * 640, rng.integers(0, 256, 64 * 900, dtype=np.uint8).tobytes(), rng.integers(97, 101, 64 * 2100, dtype=np.uint8).tobytes(), bytes(range(64)) * 3]


@pytest.mark.parametrize("scheme", [PLAIN, LZW, DEFLATE, PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
def test_round_trip(scheme, predictor):
    for data in payloads():
        (page,) = tiff.read_pages(tiff.write_page(data, 64, 100, scheme, predictor))
        assert page.pixels.tobytes() == data and (page.width, page.height, page.compression) == (64, len(data) // 64, scheme)


def directory(order, fields, at, following):
    out = struct.pack(order + "H", len(fields))
    for tag, kind, *values in fields:
        letter = tiff.FIELD_TYPES[kind]
        out += struct.pack(order + "HHI", tag, kind, len(values)) + struct.pack(f"{order}{len(values)}{letter}", *values).ljust(4, b"\0")
    return out + struct.pack(order + "I", following)


def test_big_endian_tiles_on_two_pages():
    image = np.arange(20 * 20, dtype=">u2").reshape(20, 20)
    padded = np.zeros((32, 32), ">u2")
    padded[:20, :20] = image
    native = padded.astype(np.uint16)
    tiles = [native[r : r + 16, c : c + 16] for r in (0, 16) for c in (0, 16)]
    packed = [tiff.pack_bits(np.diff(t, axis=1, prepend=np.uint16(0)).astype(">u2").tobytes()) for t in tiles]
    head, body, offsets = 8, b"", []
    for p in packed:
        offsets.append(head + len(body))
        body += p
    tables = head + len(body)
    extra = struct.pack(">4I", *offsets) + struct.pack(">4I", *map(len, packed))
    one = tables + len(extra)

    def fields(place):
        return [(256, 3, 20), (257, 3, 20), (258, 3, 16), (259, 3, PACKBITS), (317, 3, 2), (322, 3, 16), (323, 3, 16), (324, 4, place), (325, 4, place + 16)]

    def with_counts(d):  # the two tile tables have four values, kept apart
        k = d.index(struct.pack(">HHI", 324, 4, 1))
        d = d[: k + 4] + struct.pack(">I", 4) + d[k + 8 :]
        k = d.index(struct.pack(">HHI", 325, 4, 1))
        return d[: k + 4] + struct.pack(">I", 4) + d[k + 8 :]

    first = with_counts(directory(">", fields(tables), one, one + 2 + 12 * 9 + 4))
    second = with_counts(directory(">", fields(tables), 0, 0))
    data = b"MM\0*" + struct.pack(">I", one) + body + extra + first + second
    pages = list(tiff.read_pages(data))
    assert len(pages) == 2 and all(np.array_equal(p.pixels[:, :, 0], image) for p in pages)


def test_float_predictor():
    values = np.linspace(-3, 9, 24, dtype=np.float32).reshape(2, 12, 1)
    rows = np.ascontiguousarray(values.astype(">f4").view(np.uint8).reshape(2, 12, 4).transpose(0, 2, 1)).reshape(2, 48)
    coded = np.diff(rows, axis=1, prepend=np.uint8(0))
    block = np.frombuffer(coded.tobytes(), "<f4").reshape(2, 12, 1)
    assert np.array_equal(tiff.undo_predictor(block, 3, "<"), values)


def test_broken_files():
    good = tiff.write_page(b"abcd" * 64, 64, 2)
    for bad in (b"", b"PNG", good[:20], good[:-30], good.replace(b"\x08\0\0\0\x06", b"\x07\0\0\0\x06")):
        try:
            list(tiff.read_pages(bad))
        except tiff.TiffError:
            pass


def test_operator(spark):
    rows = [(1, b"abc", "x"), (2, None, "y"), (3, b"", "z"), (3, b"", "z"), (4, bytes(range(256)) * 600, None)]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, page string")
    pages = {r.doc_id: r for r in tiff.tiff_pages(tiff.tiff_encode(df, "payload")).collect()}
    for i, data, _ in rows:
        data = data or b""
        assert pages[i].pixels == data.ljust(max(64, -(-len(data) // 64) * 64), b"\0") and pages[i].page == 0 and pages[i].error is None
    broken = tiff.tiff_pages(spark.createDataFrame([(1, b"xx"), (2, None)], "doc_id long, media binary")).collect()
    assert [r.page for r in broken] == [None, None] and all(r.error for r in broken)
    assert tiff.tiff_pages(tiff.tiff_encode(df.limit(0), "payload")).count() == 0


def one_directory(entries):
    """A file of one directory of (tag, type, count, packed value)."""
    body = b"".join(struct.pack("<HHI", tag, kind, count) + value.ljust(4, b"\0") for tag, kind, count, value in entries)
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + body + b"\0" * 40


def page(width=(4, 1, struct.pack("<I", 4)), height=(4, 1, struct.pack("<I", 1)), scheme=1, offset=(4, 1, struct.pack("<I", 0)), count=(4, 1, struct.pack("<I", 4))):
    one = (3, 1, struct.pack("<H", 8))
    return one_directory([(256, *width), (257, *height), (258, *one), (259, 3, 1, struct.pack("<H", scheme)), (273, *offset), (279, *count)])


HUGE = (4, 1, struct.pack("<I", 2**31))


@pytest.mark.parametrize("scheme", [1, 5, 8, 32773])
def test_declared_sizes_that_the_bytes_cannot_hold(scheme):
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(page(HUGE, HUGE, scheme)))
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(page(HUGE, HUGE, scheme, count=HUGE)))


@pytest.mark.parametrize("field", [(2, 1, b"x"), (9, 1, struct.pack("<i", -4)), (11, 1, struct.pack("<f", 4.0)), (4, 1, struct.pack("<I", 0)), (4, 2**31, b"")])
def test_fields_that_are_no_sizes(field):
    assert list(tiff.read_pages(page()))[0].width == 4
    for name in ("width", "height", "count"):
        with pytest.raises(tiff.TiffError):
            list(tiff.read_pages(page(**{name: field})))


def test_query_against_hashlib(spark):
    import hashlib

    from pulsegrid.llm.queries import op3_tiff_media

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows, feature = op3_tiff_media(spark, "/root/testdata/sf0.001").collect(), {}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r.doc_id]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = tiff.write_page(payload, 64, 1024)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert feature.setdefault(payload, r.feature) == r.feature
