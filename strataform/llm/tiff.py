"""Media columns: TIFF.

``encode_tiff`` stores bytes as the samples of an RGB image of one or more
pages; ``tiff_pages`` walks the image directories of stored files, decodes
their strips or tiles (uncompressed, PackBits, LZW, deflate), undoes horizontal
differencing and gives one row per page. Both are map-only: a task holds one
batch of files and one file's pages.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strataform.llm.common import text_or_empty

WIDTH, CHANNELS = 64, 3
ROW_BYTES = WIDTH * CHANNELS
PAGE_ROWS = 64
TILE_ROWS = 16
STRIP_ROWS = 16
FLUSH_BYTES = 1 << 22

#: Tags and compression codes of the format.
TAGS = {
    "width": 256,
    "height": 257,
    "bits": 258,
    "compression": 259,
    "photometric": 262,
    "strip_offsets": 273,
    "channels": 277,
    "rows_per_strip": 278,
    "strip_counts": 279,
    "planar": 284,
    "predictor": 317,
    "tile_width": 322,
    "tile_height": 323,
    "tile_offsets": 324,
    "tile_counts": 325,
}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: More samples for each stored byte than any of the compressions can give.
EXPANSION = 4096
#: Struct letters and bytes of the field types that are read.
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
#: How the pages of a file are stored in turn, from the one that the payload's checksum names on: compression, predictor, tiled.
SCHEMES = [(DEFLATE, 1, False), (LZW, 2, False), (PACKBITS, 1, True), (DEFLATE, 2, True)]


class BadTiff(ValueError):
    """The bytes aren't a file of the kinds that are read here."""


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as two bytes, all else literally."""
    out = bytearray()

    def literal(piece: bytes) -> None:
        for i in range(0, len(piece), 128):
            part = piece[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)

    at = 0
    for run in re.finditer(rb"(.)\1{2,127}", data, re.DOTALL):
        literal(data[at : run.start()])
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        at = run.end()
    literal(data[at:])
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


_CLEAR, _END, _FIRST = 256, 257, 258


def pack_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; widths change one code early."""
    segments: list[list[int]] = []
    codes: list[int] = []
    table: dict[int, int] = {}
    free, held = _FIRST, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        pair = held << 8 | byte
        known = table.get(pair)
        if known is not None:
            held = known
            continue
        codes.append(held)
        table[pair] = free
        free += 1
        held = byte
        if free == 4094:
            segments.append([*codes, _CLEAR])
            codes, table, free = [], {}, _FIRST
    segments.append([*codes, held, _END] if held >= 0 else [*codes, _END])
    # the n-th code after a clear is as wide as the table's next free code
    widest = np.array([9] * (512 - _FIRST) + [10] * 512 + [11] * 1024 + [12] * 2100, np.int64)
    values = np.concatenate([[_CLEAR], *segments]).astype(np.int64)
    widths = np.concatenate([[9], *(widest[: len(c)] for c in segments)])
    place = widths[:, None] - 1 - np.arange(12)
    bits = (values[:, None] >> np.maximum(place, 0)) & 1
    return np.packbits(bits[place >= 0].astype(np.uint8)).tobytes()


def unpack_lzw(data: bytes) -> bytes:
    out: list[bytes] = []
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    width, before = 9, b""
    acc = bits = 0
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == _END:
            break
        if code == _CLEAR:
            del table[_FIRST:]
            width, before = 9, b""
            continue
        if not before:
            entry = table[code]
        else:
            if code > len(table):
                raise BadTiff("an LZW code ahead of its table")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        before = entry
    return b"".join(out)


PACK: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits}
UNPACK: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: unpack_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpack_bits}


def unpack(compression: int, data: bytes, size: int) -> bytes:
    """The samples of a strip or tile; deflate gives no more than ``size`` of them, whatever its bytes say."""
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, max(1, size))
    return UNPACK[compression](data)


def encode_tiff(payload: bytes, page_rows: int = PAGE_ROWS, schemes: list = SCHEMES) -> bytes:
    """Store a positive multiple of 192 bytes as 64 pixels a row, ``page_rows`` rows a page."""
    if not payload or len(payload) % ROW_BYTES:
        raise ValueError(f"a positive multiple of {ROW_BYTES} bytes is asked for")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    step = page_rows * ROW_BYTES
    turn = zlib.crc32(payload)
    for number, start in enumerate(range(0, len(payload), step)):
        page = payload[start : start + step]
        compression, predictor, tiled = schemes[(turn + number) % len(schemes)]
        rows = len(page) // ROW_BYTES
        pixels = np.frombuffer(page, np.uint8).reshape(rows, WIDTH, CHANNELS)
        block = TILE_ROWS if tiled else STRIP_ROWS
        if tiled and rows % block:
            pixels = np.concatenate([pixels, np.zeros((-rows % block, WIDTH, CHANNELS), np.uint8)])
        if predictor == 2:
            pixels = np.concatenate([pixels[:, :1], np.diff(pixels, axis=1)], axis=1)
        places, counts = [], []
        for at in range(0, len(pixels), block):
            packed = PACK[compression](pixels[at : at + block].tobytes())
            out += b"\0" * (len(out) % 2)
            places.append(len(out))
            counts.append(len(packed))
            out += packed
        fields = [("width", 3, [WIDTH]), ("height", 4, [rows]), ("bits", 3, [8] * CHANNELS), ("compression", 3, [compression]), ("photometric", 3, [2]), ("channels", 3, [CHANNELS]), ("planar", 3, [1]), ("predictor", 3, [predictor])]
        if tiled:
            fields += [("tile_width", 3, [WIDTH]), ("tile_height", 3, [TILE_ROWS]), ("tile_offsets", 4, places), ("tile_counts", 4, counts)]
        else:
            fields += [("rows_per_strip", 4, [STRIP_ROWS]), ("strip_offsets", 4, places), ("strip_counts", 4, counts)]
        entries = bytearray()
        for name, kind, values in sorted(fields, key=lambda f: TAGS[f[0]]):
            raw = struct.pack(f"<{len(values)}{TYPES[kind][0]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, place = struct.pack("<I", len(out)), raw
                out += place
            entries += struct.pack("<HHI", TAGS[name], kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes) -> Iterator[dict[int, list[int]]]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise BadTiff("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen or at + 2 > len(data):
            raise BadTiff("the chain of directories is broken")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        found = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                letter, size = TYPES[kind]
                place = at + 10 + 12 * i
                if size * count > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                found[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
        yield found
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def decode_tiff(data: bytes) -> Iterator[dict]:
    """A dict for each page: size, how it was stored, and its samples row by row."""
    try:
        for number, tags in enumerate(_directories(data)):
            one = lambda name, default: tags.get(TAGS[name], [default])[0]
            width, height, channels = one("width", 0), one("height", 0), one("channels", 1)
            compression, predictor = one("compression", NONE), one("predictor", 1)
            if compression not in UNPACK or predictor not in (1, 2) or set(tags.get(TAGS["bits"], [1])) != {8} or one("planar", 1) != 1:
                raise BadTiff(f"page {number} is stored in a way that isn't read")
            tiled = TAGS["tile_offsets"] in tags
            kind = "tile" if tiled else "strip"
            places, counts = tags[TAGS[f"{kind}_offsets"]], tags[TAGS[f"{kind}_counts"]]
            wide = one("tile_width", width) if tiled else width
            high = one("tile_height", height) if tiled else min(one("rows_per_strip", height), height)
            if min(width, height, channels, wide, high) < 1:
                raise BadTiff(f"page {number} has no size")
            across, down = -(-width // wide), -(-height // high)
            if not len(places) == len(counts) == across * down:
                raise BadTiff(f"page {number} has {len(places)} places and {len(counts)} lengths of {across * down} {kind}s")
            # checked before anything of that size is made
            held = sum(min(c, max(0, len(data) - p)) for p, c in zip(places, counts))
            if max(width * height, across * wide * down * high) * channels > EXPANSION * held:
                raise BadTiff(f"page {number} is larger than its {kind}s can hold")
            pixels = np.zeros((height, width, channels), np.uint8)
            for i, (place, count) in enumerate(zip(places, counts)):
                top, left = i // across * high, i % across * wide
                rows = high if tiled else min(high, height - top)
                raw = unpack(compression, data[place : place + count], rows * wide * channels)
                if len(raw) < rows * wide * channels:
                    raise BadTiff(f"page {number} has too few samples")
                block = np.frombuffer(raw, np.uint8, rows * wide * channels).reshape(rows, wide, channels)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=np.uint8)
                pixels[top : top + rows, left : left + wide] = block[: height - top, : width - left]
            yield {"page": number, "width": width, "height": height, "channels": channels, "compression": compression, "predictor": predictor, "layout": kind, "samples": pixels.tobytes()}
    except BadTiff:
        raise
    except (struct.error, KeyError, IndexError, zlib.error, ValueError, ArithmeticError) as e:
        raise BadTiff(str(e)) from e


def pad_payload(raw: bytes, unit: int = ROW_BYTES) -> bytes:
    size = max(unit, -(-len(raw) // unit) * unit)
    return raw.ljust(size, b" ")


PAGES = "row_id long, n_bytes long, media_bytes long, media_sha256 string, page int, n_pages int, width int, height int, channels int, compression int, predictor int, layout string, samples binary, error string"
_PAGES = pa.schema(
    [("row_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())]
    + [(c, pa.int32()) for c in ("page", "n_pages", "width", "height", "channels", "compression", "predictor")]
    + [("layout", pa.string()), ("samples", pa.binary()), ("error", pa.string())]
)


def _batches(rows: Iterable[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Record batches of a bounded size; weight: the column whose bytes count."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"") + 64
        if size >= FLUSH_BYTES:
            yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.record_batch([list(c) for c in zip(*held)], schema=schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, n_bytes and media of each text; null texts are empty ones."""
    schema = pa.schema([("row_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    raw = batch.column(1)[i].as_py()
                    yield batch.column(0)[i].as_py(), len(raw), encode_tiff(pad_payload(raw))

        return _batches(rows(), schema, 2)

    return docs.select(F.col(id_col).cast("long").alias("row_id"), F.encode(text_or_empty(text_col), "UTF-8").alias("raw")).mapInArrow(stored, "row_id long, n_bytes long, media binary")


def tiff_pages(files: DataFrame) -> DataFrame:
    """One row per page of the files in row_id, n_bytes, media.

    The pages of a file follow each other. Null media gives no row; bytes that
    can't be read give one row with the error and no samples.
    """

    def paged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row_id, n_bytes, media = (batch.column(c)[i].as_py() for c in range(3))
                    if media is None:
                        continue
                    head = (row_id, n_bytes, len(media), hashlib.sha256(media).hexdigest())
                    try:
                        found = list(decode_tiff(media))
                        error = None if found else "no page"
                    except BadTiff as e:
                        found, error = [], str(e)
                    for p in found:
                        yield *head, p["page"], len(found), p["width"], p["height"], p["channels"], p["compression"], p["predictor"], p["layout"], p["samples"], None
                    if error:
                        yield *head, None, 0, None, None, None, None, None, None, None, error

        return _batches(rows(), _PAGES, 12)

    return files.select("row_id", "n_bytes", "media").mapInArrow(paged, PAGES)


def page_digests(pages: DataFrame) -> DataFrame:
    """Fold the consecutive pages of each file into digests and features, without a shuffle.

    The feature is the number of pages, the storage of each kind used, and the
    mean of each channel over all pages.
    """
    schema = pa.schema([("row_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            left = 0
            for batch in batches:
                for r in batch.to_pylist():
                    if r["error"] is not None:
                        yield r["row_id"], r["n_bytes"], None, None, None, r["media_bytes"], r["media_sha256"], "error"
                        continue
                    if r["page"] == 0:
                        sha, total, tail, left = hashlib.sha256(), 0, b"", r["n_pages"]
                        sums, kinds = np.zeros(r["channels"], np.int64), set()
                    samples = r["samples"]
                    sha.update(samples)
                    total += len(samples)
                    tail = (tail + samples[-16:])[-16:]
                    sums = sums + np.frombuffer(samples, np.uint8).reshape(-1, r["channels"]).sum(axis=0, dtype=np.int64)
                    kinds.add((r["compression"], r["predictor"], r["layout"]))
                    left -= 1
                    if not left:
                        means = ",".join(f"{s * r['channels'] / total:.4f}" for s in sums.tolist())
                        stored = "+".join(f"{c}/{p}/{k}" for c, p, k in sorted(kinds))
                        yield r["row_id"], r["n_bytes"], total, sha.hexdigest(), zlib.crc32(tail), r["media_bytes"], r["media_sha256"], f"pages={r['n_pages']};stored={stored};mean={means}"

        return _batches(rows(), schema, 7)

    return pages.mapInArrow(folded, "row_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as TIFF, read the stored bytes back, and report on them.

    Null and empty texts are one row of spaces. Rows are reported one by one,
    repeated ones too; null ids pass; other columns aren't read; an empty
    table gives an empty one.
    """
    report = page_digests(tiff_pages(store_texts(docs, id_col, text_col)))
    return report.withColumnRenamed("row_id", id_col)
