"""Media columns: TIFF files in a binary column, one row per page.

The reader walks the image directories of a classic TIFF (either byte order), decodes
strips or tiles stored raw or as PackBits, LZW or deflate, undoes horizontal prediction
and hands back each page's samples. The writer stores payload bytes as 8-bit grey rows.

Defined results: a null or empty media value has no page; a damaged file gives one row
with page null and the reason in `error`, after the pages that could be read: counts of
strips or tiles that don't fit the size, and sizes that the stored bytes can't fill, are
damage. Repeated rows give repeated pages. Columns other than the ones named are carried
untouched; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: TIFF 6.0 tags, field types and compression codes
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_LEN, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_LEN = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325
TYPES = {1: "B", 3: "H", 4: "I"}
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: bytes that a stored byte gives at most, by compression
MOST = {RAW: 1, LZW: 3640, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}

ROW = 64  # samples in a row
PAGE_ROWS = 4096  # rows of a page at most: 256 KiB, longer payloads take more pages
STRIP_ROWS = 512


def pack_bits(data: bytes) -> bytes:
    """Runs of a byte as packets of up to 128, what is between them as literals."""
    if not data:
        return b""
    a = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    sizes = np.diff(np.append(starts, len(a)))
    out, at = bytearray(), 0
    runs = np.flatnonzero(sizes > 1)
    for start, size in [*zip(starts[runs].tolist(), sizes[runs].tolist(), strict=True), (len(data), 0)]:
        for i in range(at, start, 128):
            part = data[i : min(i + 128, start)]
            out.append(len(part) - 1)
            out += part
        for i in range(0, size, 128):
            n = min(128, size - i)
            out += bytes(((257 - n) & 255 if n > 1 else 0, data[start]))
        at = start + size
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


CLEAR, END = 256, 257


FIRST, MOST_CODES = 258, 4094  # first free code; a table is cleared when this many are taken
#: width of the k-th code after a clear: the first adds no entry, and codes grow one early, as TIFF has it
WIDTHS = np.array([9 if FIRST + k < 512 else 10 if FIRST + k < 1024 else 11 if FIRST + k < 2048 else 12 for k in range(MOST_CODES - FIRST + 2)])
POWERS = 1 << np.arange(11, -1, -1)


def lzw_pack(data: bytes) -> bytes:
    """Codes from the most significant bit on; which width a code has depends on its place after a clear alone."""
    codes, places = [CLEAR], [0]
    table: dict[int, int] = {}
    free, place, held = FIRST, 0, -1
    for byte in data:
        if held < 0:
            held = byte
            continue
        found = table.get(held << 8 | byte)
        if found is not None:
            held = found
            continue
        codes.append(held)
        places.append(place)
        table[held << 8 | byte] = free
        free += 1
        place += 1
        if free >= MOST_CODES:
            codes.append(CLEAR)
            places.append(place)
            table, free, place = {}, FIRST, 0
        held = byte
    if held >= 0:
        codes.append(held)
        places.append(place)
        place += 1
    codes.append(END)
    places.append(place)
    widths = WIDTHS[places]
    bits = ((np.array(codes)[:, None] & POWERS) > 0)[np.arange(12) >= 12 - widths[:, None]]
    return np.packbits(bits).tobytes()


def lzw_unpack(data: bytes, size: int) -> bytes:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    out, at = bytearray(), 0
    offsets = np.concatenate([[0], np.cumsum(WIDTHS)])
    started = False
    while len(out) < size:
        # as many codes as the bits hold and a table takes, up to the next clear or the end
        most = min(int(np.searchsorted(offsets, len(bits) - at, "right")) - 1, len(WIDTHS))
        if most < 1:
            raise ValueError("LZW data ends early")
        spots = np.minimum(at + offsets[:most, None] + np.arange(-12, 0) + WIDTHS[:most, None], len(bits) - 1)
        part = ((bits[spots] * (np.arange(12) >= 12 - WIDTHS[:most, None])) @ POWERS).tolist()
        entries = [bytes((i,)) for i in range(256)] + [b"", b""]
        prior = b""
        for k, code in enumerate(part):
            if code == CLEAR:
                at += int(offsets[k + 1])
                started = True
                break
            if code == END:
                return bytes(out[:size])
            if not started or code > len(entries) or (code == len(entries) and not prior):
                raise ValueError("LZW code out of range")
            now = entries[code] if code < len(entries) else prior + prior[:1]
            out += now
            if prior:
                entries.append(prior + now[:1])
            prior = now
            if len(out) >= size:
                break
        else:
            raise ValueError("LZW data ends early")
    return bytes(out[:size])


def squeeze(data: bytes, code: int, level: int = 1) -> bytes:
    if code == RAW:
        return data
    if code == PACKBITS:
        return pack_bits(data)
    if code == LZW:
        return lzw_pack(data)
    if code == DEFLATE:
        return zlib.compress(data, level)
    raise ValueError(f"compression {code} isn't supported")


def expand(data: bytes, code: int, size: int) -> bytes:
    if code == RAW:
        out = data[:size]
    elif code == PACKBITS:
        out = unpack_bits(data, size)
    elif code == LZW:
        out = lzw_unpack(data, size)
    elif code in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {code} isn't supported")
    if len(out) < size:
        raise ValueError("a strip or tile is short")
    return out


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<", strip_rows: int = STRIP_ROWS) -> bytes:
    """Pages of shape (rows, columns) or (rows, columns, samples), uint8, as one file; tile: its side, 0 for strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        rows, cols = page.shape[:2]
        samples = page.shape[2] if page.ndim == 3 else 1
        cube = page.reshape(rows, cols, samples)
        parts = []
        if tile:
            for y in range(0, rows, tile):
                for x in range(0, cols, tile):
                    square = np.zeros((tile, tile, samples), np.uint8)
                    piece = cube[y : y + tile, x : x + tile]
                    square[: piece.shape[0], : piece.shape[1]] = piece
                    parts.append(square)
        else:
            parts = [cube[y : y + strip_rows] for y in range(0, rows, strip_rows)]
        at, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
            stored = squeeze(np.ascontiguousarray(part).tobytes(), compression)
            at.append(len(out))
            sizes.append(len(stored))
            out += stored
        places = [(TILE_W, 4, [tile]), (TILE_H, 4, [tile]), (TILE_AT, 4, at), (TILE_LEN, 4, sizes)] if tile else [(STRIP_AT, 4, at), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_LEN, 4, sizes)]
        fields = sorted([(WIDTH, 4, [cols]), (HEIGHT, 4, [rows]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples == 1 else 2]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]), *places])
        packed = []
        for tag, kind, values in fields:
            body = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                spot, body = len(out), body
                out += body
                body = struct.pack(order + "I", spot)
            packed.append(struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(packed)) + b"".join(packed) + b"\0\0\0\0"
        link = len(out) - 4
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """Byte order and fields of each image directory, in file order; a loop in the chain is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directory chain loops")
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for k in range(count):
            spot = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(order + "HHI", data, spot)
            if kind not in TYPES:
                continue
            form = f"{order}{n}{TYPES[kind]}"
            inline = struct.calcsize(form) <= 4
            fields[tag] = list(struct.unpack_from(form, data, spot + 8 if inline else struct.unpack_from(order + "I", data, spot + 8)[0]))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def samples_of(data: bytes, fields: dict[int, list[int]]) -> np.ndarray:
    """The 8-bit samples of one page, shape (rows, columns, samples)."""
    one = lambda tag, default=None: fields[tag][0] if tag in fields else default
    cols, rows, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    code, predictor = one(COMPRESSION, RAW), one(PREDICTOR, 1)
    if not cols or not rows or not n:
        raise ValueError("a directory has no size")
    if set(fields.get(BITS, [1])) != {8} or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise ValueError("only 8-bit interleaved samples with predictor 1 or 2 are read")
    if code not in MOST:
        raise ValueError(f"compression {code} isn't supported")
    tiled = TILE_AT in fields
    if tiled:
        w, h, at, lengths = one(TILE_W), one(TILE_H), fields[TILE_AT], fields.get(TILE_LEN, [])
    else:
        w, h, at, lengths = cols, min(one(ROWS_PER_STRIP, rows), rows), fields.get(STRIP_AT, []), fields.get(STRIP_LEN, [])
    if not w or not h:
        raise ValueError("strips or tiles have no size")
    grid = [(y, x) for y in range(0, rows, h) for x in range(0, cols, w)] if -(-rows // h) * -(-cols // w) == len(at) == len(lengths) else None
    if grid is None:
        raise ValueError("the count of strips or tiles doesn't fit the size")
    if any(a + size > len(data) for a, size in zip(at, lengths, strict=True)):
        raise ValueError("a strip or tile lies outside the file")
    # no data of this length expands to that size: found out before memory is taken
    if any((h if tiled else min(h, rows - y)) * w * n > MOST[code] * size for (y, _), size in zip(grid, lengths, strict=True)):
        raise ValueError("a strip or tile is short")
    out = np.empty((rows, cols, n), np.uint8)
    for (y, x), a, size in zip(grid, at, lengths, strict=True):
        high = h if tiled else min(h, rows - y)
        block = np.frombuffer(expand(data[a : a + size], code, high * w * n), np.uint8).reshape(high, w, n)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[y : y + high, x : x + w] = block[: rows - y, : cols - x]
    return out


def feature(pixels: np.ndarray) -> str:
    """Sample count, mean, deviation, entropy in bits and a 16-bin histogram of the samples."""
    flat = pixels.reshape(-1)
    full = np.bincount(flat, minlength=256)
    share = full[full > 0] / max(1, flat.size)
    levels = np.arange(256)
    mean = float((full * levels).sum()) / max(1, flat.size)
    spread = (float((full * (levels - mean) ** 2).sum()) / max(1, flat.size)) ** 0.5
    return f"{flat.size}:{mean:.4f}:{spread:.4f}:{float(-(share * np.log2(share)).sum()) + 0.0:.4f}:" + ",".join(map(str, full.reshape(16, 16).sum(1)))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text and the payload: padded with 0 to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + b"\0" * (max(1, -(-len(raw) // ROW)) * ROW - len(raw))


def pages_for(payload: bytes) -> list[np.ndarray]:
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    return [grid[i : i + PAGE_ROWS] for i in range(0, len(grid), PAGE_ROWS)]


PAGE_FIELDS = T.StructType([T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("compression", T.IntegerType()), T.StructField("pixels", T.BinaryType()), T.StructField("feature", T.StringType()), T.StructField("error", T.StringType())])


def read_pages(data: bytes | None) -> Iterator[tuple]:
    """Rows of PAGE_FIELDS for one file."""
    k = 0
    try:
        for k, (_, fields) in enumerate(directories(data) if data else ()):
            px = samples_of(data, fields)
            yield k, px.shape[1], px.shape[0], px.shape[2], fields.get(COMPRESSION, [RAW])[0], px.tobytes(), feature(px), None
    except (ValueError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
        yield (*[None] * 7, f"after page {k}: {e}")


def tiff_pages(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """One row per page of the TIFF in column `media`, beside the columns in `keep`."""
    schema = T.StructType([df.schema[c] for c in keep] + list(PAGE_FIELDS))
    arrow = _arrow(schema)

    def run(batches):
        for batch in batches:
            cols, rows = [batch.column(c).to_pylist() for c in keep], []
            for i, data in enumerate(batch.column(media).to_pylist()):
                rows += [(*(c[i] for c in cols), *page) for page in read_pages(data)]
                if sum(len(r[-3] or b"") for r in rows[-4:]) > 1 << 22 or len(rows) >= 256:
                    yield _rows(rows, arrow)
                    rows = []
            if rows:
                yield _rows(rows, arrow)

    return df.select(*dict.fromkeys([*keep, media])).mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, compression int"


#: compression, predictor, tile side and byte order of a stored text, dealt by its bytes
LAYOUTS = [(code, predictor, tile, order) for tile in (0, ROW) for code, predictor in ((DEFLATE, 2), (LZW, 1), (PACKBITS, 1), (RAW, 1)) for order in ("<" if tile else ">",)]


def layout_of(payload: bytes) -> tuple[int, int, int, str]:
    return LAYOUTS[zlib.crc32(payload) % len(LAYOUTS)]


def stored_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: tuple[int, int, int, str] | None = None) -> DataFrame:
    """Store each text as a TIFF, read the stored bytes back page by page and describe both.

    layout: one of LAYOUTS for all texts; otherwise each text has the one that its bytes deal
    it, so that equal texts are stored alike. A null text counts as empty: one row of zeros.
    One row out per row in, whatever other columns there are; very long texts take as many
    pages as they need; an empty table gives no row.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                size, payload = payload_of(text.as_py())
                media = encode(pages_for(payload), *(layout or layout_of(payload)))
                back = list(read_pages(media))
                if any(r[-1] for r in back):
                    raise ValueError(f"document {key}: {back[-1][-1]}")
                got = b"".join(r[5] for r in back)
                rows.append((key, size, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-ROW:]), len(media), hashlib.sha256(media).hexdigest(), "|".join(r[6] for r in back), len(back), back[0][4]))
            yield _rows(rows, arrow)

    from pyspark.sql.types import _parse_datatype_string

    arrow = _arrow(_parse_datatype_string(STORED))
    return df.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(run, STORED)
