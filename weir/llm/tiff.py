"""Media columns: TIFF.

``decode`` walks a file's image file directories and gives one page for each: it reads strips or tiles,
undoes PackBits, LZW or deflate and the horizontal predictor, and returns rows of 8- or 16-bit samples. Classic TIFF
in either byte order; grey, RGB or any count of samples, chunky or planar. ``encode`` writes the same
forms, so every path has an exact round trip. ``tiff_pages`` emits a row for each page of a binary column.

Defined results: a null or empty file has no pages; a broken file gives one row with ``error`` set, instead of
failing its task; a directory chain that loops ends where it would repeat; a stated size beyond ``MAX_PAGE`` bytes is
an error, not an allocation. Texts: null counts as empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._shared import lean_batches, texts
from weir.session import ship

NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
MAX_PAGE = 1 << 30
ROW_BYTES = 576
PAGE_ROWS = 1024

#: Fixed values of the format: tag numbers.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
_TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i"}


class TiffError(ValueError):
    """A file that can't be read as TIFF."""


@dataclass
class Page:
    """One decoded image: samples as an array (height, width, samples)."""

    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def unpack_bits(data: bytes) -> bytes:
    """PackBits: literal runs and repeats."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """PackBits, greedy: repeats of three or more, literals otherwise."""
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at
        while end < n and end - at < 128 and not (end + 2 < n and data[end] == data[end + 1] == data[end + 2]):
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    """LZW with most significant bits first and codes that widen one early."""
    out, table, width, prev = [], [], 9, None
    value, have, at = 0, 0, 0
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    while True:
        while have < width:
            if at >= len(data):
                return b"".join(out)
            value = (value << 8 | data[at]) & 0xFFFFFF
            at, have = at + 1, have + 8
        have -= width
        code = value >> have & ((1 << width) - 1)
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if code == 257:
            return b"".join(out)
        if prev is None:
            if code > 255:
                raise TiffError("LZW data don't start with a clear code and a byte")
            entry = (table or base)[code]
            table = table or list(base)
        elif code < len(table):
            entry = table[code]
            table.append(prev + entry[:1])
        elif code == len(table):
            entry = prev + prev[:1]
            table.append(entry)
        else:
            raise TiffError("LZW code beyond the table")
        out.append(entry)
        prev = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1


def lzw(data: bytes) -> bytes:
    """The counterpart of unlzw."""
    out, value, have, width = bytearray(), 0, 0, 9
    table, size = {bytes((i,)): i for i in range(256)}, 258

    def put(code):
        nonlocal value, have
        value, have = value << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(value >> have & 255)
        value &= (1 << have) - 1

    put(256)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer], size = size, size + 1
        word = data[i : i + 1]
        if size == 4095:
            put(table[word])
            word = b""
            put(256)
            table, size, width = {bytes((j,)): j for j in range(256)}, 258, 9
        elif size + 1 > 1 << width:
            width += 1
    if word:
        put(table[word])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(value << (8 - have) & 255)
    return bytes(out)


def _expand(data: bytes, compression: int, most: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    if compression == LZW:
        return unlzw(data)
    if compression == PACKBITS:
        return unpack_bits(data)
    raise TiffError(f"compression {compression} isn't supported")


def _shrink(data: bytes, compression: int) -> bytes:
    if compression in (ADOBE_DEFLATE, DEFLATE):
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw, PACKBITS: pack_bits}[compression](data)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """(tags, offset of the next directory)."""
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in _TYPES:
                continue
            form = f"{order}{n * len(_TYPES[kind])}{_TYPES[kind][0]}"
            where = at + 2 + 12 * i + 8
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = struct.unpack_from(form, data, where)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        return tags, following
    except struct.error as e:
        raise TiffError(f"directory at {at} is cut off") from e


def _undo_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    raise TiffError(f"predictor {predictor} isn't supported")


def _page(data: bytes, tags: dict[int, tuple], order: str, number: int) -> Page:
    one = lambda tag, other: tags.get(tag, (other,))[0]
    width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or bits not in (8, 16) or not samples:
        raise TiffError(f"page {number}: {width} x {height} with {samples} samples of {bits} bits isn't supported")
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    if width * height * samples * kind.itemsize > MAX_PAGE:
        raise TiffError(f"page {number} is too large")
    tiled = TILE_OFFSETS in tags
    bw, bh = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    if not bw or not bh:
        raise TiffError(f"page {number} has blocks without size")
    starts, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS)
    across, down = -(-width // bw), -(-height // bh)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if not starts or not counts or len(starts) < across * down * planes or len(counts) < len(starts):
        raise TiffError(f"page {number} lacks blocks")
    pixels = np.zeros((height, width, samples), dtype=kind)
    for i in range(across * down * planes):
        plane, rest = divmod(i, across * down)
        y, x = (v * s for v, s in zip(divmod(rest, across), (bh, bw)))
        rows = bh if tiled else min(bh, height - y)
        want = rows * bw * depth * kind.itemsize
        raw = _expand(data[starts[i] : starts[i] + counts[i]], compression, want)
        if len(raw) < want:
            raise TiffError(f"page {number}, block {i}: {len(raw)} bytes instead of {want}")
        block = _undo_predictor(np.frombuffer(raw, dtype=kind, count=want // kind.itemsize).reshape(rows, bw, depth), predictor)
        part = pixels[y : y + rows, x : x + bw, plane : plane + depth] if planar == 2 else pixels[y : y + rows, x : x + bw]
        part[...] = block[: part.shape[0], : part.shape[1]]
    return Page(number, width, height, samples, bits, compression, predictor, tiled, pixels)


def decode(data: bytes) -> Iterator[Page]:
    """The pages of a file, in directory order."""
    if data[:4] not in (b"II*\x00", b"MM\x00*"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    if len(data) < 8:
        raise TiffError("header is cut off")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, number = set(), 0
    while at and at not in seen:
        seen.add(at)
        tags, following = _directory(data, at, order)
        yield _page(data, tags, order, number)
        at, number = following, number + 1


def encode(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 2, tile: tuple[int, int] | None = None, strip_rows: int = 64, order: str = "<", planar: int = 1) -> bytes:
    """A TIFF file of arrays (height, width) or (height, width, samples), uint8 or uint16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for pixels in pages:
        pixels = pixels[:, :, None] if pixels.ndim == 2 else pixels
        height, width, samples = pixels.shape
        kind = np.dtype(np.uint8 if pixels.dtype.itemsize == 1 else order + "u2")
        pixels = pixels.astype(kind, copy=False)
        bw, bh = tile or (width, min(strip_rows, height))
        starts, counts = [], []
        for plane in range(samples if planar == 2 else 1):
            body = pixels[:, :, plane : plane + 1] if planar == 2 else pixels
            for y in range(0, height, bh):
                for x in range(0, width, bw):
                    block = body[y : y + bh, x : x + bw]
                    if tile:
                        full = np.zeros((bh, bw, body.shape[2]), dtype=kind)
                        full[: block.shape[0], : block.shape[1]] = block
                        block = full
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1).astype(kind)
                    packed = _shrink(block.tobytes(), compression)
                    starts.append(len(out))
                    counts.append(len(packed))
                    out += packed
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8 * kind.itemsize] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1])]
        if not tile:
            tags += [(STRIP_OFFSETS, 4, starts)]
        tags += [(SAMPLES, 3, [samples])]
        if not tile:
            tags += [(ROWS_PER_STRIP, 4, [bh]), (STRIP_COUNTS, 4, counts)]
        tags += [(PLANAR, 3, [planar]), (PREDICTOR, 3, [predictor])]
        if tile:
            tags += [(TILE_WIDTH, 4, [bw]), (TILE_LENGTH, 4, [bh]), (TILE_OFFSETS, 4, starts), (TILE_COUNTS, 4, counts)]
        entries = b""
        for tag, t, values in tags:
            packed = struct.pack(f"{order}{len(values)}{_TYPES[t]}", *values)
            if len(packed) > 4:
                out += b"\x00" * (len(out) % 2)
                where = struct.pack(order + "I", len(out))
                out += packed
                packed = where
            entries += struct.pack(order + "HHI", tag, t, len(values)) + packed.ljust(4, b"\x00")
        out += b"\x00" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def tiff_pages(df: DataFrame, key: str, media: str) -> DataFrame:
    """A row for each page of the files in ``media``: key, page, width, height, samples, bits, compression, predictor, tiled, pixels, error."""
    ship(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.col(media).cast("binary").alias("media"))
    schema = f"key {df.schema[key].dataType.simpleString()}, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrow(got: list[tuple], like: pa.DataType):
            kinds = [like, *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got), kinds)], names=names)

        for batch in lean_batches(batches):
            got, held = [], 0
            for k, data in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                try:
                    for p in decode(data) if data else ():
                        got.append((k, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None))
                        held += p.pixels.nbytes
                        if held > 32 << 20:
                            yield arrow(got, batch.column(0).type)
                            got, held = [], 0
                except (TiffError, zlib.error) as e:
                    got.append((k, None, None, None, None, None, None, None, None, None, str(e)))
            if got:
                yield arrow(got, batch.column(0).type)

    return rows.mapInArrow(run, schema)


def payload(text: bytes) -> bytes:
    """UTF-8 bytes, filled with 255 up to a positive multiple of ROW_BYTES."""
    return text + b"\xff" * (max(ROW_BYTES, -(-len(text) // ROW_BYTES) * ROW_BYTES) - len(text))


def store_text(text: bytes) -> bytes:
    """A text's payload as grey pages of ROW_BYTES columns: deflate with predictor, tiles on pages that fill them."""
    grid = np.frombuffer(payload(text), dtype=np.uint8).reshape(-1, ROW_BYTES)
    pages = [grid[at : at + PAGE_ROWS] for at in range(0, len(grid), PAGE_ROWS)]
    return encode(pages, ADOBE_DEFLATE, 2, (192, 64) if len(pages) > 1 else None)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in lean_batches(batches):
        rows = []
        for t in texts(batch.column(1)):
            media = store_text(t)
            whole, ends, n, pages, counts = hashlib.sha256(), b"", 0, 0, np.zeros(256, dtype=np.int64)
            moved = 0
            for p in decode(media):
                raw = p.pixels.tobytes()
                whole.update(raw)
                ends = (ends + raw[-32:])[-32:]
                n, pages = n + len(raw), pages + 1
                counts += np.bincount(p.pixels.reshape(-1), minlength=256)
                moved += int(np.abs(np.diff(p.pixels[:, :, 0].astype(np.int16), axis=1)).sum(dtype=np.int64))
            share = counts[counts > 0] / n
            values = np.arange(256)
            mean = float((counts * values).sum() / n)
            spread = float(np.sqrt(max(0.0, (counts * values * values).sum() / n - mean * mean)))
            feature = f"pages={pages};mean={mean:.4f};std={spread:.4f};entropy={-float((share * np.log2(share)).sum()) + 0.0:.4f};gradient={moved / n:.4f}"
            rows.append((len(t), n, whole.hexdigest(), zlib.crc32(ends), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in zip(*rows)]], names=["doc_id", *names])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: every text stored as TIFF, read back and described."""
    from weir.session import table

    ship(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
