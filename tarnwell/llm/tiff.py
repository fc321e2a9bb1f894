"""TIFF media columns: write 8-bit grey pages, and read pages back by walking the image directories.

The reader follows the chain of image file directories of classic TIFF in either byte order, reads strips or tiles,
decompresses PackBits, LZW or deflate, undoes horizontal differencing, crops tiles at the edges, and yields one record for
each page. The writer makes what the round trip needs: strips or tiles in any of these codings.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import batch, id_and_text, map_arrow

# Fixed values of the TIFF 6.0 format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CLEAR, END = 256, 257


class TiffError(ValueError):
    """The bytes are no TIFF that this reader can decode."""


@dataclass
class Page:
    """One decoded page; ``pixels`` is (height, width, samples) of unsigned integers."""

    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


# -- codings --------------------------------------------------------------------------------------------------------

RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(lo: int, hi: int) -> None:
        for i in range(lo, hi, 128):
            part = data[i : min(i + 128, hi)]
            out.append(len(part) - 1)
            out.extend(part)

    for m in RUN.finditer(data):
        literal(at, m.start())
        out.extend((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(at, len(data))
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 1
            at += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, widened one code early as TIFF does.

    A table entry is keyed by (code of the prefix, next byte) as one integer; the codes between two clear codes have widths
    that follow from their number alone, so the bits are packed for all of them at once.
    """
    codes: list[int] = [CLEAR]
    starts = [0]  # where in codes each table begins
    table: dict[int, int] = {}
    get, put, nxt = table.get, codes.append, 258
    it = iter(data)
    w = next(it, -1)
    for c in it:
        k = w << 8 | c
        known = get(k)
        if known is not None:
            w = known
            continue
        put(w)
        table[k] = nxt
        nxt += 1
        w = c
        if nxt == 4095:
            starts.append(len(codes))
            put(CLEAR)
            table.clear()
            nxt = 258
    if w >= 0:
        put(w)
    put(END)
    all_codes = np.array(codes, np.uint32)
    nth = np.arange(len(codes)) - np.repeat(starts, np.diff([*starts, len(codes)]))
    # the clear code (number 0) has the width reached before it: that of a full table, 9 for the first
    width = np.where(nth == 0, 12, 9 + (nth >= 255) + (nth >= 767) + (nth >= 1791))
    width[0] = 9
    bits = (all_codes[:, None] >> np.arange(11, -1, -1, dtype=np.uint32) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) >= 12 - width[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """At most ``size`` bytes; a code beyond the table is an error, missing codes give a shorter result."""
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, got = first[:], [], 0
    width, acc, n, prev, full = 9, 0, 0, b"", 511
    for byte in data:
        acc, n = acc << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code = acc >> n
        acc &= (1 << n) - 1
        if code < 256 or code > 257:
            known = len(table)
            if code < known:
                entry = table[code]
                if prev and known < 4096:
                    table.append(prev + entry[:1])
            elif code == known and prev:
                entry = prev + prev[:1]
                table.append(entry)
            else:
                raise TiffError("LZW code beyond the table")
            out.append(entry)
            got += len(entry)
            if got >= size:
                break
            prev = entry
            if known + 1 >= full and width < 12:
                width = min(12, (known + 2).bit_length())
                full = (1 << width) - 1
        elif code == END:
            break
        else:
            table, width, prev, full = first[:], 9, b"", 511
    return b"".join(out)[:size]


def encode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1)


def decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(str(e)) from e
    raise TiffError(f"compression {compression} is not supported")


# -- the reader -----------------------------------------------------------------------------------------------------


def directories(data: bytes) -> Iterator[dict[int, list]]:
    """The tags of each image file directory in the chain. A chain that loops ends; one that leaves the file is an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no classic TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    try:
        while at and at not in seen:
            seen.add(at)
            tags: dict[int, list] = {0: [order]}
            for i in range(struct.unpack_from(order + "H", data, at)[0]):
                tag, kind, n, raw = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
                size = TYPE_SIZES.get(kind, 0) * n
                if size > len(data):
                    raise TiffError("a tag is longer than the file")
                here = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", raw)[0]
                code = {1: "B", 3: "H", 4: "I"}.get(kind)
                if code:
                    tags[tag] = list(struct.unpack_from(f"{order}{n}{code}", data, here))
            yield tags
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * struct.unpack_from(order + "H", data, at)[0])[0]
    except struct.error as e:
        raise TiffError("a directory is cut off") from e


#: Decoded bytes a page may have, and how many times longer than its stored bytes a strip or tile may be by each coding (deflate
#: and LZW cannot pack tighter than this, PackBits packs 128 bytes into two).
MAX_PAGE_BYTES = 1 << 28
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 2800, DEFLATE: 1040, OLD_DEFLATE: 1040}


def pages(data: bytes, max_bytes: int = MAX_PAGE_BYTES) -> Iterator[Page]:
    """Decode every page: grey or RGB(A) of 8 or 16 bits a sample, samples side by side.

    Nothing is allocated by what the header claims alone: a page of more than ``max_bytes``, or of more than its stored bytes
    can decode to, is a :class:`TiffError`, as is every other damage.
    """
    for number, t in enumerate(directories(data)):
        one = lambda tag, default=None, t=t: (t.get(tag) or [default])[0]
        w, h, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
        comp, pred, order = one(COMPRESSION, NONE), one(PREDICTOR, 1), one(0)
        if not w or not h or bits not in (8, 16) or one(PLANAR, 1) != 1 or pred not in (1, 2):
            raise TiffError("unsupported page layout")
        kind = np.dtype(order + ("u1" if bits == 8 else "u2"))
        tiled = TILE_OFFSETS in t
        tw, th = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
        offsets, lengths = (t[TILE_OFFSETS], t.get(TILE_BYTES)) if tiled else (t.get(STRIP_OFFSETS), t.get(STRIP_BYTES))
        if not tw or not th or not offsets or not lengths or len(offsets) != len(lengths):
            raise TiffError("strips or tiles are missing")
        across, down = -(-w // tw), -(-h // th)
        if len(offsets) < across * down:
            raise TiffError("strips or tiles are missing")
        if not 0 < samples <= 16 or w * h * samples * kind.itemsize > max_bytes or tw * th * samples * kind.itemsize > max_bytes:
            raise TiffError("a page is larger than the limit")
        if comp not in EXPANSION:
            raise TiffError(f"compression {comp} is not supported")
        stored = sum(max(0, min(n, len(data) - o)) for o, n in zip(offsets[: across * down], lengths, strict=False))
        if w * h * samples * kind.itemsize > EXPANSION[comp] * (stored + 64 * len(offsets)):
            raise TiffError("strips or tiles are too short for the page")
        img = np.zeros((h, w, samples), kind)
        for i in range(across * down):
            y, x = i // across * th, i % across * tw
            rows = th if tiled else min(th, h - y)
            size = rows * tw * samples * kind.itemsize
            raw = decode(data[offsets[i] : offsets[i] + lengths[i]], comp, size)
            if len(raw) < size:
                raise TiffError("a strip or tile is cut off")
            block = np.frombuffer(raw, kind).reshape(rows, tw, samples)
            if pred == 2:
                block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
            img[y : y + rows, x : x + tw] = block[: h - y, : w - x]
        yield Page(number, w, h, samples, bits, comp, pred, tiled, img)


# -- the writer -----------------------------------------------------------------------------------------------------


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, tile: int = 0, rows: int = 64) -> bytes:
    """A little-endian TIFF with one page for each 8-bit grey image, in strips of ``rows`` rows or square tiles of ``tile``."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for img in images:
        h, w = img.shape
        bh, bw = (tile, tile) if tile else (min(rows, h), w)
        offsets, lengths = [], []
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                block = img[y : y + bh, x : x + bw]
                if tile and block.shape != (tile, tile):
                    block = np.pad(block, ((0, bh - block.shape[0]), (0, bw - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
                coded = encode(np.ascontiguousarray(block).tobytes(), compression)
                offsets.append(len(out))
                lengths.append(len(coded))
                out += coded + b"\0" * (len(coded) % 2)
        tags = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
        tags += [(TILE_WIDTH, 4, [bw]), (TILE_HEIGHT, 4, [bh]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, lengths)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [bh]), (STRIP_BYTES, 4, lengths)]
        tags += [(PREDICTOR, 3, [predictor])] if predictor != 1 else []
        entries = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                out, raw = out + raw, struct.pack("<I", len(out))
            entries += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# -- as operators ---------------------------------------------------------------------------------------------------

PAGES = "id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def decode_pages(files: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row for each page of each TIFF in a binary column; pixels row by row, 16-bit samples little-endian.

    Bytes that cannot be decoded, and null media, give one row with ``error`` set and no pixels (pages before the damage are
    given too); an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n = 0
                try:
                    for n, p in enumerate(pages(data or b""), 1):
                        raw = p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                        yield batch(PAGES, [[x] for x in (i, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, raw, None)])
                except TiffError as e:
                    yield batch(PAGES, [[x] for x in (i, n, None, None, None, None, None, None, None, None, str(e))])

    return map_arrow(files.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media")), run, PAGES)


PAGE_ROWS = 4096  # of 64 bytes
CODINGS = ((LZW, 1, 0), (PACKBITS, 1, 0), (DEFLATE, 2, 64), (DEFLATE, 2, 0), (LZW, 2, 64), (NONE, 1, 0))  # compression, predictor, tile


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a TIFF 64 pixels wide, in pages of PAGE_ROWS rows; each payload's coding goes by its
    checksum, whatever its length."""
    img = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    compression, predictor, tile = CODINGS[zlib.crc32(payload) % len(CODINGS)]
    return write([img[i : i + PAGE_ROWS] for i in range(0, len(img), PAGE_ROWS)], compression, predictor, tile, rows=1024)


def described(every: list[Page], media: bytes) -> tuple:
    """(payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of a stored payload's pages."""
    got, p = b"".join(x.pixels.tobytes() for x in every), every[0]
    px = np.frombuffer(got, np.uint8)
    shares = ",".join(f"{x:.4f}" for x in np.bincount(px >> 5, minlength=8) / len(px))
    size, coding = f"{p.width}x{sum(x.height for x in every)}", f"{p.compression}/{p.predictor}/{'tiles' if p.tiled else 'strips'}"
    feature = f"pages={len(every)};size={size};coding={coding};mean={px.mean():.4f};dev={px.std():.4f};shares={shares}"
    return len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store each text as a TIFF, read it back by the directory walk and describe the pixels; one row for each row of ``docs``.

    A null text is the empty text (one row of 64 zero bytes). Equal texts give equal values; ids may be null or repeated;
    other columns are ignored; an empty table gives an empty table. A long text has several pages. ``feature`` names their
    number, the size of all of them, their coding, the mean and deviation of the pixels and the shares of their upper three bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                media = store(raw + bytes(-len(raw) % 64 or (0 if raw else 64)))
                every = list(pages(media))
                rows.append((i, len(raw), *described(every, media)))
            if rows:
                yield batch(MEDIA, list(zip(*rows, strict=True)))

    return map_arrow(id_and_text(docs, id_col, text_col), run, MEDIA)
