"""Media columns: TIFF pages.

``write_tiff`` makes a baseline grey image in strips or tiles; ``read_tiff`` walks the chain of image directories of either byte order,
decodes PackBits, LZW or deflate data of 8 or 16 bits a sample, chunky or planar, undoes fill order and horizontal predictor and returns one page
after another.  The query stores each text as pages of 256 rows at most; a checksum of the text chooses strips or tiles, compression, predictor and
byte order, so that all of these are read back.

Defined results: a null or empty text is one row of 192 blanks; extra columns of the input are ignored by the query; damaged media
give the pages before the damage and an error text in ``tiff_pages``, whatever the damage; repeated rows are stored each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, read

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
_FLIPPED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))
#: No compression that is read here makes more bytes of one.
MOST_FOLD = 4096
#: What reading damaged data may raise.
DAMAGE = (ValueError, ArithmeticError, LookupError, TypeError, MemoryError, struct.error, zlib.error)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for k in range(at, end, 128):
            out.append(min(128, end - k) - 1)
            out.extend(data[k : min(k + 128, end)])

    for m in _RUN.finditer(data):
        literal(m.start())
        out += bytes((257 - (m.end() - m.start()), data[m.start()]))
        at = m.end()
    literal(len(data))
    return bytes(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Variable-width codes, most significant bit first, widened one code early."""
    out, acc, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, following, word = 9, 258, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    code_of = lambda w: w[0] if len(w) == 1 else table[w]
    put(256)
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        put(code_of(word))
        table[longer] = following
        following += 1
        if following == 4094:
            put(256)
            table, width, following = {}, 9, 258
        elif following == 1 << width:
            width += 1
        word = data[k : k + 1]
    if word:
        put(code_of(word))
        if following + 1 == 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def unlzw(data: bytes, size: int) -> bytes:
    out, acc, bits, at = bytearray(), 0, 0, 0
    table: list[bytes] = []
    width, last = 9, b""
    while len(out) < size:
        while bits < width and at < len(data):
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        code = acc >> bits - width
        bits -= width
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data don't begin with a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def _packed(raw: bytes, how: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits, LZW: lzw, DEFLATE: lambda x: zlib.compress(x, 1)}[how](raw)


def _unpacked(raw: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return raw
    if how == PACKBITS:
        return unpackbits(raw, size)
    if how == LZW:
        return unlzw(raw, size)
    if how in (DEFLATE, 32946):
        return zlib.decompressobj().decompress(raw, size)
    raise ValueError(f"compression {how}")


def write_tiff(pages: list[np.ndarray], how: int = DEFLATE, predictor: int = 2, rows: int = 128, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of 8-bit grey samples [height, width]; strips of so many rows, or tiles (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w = page.shape
        th, tw = tile or (rows, w)
        pieces = []
        for y in range(0, h, th):
            for x in range(0, w, tw):
                piece = page[y : y + th, x : x + tw]
                if tile:
                    piece = np.pad(piece, ((0, th - piece.shape[0]), (0, tw - piece.shape[1])))
                if predictor == 2:
                    piece = np.diff(piece, axis=1, prepend=np.uint8(0))
                pieces.append(_packed(np.ascontiguousarray(piece).tobytes(), how))
        where = []
        for piece in pieces:
            where.append(len(out))
            out += piece + b"\0" * (len(piece) % 2)
        tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8]), 259: (3, [how]), 262: (3, [1]), 277: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (4, [tw]), 323: (4, [th]), 324: (4, where), 325: (4, [*map(len, pieces)])} if tile else {273: (4, where), 278: (4, [rows]), 279: (4, [*map(len, pieces)])}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(raw) > 4:
                at = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
                raw = at
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += bytes(4)
    return bytes(out)


def read_tiff(data: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    """The tags and the samples [height, width, samples] of each page, in the order of the directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in _CODES:
                place = at + 10 + 12 * k
                if _SIZES[kind] * n > 4:
                    (place,) = struct.unpack_from(order + "I", data, place)
                tags[tag] = [*struct.unpack_from(f"{order}{n}{_CODES[kind]}", data, place)]
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        w, h, s = tags[256][0], tags[257][0], tags.get(277, [1])[0]
        how, predictor, planar = tags.get(259, [1])[0], tags.get(317, [1])[0], tags.get(284, [1])[0] == 2
        bits = set(tags.get(258, [1]))
        if len(bits) != 1 or not bits <= {8, 16}:
            raise ValueError("only 8-bit and 16-bit samples")
        kind = np.dtype(np.uint8 if bits == {8} else order + "u2")
        tiled = 324 in tags
        tw, th = (tags[322][0], tags[323][0]) if tiled else (w, min(tags.get(278, [h])[0], h))
        each = 1 if planar else s
        if min(w, h, s, tw, th) < 1 or max(w * h * s, tw * th * each) * kind.itemsize > MOST_FOLD * len(data):
            raise ValueError("sizes that the data can't hold")
        across, down = -(-w // tw), -(-h // th)
        places, sizes = tags[324 if tiled else 273], tags[325 if tiled else 279]
        if len(places) != len(sizes) or len(places) != across * down * (s if planar else 1):
            raise ValueError("number of strips or tiles")
        page = np.zeros((h, w, s), kind)
        for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
            plane, at_k = divmod(k, across * down)
            y, x = at_k // across * th, at_k % across * tw
            height = th if tiled else min(th, h - y)
            stored_ = data[place : place + size]
            need = height * tw * each * kind.itemsize
            raw = _unpacked(stored_.translate(_FLIPPED) if tags.get(266, [1])[0] == 2 else stored_, how, need)
            if len(raw) < need:
                raise ValueError("data end early")
            piece = np.frombuffer(raw, kind, height * tw * each).reshape(height, tw, each)
            if predictor == 2:
                piece = np.cumsum(piece, axis=1, dtype=kind.newbyteorder("="))
            part = page[y : y + th, x : x + tw, plane : plane + 1] if planar else page[y : y + th, x : x + tw]
            part[:] = piece[: part.shape[0], : part.shape[1]]
        yield tags, page


def tiff_pages(df: DataFrame, media: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row for each page of each binary: id, page (from 0), width, height, samples, compression, mean, pixels; or error."""
    schema = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("mean", pa.float64()), ("pixels", pa.binary()), ("error", pa.string())])

    def pages(batches):
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, k = [], 0
                try:
                    for k, (tags, page) in enumerate(read_tiff(blob or b"")):
                        rows.append((key, k, page.shape[1], page.shape[0], page.shape[2], tags.get(259, [1])[0], float(page.mean()) if page.size else 0.0, page.tobytes(), None))
                except DAMAGE as e:
                    rows.append((key, len(rows), None, None, None, None, None, None, str(e)[:200]))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    bounded_batches(df.sparkSession)
    out = df.select(F.col(id_col).alias("id"), F.col(media).alias("media")).mapInArrow(pages, "id long, page int, width int, height int, samples int, compression int, mean double, pixels binary, error string")
    return out.withColumnRenamed("id", id_col)


WIDTH, PAGE_ROWS = 192, 256
#: Compression, predictor, tile, byte order of the stored form, by the payload's checksum.
FORMS = ((DEFLATE, 2, None, "<"), (DEFLATE, 1, (64, 64), ">"), (PACKBITS, 1, None, "<"), (DEFLATE, 2, None, ">"), (LZW, 2, (64, 64), "<"), (DEFLATE, 1, None, "<"), (PACKBITS, 1, (64, 96), ">"), (NONE, 1, None, ">"), *[(DEFLATE, 2, None, "<")] * 8)
_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8", "surrogatepass")
    size = max(WIDTH, -(-len(raw) // WIDTH) * WIDTH)
    payload = raw.ljust(size, b" ")
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    how, predictor, tile, order = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write_tiff([image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)], how, predictor, tile=tile, order=order), len(raw)


def digest(text: str) -> tuple:
    """What the query returns for a text, from the stored bytes read back."""
    media, n = stored(text)
    pages = [page for _, page in read_tiff(media)]
    payload = b"".join(p.tobytes() for p in pages)
    flat = np.frombuffer(payload, np.uint8)
    counts = np.bincount(flat, minlength=256)
    p = counts[counts > 0] / len(flat)
    feature = f"pages={len(pages)};size={WIDTH}x{len(flat) // WIDTH};mean={flat.mean():.4f};sd={flat.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};mode={int(counts.argmax())}"
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return n, len(payload), sha(payload), zlib.crc32(payload[-16:]), len(media), sha(media), feature


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [digest(t or "") for t in batch.column(1).to_pylist()]
            columns = [*zip(*rows, strict=True)] if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    bounded_batches(spark)
    return read(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(run, _SCHEMA)


QUERIES = {"op10_tiff": op10_tiff}
#: Payload and sizes can be said in SQL, the stored form can't.
ORACLE: dict[str, str] = {}
