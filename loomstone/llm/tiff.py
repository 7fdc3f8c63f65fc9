"""Media columns of TIFF files: image directories, strips and tiles, one row per page.

The reader walks the chain of image directories (classic and big files, either
byte order), decodes strips or tiles that are plain, PackBits, LZW or deflate,
undoes horizontal and floating-point predictors, and gives the samples of each
page row by row.  The writer stores 8-bit samples in strips.

Sizes in a file are not trusted: nothing is allocated that its strips cannot fill,
and no strip is decoded beyond the rows it stands for.

Defined results: a null file has no pages; a broken or unknown one gives the pages
before the fault and a row with page -1 and the reason in ``error``; faults are also
strips that end early, pages over ``MOST_PAGE_BYTES`` and predictors of samples that
are not whole bytes; a chain that comes back to a directory it has seen ends there.
Files that are repeated give their rows again, null ids stay null, and an empty table
gives no rows.  Columns are read by the names given, others are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, documents, rows, ship, text_bytes

WIDTH = 64
#: Rows in a strip and in a page.
STRIP_ROWS, PAGE_ROWS = 1024, 1 << 18
#: Fixed values of the format: bytes of a field of each type, tags, compressions.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FILL_ORDER = 266
#: The most that a byte of each compression can stand for, rounded up.
EXPANDS = {PLAIN: 1, LZW: 4096, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
MOST_PAGE_BYTES = 1 << 29
REVERSED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def packbits_decode(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < most:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + n + 2]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at, plain = bytearray(), 0, bytearray()

    def flush() -> None:
        for k in range(0, len(plain), 128):
            out.append(len(plain[k : k + 128]) - 1)
            out.extend(plain[k : k + 128])
        plain.clear()

    while at < len(data):
        to = at + 1
        while to < len(data) and to - at < 128 and data[to] == data[at]:
            to += 1
        if to - at >= 3:
            flush()
            out += bytes((257 - (to - at), data[at]))
        else:
            plain += data[at:to]
        at = to
    flush()
    return bytes(out)


def lzw_decode(data: bytes, most: int) -> bytes:
    """Codes from 9 to 12 bits, high bits first, a code wider one entry early."""
    start = [bytes((k,)) for k in range(256)] + [b"", b""]
    table, out, last, width = list(start), [], b"", 9
    held = bits = size = 0
    for byte in data:
        if size >= most:
            break
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = list(start), b"", 9
            continue
        if not last:
            now = table[code]
        elif code < len(table):
            now = table[code]
            table.append(last + now[:1])
        elif code == len(table):
            now = last + last[:1]
            table.append(now)
        else:
            raise ValueError("a code beyond the table")
        out.append(now)
        size += len(now)
        last = now
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    held = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    table, size, width, now = {bytes((k,)): k for k in range(256)}, 258, 9, b""
    put(256, 9)
    for k in range(len(data)):
        more = now + data[k : k + 1]
        if more in table:
            now = more
            continue
        put(table[now], width)
        table[more] = size
        size, now = size + 1, data[k : k + 1]
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            put(256, width)
            table, size, width = {bytes((k,)): k for k in range(256)}, 258, 9
    if now:
        put(table[now], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


DECODERS = {PLAIN: lambda data, most: data, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
ENCODERS = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}


def undo_predictor(raw: bytes, predictor: int, high: int, wide: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Samples of a strip or tile as rows of bytes, as native values where a predictor had to be undone."""
    row = -(-wide * samples * bits // 8)
    a = np.frombuffer(raw[: high * row].ljust(high * row, b"\0"), dtype=np.uint8).reshape(high, row)
    if predictor == 1:
        return a
    if bits not in (8, 16, 32, 64) and (predictor, bits) != (3, 24):
        raise ValueError(f"predictor {predictor} of samples of {bits} bits")
    if predictor == 2:
        kind = np.dtype(f"{order}u{bits // 8}")
        v = np.ascontiguousarray(a).view(kind).reshape(high, wide, samples)
        return np.cumsum(v, axis=1, dtype=np.dtype(f"u{bits // 8}")).astype(kind).reshape(high, -1).view(np.uint8)
    if predictor == 3:
        size = bits // 8
        v = np.cumsum(a.reshape(high, wide * size, samples), axis=1, dtype=np.uint8).reshape(high, size, wide * samples)
        v = v.transpose(0, 2, 1)  # the planes hold the high byte first
        return np.ascontiguousarray(v[:, :, ::-1] if order == "<" else v).reshape(high, -1)
    raise ValueError(f"predictor {predictor}")


def _fields(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, list], int]:
    """The directory at ``at`` and where the next one is."""
    head, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    (n,), at = struct.unpack_from(order + head, data, at), at + struct.calcsize(head)
    found: dict[int, list] = {}
    for k in range(n):
        here = at + k * entry
        tag, kind = struct.unpack_from(order + "HH", data, here)
        (count,) = struct.unpack_from(order + word, data, here + 4)
        if kind not in TYPE_CODES:
            continue
        room = here + 4 + struct.calcsize(word)
        if count * TYPE_BYTES[kind] > struct.calcsize(word):
            (room,) = struct.unpack_from(order + word, data, room)
        if room + count * TYPE_BYTES[kind] > len(data):
            raise ValueError(f"tag {tag} lies beyond the file")
        found[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, room))
    (after,) = struct.unpack_from(order + word, data, at + n * entry)
    return found, after


def pages(data: bytes) -> Iterator[dict]:
    """Every page: page, width, height, samples, bits, compression, predictor, pixels (rows of samples, file's byte order)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8:
        raise ValueError("no TIFF header")
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise ValueError(f"version {magic}")
    big = magic == 43
    (at,) = struct.unpack_from(order + "Q", data, 8) if big else struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        f, after = _fields(data, at, order, big)
        yield _page(data, f, order) | {"page": len(seen) - 1}
        at = after


def _page(data: bytes, f: dict[int, list], order: str) -> dict:
    one = lambda tag, default: f.get(tag, [default])[0]
    width, height, samples, planar = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES, 1), one(PLANAR, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if len(set(f.get(BITS, [1]))) > 1:
        raise ValueError("samples of different sizes")
    if compression not in DECODERS:
        raise ValueError(f"compression {compression}")
    decode, planes, each = DECODERS[compression], samples if planar == 2 else 1, 1 if planar == 2 else samples
    tiled = TILE_OFFSETS in f
    wide, high = (one(TILE_WIDTH, width), one(TILE_LENGTH, height)) if tiled else (width, min(one(ROWS_PER_STRIP, height) or height, height) or 1)
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f.get(STRIP_OFFSETS, []), f.get(STRIP_COUNTS, []))
    across, down = (-(-width // wide) if wide else 0), (-(-height // high) if high else 0)
    if len(offsets) < across * down * planes or len(counts) != len(offsets):
        raise ValueError("strips or tiles are missing")
    if tiled and across > 1 and wide * each * bits % 8:
        raise ValueError("tiles that end within a byte")
    if planes > 1 and bits % 8:
        raise ValueError("separate planes of samples that are not whole bytes")
    row, used = -(-width * each * bits // 8), across * down * planes
    if any(i + n > len(data) for i, n in zip(offsets[:used], counts[:used], strict=True)):
        raise ValueError("a strip or tile lies beyond the file")
    if planes * height * row > min(MOST_PAGE_BYTES, EXPANDS[compression] * sum(counts[:used])):
        raise ValueError(f"{width} x {height} pixels do not come of so few bytes, or are too many")
    out = np.zeros((planes, height, row), dtype=np.uint8)
    for k in range(used):
        plane, cell = divmod(k, across * down)
        y, x = divmod(cell, across)
        rows_ = high if tiled else min(high, height - y * high)
        raw, need = data[offsets[k] : offsets[k] + counts[k]], rows_ * -(-wide * each * bits // 8)
        if need > EXPANDS[compression] * len(raw):
            raise ValueError("a strip or tile ends early")
        raw = decode(raw.translate(REVERSED) if one(FILL_ORDER, 1) == 2 else raw, need)
        if len(raw) < need:
            raise ValueError("a strip or tile ends early")
        a = undo_predictor(raw, predictor, rows_, wide, each, bits, order)
        top, left = y * high, x * (wide * each * bits // 8)
        a = a[: height - top, : row - left]
        out[plane, top : top + a.shape[0], left : left + a.shape[1]] = a
    if planes > 1 and bits % 8 == 0:  # separate planes are brought together
        out = out.reshape(planes, height, width, bits // 8).transpose(1, 2, 0, 3)
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": compression, "predictor": predictor, "pixels": out.tobytes()}


def write_gray(payload: bytes, width: int = WIDTH, compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian file of 8-bit gray samples; ``payload`` is a positive multiple of ``width`` long."""
    a = np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)
    if predictor == 2:
        a = np.concatenate([a[:, :1], a[:, 1:] - a[:, :-1]], axis=1)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for top in range(0, len(a), page_rows):
        page, offsets, counts = a[top : top + page_rows], [], []
        for y in range(0, len(page), strip_rows):
            strip = ENCODERS[compression](page[y : y + strip_rows].tobytes())
            offsets.append(len(out))
            counts.append(len(strip))
            out += strip
        n = len(offsets)
        far = {}
        if n > 1:
            for tag, values in ((STRIP_OFFSETS, offsets), (STRIP_COUNTS, counts)):
                out += b"\0" * (len(out) % 2)
                far[tag] = len(out)
                out += struct.pack(f"<{n}I", *values)
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        fields = [(IMAGE_WIDTH, 4, 1, width), (IMAGE_LENGTH, 4, 1, len(page)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (STRIP_OFFSETS, 4, n, far.get(STRIP_OFFSETS, offsets[0])), (SAMPLES, 3, 1, 1), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_COUNTS, 4, n, far.get(STRIP_COUNTS, counts[0])), (PREDICTOR, 3, 1, predictor)]
        out += struct.pack("<H", len(fields))
        for field in fields:
            out += struct.pack("<HHII", *field)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def feature(samples: np.ndarray) -> str:
    """64 bits of an average hash (64 runs of samples against the mean) and a histogram of 16 levels, in hex."""
    edge = np.linspace(0, len(samples), 65).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(samples, dtype=np.int64)])
    means = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(np.diff(edge), 1)
    bits = int("".join("1" if x > total[-1] / len(samples) else "0" for x in means), 2)
    share = np.bincount(samples >> 4, minlength=16) * 15 // len(samples)
    return f"{bits:016x}-" + "".join(f"{x:x}" for x in share)


PAGE_SCHEMA = "file_id long, page int, width long, height long, samples int, bits int, compression int, predictor int, sha256 string, pixels binary, error string"


def tiff_pages(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of every file in a binary column; the columns are PAGE_SCHEMA."""
    ship(files.sparkSession)

    def run(batches):
        kinds = {"file_id": pa.int64(), "page": pa.int32(), "width": pa.int64(), "height": pa.int64(), "samples": pa.int32(), "bits": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "sha256": pa.string(), "pixels": pa.binary(), "error": pa.string()}

        def flush(out):
            return pa.RecordBatch.from_arrays([pa.array([p.get(c) for p in out], kind) for c, kind in kinds.items()], names=list(kinds))

        for b in chunks(batches, "media"):
            out, held = [], 0
            for i, media in zip(b.column("file_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                if media is None:
                    continue
                try:
                    for p in pages(media):
                        out.append(p | {"sha256": hashlib.sha256(p["pixels"]).hexdigest(), "file_id": i})
                        held += len(p["pixels"])
                        if held > CHUNK_BYTES:
                            yield flush(out)
                            out, held = [], 0
                except (ValueError, KeyError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
                    out.append({"page": -1, "error": str(e)[:200], "file_id": i})
            if out:
                yield flush(out)

    return files.select(F.col(f"`{id_col}`").cast("long").alias("file_id"), F.col(f"`{media_col}`").cast("binary").alias("media")).mapInArrow(run, PAGE_SCHEMA)


def payload_of(text: bytes, block: int = 64) -> bytes:
    """``text`` with zeros up to a positive multiple of ``block``."""
    return text.ljust(max(block, -(-len(text) // block) * block), b"\0")


def to_tiff(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every whole text as the samples of a TIFF file."""

    def run(batches):
        for b in chunks(batches):
            texts = text_bytes(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array([write_gray(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Digests and features of what is read back from the files of to_tiff, all pages of a file together."""
    ship(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int"

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32())
        names = [x.split()[0] for x in schema.split(", ")]
        for b in chunks(batches, "media"):
            out = []
            for d, n, m in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist(), strict=True):
                own = [p["pixels"] for p in pages(m)]
                read = b"".join(own)
                out.append((d, n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(read, dtype=np.uint8)), len(own)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return media_digest(to_tiff(documents(spark, sf_dir)))
