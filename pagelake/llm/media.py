"""Media columns: Netpbm and BMP bytes as numpy arrays, area-resized copies, NPY tiles, difference hashes.

decode() reads Netpbm of all six kinds (P1 to P6, 8 and 16 bits a sample, the first image of a file) and
BMP without compression (1, 4, 8, 16, 24, 32 bits, palettes, bit fields, both row orders). resized()
averages over areas by an integral image, of which only the rows at the edges of the new samples are
kept, so memory is a band of rows and not eight times the image. inspect() adds to every row of a media column its shape, the
digest of its samples, its difference hash and NPY files of the tiles of a resized copy.

All sums are integers, so equal images have equal values on every machine.

Nulls and edge cases: media that are null, empty, cut or of another kind have null values and say why in
``error``; an image without rows or columns is such an error. A text that is null is stored as the empty one. Very long texts are
tall images, read whole in bands; repeated rows are rows each; all columns asked for are kept, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelake.llm.common import quoted

#: Samples of an image that are summed at once.
BAND = 1 << 18

# ---------------------------------------------------------------- reading


def _netpbm_numbers(data: bytes, at: int, n: int) -> tuple[list[int], int]:
    """n whole numbers of a header, and the place after the white space that ends them; # starts a comment."""
    out = []
    while len(out) < n:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            else:
                at += 1
        stop = at
        while stop < len(data) and 48 <= data[stop] <= 57:
            stop += 1
        if stop == at:
            raise ValueError("bad Netpbm header")
        out.append(int(data[at:stop]))
        at = stop
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples (rows, columns, channels), 8 or 16 bits; 1 is black in bitmaps, as in the files."""
    kind = data[1] - 48
    bits = kind in (1, 4)
    numbers, at = _netpbm_numbers(data, 2, 2 if bits else 3)
    width, height, top = numbers if not bits else (*numbers, 1)
    if not width or not height:
        raise ValueError("image without samples")
    if not 0 < top < 65536:
        raise ValueError("bad Netpbm maximum")
    channels = 3 if kind in (3, 6) else 1
    n, wide = width * height * channels, np.dtype(">u2" if top > 255 else "u1")
    if kind == 1:
        found = np.frombuffer(data, np.uint8, offset=min(at, len(data)))
        flat = found[(found == 48) | (found == 49)][:n] - 48
    elif kind in (2, 3):
        flat = np.array(data[at:].split()[:n], dtype="S").astype(np.int64) if n else np.zeros(0)
        flat = flat.astype(wide.newbyteorder("="))
    elif kind == 4:
        stride = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, offset=min(at, len(data)))[: stride * height]
        if len(packed) < stride * height:
            raise ValueError("image is cut")
        flat = np.unpackbits(packed.reshape(height, stride), axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data[at : at + n * wide.itemsize], wide, count=min(n, max(0, len(data) - at) // wide.itemsize)).astype(wide.newbyteorder("="), copy=False)
    if len(flat) < n:
        raise ValueError("image is cut")
    return flat.reshape(height, width, channels)


def _field(pixels: np.ndarray, mask: int) -> np.ndarray:
    """A bit field of each pixel, spread to 0..255."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    return ((pixels >> np.uint32(shift) & np.uint32(top)).astype(np.uint64) * 255 // top).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Samples (rows, columns, 3) in red, green, blue, top row first."""
    if len(data) < 26:
        raise ValueError("image is cut")
    start, head = struct.unpack_from("<II", data, 10)
    if head == 12:
        width, height, _, bits = struct.unpack_from("<HHHH", data, 18)
        packing, entry, colours = 0, 3, 0
    elif head >= 40 and len(data) >= 54:
        width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
        entry, colours = 4, struct.unpack_from("<I", data, 46)[0]
    else:
        raise ValueError("bad BMP header")
    if bits not in (1, 4, 8, 16, 24, 32) or packing not in (0, 3) or (packing == 3 and bits not in (16, 32)):
        raise ValueError("compressed BMP")
    rows, stride = abs(height), (width * bits + 31) // 32 * 4
    if width <= 0 or not rows:
        raise ValueError("image without samples")
    if len(data) < start + stride * rows:
        raise ValueError("image is cut")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if bits <= 8:
        n = min(colours or 1 << bits, 1 << bits)
        table = np.zeros((256, 3), np.uint8)
        given = np.frombuffer(data, np.uint8, entry * n, 14 + head).reshape(n, entry)
        table[:n] = given[:, 2::-1]
        if bits == 8:
            index = lines[:, :width]
        else:
            each = np.unpackbits(lines, axis=1).reshape(rows, -1, bits)
            index = (each @ (1 << np.arange(bits - 1, -1, -1)))[:, :width]
        out = table[index]
    elif bits == 24:
        out = lines[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1]
    else:
        pixels = np.ascontiguousarray(lines[:, : width * bits // 8]).view("<u2" if bits == 16 else "<u4").astype(np.uint32)
        usual = (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else usual
        out = np.stack([_field(pixels, m) for m in masks], axis=2)
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> tuple[str, np.ndarray]:
    """(format, samples) of an image file; ValueError where it is none that this module reads."""
    if data[:1] == b"P" and data[1:2] in (b"1", b"2", b"3", b"4", b"5", b"6"):
        return f"P{data[1] - 48}", decode_netpbm(data)
    if data[:2] == b"BM":
        return "BMP", decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


# ---------------------------------------------------------------- resizing, hashing, tiles


def resized(image: np.ndarray, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Copies of an image (rows, columns, channels) in several shapes (rows, columns); each sample is the rounded mean of its area.

    An edge between samples lies a rational part of a row or column into the image; the integral image is linear there.
    """
    h, w, c = image.shape
    wanted = np.unique(np.concatenate([np.concatenate((e, np.minimum(e + 1, h))) for rows, _ in shapes for e in (np.arange(rows + 1) * h // rows,)]))
    kept = np.zeros((len(wanted), w + 1, c), np.int64)
    carry, step = np.zeros((w + 1, c), np.int64), max(1, BAND // w)
    for at in range(0, h, step):
        part = np.zeros((min(step, h - at), w + 1, c), np.int64)
        np.cumsum(image[at : at + step], axis=1, out=part[:, 1:])
        np.cumsum(part, axis=0, out=part)
        part += carry
        a, b = np.searchsorted(wanted, (at + 1, at + 1 + len(part)))
        kept[a:b] = part[wanted[a:b] - at - 1]
        carry = part[-1]
    out = []
    for rows, columns in shapes:
        edge, rest = np.divmod(np.arange(rows + 1) * h, rows)
        low, high = kept[np.searchsorted(wanted, edge)], kept[np.searchsorted(wanted, np.minimum(edge + 1, h))]
        down = np.diff(low * rows + (high - low) * rest[:, None, None], axis=0)
        edge, rest = np.divmod(np.arange(columns + 1) * w, columns)
        low, high = down[:, edge], down[:, np.minimum(edge + 1, w)]
        area = np.diff(low * columns + (high - low) * rest[None, :, None], axis=1)
        out.append(((2 * area + h * w) // (2 * h * w)).astype(image.dtype))
    return out


def grey(image: np.ndarray) -> np.ndarray:
    """(rows, columns) of one or three channels."""
    if image.shape[2] == 1:
        return image[:, :, 0].astype(np.int64)
    return (image.astype(np.int64) @ np.array([299, 587, 114]) + 500) // 1000


#: Rows and columns of the copy that is hashed: eight comparisons in each of eight rows.
HASHED = (8, 9)


def difference_hash(copy: np.ndarray) -> str:
    """16 hex digits of a copy in the shape HASHED: is a sample brighter than the one on its right?"""
    g = grey(copy)
    return np.packbits(g[:, :-1] > g[:, 1:]).tobytes().hex()


@lru_cache(256)
def _npy_head(shape: tuple[int, ...], kind: str) -> bytes:
    out = BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": kind, "fortran_order": False, "shape": shape})
    return out.getvalue()


def npy(array: np.ndarray) -> bytes:
    """The array as an NPY file."""
    array = np.ascontiguousarray(array)
    return _npy_head(array.shape, np.lib.format.dtype_to_descr(array.dtype)) + array.tobytes()


def tiles(image: np.ndarray, side: int) -> list[tuple[int, int, bytes]]:
    """(tile's row, tile's column, NPY file) of each tile; those at the right and lower edge may be smaller."""
    return [(r // side, k // side, npy(image[r : r + side, k : k + side])) for r in range(0, image.shape[0], side) for k in range(0, image.shape[1], side)]


# ---------------------------------------------------------------- columns

FOUND = "format string, height long, width long, channels long, samples_bytes long, samples_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tiles array<struct<row:long,column:long,npy:binary>>, error string"
TAIL = 64


def _inspected(data: bytes | None, shape: tuple[int, int], side: int) -> tuple:
    if data is None:
        return (None,) * 11 + ("null",)
    whole = (len(data), hashlib.sha256(data).hexdigest())
    try:
        kind, image = decode(data)
    except (ValueError, struct.error) as e:
        return (None,) * 7 + (*whole, None, None, str(e))
    samples = memoryview(np.ascontiguousarray(image)).cast("B")
    copy, small = resized(image, [shape, HASHED])
    cut = [{"row": r, "column": c, "npy": x} for r, c, x in tiles(copy, side)]
    return (kind, *image.shape, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), *whole, difference_hash(small), cut, None)


def inspect(media: DataFrame, media_col: str = "media", keep: list[str] | None = None, shape: tuple[int, int] = (16, 16), side: int = 16) -> DataFrame:
    """The columns ``keep`` and FOUND of every row: what the media column holds, and the tiles of its copy in ``shape``."""
    keep = [c for c in media.columns if c != media_col] if keep is None else keep
    found = StructType.fromDDL(FOUND)
    # Names in the result are free, so the rows travel by place.
    asked = media.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)), F.col(quoted(media_col)).alias("media"))
    schema = StructType([*asked.schema.fields[:-1], *(f for f in found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(found)
        for batch in batches:
            rows = [_inspected(x.as_py(), shape, side) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(len(found))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *found.names])

    out = asked.mapInArrow(run, schema)
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *found.names)


def text_image(text: Column, width: int = 64) -> tuple[Column, Column]:
    """(bytes of the UTF-8 text, binary PGM file of rows of ``width`` samples that holds them, zeros at the end)."""
    data = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    n = F.octet_length(data).cast("long")
    rows = F.greatest(F.lit(1), F.ceil(n / width)).cast("int")
    head = F.encode(F.concat(F.lit(f"P5\n{width} "), rows.cast("string"), F.lit("\n255\n")), "UTF-8")
    return n, F.concat(head, F.rpad(data, rows * width, F.lit(b"\0")))
