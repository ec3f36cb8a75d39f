"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

Decoders take P5 and P6 (8 and 16 bits), P2 and P3, P1 and P4, and uncompressed BMP of 8, 24 and 32 bits.
Resizing reads a summed-area table at fractional corners; the table is built in blocks of rows, so memory
does not grow with the height of a picture.

Defined results: a null text counts as empty, an empty one is stored as 64 zero bytes; texts of any length are stored
whole; equal texts give equal values, repeated rows one row each; an empty table gives an empty result; a null, empty
or broken picture gets nulls and a reason; a sample above its depth is a broken picture; tiles are 8 bits of the depth;
other columns are kept by ``media_tiles``, but for those of the names it adds, and not read by ``text_media``.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skein.llm.common import by_size, text_bytes

BLOCK_ROWS = 1024
#: Width of the picture that a payload is stored as; payloads are padded to a multiple of it.
PAYLOAD_WIDTH = 64
HASH_ROWS, HASH_COLUMNS = 8, 9
_SLICE_BYTES = 4 << 20

_GAP = rb"(?:\s|#[^\r\n]*[\r\n])+"
_NETPBM = re.compile(rb"P([1-6])" + _GAP + rb"(\d+)" + _GAP + rb"(\d+)")
_MAXVAL = re.compile(_GAP + rb"(\d+)")


def encode_pgm(pixels: np.ndarray) -> bytes:
    """Binary Netpbm of 8-bit samples: grey (height, width) or RGB (height, width, 3)."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """Uncompressed BMP of 8-bit grey samples with a grey palette, bottom row first."""
    height, width = pixels.shape
    rows = np.zeros((height, -(-width // 4) * 4), np.uint8)
    rows[:, :width] = pixels[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1)
    palette[:, 3] = 0
    offset = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", offset + rows.size, 0, 0, offset)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + info + palette.tobytes() + rows.tobytes()


def _samples(data: bytes, kind: type | np.dtype | str, count: int, at: int) -> np.ndarray:
    """``count`` samples from ``at`` on; sizes of broken headers are compared as whole numbers of any length."""
    if count <= 0:
        raise ValueError("no pixels")
    if at < 0 or count * np.dtype(kind).itemsize > len(data) - at:
        raise ValueError("the picture is cut short")
    return np.frombuffer(data, kind, count, at)


def decode_netpbm(data: bytes) -> tuple[np.ndarray, int]:
    """Samples as stored and the largest value they may take; bitmaps become 0 and 255."""
    head = _NETPBM.match(data)
    if not head:
        raise ValueError("not a Netpbm picture")
    kind, width, height = (int(x) for x in head.groups())
    at, high = head.end(), 1
    if kind not in (1, 4):
        depth = _MAXVAL.match(data, at)
        if not depth:
            raise ValueError("no sample depth")
        high, at = int(depth[1]), depth.end()
        if not 0 < high < 65536:
            raise ValueError("no sample depth of 1 to 65535")
    planes = 3 if kind in (3, 6) else 1
    count = width * height * planes
    if kind == 4:
        stride = -(-width // 8)
        bits = np.unpackbits(_samples(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        return (1 - bits[:, :width]) * np.uint8(255), 255
    if kind in (5, 6):
        flat = _samples(data, np.uint8 if high < 256 else ">u2", count, at + 1)
    else:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        digits = re.findall(rb"[01]", body) if kind == 1 else body.split()
        if not 0 < count <= len(digits):
            raise ValueError("the picture is cut short" if count else "no pixels")
        values = [int(x) for x in digits[:count]]
        if not 0 <= min(values) <= max(values) <= high:
            raise ValueError("a sample is outside of the depth")
        if kind == 1:
            return ((1 - np.array(values, np.uint8)) * 255).reshape(height, width), 255
        flat = np.array(values, np.uint8 if high < 256 else np.uint16)
    return flat.reshape((height, width, 3) if planes == 3 else (height, width)), high


def decode_bmp(data: bytes) -> np.ndarray:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP picture")
    offset, info = struct.unpack_from("<II", data, 10)
    width, height, _, depth, packed = struct.unpack_from("<iiHHI", data, 18)
    if packed or depth not in (8, 24, 32) or width <= 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    tall, stride = abs(height), -(-width * depth // 32) * 4
    rows = _samples(data, np.uint8, stride * tall, offset).reshape(tall, stride)
    if height > 0:
        rows = rows[::-1]
    if depth > 8:
        return rows[:, : width * depth // 8].reshape(tall, width, depth // 8)[:, :, 2::-1]
    colours = min(256, (offset - 14 - info) // 4)
    if colours <= 0:
        raise ValueError("no palette")
    palette = _samples(data, np.uint8, 4 * colours, 14 + info).reshape(-1, 4)[:, 2::-1]
    index = rows[:, :width]
    if index.max() >= colours:
        raise ValueError("a pixel is outside of the palette")
    return palette[:, 0][index] if (palette == palette[:, :1]).all() else palette[index]


def picture(data: bytes) -> tuple[np.ndarray, int]:
    """Samples and the largest value they may take."""
    return (decode_bmp(data), 255) if data[:2] == b"BM" else decode_netpbm(data)


def decode(data: bytes) -> np.ndarray:
    return picture(data)[0]


def _corners(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.arange(parts + 1) * (size / parts)
    whole = np.minimum(edge.astype(np.int64), size - 1)
    return whole, edge - whole


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the area that each target pixel covers, from a summed-area table at fractional corners."""
    planes = pixels[:, :, None] if pixels.ndim == 2 else pixels
    tall, wide, depth = planes.shape
    row, row_part = _corners(tall, height)
    col, col_part = _corners(wide, width)
    at_rows = np.zeros((height + 1, width + 1, depth))
    above = np.zeros((width + 1, depth))  # the table's row at the top of the block, at the column corners
    for top in range(0, tall, BLOCK_ROWS):
        block = planes[top : top + BLOCK_ROWS].astype(np.float64)
        across = np.zeros((len(block), wide + 1, depth))
        np.cumsum(block, axis=1, out=across[:, 1:])
        sums = across[:, col] + (across[:, col + 1] - across[:, col]) * col_part[None, :, None]
        table = np.concatenate([above[None], above + np.cumsum(sums, axis=0)])
        here = np.flatnonzero((row >= top) & (row < top + len(block)))
        low, part = row[here] - top, row_part[here][:, None, None]
        at_rows[here] = table[low] + (table[low + 1] - table[low]) * part
        above = table[-1]
    cells = at_rows[1:, 1:] - at_rows[:-1, 1:] - at_rows[1:, :-1] + at_rows[:-1, :-1]
    mean = cells / (tall / height * wide / width)
    return mean[:, :, 0] if pixels.ndim == 2 else mean


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8 x 9 reduction is darker than its right neighbour."""
    grey = pixels.mean(axis=2) if pixels.ndim == 3 else pixels
    small = np.round(area_resize(grey, HASH_ROWS, HASH_COLUMNS), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, height: int = 16, width: int = 16, high: int = 255) -> bytes:
    """The reduction to one tile of 8-bit samples, in NPY format; ``high`` becomes 255."""
    out = io.BytesIO()
    scaled = area_resize(pixels, height, width) * (255 / high)
    np.save(out, np.clip(np.rint(scaled), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, media_col: str = "media", *, tile: int = 16) -> DataFrame:
    """Adds ``height, width, tile_npy, dhash, media_error`` to a table of pictures.

    A null, empty or broken picture gets nulls and says why in ``media_error``. Columns of those names are replaced.
    """
    made = {"height": pa.int64(), "width": pa.int64(), "tile_npy": pa.binary(), "dhash": pa.string(), "media_error": pa.string()}
    base = df.drop(*[c for c in df.columns if c in made])

    def one(data: bytes | None) -> tuple:
        if not data:
            return None, None, None, None, "no data"
        try:
            pixels, high = picture(data)
        except (ValueError, struct.error) as why:
            return None, None, None, None, str(why)
        return pixels.shape[0], pixels.shape[1], npy_tile(pixels, tile, tile, high), difference_hash(pixels), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(one(x.as_py()) for x in batch.column(media_col)), strict=True)) or [[]] * len(made)
            columns = [pa.array(values, kind) for values, kind in zip(rows, made.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *made])

    schema = StructType(list(base.schema.fields))
    for name, kind in zip(made, ("long", "long", "binary", "string", "string"), strict=True):
        schema = schema.add(name, kind)
    return base.mapInArrow(run, schema)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the text with zero bytes up to a positive multiple of the width."""
    raw = text_bytes(text)
    return len(raw), raw + bytes(max(PAYLOAD_WIDTH, -(-len(raw) // PAYLOAD_WIDTH) * PAYLOAD_WIDTH) - len(raw))


def store_text(text: str | None) -> bytes:
    """A text as a grey picture of 64 columns, one byte a sample."""
    payload = payload_of(text)[1]
    return encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, PAYLOAD_WIDTH))


MEDIA_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, tile_sha256 string, bmp_bytes long, bmp_sha256 string"
)


def _digest(doc_id: int | None, text: str | None) -> tuple:
    n_bytes, _ = payload_of(text)
    media = store_text(text)
    pixels = decode(media)
    back = pixels.tobytes()
    bmp = encode_bmp(pixels)
    if decode(bmp).tobytes() != back:
        raise ValueError("the BMP form does not read back")
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return (doc_id, n_bytes, len(back), sha(back), zlib.crc32(back[-64:]), len(media), sha(media), difference_hash(pixels),
            sha(npy_tile(pixels)), len(bmp), sha(bmp))


def text_media(docs: DataFrame) -> DataFrame:
    """Each whole text stored as a Netpbm and a BMP picture, read back and hashed; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_size(batch, 1, _SLICE_BYTES):
                rows = [_digest(i.as_py(), t.as_py()) for i, t in zip(part.column(0), part.column(1), strict=True)]
                columns = zip(*rows, strict=True)
                kinds = [pa.int64() if c == "long" else pa.string() for c in MEDIA_SCHEMA.replace(",", "").split()[1::2]]
                names = MEDIA_SCHEMA.replace(",", "").split()[::2]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MEDIA_SCHEMA)
