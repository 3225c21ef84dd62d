"""Media columns: texts stored as 8-bit images, decoded, resized by area and tiled.

Storing: the UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of a grey image 64 wide, as binary PGM (Netpbm P5) or
as an 8-bit BMP with a grey palette, by a checksum of the payload. Reading: a decoder for PGM/PPM and 8- or 24-bit BMP gives numpy arrays;
an image is reduced to TILE by area, each cell being the mean over its exact, fractional rectangle, from an
integral image; the tile is written as NPY, and a difference hash is taken from it (each cell against its right neighbour).

Images and tiles are written as tables of blobs in the shared folder, a row for each, and read back from there; files by the million would swamp a file system. export() writes either as files.

Defined cases: a null or empty text is a payload of 64 zeros; images smaller than a tile are enlarged by the same law; equal texts give equal values;
a null doc_id is passed on; repeated rows are stored each; very long texts make tall images; columns beside doc_id and text are ignored; an empty table gives an empty result; bytes that aren't a valid image raise ValueError.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ploidyne.llm import textkernel as tk
from ploidyne.llm.common import documents, new_path

WIDTH = 64
#: Rows and columns of a tile; one column more than the hash has bits in a row.
TILE = (8, 9)
MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, kind string, height int, width int, tile binary, dhash string"


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """Bottom-up rows of 8-bit indices into a grey palette, each padded to four bytes."""
    h, w = samples.shape
    rows = np.zeros((h, -(-w // 4) * 4), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4)
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    head = struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 256)
    return head + palette.tobytes() + rows.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while end < len(data) and not data[end : end + 1].isspace():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header ends early")
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    depth = 3 if data[:2] == b"P6" else 1
    if most > 255 or len(data) - at - 1 < w * h * depth:
        raise ValueError("Netpbm samples are wide or missing")
    out = np.frombuffer(data, np.uint8, w * h * depth, at + 1)
    return out.reshape(h, w) if depth == 1 else out.reshape(h, w, 3)


def _bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (8, 24) or packing:
        raise ValueError("only plain BMP of 8 or 24 bits")
    line = -(-w * bits // 32) * 4
    if len(data) < start + line * abs(h):
        raise ValueError("BMP rows are missing")
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if bits == 24:
        return rows[:, : 3 * w].reshape(abs(h), w, 3)[:, :, ::-1]
    palette = np.frombuffer(data, np.uint8, 1024, 14 + head).reshape(256, 4)[:, 2::-1]
    grey = (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all()
    return palette[:, 0][rows[:, :w]] if grey else palette[rows[:, :w]]


def decode(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples of a PGM, PPM or BMP image."""
    if data[:2] in (b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, shape: tuple[int, int] = TILE) -> np.ndarray:
    """Means over the exact rectangles of a grid: differences of the integral image, taken between whole samples linearly."""
    if image.ndim == 3:
        image = image.mean(2)
    h, w = image.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0, dtype=np.int64), 1, out=total[1:, 1:])

    def at(m, n, axis):
        cuts = np.arange(n + 1) * (m / n)
        low = np.minimum(cuts.astype(np.int64), m - 1)
        part = (cuts - low).reshape((-1, 1) if axis == 0 else (1, -1))
        return low, part

    y, py = at(h, shape[0], 0)
    rows = total[y] * (1 - py) + total[y + 1] * py
    x, px = at(w, shape[1], 1)
    grid = rows[:, x] * (1 - px) + rows[:, x + 1] * px
    means = (grid[1:, 1:] - grid[:-1, 1:] - grid[1:, :-1] + grid[:-1, :-1]) / ((h / shape[0]) * (w / shape[1]))
    return np.clip(np.rint(means), 0, 255).astype(np.uint8)


def difference_hash(tile: np.ndarray) -> str:
    return np.packbits(tile[:, 1:] > tile[:, :-1]).tobytes().hex()


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an image."""

    def run(batches):
        for batch in batches:
            for part in tk.slices(batch, "text", 2 << 20):
                data, offsets = tk.buffers(part.column("text"))
                media = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    payload = np.zeros(max(1, -(-(b - a) // WIDTH)) * WIDTH, np.uint8)
                    payload[: b - a] = data[a:b]
                    image = payload.reshape(-1, WIDTH)
                    media.append(encode_bmp(image) if zlib.crc32(payload) & 1 else encode_pgm(image))
                yield pa.record_batch([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)


def read(media: DataFrame) -> DataFrame:
    """Decode stored images and compute their features and tiles."""

    def one(stored: bytes) -> tuple:
        image = decode(stored)
        payload = np.ascontiguousarray(image).tobytes()
        tile = area_resize(image)
        kind = "bmp" if stored[:2] == b"BM" else "pgm"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), kind, image.shape[0], image.shape[1], npy(tile), difference_hash(tile)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "kind", "height", "width", "tile", "dhash"]

    def run(batches):
        for batch in batches:
            found = [one(memoryview(m.as_buffer()).tobytes()) for m in batch.column("media")]
            columns = list(zip(*found, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", *names])

    return media.mapInArrow(run, FEATURES)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export(blobs: DataFrame, folder: str, column: str, ending: str) -> list[str]:
    """Write the blobs of a table as files ``doc_id.ending`` (numbered where doc_ids are null or repeat) in a folder of this process; rows pass one by one."""
    paths = []
    for i, row in enumerate(blobs.select("doc_id", column).toLocalIterator()):
        path = Path(folder) / f"{row.doc_id}.{ending}"
        path = Path(folder) / f"{row.doc_id}-{i}.{ending}" if path.exists() or row.doc_id is None else path
        path.write_bytes(row[column])
        paths.append(str(path))
    return paths


def op4(spark, sf_dir: str) -> DataFrame:
    found = written(read(written(store(documents(spark, sf_dir)), "media")), "tiles")
    feature = F.concat_ws(":", "kind", F.concat_ws("x", "width", "height"), "dhash", F.md5("tile"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
