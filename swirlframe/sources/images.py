"""Image files as frames: PNG and baseline TIFF decoders, a binary-file reader, and a data source of TIFF pages."""

from __future__ import annotations

import mmap
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.selection import numbered
from ..schema import FRAMES


def _gray(a: np.ndarray, channels: int) -> np.ndarray:
    """Luma of colours; alpha is left out."""
    if channels in (1, 2):
        return a[..., 0]
    return a[..., :3] @ np.array([0.299, 0.587, 0.114])


def decode_png(data: bytes) -> np.ndarray:
    """Gray values in [0, 1] of a PNG without interlacing."""
    at, idat, head, palette = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3) / 255
        elif kind == b"IDAT":
            idat += body
    if head is None or head[6]:
        raise ValueError("not a PNG, or an interlaced one")
    width, height, depth, colour = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    size = max(1, channels * depth // 8)
    line = (width * channels * depth + 7) // 8
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(height, line + 1)
    out = np.zeros((height, line), np.uint8)
    before = np.zeros(line, np.int64)
    for r in range(height):
        kind, x = int(raw[r, 0]), raw[r, 1:].astype(np.int64)
        if kind == 2:
            x = (x + before) & 255
        elif kind == 1:
            for c in range(size):
                x[c::size] = np.cumsum(x[c::size]) & 255
        elif kind in (3, 4):
            for i in range(line):
                a = x[i - size] if i >= size else 0
                if kind == 3:
                    x[i] = (x[i] + (a + before[i]) // 2) & 255
                    continue
                c = before[i - size] if i >= size else 0
                p = a + before[i] - c
                near = min((abs(p - a), 0, a), (abs(p - before[i]), 1, before[i]), (abs(p - c), 2, c))
                x[i] = (x[i] + near[2]) & 255
        out[r], before = x, x
    if depth == 16:
        values = out.view(">u2").astype(float).reshape(height, width, channels) / 65535
    elif depth == 8:
        values = out.reshape(height, width, channels).astype(float)
    else:
        bits = np.unpackbits(out, axis=1).reshape(height, -1, depth)[:, : width * channels]
        values = (bits @ (1 << np.arange(depth)[::-1])).reshape(height, width, channels).astype(float)
    if colour == 3:
        return palette[values[..., 0].astype(int)] @ np.array([0.299, 0.587, 0.114])
    return _gray(values if depth == 16 else values / (2**depth - 1), channels)


def encode_png(image: np.ndarray) -> bytes:
    """A 16-bit gray PNG of values in [0, 1]."""
    v = np.rint(np.clip(image, 0, 1) * 65535).astype(">u2")
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + r.tobytes() for r in v)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", v.shape[1], v.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


_SIZES = {1: 1, 3: 2, 4: 4}


def tiff_pages(data: bytes) -> list[dict[int, tuple]]:
    """Tags of each page of a baseline TIFF."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF")
    e = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(e + "I", data[4:8])
    pages = []
    while at:
        (n,) = struct.unpack(e + "H", data[at : at + 2])
        tags = {0: (e,)}
        for i in range(n):
            tag, kind, count = struct.unpack(e + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            if kind not in _SIZES:
                continue
            size = _SIZES[kind] * count
            place = at + 10 + 12 * i
            if size > 4:
                (place,) = struct.unpack(e + "I", data[place : place + 4])
            tags[tag] = struct.unpack(e + {1: "B", 3: "H", 4: "I"}[kind] * count, data[place : place + size])
        pages.append(tags)
        (at,) = struct.unpack(e + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
    return pages


def _packbits(data: bytes) -> bytes:
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


def decode_tiff(data: bytes, page: int = 0) -> np.ndarray:
    """Gray values in [0, 1] of a page: 8 or 16 bits, plain, PackBits or deflate strips."""
    t = tiff_pages(data)[page]
    e, width, height = t[0][0], t[256][0], t[257][0]
    bits, channels, packing, photo = t.get(258, (1,))[0], t.get(277, (1,))[0], t.get(259, (1,))[0], t.get(262, (1,))[0]
    if bits not in (8, 16) or packing not in (1, 8, 32773, 32946) or 322 in t:
        raise ValueError("only 8- and 16-bit strips, plain, PackBits or deflate")
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}[packing]
    raw = b"".join(unpack(data[o : o + n]) for o, n in zip(t[273], t[279], strict=True))
    a = np.frombuffer(raw, e + ("u1" if bits == 8 else "u2"), width * height * channels).reshape(height, width, channels).astype(float)
    if t.get(317, (1,))[0] == 2:
        a = np.cumsum(a, axis=1) % (1 << bits)
    g = _gray(a / ((1 << bits) - 1), channels)
    return 1 - g if photo == 0 else g


def encode_tiff(pages: list[np.ndarray]) -> bytes:
    """A 16-bit gray TIFF of pages with values in [0, 1]."""
    out = bytearray(b"II*\0" + b"\0" * 4)
    link = 4
    for image in pages:
        v = np.rint(np.clip(image, 0, 1) * 65535).astype("<u2")
        place = len(out)
        out += v.tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, v.shape[1]), (257, 4, v.shape[0]), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, place), (277, 3, 1), (278, 4, v.shape[0]), (279, 4, v.nbytes)]
        out += struct.pack("<H", len(tags))
        for tag, kind, value in tags:
            out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def decode(data: bytes, page: int = 0) -> np.ndarray:
    if data[:4] == b"\x89PNG":
        return decode_png(data)
    return decode_tiff(data, page)


def load_frames(spark: SparkSession, path: str | list[str], recording: str = "recording", camera: int = 1, glob: str = "*", broadcast_files: int = 100_000) -> DataFrame:
    """FRAMES of image files in name order: files are read by Spark, decoded where they are read; pages count as frames.

    frame_idx numbers files by name; a page's index follows its file's. A missing path is Spark's own error. Files are
    numbered first, from their names and numbers of pages, by ranges of names; up to ``broadcast_files`` names are broadcast, else files join them undecoded.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = [len(tiff_pages(d)) if d[:2] in (b"II", b"MM") else 1 for d in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], names=["path", "pages"])

    single = F.lower(F.col("path")).endswith(".png")  # their content isn't read here
    pages = files.filter(~single).mapInArrow(count, "path string, pages long").unionAll(files.filter(single).select("path", F.lit(1).cast("long").alias("pages")))
    each = pages.select("path", F.explode(F.sequence(F.lit(1).cast("long"), "pages")).alias("page"))  # names only
    first = numbered(each, ("path", "page"), "n").filter("page = 1").select("path", (F.col("n") - 1).alias("before"))
    few = len(files.inputFiles()) <= broadcast_files
    rows = files.join(F.broadcast(first) if few else first.hint("merge"), "path").select("path", "before", "content")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, start, data in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                for k in range(len(tiff_pages(data)) if data[:2] in (b"II", b"MM") else 1):
                    a = decode(data, k)
                    yield _frame_batch((recording, camera, start + k + 1, None, name.rsplit("/", 1)[-1], *a.shape, a.ravel()))

    return rows.mapInArrow(run, FRAMES)


def _frame_batch(row: tuple) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in FRAMES.split(", ")])


def frame_row(recording: str, camera: int, index: int, image: np.ndarray, ts: float | None = None, label: str | None = None) -> tuple:
    return recording, camera, index, ts, label or f"frame {index}", image.shape[0], image.shape[1], np.asarray(image, float).ravel().tolist()


def frames_of(spark: SparkSession, images: list[np.ndarray], recording: str = "recording", camera: int = 1, timestamps=None, labels=None) -> DataFrame:
    """FRAMES of images that the driver has."""
    for other in (timestamps, labels):
        if other is not None and len(other) != len(images):
            raise ValueError("timestamps and labels are as many as images")
    rows = [frame_row(recording, camera, i, a, timestamps[i - 1] if timestamps is not None else None, labels[i - 1] if labels is not None else None) for i, a in enumerate(images, 1)]
    return spark.createDataFrame(rows, FRAMES)


def frame_source(spark: SparkSession, n: int, loader: Callable[[int], np.ndarray], timestamps=None, labels=None, recording: str = "recording", camera: int = 1) -> DataFrame:
    """FRAMES that ``loader(i)`` (i from 1) makes on the executors when they are needed."""
    for other in (timestamps, labels):
        if other is not None and len(other) != n:
            raise ValueError("timestamps and labels are as many as frames")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in part.column(0).to_pylist():
                yield _frame_batch(frame_row(recording, camera, i, loader(i), timestamps[i - 1] if timestamps is not None else None, labels[i - 1] if labels is not None else None))

    return spark.range(1, n + 1).mapInArrow(run, FRAMES)


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class TiffStack(DataSource):
    """``spark.read.format("tiff_stack").load(path)``: a partition for each page of a file that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "tiff_stack"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)


class _TiffReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = re.sub("^file:(//)?", "", options["path"])
        self.recording = options.get("recording", "recording")

    def partitions(self) -> list[_Page]:
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return [_Page(k) for k in range(len(tiff_pages(data)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(self.path, "rb") as f:  # mapped: only the page's own blocks are read
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            yield frame_row(self.recording, 1, partition.page + 1, decode_tiff(data, partition.page), None, f"{self.path}#{partition.page + 1}")
