"""Files as rows: written from a table, and inspected by their first bytes.

Sizes and orientation of images come from their heads, whatever their suffix, so
a picture of many megabytes costs a read of a few kilobytes.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import folder
from ..operators.written import written

BLOCK = 4096
FILES_A_TASK = 1024
HEAD = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("bytes_read", pa.int64()), ("found", pa.bool_())])


def place(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address as Spark writes it."""
    m = re.match(r"([A-Za-z][\w+.-]*):(//[^/]*)?(/.*)$", address)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), m[3] if m else address
    system, root = fs.FileSystem.from_uri(f"{m[1]}:{m[2] or '//'}/")
    return system, root.rstrip("/") + m[3]


def write_files(df: DataFrame, base: str, path: str = "path", content: str = "content") -> int:
    """Write each row's bytes to ``base``/``path``: the number of files.

    A file is written aside and renamed, so a task that is run again, or twice at
    once, leaves whole files only; null paths are left out, null content is empty."""

    def put(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = place(f"{base}/{name}")
                within = at.rsplit("/", 1)[0]
                system.create_dir(within, recursive=True)
                aside = f"{within}/.{uuid.uuid4().hex}.part"  # hidden from readers
                with system.open_output_stream(aside) as out:
                    out.write(data or b"")
                system.move(aside, at)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]}, schema=pa.schema([("n", pa.int64())]))

    rows = df.where(F.col(path).isNotNull()).select(F.col(path).cast("string").alias("path"), F.col(content).cast("binary").alias("content"))
    return rows.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Head:
    """Bytes of a file by place, read a block at a time; ``count`` is what was read."""

    def __init__(self, file):
        self.file, self.start, self.block, self.count = file, 0, b"", 0

    def at(self, place: int, n: int) -> bytes:
        if not self.start <= place <= place + n <= self.start + len(self.block):
            self.file.seek(place)
            self.start, self.block = place, self.file.read(max(n, BLOCK))
            self.count += len(self.block)
        out = self.block[place - self.start : place - self.start + n]
        if len(out) < n:
            raise EOFError(place)
        return out

    def number(self, kind: str, place: int) -> int:
        return struct.unpack(kind, self.at(place, struct.calcsize(kind)))[0]


def exif_orientation(head: Head, base: int) -> int | None:
    """Tag 0x0112 of the first directory of a TIFF block."""
    order = {b"II": "<", b"MM": ">"}.get(head.at(base, 2))
    if order is None:
        return None
    at = base + head.number(order + "I", base + 4)
    for i in range(head.number(order + "H", at)):
        if head.number(order + "H", at + 2 + 12 * i) == 0x0112:
            value = head.number(order + "H", at + 10 + 12 * i)
            return value if 1 <= value <= 8 else None
    return None


def _exif(head: Head, base: int) -> int | None:
    try:
        return exif_orientation(head, base)
    except EOFError:  # a block that points outside the file tells nothing
        return None


def jpeg_head(head: Head) -> tuple[int, int, int | None] | None:
    at, turned = 2, None
    while True:
        if head.at(at, 1) != b"\xff":
            return None
        mark = head.number("B", at + 1)
        if mark == 0xFF:  # fill
            at += 1
        elif mark == 1 or 0xD0 <= mark <= 0xD7:  # no length
            at += 2
        elif mark in (0xD9, 0xDA):  # the picture, or its end, before any size
            return None
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return head.number(">H", at + 7), head.number(">H", at + 5), turned
        else:
            if mark == 0xE1 and turned is None and head.at(at + 4, 6) == b"Exif\0\0":
                turned = _exif(head, at + 10)
            at += 2 + head.number(">H", at + 2)


def png_head(head: Head) -> tuple[int, int, int | None]:
    width, height = head.number(">I", 16), head.number(">I", 20)
    at = 8
    try:
        while head.at(at + 4, 4) not in (b"IDAT", b"IEND"):
            if head.at(at + 4, 4) == b"eXIf":
                return width, height, _exif(head, at + 8)
            at += 12 + head.number(">I", at)
    except EOFError:  # the size is known all the same
        pass
    return width, height, None


def webp_head(head: Head) -> tuple[int, int, int | None] | None:
    kind = head.at(12, 4)
    if kind == b"VP8X":
        return *(int.from_bytes(head.at(p, 3), "little") + 1 for p in (24, 27)), None
    if kind == b"VP8L":
        bits = head.number("<I", 21)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, None
    return (head.number("<H", 26) & 0x3FFF, head.number("<H", 28) & 0x3FFF, None) if kind == b"VP8 " else None


def image_head(head: Head) -> tuple[int, int, int | None] | None:
    """(width, height, orientation) as stored; None where no size is found."""
    try:
        first = head.at(0, 2)
        if first == b"\xff\xd8":
            found = jpeg_head(head)
        elif first == b"\x89P" and head.at(0, 8) == b"\x89PNG\r\n\x1a\n":
            found = png_head(head)
        elif first == b"RI" and head.at(0, 4) == b"RIFF" and head.at(8, 4) == b"WEBP":
            found = webp_head(head)
        else:
            return None
    except EOFError:
        return None
    return found if found and 0 < found[0] < 1 << 31 and 0 < found[1] < 1 << 31 else None


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``file`` (its address) and ``size`` of all files below a folder, which are not
    opened.  The listing is taken once and written.  Spark's readers pass over empty
    files, so those are not listed; rows of them from elsewhere are inspected as any other."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return written(files.select(F.col("path").alias("file"), F.col("length").alias("size")).coalesce(spark.sparkContext.defaultParallelism))


def heads(files: DataFrame, file: str = "file") -> DataFrame:
    """``files`` (file, size) with ``width``, ``height``, ``orientation``, the
    ``bytes_read`` for them, and ``found``: whether the file was still there.

    Files are dealt out, about ``FILES_A_TASK`` to a task; only images by suffix are opened."""

    def read(batches):
        for batch in batches:
            out = []
            for address, kind in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if kind != "image" or address is None:
                    out.append((None, None, None, 0, True))
                    continue
                system, at = place(address)
                try:
                    with system.open_input_file(at) as f:
                        head = Head(f)
                        out.append((*(image_head(head) or (None, None, None)), head.count, True))
                except FileNotFoundError:
                    out.append((None, None, None, 0, False))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), HEAD.types)] if out else [pa.array([], t) for t in HEAD.types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *HEAD.names])

    rows = files.select(F.col(file).alias("file"), F.col("size").cast("long").alias("size"), folder.media_kind(file).alias("media_kind"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FILES_A_TASK))
    schema = "file string, size long, media_kind string, width int, height int, orientation int, bytes_read long, found boolean"
    return rows.repartition(tasks, "file").mapInArrow(read, schema)


def inspect(files: DataFrame, probes: DataFrame | None = None, measures: DataFrame | None = None) -> DataFrame:
    """State and issues of each of ``files`` (file, size), by its kind.

    Images: size by the head, else by ``probes`` (file, width, height,
    duration_seconds); brightness, contrast and sharpness by ``measures`` (file, ...).
    ``no_size`` and ``no_quality`` tell what was asked for and not found.  Videos: all
    by probes, state pending.  Other files are listed as unsupported.  ``probes`` and
    ``measures`` have one row for each file."""
    rows = heads(files)
    given = {"probes": (probes, ["width int", "height int", "duration_seconds double"]), "measures": (measures, [f"{c} double" for c in ("brightness", "contrast", "sharpness")])}
    for name, (side, columns) in given.items():
        pairs = [c.split() for c in columns]
        if side is None:
            rows = rows.withColumns({f"_{c}": F.lit(None).cast(t) for c, t in pairs})
            continue
        known = side.select(F.col("file").alias("_file"), *[F.col(c).cast(t).alias(f"_{c}") for c, t in pairs])
        rows = rows.join(known, F.col("file") == F.col("_file"), "left").drop("_file")
    image, video = F.col("media_kind") == "image", F.col("media_kind") == "video"
    sized = rows.withColumns({c: F.when(image | video, F.coalesce(c, f"_{c}")) for c in ("width", "height")}).withColumn("duration_seconds", F.when(video, F.col("_duration_seconds")))
    state, issues = folder.quality_status(brightness="_brightness", contrast="_contrast", sharpness="_sharpness")
    return sized.select(
        "file", "size", "media_kind", "width", "height", "orientation", "duration_seconds",
        F.when(image, state).otherwise("pending").alias("quality_status"),
        F.when(image, _image_issues(issues, measures is not None)).when(video, folder.video_issues()).otherwise(F.array(F.lit("unsupported"))).alias("issues"),
        "bytes_read",
    )


def _image_issues(issues: Column, measured: bool) -> Column:
    missing = F.filter(
        F.array(
            F.when(~F.col("found"), "missing"),
            F.when(F.col("width").isNull() | F.col("height").isNull(), "no_size"),
            F.when(F.lit(measured) & F.col("_brightness").isNull(), "no_quality"),
        ),
        lambda x: x.isNotNull(),
    )
    known = F.filter(issues, lambda x: x != "acceptable")
    every = F.concat(missing, known)
    return F.when(F.size(every) == 0, F.array(F.lit("acceptable"))).otherwise(every)


def png(rgb: np.ndarray) -> bytes:
    """An image file of height by width by 3 pixels."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = rgb.shape[:2]
    lines = np.zeros((h, 1 + 3 * w), np.uint8)
    lines[:, 1:] = rgb.reshape(h, -1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")
