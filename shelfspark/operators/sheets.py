"""Contact sheets: small versions of images, put in order on white sheets.

Images are made small before anything is shuffled; places come from numbers over
the whole table, so a sheet's name that a third of all rows share is no single
task; each page is put together on its own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pixels import area_shrink, decode
from ..sources import media
from .numbering import numbered
from .written import spread, written

#: Size of a tile, of a picture on it, its distance from the top, tiles in a row, the head of a sheet.
TILE_WIDTH, TILE_HEIGHT, SIDE, TOP, COLUMNS, HEAD, MOST = 210, 230, 180, 6, 6, 30, 120
#: Up to so many sheets, the first number of each is broadcast.
BROADCAST_SHEETS = 100_000
SHEET = "sheet string, page long, n_tiles int, height int, width int, data "
SMALL = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])


@F.pandas_udf(SMALL)
def small_udf(image: pd.DataFrame) -> pd.DataFrame:
    """An ``image`` struct within ``SIDE`` pixels, never enlarged; of no size where it is broken."""
    rows = []
    for h, w, c, data in zip(image["height"], image["width"], image["nChannels"], image["data"]):
        if data is None or not (h > 0 and w > 0) or len(data) != h * w * c:
            rows.append((0, 0, b""))
            continue
        rgb = decode(int(h), int(w), int(c), data)
        if max(h, w) > SIDE:
            nh, nw = (max(1, round(x * SIDE / max(h, w))) for x in (h, w))
            rgb = np.floor(area_shrink(rgb, nh, nw) + 0.5).astype(np.uint8)
        rows.append((*rgb.shape[:2], rgb.tobytes()))
    return pd.DataFrame(rows, columns=SMALL.names)


def layout(tiles: DataFrame, sheet: str, order: list[str], image: str = "image", most: int = MOST, pages: int | None = None) -> DataFrame:
    """(sheet, the order's columns, page, idx, row, col, small): the place of each image.

    A sheet holds ``most`` tiles, what is beyond goes on to its next page; with
    ``pages`` only so many are made of each sheet.  Rows that tie in ``order`` may
    stand in any order; a null sheet is one of its own."""
    rows = tiles.select(F.col(sheet).cast("string").alias("sheet"), *order, small_udf(image).alias("small"))
    n = numbered(rows, [F.asc("sheet"), *[F.asc(c) for c in order]], "_n")
    first = written(n.groupBy("sheet").agg(F.min("_n").alias("_first")).withColumnRenamed("sheet", "_sheet"))
    side = F.broadcast(first) if first.count() <= BROADCAST_SHEETS else first
    at = F.col("_n") - F.col("_first")
    idx = F.pmod(at, F.lit(most))
    placed = n.join(side, F.col("sheet").eqNullSafe(F.col("_sheet"))).select(
        "sheet", *order, F.floor(at / most).alias("page"), idx.cast("int").alias("idx"), F.floor(idx / COLUMNS).cast("int").alias("row"), (idx % COLUMNS).cast("int").alias("col"), "small"
    )
    return placed if pages is None else placed.where(F.col("page") < pages)


def draw(tiles: list[tuple[int, int, int, bytes]]) -> np.ndarray:
    """A sheet of (idx, height, width, rgb)."""
    rows = max(i for i, *_ in tiles) // COLUMNS + 1
    out = np.full((rows * TILE_HEIGHT + HEAD, COLUMNS * TILE_WIDTH, 3), 255, np.uint8)
    for i, h, w, data in tiles:
        if h and w:
            y, x = HEAD + i // COLUMNS * TILE_HEIGHT + TOP, i % COLUMNS * TILE_WIDTH + (TILE_WIDTH - w) // 2
            out[y : y + h, x : x + w] = np.frombuffer(data, np.uint8).reshape(h, w, 3)
    return out


def assemble(placed: DataFrame, made=np.ndarray.tobytes, kind: str = "binary", arrow: pa.DataType = pa.binary()) -> DataFrame:
    """One row for each page: its size, its number of tiles and ``data``, its RGB bytes or
    what ``made`` makes of its pixels (of type ``kind``).  A task holds one page at a time;
    pages are many megabytes, so what is wanted of them is best made here."""

    def sheet_row(key, tiles):
        rgb = draw(tiles)
        columns = [[key[0]], [key[1]], [len(tiles)], [rgb.shape[0]], [rgb.shape[1]], [made(rgb)]]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["sheet", "page", "n_tiles", "height", "width", "data"])

    def run(batches):
        key, tiles = None, []
        for batch in batches:
            for *now, idx, h, w, rgb in zip(*[c.to_pylist() for c in batch.columns]):
                if now != key and tiles:
                    yield sheet_row(key, tiles)
                    tiles = []
                key = now
                tiles.append((idx, h, w, rgb))
        if tiles:
            yield sheet_row(key, tiles)

    rows = placed.select("sheet", "page", "idx", "small.height", "small.width", "small.rgb")
    return spread(rows, "sheet", "page").sortWithinPartitions("sheet", "page", "idx").mapInArrow(run, SHEET + kind)


def write_sheets(placed: DataFrame, folder: str) -> int:
    """Image files ``sheet_<name>_<page>.png`` of a layout (a name of its own may begin like
    a hidden file's), the name URL-encoded (a lone % for null): their number."""
    name = F.format_string("sheet_%s_%05d.png", F.coalesce(F.url_encode("sheet"), F.lit("%")), "page")
    return media.write_files(assemble(placed, media.png).select(name.alias("path"), F.col("data").alias("content")), folder)


def ink(rgb: np.ndarray) -> dict[str, int]:
    """How much of a sheet is not white, and its moments by column and row."""
    dark = 255 - rgb.reshape(len(rgb), -1)
    by_row, by_column = (dark.sum(axis=i, dtype=np.int64) for i in (1, 0))
    return {"ink": int(by_row.sum()), "ink_x": int(by_column @ (np.arange(dark.shape[1]) // 3)), "ink_y": int(by_row @ np.arange(len(dark)))}


def inked(placed: DataFrame) -> DataFrame:
    """Pages without their pixels, with :func:`ink`."""
    names = ("ink", "ink_x", "ink_y")
    drawn = assemble(placed, ink, "struct<" + ",".join(f"{n}:long" for n in names) + ">", pa.struct([(n, pa.int64()) for n in names]))
    return drawn.select("*", "data.*").drop("data")
