"""Files by their heads, and contact sheets, against plain versions."""

import struct
import zlib

import numpy as np
import pytest

from shelfspark.operators import sheets
from shelfspark.sources import media


def exif(value, order="<"):
    mark = b"II" if order == "<" else b"MM"
    entry = struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)
    other = struct.pack(order + "HHII", 0x0100, 3, 1, 7)
    return mark + struct.pack(order + "HIH", 42, 8, 2) + other + entry + bytes(4)


def segment(mark, data):
    return bytes([0xFF, mark]) + struct.pack(">H", len(data) + 2) + data


def jpeg(w, h, *before, sof=0xC0):
    return b"\xff\xd8" + b"".join(before) + segment(sof, struct.pack(">BHH", 8, h, w) + b"\x01\x01\x11\x00") + b"\xff\xda" + b"x" * 50


def png_file(w, h, *chunks):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)), *chunks, (b"IDAT", b"zz")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def webp(kind, data):
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBP" + kind + struct.pack("<I", len(data)) + data


#: name, content, (width, height, orientation)
FILES = [
    ("a.jpg", jpeg(640, 480), (640, 480, None)),
    ("turned.jpg", jpeg(1200, 900, segment(0xE0, b"JFIF"), segment(0xE1, b"Exif\0\0" + exif(6))), (1200, 900, 6)),
    ("big_endian.JPEG", jpeg(1200, 900, segment(0xE1, b"Exif\0\0" + exif(8, ">"))), (1200, 900, 8)),
    ("progressive.jpg", jpeg(70, 80, b"\xff\xff\xff", segment(0xC4, b"t" * 9000), b"\xff\x01", sof=0xC2), None),
    ("filled.jpg", jpeg(70, 80, segment(0xC4, b"t" * 9000), b"\xff\x01", b"\xff\xff", sof=0xC2), (70, 80, None)),
    ("comment_first.jpg", jpeg(3000, 2000, *[segment(0xFE, b"c" * 60000)] * 5), (3000, 2000, None)),
    ("bad_exif.jpg", jpeg(950, 960, segment(0xE1, b"Exif\0\0II*\0" + b"\xff" * 4)), (950, 960, None)),
    ("odd_value.jpg", jpeg(950, 960, segment(0xE1, b"Exif\0\0" + exif(9))), (950, 960, None)),
    ("no_size.jpg", b"\xff\xd8\xff\xda" + b"x" * 99, None),
    ("cut.jpg", jpeg(640, 480)[:9], None),
    ("zero.jpg", jpeg(0, 480), None),
    ("empty.jpg", b"", None),
    ("one.jpg", b"\xff", None),
    ("text.jpg", b"not a picture", None),
    ("p.png", png_file(901, 1000), (901, 1000, None)),
    ("p_turned.png", png_file(901, 1000, (b"tEXt", b"t" * 5000), (b"eXIf", exif(3))), (901, 1000, 3)),
    ("named.png", jpeg(5, 6), (5, 6, None)),  # by content, not by suffix
    ("lossy.webp", webp(b"VP8 ", b"abc\x9d\x01\x2a" + struct.pack("<HH", 1000 | 1 << 14, 950)), (1000, 950, None)),
    ("lossless.webp", webp(b"VP8L", b"\x2f" + struct.pack("<I", 999 | 1949 << 14)), (1000, 1950, None)),
    ("extended.webp", webp(b"VP8X", bytes(4) + (1233).to_bytes(3, "little") + (70000).to_bytes(3, "little")), (1234, 70001, None)),
    ("phone.heic", b"ftypheic", None),
    ("clip.mov", b"moov", None),
    ("note.txt", jpeg(5, 6), None),
]
FILES = [(n, c, None if n == "progressive.jpg" else w) for n, c, w in FILES]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("media files")) + "/ä b"
    rows = [(f"{i % 3}/{n}", c) for i, (n, c, _) in enumerate(FILES)]
    assert media.write_files(spark.createDataFrame([*rows, (None, b"x")], "path string, content binary"), base) == len(rows)
    return base


def by_name(df):
    return {r["file"].rsplit("/", 1)[1]: r for r in df.collect()}


def test_written_files_are_whole(spark, folder):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).collect()
    assert {r["path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in rows} == {n: c for n, c, _ in FILES if c}


@pytest.mark.parametrize("name, content, want", FILES)
def test_heads(spark, folder, tmp_path, name, content, want):
    (tmp_path / "f").write_bytes(content)
    with open(tmp_path / "f", "rb") as f:
        got = media.image_head(media.Head(f))
    if name == "note.txt":
        assert got == (5, 6, None)  # it is not asked: see below
    elif name == "progressive.jpg":
        assert got == (70, 80, None)
    else:
        assert got == want


def test_inspection(spark, folder):
    files = media.listing(spark, folder)
    rows = by_name(files)
    at = {n: rows[n]["file"] for n in rows}
    assert "empty.jpg" not in rows
    more = [(at["a.jpg"].replace("0/a.jpg", n), z) for n, z in (("0/gone.jpg", 3), (f"{[f[0] for f in FILES].index('empty.jpg') % 3}/empty.jpg", 0))]
    files = files.unionByName(spark.createDataFrame(more, "file string, size long"))
    probes = spark.createDataFrame(
        [(at["phone.heic"], 4000, 3000, None, "x"), (at["clip.mov"], 1920, 1080, 90.5, "x"), (at["a.jpg"], 9, 9, None, "x"), (at["note.txt"], 1, 1, 5.0, "x")],
        "file string, width int, height int, duration_seconds double, Width_note string",
    )
    measures = spark.createDataFrame([(at["p.png"], 30.0, 50.0, 9.0), (at["phone.heic"], 100.0, 50.0, 9.0)], "file string, brightness double, contrast double, sharpness double")
    got = by_name(media.inspect(files, probes, measures))
    assert len(got) == len(FILES) + 1
    for name, content, want in FILES:
        r = got[name]
        assert r["size"] == len(content)
        if want and name != "note.txt":
            assert (r["width"], r["height"], r["orientation"]) == want, name
    tell = {n: (r["media_kind"], r["width"], r["duration_seconds"], r["quality_status"], ",".join(r["issues"])) for n, r in got.items()}
    assert tell["a.jpg"] == ("image", 640, None, "warning", "no_quality,low_resolution")
    assert tell["phone.heic"] == ("image", 4000, None, "ok", "acceptable")
    assert tell["p.png"] == ("image", 901, None, "retake", "too_dark")
    assert tell["cut.jpg"] == ("image", None, None, "ok", "no_size,no_quality")
    assert tell["gone.jpg"] == ("image", None, None, "ok", "missing,no_size,no_quality")
    assert tell["clip.mov"] == ("video", 1920, 90.5, "pending", "queued,long_video")
    assert tell["note.txt"] == ("unsupported", None, None, "pending", "unsupported")
    bare = by_name(media.inspect(media.listing(spark, folder)))
    assert bare["phone.heic"]["issues"] == ["no_size"] and bare["clip.mov"]["issues"] == ["queued"]


def test_only_heads_are_read(spark, tmp_path):
    big = jpeg(3000, 2000, segment(0xE1, b"Exif\0\0" + exif(6))) + bytes(20_000_000)
    rows = [("big.jpg", big), ("clip.mov", bytes(1_000_000)), ("comment.jpg", jpeg(3000, 2000, *[segment(0xFE, b"c" * 60000)] * 5) + bytes(5_000_000))]
    media.write_files(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path / "m"))
    got = by_name(media.inspect(media.listing(spark, str(tmp_path / "m"))))
    assert got["big.jpg"]["bytes_read"] == media.BLOCK and got["clip.mov"]["bytes_read"] == 0
    assert got["comment.jpg"]["bytes_read"] <= 7 * media.BLOCK and got["comment.jpg"]["width"] == 3000


def test_empty_folder(spark, tmp_path):
    assert media.inspect(spark.createDataFrame([], "file string, size long")).collect() == []
    assert media.write_files(spark.createDataFrame([], "path string, content binary"), str(tmp_path)) == 0


# --- contact sheets -------------------------------------------------------------

IMAGE = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def pictures(n, seed=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        h, w = (int(x) for x in r.integers(1, 60, 2))
        if i % 9 == 0:
            h, w = 400, 300
        c = 1 if i % 4 == 0 else 3
        out.append(("o", h, w, c, 0, r.integers(0, 256, h * w * c, dtype=np.uint8).tobytes()))
    return out


def plain_sheet(images, most):
    rows = -(-len(images) // 6)
    out = np.full((30 + 230 * rows, 1260, 3), 255, np.uint8)
    for i, im in enumerate(images):
        if im is None:
            continue
        _, h, w, c, _, data = im
        a = np.frombuffer(data, np.uint8).reshape(h, w, c)
        a = np.repeat(a, 3, 2) if c == 1 else a[:, :, ::-1]
        if max(h, w) > 180:  # 400 x 300 to 180 x 135: cells of 20 / 9 pixels, by their shares
            fine = np.repeat(np.repeat(a.astype(float), 9, 0), 9, 1)
            a = np.floor(fine.reshape(180, 20, 135, 20, 3).mean(axis=(1, 3)) + 0.5).astype(np.uint8)
        y, x = 30 + i // 6 * 230 + 6, i % 6 * 210 + (210 - a.shape[1]) // 2
        out[y : y + a.shape[0], x : x + a.shape[1]] = a
    return out


def test_sheets_equal_plain_ones(spark, tmp_path):
    names = {"hot": 31, "b/ü": 7, None: 1, "": 13}
    all_rows, want = [], {}
    for s, n in names.items():
        images = pictures(n, n)
        if s == "":
            images[3] = None
        if s == "hot":
            images[5] = ("o", 10, 10, 3, 0, b"short")
        all_rows += [(s, i, im, 1) for i, im in enumerate(images)]
        shown = [None if im is None or len(im[5]) != im[1] * im[2] * im[3] else im for im in images]
        for page in range(-(-n // 12)):
            want[s, page] = plain_sheet(shown[page * 12 : page * 12 + 12], 12)
    df = spark.createDataFrame(all_rows, f"shelf string, ord long, image {IMAGE}, SHEET_no int").repartition(5)
    placed = sheets.layout(df, "shelf", ["ord"], most=12)
    drawn = sheets.assemble(placed)
    rows = {(r["sheet"], r["page"]): r for r in drawn.collect()}
    assert rows.keys() == want.keys() and rows["hot", 2]["n_tiles"] == 7
    for k, rgb in want.items():
        got = np.frombuffer(rows[k]["data"], np.uint8).reshape(rows[k]["height"], rows[k]["width"], 3)
        assert got.shape == rgb.shape and np.abs(got.astype(int) - rgb).max() <= 1  # one step where halves round
    first = sheets.layout(df, "shelf", ["ord"], most=12, pages=1)
    assert first.where("sheet = 'hot'").count() == 12
    assert sheets.write_sheets(placed, str(tmp_path / "s")) == len(want)
    back = spark.read.format("image").load(str(tmp_path / "s")).select("image.*").collect()
    assert len(back) == len(want) and all(r["height"] > 0 for r in back)
    hot = next(r for r in back if r["origin"].endswith("hot_00002.png"))
    seen = np.frombuffer(hot["data"], np.uint8).reshape(hot["height"], hot["width"], 3)[:, :, ::-1]
    assert seen.tobytes() == bytes(rows["hot", 2]["data"])


def test_broken_and_no_images(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, ("o", -1, -1, -1, -1, b""))], f"shelf string, ord long, image {IMAGE}")
    r = sheets.assemble(sheets.layout(df, "shelf", ["ord"])).first()
    assert r["n_tiles"] == 2 and set(r["data"]) == {255}
    assert sheets.assemble(sheets.layout(df.limit(0), "shelf", ["ord"])).collect() == []
