"""Boxes: columns ``x1 y1 x2 y2``, flat so that predicates stay in generated code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def area(p: str = "") -> Column:
    return F.greatest(F.lit(0.0), col(f"{p}x2") - col(f"{p}x1")) * F.greatest(F.lit(0.0), col(f"{p}y2") - col(f"{p}y1"))


def intersection(a: str, b: str) -> Column:
    w = F.least(col(f"{a}x2"), col(f"{b}x2")) - F.greatest(col(f"{a}x1"), col(f"{b}x1"))
    h = F.least(col(f"{a}y2"), col(f"{b}y2")) - F.greatest(col(f"{a}y1"), col(f"{b}y1"))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: str, b: str, eps: float = 0.0) -> Column:
    """With ``eps`` added to the union, or else 0 where there is no union."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    if eps:
        return both / (union + F.lit(eps))
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class BoxFilter:
    """Limits of a box: smallest side in pixels, share of the image, width to height."""

    side: float
    area: tuple[float, float]
    aspect: tuple[float, float]

    def holds(self, width, height, p: str = "") -> Column:
        w, h = col(f"{p}x2") - col(f"{p}x1"), col(f"{p}y2") - col(f"{p}y1")
        share = w * h / (col(width) * col(height))
        ratio = w / F.greatest(F.lit(1.0), h)
        return (
            (w >= self.side) & (h >= self.side) & share.between(*map(F.lit, self.area)) & ratio.between(*map(F.lit, self.aspect))
        )


#: Limits of packages, unboxed goods, proposals and tracked boxes.
PACKAGE = BoxFilter(35, (0.0015, 0.45), (0.12, 8.0))
UNBOXED = BoxFilter(45, (0.002, 0.5), (0.08, 7.5))
PROPOSAL = BoxFilter(24, (0.0006, 0.42), (0.08, 8.5))
TRACKED = BoxFilter(0, (0.0005, 0.55), (1 / 8, 8.0))


def clip(v, low, high) -> Column:
    """Into [low, high]; not-a-number goes low."""
    v, low, high = (x if isinstance(x, Column) else F.lit(x) for x in (v, low, high))
    return F.when(F.isnan(v.cast("double")), low).otherwise(F.least(F.greatest(v, low), high))


def padded_crop(width, height, pad: float, side: int, share: tuple[float, float]) -> Column:
    """The box grown by ``pad`` of its size, clamped to whole pixels (towards
    zero), or null where it is then too small or out of the area limits."""
    w, h = col("x2") - col("x1"), col("y2") - col("y1")
    grown = [
        F.greatest(F.lit(0), (col("x1") - w * pad).cast("int")),
        F.greatest(F.lit(0), (col("y1") - h * pad).cast("int")),
        F.least(col(width).cast("int"), (col("x2") + w * pad).cast("int")),
        F.least(col(height).cast("int"), (col("y2") + h * pad).cast("int")),
    ]
    cw, ch = grown[2] - grown[0], grown[3] - grown[1]
    part = cw * ch / (col(width) * col(height))
    good = (cw >= side) & (ch >= side) & part.between(F.lit(share[0]), F.lit(share[1]))
    return F.when(good, F.struct(*[g.alias(n) for g, n in zip(grown, ("cx1", "cy1", "cx2", "cy2"))]))


def crop_quality(conf, width, height, edge: float = 4, penalty: float = 0.7) -> Column:
    """Confidence times the root of the area, less near the image's border."""
    near = (col("x1") <= edge) | (col("y1") <= edge) | (col("x2") >= col(width) - edge) | (col("y2") >= col(height) - edge)
    return col(conf) * F.sqrt(area()) * F.when(near, penalty).otherwise(1.0)


def centre_inside(inner: str, outer: str, grow: float = 0.0) -> Column:
    """The centre of one box lies in the other, grown by a share of its size."""
    cx, cy = (col(f"{inner}x1") + col(f"{inner}x2")) / 2, (col(f"{inner}y1") + col(f"{inner}y2")) / 2
    dx, dy = (col(f"{outer}x2") - col(f"{outer}x1")) * grow, (col(f"{outer}y2") - col(f"{outer}y1")) * grow
    return (
        (cx >= col(f"{outer}x1") - dx) & (cx <= col(f"{outer}x2") + dx) & (cy >= col(f"{outer}y1") - dy) & (cy <= col(f"{outer}y2") + dy)
    )


def text_anchor(width, height) -> Column:
    """A product box around a line of text, or null where it is too small."""
    tw, th = col("x2") - col("x1"), col("y2") - col("y1")
    cx, cy = (col("x1") + col("x2")) / 2, (col("y1") + col("y2")) / 2
    bw, bh = clip(tw * 1.8, 70.0, 220.0), clip(th * 3.4, 60.0, 180.0)
    box = [
        clip(cx - bw / 2, 0.0, col(width)),
        clip(cy - bh * 0.45, 0.0, col(height)),
        clip(cx + bw / 2, 0.0, col(width)),
        clip(cy + bh * 0.55, 0.0, col(height)),
    ]
    good = (tw >= 18) & (th >= 10) & (box[2] - box[0] >= 50) & (box[3] - box[1] >= 50)
    return F.when(good, F.struct(*[b.alias(n) for b, n in zip(box, ("x1", "y1", "x2", "y2"))]))


def polygon(width, height) -> Column:
    """Corners from the upper left, clockwise, as shares of the image."""
    xs, ys = [clip(col(c) / col(width), 0.0, 1.0) for c in ("x1", "x2")], [clip(col(c) / col(height), 0.0, 1.0) for c in ("y1", "y2")]
    return F.array(xs[0], ys[0], xs[1], ys[0], xs[1], ys[1], xs[0], ys[1])


def centre_size(width, height) -> Column:
    return F.array(
        (col("x1") + col("x2")) / 2 / col(width),
        (col("y1") + col("y2")) / 2 / col(height),
        (col("x2") - col("x1")) / col(width),
        (col("y2") - col("y1")) / col(height),
    )


def label_line(cls, coords) -> Column:
    """A label file's line: the class and coordinates of six digits."""
    return F.concat_ws(" ", col(cls).cast("string"), F.array_join(F.transform(coords, lambda x: F.format_string("%.6f", x)), " "))


def parse_label(line) -> Column:
    """(cls, x1, y1, x2, y2) as shares: five fields are centre and size, seven or
    more a polygon whose bounds count; other lines are null."""
    parts = F.filter(F.split(F.trim(col(line)), r"\s+"), lambda x: x != "")
    nums = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x.try_cast("double"))
    xs, ys = F.filter(nums, lambda x, i: i % 2 == 0), F.filter(nums, lambda x, i: i % 2 == 1)
    cls = F.get(parts, F.lit(0)).try_cast("int")
    n = [F.get(nums, F.lit(i)) for i in range(4)]
    names = ("x1", "y1", "x2", "y2")
    boxed = [n[0] - n[2] / 2, n[1] - n[3] / 2, n[0] + n[2] / 2, n[1] + n[3] / 2]
    bounds = [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]

    def out(values):
        return F.struct(cls.alias("cls"), *[v.alias(k) for v, k in zip(values, names)])

    return F.when(F.size(parts) == 5, out(boxed)).when(F.size(parts) >= 7, out(bounds))


def override_box(box, width, height) -> Column:
    """Pixel box of a manual entry: shares if all are within 1, sides in order, five pixels at least (else null)."""
    v = [F.get(col(box), F.lit(i)).cast("double") for i in range(4)]
    share = F.greatest(*[F.abs(x) for x in v]) <= 1.0
    x = [clip(F.when(share, v[i] * col(width)).otherwise(v[i]), 0.0, col(width)) for i in (0, 2)]
    y = [clip(F.when(share, v[i] * col(height)).otherwise(v[i]), 0.0, col(height)) for i in (1, 3)]
    out = [F.least(*x), F.least(*y), F.greatest(*x), F.greatest(*y)]
    good = (out[2] - out[0] >= 5) & (out[3] - out[1] >= 5)
    return F.when(good, F.struct(*[b.alias(n) for b, n in zip(out, ("x1", "y1", "x2", "y2"))]))


def pixel_box(width, height) -> Column:
    """Shares to pixels, halves up, clamped."""

    def at(c, size):
        return F.least(F.greatest(F.floor(col(c) * col(size) + 0.5), F.lit(0)), col(size)).cast("int")

    return F.struct(at("x1", width).alias("left"), at("y1", height).alias("top"), at("x2", width).alias("right"), at("y2", height).alias("bottom"))


def sample_indexes(n, k: int, low: float = 0.0, high: float = 1.0) -> Column:
    """``k`` evenly spaced whole indexes between two shares of ``n`` frames."""
    a, b = col(n) * low, F.greatest(col(n) * high, F.lit(0.0))
    if k == 1:
        return F.array(a.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + i * (b - a) / (k - 1)).cast("int"))


def midpoints(start, end, k: int) -> Column:
    """The middles of ``k`` equal stretches of a time span."""
    step = (col(end) - col(start)) / k
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: col(start) + step * (i + 0.5))


def grid_cells(cx, cy, cell: float = 0.25, margin: float = 1e-4) -> Column:
    """(col, row) of all cells that a unit window at (cx, cy) touches."""

    def edge(c):
        c = col(c)
        return F.sequence(F.floor(c / cell).cast("int"), F.floor((c + 1 - margin) / cell).cast("int"))

    pairs = F.transform(edge(cx), lambda x: F.transform(edge(cy), lambda y: F.struct(x.alias("col"), y.alias("row"))))
    return F.flatten(pairs)


def repass_gap(a: str, b: str) -> Column:
    """Frames between two spans, null where they touch or overlap."""
    return F.when(col(f"{a}last") < col(f"{b}first"), col(f"{b}first") - col(f"{a}last")).when(
        col(f"{b}last") < col(f"{a}first"), col(f"{a}first") - col(f"{b}last")
    )


#: Side of the model's square input, and limits of its candidates.
INPUT, LEAST_CONF, GREEN_CONF, LEAST_SIDE = 320, 0.55, 0.70, 0.01
CANDIDATE_AREA = (0.004, 0.60)


def from_letterbox(width, height, size: int = INPUT) -> Column:
    """A box (``cx cy bw bh``, shares or pixels of a padded square input) as shares of the frame."""
    w, h = col(width).cast("double"), col(height).cast("double")
    scale = F.least(size / w, size / h)
    pad_x = F.floor((size - F.floor(w * scale + 0.5)) / 2)
    pad_y = F.floor((size - F.floor(h * scale + 0.5)) / 2)
    k = F.when(col("cx") <= 1.5, F.lit(float(size))).otherwise(F.lit(1.0))

    def at(centre: str, side: str, sign: int, pad, full) -> Column:
        return clip((col(centre) * k + sign * col(side) * k / 2 - pad) / scale / full, 0.0, 1.0)

    return F.struct(
        at("cx", "bw", -1, pad_x, w).alias("x1"), at("cy", "bh", -1, pad_y, h).alias("y1"), at("cx", "bw", 1, pad_x, w).alias("x2"), at("cy", "bh", 1, pad_y, h).alias("y2")
    )


def is_candidate(p: str = "", conf="conf") -> Column:
    """Sure enough, and neither noise nor furniture; shares of the frame."""
    w, h = col(f"{p}x2") - col(f"{p}x1"), col(f"{p}y2") - col(f"{p}y1")
    return (col(conf) >= LEAST_CONF) & (w >= LEAST_SIDE) & (h >= LEAST_SIDE) & (w * h).between(*map(F.lit, CANDIDATE_AREA))


def camera_roi(width, height) -> Column:
    """The preview's part of a screen record, by its orientation."""
    w, h = col(width), col(height)
    tall = h > w * 1.15

    def share(a: float, b: float) -> Column:
        return F.floor(h * F.when(tall, a).otherwise(b)).cast("int")

    return F.struct(F.lit(0).alias("x1"), share(0.18, 0.14).alias("y1"), w.cast("int").alias("x2"), share(0.60, 0.50).alias("y2"))
