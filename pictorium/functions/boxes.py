"""Box geometry as column expressions. A box is a struct or tuple of l, t, r, b."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keeps the diagonal of two coinciding points from dividing by zero.
EPSILON = 1e-7


class Box(NamedTuple):
    l: Column
    t: Column
    r: Column
    b: Column

    @staticmethod
    def of(prefix: str = "", struct: Column | None = None) -> Box:
        return Box(*[struct[n] if struct is not None else F.col(f"{prefix}{n}") for n in "ltrb"])


def area(x: Box) -> Column:
    return (x.r - x.l) * (x.b - x.t)


def intersection(x: Box, y: Box) -> Column:
    wide = F.greatest(F.least(x.r, y.r) - F.greatest(x.l, y.l), F.lit(0))
    high = F.greatest(F.least(x.b, y.b) - F.greatest(x.t, y.t), F.lit(0))
    return wide * high


def iou(x: Box, y: Box) -> Column:
    both = intersection(x, y).cast("double")
    return F.coalesce(F.try_divide(both, area(x) + area(y) - both), F.lit(0.0))


def distance_iou(x: Box, y: Box) -> Column:
    """IoU less the squared distance of the centres over the squared diagonal of the box around both."""
    wide = (F.greatest(x.r, y.r) - F.least(x.l, y.l)).cast("double")
    high = (F.greatest(x.b, y.b) - F.least(x.t, y.t)).cast("double")
    dx, dy = (x.l + x.r - y.l - y.r) / 2.0, (x.t + x.b - y.t - y.b) / 2.0
    return iou(x, y) - (dx * dx + dy * dy) / (wide * wide + high * high + EPSILON)


def halved(value: Column) -> Column:
    """Half, rounded down."""
    return F.floor(value / 2).cast("int")


def centre(x: Box) -> tuple[Column, Column]:
    return halved(F.abs(x.r - x.l)) + x.l, halved(F.abs(x.b - x.t)) + x.t


def centre_distance(x: Box, y: Box) -> Column:
    (ax, ay), (bx, by) = centre(x), centre(y)
    return F.sqrt(((ax - bx) * (ax - bx) + (ay - by) * (ay - by)).cast("double"))


def clipped(x: Box, width: Column, height: Column) -> Box:
    return Box(F.greatest(x.l, F.lit(0)), F.greatest(x.t, F.lit(0)), F.least(x.r, width), F.least(x.b, height))


def as_struct(x: Box) -> Column:
    return F.struct(*[c.cast("int").alias(n) for c, n in zip(x, "ltrb", strict=True)])


def tiles(width: Column, height: Column, cuts: tuple[int, ...], overlap: float) -> Column:
    """All tiles of an image: each cut n gives n x n parts, widened by `overlap` of a part and clipped to the image."""
    out, number = [], 0
    for n in cuts:
        w, h = width / float(n), height / float(n)
        for x in range(n):
            for y in range(n):
                if n == 1:
                    edges = [F.lit(0), F.lit(0), width, height]
                else:
                    edges = [F.greatest(F.lit(0.0), x * w - w * overlap), F.greatest(F.lit(0.0), y * h - h * overlap), F.least(width.cast("double"), (x + 1) * w + w * overlap), F.least(height.cast("double"), (y + 1) * h + h * overlap)]
                out.append(F.struct(F.lit(n).alias("cut"), F.lit(number).alias("tile_no"), *[e.cast("int").alias(k) for e, k in zip(edges, "ltrb", strict=True)]))
                number += 1
    return F.array(*out)


def moved(x: Box, tile: Box) -> tuple[Box, Column]:
    """A detection inside a tile in the image's coordinates, and whether it ran over the tile's edge."""
    off = (x.l < 0) | (x.t < 0) | (x.r > tile.r - tile.l) | (x.b > tile.b - tile.t)
    return Box(*[(c + d).cast("int") for c, d in ((x.l, tile.l), (x.t, tile.t), (x.r, tile.l), (x.b, tile.t))]), off


def suppressed(boxes: Column, threshold: float) -> Column:
    """Greedy suppression over an array of (score, id, l, t, r, b): what stays, best first, equal scores by id."""
    order = F.array_sort(F.transform(boxes, lambda x: F.struct((-x["score"]).alias("order"), x["id"].alias("id"), *[x[n].alias(n) for n in "ltrb"])))
    start = F.filter(order, lambda x: F.lit(False))
    hides = lambda kept, x: F.exists(kept, lambda k: iou(Box.of(struct=k), Box.of(struct=x)) > threshold)
    return F.aggregate(order, start, lambda kept, x: F.when(hides(kept, x), kept).otherwise(F.concat(kept, F.array(x))))


def square_thumbnail(x: Box, width: Column, height: Column, extension: int = 2) -> Column:
    """The square cut-out around a face, within the image where possible, and the padding where not."""
    inside = clipped(x, width, height)
    cx, cy = halved(inside.r - inside.l) + inside.l, halved(inside.b - inside.t) + inside.t
    largest = F.greatest(inside.r - inside.l, inside.b - inside.t)
    room = F.least(cx, width - cx, cy, height - cy)
    margin = F.greatest(F.least(F.floor(largest * extension / 2), room), halved(largest))
    edges = {"l": cx - margin, "t": cy - margin, "r": cx + margin, "b": cy + margin}
    pads = {"pad_l": F.greatest(-edges["l"], F.lit(0)), "pad_t": F.greatest(-edges["t"], F.lit(0)), "pad_r": F.greatest(edges["r"] - width, F.lit(0)), "pad_b": F.greatest(edges["b"] - height, F.lit(0))}
    cut = clipped(Box(**edges), width, height)
    return F.struct(*[c.cast("int").alias(n) for c, n in zip(cut, "ltrb", strict=True)], *[c.cast("int").alias(n) for n, c in pads.items()])


def square_highlight(x: Box) -> Column:
    """The largest square of the shorter side around a box's middle."""
    cx, cy = x.l + halved(x.r - x.l), x.t + halved(x.b - x.t)
    extent = halved(F.least(x.b - x.t, x.r - x.l))
    return as_struct(Box(cx - extent, cy - extent, cx + extent, cy + extent))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def padded_chip(x: Box, width: Column, height: Column, pad: float, largest: int) -> Column:
    """The cut-out with `pad` of the box on each side, the box within it, and both shrunk to `largest`; null off the image."""

    def chip(i: Column) -> Column:
        w, h = i["r"] - i["l"], i["b"] - i["t"]
        l, t = F.greatest(i["l"] - F.abs(w) * pad, F.lit(0.0)).cast("int"), F.greatest(i["t"] - F.abs(h) * pad, F.lit(0.0)).cast("int")
        r, b = F.least(i["r"] + F.abs(w) * pad, i["width"].cast("double")).cast("int"), F.least(i["b"] + F.abs(h) * pad, i["height"].cast("double")).cast("int")
        outside = (i["r"] < 0) | (i["b"] < 0) | (i["t"] > i["height"]) | (i["l"] > i["width"])
        return F.struct((~outside & (w != 0) & (h != 0)).alias("ok"), i.alias("inside"), *[c.alias(n) for c, n in zip((l, t, r, b), "ltrb", strict=True)])

    def scaled(c: Column) -> Column:
        longest = F.greatest(c["r"] - c["l"], c["b"] - c["t"])
        return F.struct(c.alias("chip"), F.when(longest > largest, F.lit(float(largest)) / longest).otherwise(F.lit(1.0)).alias("scale"))

    def fields(s: Column) -> Column:
        c, scale = s["chip"], s["scale"]
        box = [c["inside"][n] - c[o] for n, o in zip("ltrb", "ltlt", strict=True)]
        out = [c[n].alias(f"chip_{n}") for n in "ltrb"] + [(v * scale).cast("int").alias(f"box_{n}") for v, n in zip(box, "ltrb", strict=True)]
        return F.when(c["ok"], F.struct(*out, ((c["r"] - c["l"]) * scale).cast("int").alias("out_w"), ((c["b"] - c["t"]) * scale).cast("int").alias("out_h")))

    inside = F.struct(*[c.alias(n) for c, n in zip(clipped(x, width, height), "ltrb", strict=True)], width.alias("width"), height.alias("height"))
    return bound(bound(bound(inside, chip), scaled), fields)


def turning_chip(x: Box, width: Column, height: Column) -> Column:
    """The cut-out that leaves room to turn the box: its longer side times the root of two, as far as the image goes."""
    size = F.ceil(F.sqrt(F.lit(2.0)) * F.greatest(x.r - x.l, x.b - x.t))
    across = F.least(x.l, width - x.r, F.floor((size - (x.r - x.l)) / 2))
    down = F.least(x.t, height - x.b, F.floor((size - (x.b - x.t)) / 2))
    return as_struct(Box(x.l - across, x.t - down, x.r + across, x.b + down))


def resized(width: Column, height: Column, to_height: int) -> Column:
    """Width and height at a given height, the aspect kept."""
    return F.struct((width / height * to_height).cast("int").alias("width"), F.lit(to_height).alias("height"))


def valid_box(x: Box, width: Column, height: Column) -> Column:
    return (x.l >= 0) & (x.t >= 0) & (x.l < x.r) & (x.t < x.b) & (x.r <= width) & (x.b <= height)
