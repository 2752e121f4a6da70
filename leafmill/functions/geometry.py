"""Boxes, quads and lines as column expressions. Points are ``struct<x, y>``, a quad is four of them from the top left clockwise."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.text import half_up

PAGE_SIZES = {"a4": (595.28, 841.89), "letter": (612.0, 792.0), "legal": (612.0, 1008.0), "a5": (419.53, 595.28)}  # fixed values, in points


def point(x, y) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def box_of(word: Column) -> Column:
    """A word's box as ``struct<x0, y0, x1, y1>``."""
    return F.struct(*(F.coalesce(word["bbox"][c], F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")))


def iou(a: Column | Callable[[str], Column], b: Column | Callable[[str], Column]) -> Column:
    """Intersection over union of two boxes, 0 where they don't overlap."""
    get = lambda v: v if callable(v) and not isinstance(v, Column) else (lambda c: v[c])
    a, b = get(a), get(b)
    w = F.least(a("x1"), b("x1")) - F.greatest(a("x0"), b("x0"))
    h = F.least(a("y1"), b("y1")) - F.greatest(a("y0"), b("y0"))
    area = lambda v: (v("x1") - v("x0")) * (v("y1") - v("y0"))
    return F.when((w <= 0) | (h <= 0), 0.0).otherwise(F.try_divide(w * h, area(a) + area(b) - w * h))


def rotate_words(words: Column, height: Column) -> Column:
    """Boxes of a page that was turned by 90 degrees clockwise, from its height before."""
    return F.transform(
        words,
        lambda w: w.withField("bbox", F.struct((height - w["bbox"]["y1"]).alias("x0"), w["bbox"]["x0"].alias("y0"), (height - w["bbox"]["y0"]).alias("x1"), w["bbox"]["x1"].alias("y1"))),
    )


def dist(a: Column, b: Column) -> Column:
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def angle_diff(a: Column, b: Column) -> Column:
    """Of two lines' directions, at most a right angle."""
    d = F.abs(a - b) % math.pi
    return F.when(d > math.pi / 2, math.pi - d).otherwise(d)


def _sides(quad: Column, n: int, f: Callable[[Column, Column, Column], Column]) -> list[Column]:
    at = lambda i: F.get(quad, F.lit(i % n))
    return [f(at(i), at(i + 1), at(i + 2)) for i in range(n)]


def order_corners(quad: Column) -> Column:
    """By angle about the centroid, beginning with the least x + y."""
    mean = lambda c: F.aggregate(quad, F.lit(0.0), lambda s, p: s + p[c]) / 4
    cx, cy = mean("x"), mean("y")
    turned = F.array_sort(F.transform(quad, lambda p, i: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("a"), i.alias("i"), p["x"].alias("x"), p["y"].alias("y"))))
    least = F.array_min(F.transform(turned, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), i.alias("i"))))["i"]
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct(F.get(turned, (least + k) % 4)["x"].alias("x"), F.get(turned, (least + k) % 4)["y"].alias("y")))


def polygon_area(points: Column) -> Column:
    """Shoelace, for any number of points."""
    n = F.size(points)
    cross = lambda i: F.get(points, i)["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * F.get(points, i)["y"]
    return F.when(n > 0, F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + cross(i))) / 2).otherwise(0.0)


def is_convex(quad: Column) -> Column:
    """Whether all corners that turn turn the same way, and one does."""
    turns = _sides(quad, 4, lambda a, b, c: (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))
    signs = F.array_compact(F.array(*(F.when(F.abs(t) >= 1e-9, F.signum(t)) for t in turns)))
    return F.size(F.array_distinct(signs)) == 1


def min_interior_angle(quad: Column) -> Column:
    """In degrees."""

    def angle(a: Column, b: Column, c: Column) -> Column:
        ux, uy, vx, vy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
        length = lambda x, y: F.coalesce(F.nullif(F.hypot(x, y), F.lit(0.0)), F.lit(1e-9))
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / (length(ux, uy) * length(vx, vy))))))

    return F.least(F.lit(180.0), *_sides(quad, 4, angle))


def line_intersection(rho1: Column, theta1: Column, rho2: Column, theta2: Column) -> Column:
    """Of two lines in normal form; null if they are parallel."""
    c1, s1, c2, s2 = F.cos(theta1), F.sin(theta1), F.cos(theta2), F.sin(theta2)
    det = c1 * s2 - s1 * c2
    return F.when(F.abs(det) >= 1e-9, point(F.try_divide(rho1 * s2 - rho2 * s1, det), F.try_divide(rho2 * c1 - rho1 * c2, det)))


def scale_quad(quad: Column, factor: Column | float) -> Column:
    """About its centroid."""
    f = factor if isinstance(factor, Column) else F.lit(float(factor))
    mean = lambda c: F.aggregate(quad, F.lit(0.0), lambda s, p: s + p[c]) / F.size(quad)
    cx, cy = mean("x"), mean("y")
    return F.transform(quad, lambda p: F.struct((cx + (p["x"] - cx) * f).alias("x"), (cy + (p["y"] - cy) * f).alias("y")))


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    """The projective image of (x, y) by nine coefficients in rows; the origin where it has none."""
    at = lambda i: F.get(h, F.lit(i))
    w = at(6) * x + at(7) * y + at(8)
    return point(F.when(w == 0, 0.0).otherwise(F.try_divide(at(0) * x + at(1) * y + at(2), w)), F.when(w == 0, 0.0).otherwise(F.try_divide(at(3) * x + at(4) * y + at(5), w)))


def estimate_output_size(quad: Column, longest: int = 2400) -> Column:
    """``struct<width, height>`` of the upright page: its longer opposite edges, 16 at least, ``longest`` at most."""
    p = [F.get(quad, F.lit(i)) for i in range(4)]
    w = F.greatest(F.lit(16), half_up(F.greatest(dist(p[0], p[1]), dist(p[3], p[2]))))
    h = F.greatest(F.lit(16), half_up(F.greatest(dist(p[0], p[3]), dist(p[1], p[2]))))
    top = F.greatest(w, h)
    scaled = lambda v: F.when(top > longest, half_up(v * (F.lit(float(longest)) / top))).otherwise(v).cast("int")
    return F.struct(scaled(w).alias("width"), scaled(h).alias("height"))


def inset_corners(width: Column, height: Column, share: float = 0.04) -> Column:
    """What stands in for an outline that wasn't found: 4 % from each edge, or 6 % as an editor begins."""
    x, y = width * F.lit(share), height * F.lit(share)
    return F.array(point(x, y), point(width - x, y), point(width - x, height - y), point(x, height - y))


def page_layout(width: Column, height: Column, size: str = "fit", margin: float = 0.0, dpi: float = 200.0) -> Column:
    """``struct<pageWidth, pageHeight, drawWidth, drawHeight, offsetX, offsetY>`` in points.

    ``fit``: the image at ``dpi`` with the margin around it. A named size is
    turned for wide images, and the image is centred in it as large as fits.
    """
    if size == "fit":
        w, h = width * (72.0 / dpi), height * (72.0 / dpi)
        m = F.lit(float(margin))
        return F.struct((w + 2 * m).alias("pageWidth"), (h + 2 * m).alias("pageHeight"), w.alias("drawWidth"), h.alias("drawHeight"), m.alias("offsetX"), m.alias("offsetY"))
    a, b = PAGE_SIZES[size]
    wide = width > height
    pw, ph = F.when(wide, max(a, b)).otherwise(min(a, b)), F.when(wide, min(a, b)).otherwise(max(a, b))
    scale = F.least((pw - 2 * margin) / width, (ph - 2 * margin) / height)
    dw, dh = width * scale, height * scale
    return F.struct(pw.alias("pageWidth"), ph.alias("pageHeight"), dw.alias("drawWidth"), dh.alias("drawHeight"), ((pw - dw) / 2).alias("offsetX"), ((ph - dh) / 2).alias("offsetY"))


def text_placement(bbox: Column, clusters: Column, scale_x: Column, scale_y: Column, page_height: Column, offset_x: Column, offset_y: Column) -> Column:
    """``struct<x, baseline, fontSize, stretch>`` of a word's invisible text; null if it is too small or has no cluster."""
    w, h = (bbox["x1"] - bbox["x0"]) * scale_x, (bbox["y1"] - bbox["y0"]) * scale_y
    font = F.greatest(F.lit(1.0), h * 0.92)
    stretch = F.greatest(F.lit(1.0), F.least(F.lit(1200.0), F.try_divide(w, clusters * 0.5 * font) * 100))
    placed = F.struct((bbox["x0"] * scale_x + offset_x).alias("x"), (page_height - (bbox["y1"] * scale_y + offset_y) + h * 0.18).alias("baseline"), font.alias("fontSize"), stretch.alias("stretch"))
    return F.when((w > 0.4) & (h > 0.4) & (clusters > 0), placed)
