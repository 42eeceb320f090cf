"""Box, polygon and run-length column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.model import unit

# width/height ranges of licence plates by region.
PLATE_ASPECT = {"default": (1.5, 6.0), "eu": (3.0, 5.5), "us": (1.8, 2.5), "china": (2.5, 4.0)}


def center_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def corners_to_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, ...]:
    w, h = x2 - x1, y2 - y1
    return x1 + w / 2, y1 + h / 2, w, h


def topleft_to_center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x + w / 2, y + h / 2, w, h


def center_to_topleft(cx: Column, cy: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return cx - w / 2, cy - h / 2, w, h


def scale(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    """Normalized to pixel values, in any of the three layouts."""
    a, b, c, d = box
    return a * width, b * height, c * width, d * height


def unscale(box: tuple[Column, ...], width: Column, height: Column) -> tuple[Column, ...]:
    a, b, c, d = box
    return a / width, b / height, c / width, d / height


def to_layout(box: tuple[Column, ...], layout: str) -> tuple[Column, ...]:
    """Center box to ``xyxy``, ``xywh`` or ``cxcywh``."""
    if layout == "xyxy":
        return center_to_corners(*box)
    if layout == "xywh":
        return center_to_topleft(*box)
    if layout == "cxcywh":
        return box
    raise ValueError(f"unknown box layout: {layout}")


def from_layout(box: tuple[Column, ...], layout: str) -> tuple[Column, ...]:
    """``xyxy``, ``xywh`` or ``cxcywh`` to a clamped center box."""
    if layout == "xyxy":
        box = corners_to_center(*box)
    elif layout == "xywh":
        box = topleft_to_center(*box)
    elif layout != "cxcywh":
        raise ValueError(f"unknown box layout: {layout}")
    return tuple(unit(c) for c in box)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap ratio of two corner boxes; 0 without a strict overlap or with an empty union."""
    ix = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    iy = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    inter = ix * iy
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((ix > 0) & (iy > 0) & (union > 0), F.try_divide(inter, union)).otherwise(
        F.lit(0.0)
    )


def pixel_corners(cx, cy, w, h, width: Column, height: Column) -> tuple[Column, ...]:
    """Truncated pixel corners held inside the image."""
    x1, y1, x2, y2 = scale(center_to_corners(cx, cy, w, h), width, height)

    def hold(v, size):
        return F.greatest(F.lit(0), F.least(v.cast("int"), size.cast("int") - 1))

    return hold(x1, width), hold(y1, height), hold(x2, width), hold(y2, height)


def expand(box: tuple[Column, ...], factor: Column, width: Column, height: Column):
    """Grow a corner box about its center and cut it to the image."""
    x1, y1, x2, y2 = box
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    hw, hh = (x2 - x1) / 2 * factor, (y2 - y1) / 2 * factor
    return (
        F.greatest(F.lit(0.0), mx - hw),
        F.greatest(F.lit(0.0), my - hh),
        F.least(width.cast("double"), mx + hw),
        F.least(height.cast("double"), my + hh),
    )


def polygon_box(flat: Column) -> tuple[Column, ...]:
    """Corner box of a flat ``[x, y, x, y, ...]`` array."""
    xs = F.filter(flat, lambda _, i: i % 2 == 0)
    ys = F.filter(flat, lambda _, i: i % 2 == 1)
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def polygon_to_pixels(flat: Column, width: Column, height: Column) -> Column:
    """Scale a polygon to pixels when all of it lies in [0, 1]; otherwise it already is."""
    scaled = F.transform(flat, lambda v, i: v * F.when(i % 2 == 0, width).otherwise(height))
    return F.when(F.forall(flat, lambda v: (v >= 0) & (v <= 1)), scaled).otherwise(flat)


def plate_aspect_ok(w: Column, h: Column, region: str = "default") -> Column:
    low, high = PLATE_ASPECT.get(region, PLATE_ASPECT["default"])
    return (h > 0) & F.try_divide(w, h).between(low, high)


def point_distance(points: Column, width: Column, height: Column) -> Column:
    """Pixel distance of the first two (x, y) landmarks; null with fewer than two."""
    a, b = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(2))
    dx = (b["x"] - a["x"]) * width
    dy = (b["y"] - a["y"]) * height
    return F.when(F.size(points) >= 2, F.sqrt(dx * dx + dy * dy))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, also inside other lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def run_lengths(pixels: Column) -> Column:
    """Run lengths of a 0/1 array in storage order; the first run counts zeros (maybe none)."""

    def encode(px: Column) -> Column:
        n = F.size(px)
        starts = F.filter(
            F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & (F.get(px, i) != F.get(px, i - 1))
        )
        head = F.when(F.get(px, F.lit(0)) == 1, F.array(F.lit(0), F.lit(0))).otherwise(
            F.array(F.lit(0))
        )

        def lengths(edges: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(edges) - 1),
                lambda i: F.get(edges, i) - F.get(edges, i - 1),
            )

        runs = let(F.concat(head, starts, F.array(n)), lengths)
        return F.when(n == 0, F.array().cast("array<int>")).otherwise(runs)

    return let(pixels, encode)


def run_area(runs: Column) -> Column:
    """Foreground pixels of a run-length array."""
    return F.aggregate(
        F.filter(runs, lambda _, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda s, v: s + v
    )


def clean_stem(stem: Column) -> Column:
    """Drop a leading ``digits_`` unless nothing would remain."""
    return F.regexp_replace(stem, r"^[0-9]+_(?=.)", "")
