"""Boxes, masks and pixels (survey X30 non-maximum suppression, W17, A20, X37).

Suppression works on an array of boxes per image, so the images' rows never meet; the number of boxes of one image is
the detector's limit. Order is by score, ties by coordinates.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = T.StructType([T.StructField(k, T.DoubleType()) for k in ("x1", "y1", "x2", "y2", "score")])


def iou(a: tuple, b: tuple) -> float:
    """Intersection over union of two boxes (x1, y1, x2, y2, ...); 0 for empty boxes."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    area = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    union = area(a) + area(b) - inter
    return inter / union if union > 0 else 0.0


def suppress(boxes: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """Boxes by score; one that overlaps a kept one by at least the threshold goes. Boxes with a null part are left out."""
    kept: list[tuple] = []
    for b in sorted((b for b in boxes if None not in b), key=lambda r: (-r[4], *r[:4])):
        if all(iou(b, k) < threshold for k in kept):
            kept.append(b)
    return kept


def near_longest(boxes: list[tuple], most: int = 10, near: float = 10.0) -> list[tuple]:
    """Of the `most` boxes with the longest half perimeter those within `near` of the longest; one whose corners all
    lie within `near` of a kept one goes."""
    half = lambda r: (r[2] - r[0]) + (r[3] - r[1])
    top = sorted((b for b in boxes if None not in b), key=lambda r: (-half(r), *r[:4]))[:most]
    kept: list[tuple] = []
    for b in top:
        if half(top[0]) - half(b) <= near and not any(all(abs(p - q) <= near for p, q in zip(b[:4], k[:4])) for k in kept):
            kept.append(b)
    return kept


def _per_image(f, boxes: Column) -> Column:
    @F.pandas_udf(T.ArrayType(BOX))
    def run(s: pd.Series) -> pd.Series:
        keys = BOX.names
        return pd.Series([[dict(zip(keys, k)) for k in f([tuple(b[n] for n in keys) for b in (x if x is not None else [])])] for x in s])

    return run(boxes)


def nms(boxes: Column, threshold: float = 0.8) -> Column:
    """Column form of suppress: array of struct(x1, y1, x2, y2, score); null gives the empty array."""
    return _per_image(lambda b: suppress(b, threshold), boxes)


def subplots(boxes: Column, most: int = 10, near: float = 10.0) -> Column:
    return _per_image(lambda b: near_longest(b, most, near), boxes)


def window_level(pixels: Column, level: float, width: float) -> Column:
    """An array of pixels clipped to the window and rescaled to 0-255; a width of 0 or less gives null."""
    low = level - width / 2
    return F.when(F.lit(width) > 0, F.transform(pixels, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.lit(low)) / F.lit(width))) * 255))


def mask_statistics(mask: Column, pixels: Column, columns: Column) -> Column:
    """struct(area, cx, cy, x1, y1, x2, y2, mean) of the pixels under a flat mask of rows of `columns`; null for an empty mask."""
    at = F.filter(F.transform(mask, lambda m, i: F.when(m > 0, i)), lambda i: i.isNotNull())
    n = F.size(at)
    x = lambda i: F.pmod(i, columns)
    y = lambda i: F.floor(i / columns).cast("int")
    total = lambda f: F.aggregate(at, F.lit(0.0), lambda s, i: s + f(i))
    xs, ys = F.transform(at, x), F.transform(at, y)
    s = F.struct(n.alias("area"), (total(x) / n).alias("cx"), (total(y) / n).alias("cy"), F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"), (total(lambda i: F.get(pixels, i).cast("double")) / n).alias("mean"))
    return F.when(n > 0, s)
