"""Rectangle arithmetic over columns. A rectangle is a name prefix with ``x0, y0, x1, y1`` behind it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def sides(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def area(r) -> Column:
    return F.greatest(r[2] - r[0], F.lit(0)) * F.greatest(r[3] - r[1], F.lit(0))


def overlap_area(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def intersects(a, b) -> Column:
    """Rectangles that share some area; touching ones do not."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def iou(a, b) -> Column:
    shared = overlap_area(a, b)
    return F.coalesce(F.try_divide(shared.cast("double"), (area(a) + area(b) - shared).cast("double")), F.lit(0.0))


def share_inside(a, b) -> Column:
    """Part of a's area that lies in b."""
    return F.coalesce(F.try_divide(overlap_area(a, b).cast("double"), area(a).cast("double")), F.lit(0.0))


def centre(r) -> tuple[Column, Column]:
    return (r[0] + r[2]) / 2, (r[1] + r[3]) / 2


def holds(r, x: Column, y: Column) -> Column:
    return (x >= r[0]) & (x <= r[2]) & (y >= r[1]) & (y <= r[3])


def distance_to(r, x: Column, y: Column) -> Column:
    """From a point to the nearest point of a rectangle."""
    dx = F.greatest(r[0] - x, F.lit(0), x - r[2])
    dy = F.greatest(r[1] - y, F.lit(0), y - r[3])
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def flip(r, height: Column) -> tuple[Column, ...]:
    """Between origins at the bottom left and the top left."""
    return r[0], height - r[3], r[2], height - r[1]


def scaled(r, fx: Column, fy: Column) -> tuple[Column, ...]:
    return r[0] * fx, r[1] * fy, r[2] * fx, r[3] * fy


def peak_memory_mb(file_mb: Column, pages: Column, dpi: Column, width: float = 612.0, height: float = 792.0) -> Column:
    """5 x file, 1.5 x one page's bitmap, 2 MB a page and 200 MB."""
    bitmap = (F.lit(width) / 72 * dpi) * (F.lit(height) / 72 * dpi) * 3 / 1048576
    return file_mb * 5 + bitmap * 1.5 + pages * 2 + 200


def suggested_dpi(file_mb: Column, pages: Column, most_mb: float = 4000.0) -> Column:
    """The first of 200, 150 and 100 whose estimate fits, else 100."""
    return F.when(peak_memory_mb(file_mb, pages, F.lit(200)) <= most_mb, 200).when(peak_memory_mb(file_mb, pages, F.lit(150)) <= most_mb, 150).otherwise(100)
