"""Areas of interest: shapes whose tests are Catalyst expressions. New shapes subclass :class:`AOI`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class AOI:
    """A named area; subclasses say when it contains a point. NULL coordinates are contained by none."""

    name: str

    def test(self, x: Column, y: Column) -> Column:
        raise NotImplementedError

    def contains(self, x: Column, y: Column) -> Column:
        return F.coalesce(self.test(x, y), F.lit(False))


@dataclass(frozen=True)
class Rect(AOI):
    """Centre, width and height; all four edges belong to it."""

    cx: float
    cy: float
    width: float
    height: float

    def test(self, x: Column, y: Column) -> Column:
        return x.between(self.cx - self.width / 2, self.cx + self.width / 2) & y.between(self.cy - self.height / 2, self.cy + self.height / 2)


@dataclass(frozen=True)
class Circle(AOI):
    cx: float
    cy: float
    radius: float

    def test(self, x: Column, y: Column) -> Column:
        dx, dy = x - float(self.cx), y - float(self.cy)
        return dx * dx + dy * dy <= float(self.radius) ** 2


@dataclass(frozen=True)
class Ellipse(AOI):
    cx: float
    cy: float
    rx: float
    ry: float

    def test(self, x: Column, y: Column) -> Column:
        dx, dy = (x - float(self.cx)) / float(self.rx), (y - float(self.cy)) / float(self.ry)
        return dx * dx + dy * dy <= 1.0


@dataclass(frozen=True)
class Polygon(AOI):
    """Even-odd rule over the edges; fewer than three corners contain nothing."""

    vertices: tuple[tuple[float, float], ...]

    def test(self, x: Column, y: Column) -> Column:
        v = [(float(a), float(b)) for a, b in self.vertices]
        if len(v) < 3:
            return F.lit(False)
        crossings = F.lit(0)
        for (xi, yi), (xj, yj) in zip(v, [v[-1], *v[:-1]], strict=True):
            if yi == yj:
                continue  # a level edge is never crossed
            side = (F.lit(yi) > y) != (F.lit(yj) > y)
            crossings = crossings + (side & (x < (xj - xi) * (y - yi) / (yj - yi) + xi)).cast("int")
        return crossings % 2 == 1


def first_match(aois: Sequence[AOI], x: Column, y: Column) -> Column:
    """1-based number of the first area that contains the point, 0 for none."""
    out = F.lit(0)
    for k in range(len(aois) - 1, -1, -1):
        out = F.when(aois[k].contains(x, y), F.lit(k + 1)).otherwise(out)
    return out


def names_array(aois: Sequence[AOI]) -> Column:
    return F.array(*(F.lit(a.name) for a in aois))


def explode_areas(aois: Sequence[AOI]) -> Column:
    """One row for each area: struct(k, name), to be exploded."""
    return F.explode(F.array(*(F.struct(F.lit(k + 1).alias("k"), F.lit(a.name).alias("name")) for k, a in enumerate(aois))))


def any_match(aois: Sequence[AOI], k: Column, x: Column, y: Column) -> Column:
    """Whether area number k contains the point, all areas tested apart."""
    out = F.lit(False)
    for i in range(len(aois) - 1, -1, -1):
        out = F.when(k == i + 1, aois[i].contains(x, y)).otherwise(out)
    return out
