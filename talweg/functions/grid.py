"""Grid geometry as column expressions. A node is a cell: its number is row * nx + column."""

from __future__ import annotations

from dataclasses import dataclass
from math import hypot

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets (dir, dr, dc): 0 to 7 from the upper left neighbour by rows.
D8 = [(0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, -1), (4, 0, 1), (5, 1, -1), (6, 1, 0), (7, 1, 1)]
D4 = [o for o in D8 if o[1] == 0 or o[2] == 0]
DIRECTIONS = ("topleft", "top", "topright", "left", "right", "bottomleft", "bottom", "bottomright")


@dataclass(frozen=True)
class GridSpec:
    """A regular grid. A periodic axis joins its two ends."""

    nx: int
    ny: int
    dx: float = 1.0
    dy: float = 1.0
    xmin: float = 0.0
    ymin: float = 0.0
    periodic_ew: bool = False
    periodic_ns: bool = False

    @property
    def size(self) -> int:
        return self.nx * self.ny

    @property
    def cell_area(self) -> float:
        return self.dx * self.dy

    @property
    def dxy(self) -> float:
        return hypot(self.dx, self.dy)

    def length(self, dr: int, dc: int) -> float:
        return self.dxy if dr and dc else (self.dy if dr else self.dx)

    def width(self, dr: int, dc: int) -> float:
        """Width of flow across a link: the cell's side, or its diagonal."""
        return self.dxy if dr and dc else (self.dx if dr else self.dy)

    def node(self, r: Column, c: Column) -> Column:
        return (r * F.lit(self.nx) + c).cast("long")

    def row(self, node: Column) -> Column:
        return F.floor(node / F.lit(self.nx)).cast("long")

    def col(self, node: Column) -> Column:
        return F.pmod(node, F.lit(self.nx)).cast("long")

    def x(self, c: Column) -> Column:
        """x of a column's cell centres."""
        return F.lit(self.xmin) + (c + F.lit(0.5)) * F.lit(self.dx)

    def y(self, r: Column) -> Column:
        """y of a row's cell centres; row 0 is the top."""
        return F.lit(self.ymin) + (F.lit(self.ny) - r - F.lit(0.5)) * F.lit(self.dy)

    def node_at(self, x: Column, y: Column) -> Column:
        """The node whose cell holds a point; null outside the grid."""
        c = F.floor((x - F.lit(self.xmin)) / F.lit(self.dx))
        r = F.lit(self.ny - 1) - F.floor((y - F.lit(self.ymin)) / F.lit(self.dy))
        inside = c.between(0, self.nx - 1) & r.between(0, self.ny - 1)
        return F.when(inside, self.node(r, c))

    def is_top(self, r: Column) -> Column:
        return r == 0

    def is_bottom(self, r: Column) -> Column:
        return r == self.ny - 1

    def is_left(self, c: Column) -> Column:
        return c == 0

    def is_right(self, c: Column) -> Column:
        return c == self.nx - 1

    def on_edge(self, r: Column, c: Column) -> Column:
        return self.is_top(r) | self.is_bottom(r) | self.is_left(c) | self.is_right(c)

    def with_rowcol(self, nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("r", self.row(F.col("node"))).withColumn("c", self.col(F.col("node")))


def distance(spec: GridSpec, r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.hypot((c1 - c2) * spec.dx, (r1 - r2) * spec.dy)


def manhattan(spec: GridSpec, r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.abs(c1 - c2) * spec.dx + F.abs(r1 - r2) * spec.dy
