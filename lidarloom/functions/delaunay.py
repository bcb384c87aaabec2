"""Delaunay triangulation of points in the plane: incremental, with an adjacency structure and exact predicates."""

from __future__ import annotations

from fractions import Fraction

import numpy as np

Point = tuple[float, float]
#: The vertex beyond the hull: a hull edge and it make a triangle, so that every edge has two sides.
BEYOND = -1
#: Relative rounding below which a predicate is computed again with fractions.
ORIENT_ERROR, CIRCLE_ERROR = 4e-16, 1.2e-15


def orient(a: Point, b: Point, c: Point) -> float:
    """Positive if a, b, c turn to the left, negative to the right, 0 on a line; the sign is exact."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = left - right
    if abs(d) > ORIENT_ERROR * (abs(left) + abs(right)):
        return d
    a, b, c = ((Fraction(p[0]), Fraction(p[1])) for p in (a, b, c))
    exact = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return float((exact > 0) - (exact < 0))


def in_circle(a: Point, b: Point, c: Point, p: Point) -> bool:
    """Whether p is strictly inside the circle through a, b, c (in left turn); exact."""

    def determinant(one: type) -> tuple:
        rows = [(one(q[0]) - one(p[0]), one(q[1]) - one(p[1])) for q in (a, b, c)]
        s = [x * x + y * y for x, y in rows]
        terms = [s[i] * (rows[(i + 1) % 3][0] * rows[(i + 2) % 3][1] - rows[(i + 1) % 3][1] * rows[(i + 2) % 3][0]) for i in range(3)]
        size = sum(s[i] * (abs(rows[(i + 1) % 3][0] * rows[(i + 2) % 3][1]) + abs(rows[(i + 1) % 3][1] * rows[(i + 2) % 3][0])) for i in range(3))
        return sum(terms), size

    d, size = determinant(float)
    if abs(d) > CIRCLE_ERROR * 4 * size:
        return d > 0
    return determinant(Fraction)[0] > 0


class Mesh:
    """Triangles as vertex triples in left turn, and for each vertex of a triangle the triangle across the edge that
    doesn't touch it."""

    def __init__(self, points: np.ndarray):
        self.p: list[Point] = [(float(x), float(y)) for x, y in points]
        self.tri: list[list[int] | None] = []
        self.near: list[list[int]] = []
        self.last = -1
        order = self.ordered(points)
        first = self.begin(order)
        for v in order:
            if first and v not in first:
                self.insert(v)

    @staticmethod
    def ordered(points: np.ndarray) -> list[int]:
        """Along a snake through strips, so that each point lies near the one before."""
        if not len(points):
            return []
        strips = max(1, int(len(points) ** 0.5 / 2))
        low, high = points[:, 0].min(), points[:, 0].max()
        strip = np.minimum(((points[:, 0] - low) / max(high - low, 1e-300) * strips).astype(int), strips - 1)
        return np.lexsort((np.where(strip % 2, -points[:, 1], points[:, 1]), strip)).tolist()

    def begin(self, order: list[int]) -> set[int]:
        """The first triangle and the three beyond it; nothing if all points lie on a line."""
        if len(order) < 3:
            return set()
        a = order[0]
        b = next((v for v in order if self.p[v] != self.p[a]), None)
        c = None if b is None else next((v for v in order if orient(self.p[a], self.p[b], self.p[v]) != 0), None)
        if c is None:
            return set()
        if orient(self.p[a], self.p[b], self.p[c]) < 0:
            a, b = b, a
        self.tri = [[a, b, c], [c, b, BEYOND], [a, c, BEYOND], [b, a, BEYOND]]
        self.near = [[1, 2, 3], [3, 2, 0], [1, 3, 0], [2, 1, 0]]
        self.last = 0
        return {a, b, c}

    def conflict(self, t: int, p: Point) -> bool:
        """Whether ``p`` is inside the circle of triangle ``t``; beyond the hull, the circle is the half plane."""
        own = self.tri[t]
        if BEYOND not in own:
            return in_circle(*(self.p[v] for v in own), p)
        k = own.index(BEYOND)
        a, b = self.p[own[(k + 1) % 3]], self.p[own[(k + 2) % 3]]
        side = orient(a, b, p)
        return side > 0 or (side == 0 and min(a, b) < p < max(a, b))

    def locate(self, p: Point) -> tuple[int, int]:
        """(the triangle that ``p`` is in, or the one beyond the hull edge that it lies across; the last real one)."""
        t = self.last
        while True:
            own, real = self.tri[t], t
            for k in range(3):
                if orient(self.p[own[(k + 1) % 3]], self.p[own[(k + 2) % 3]], p) < 0:
                    t = self.near[t][k]
                    break
            else:
                return t, t
            if BEYOND in self.tri[t]:
                return t, real

    def insert(self, v: int) -> None:
        p = self.p[v]
        start, _ = self.locate(p)
        if BEYOND not in self.tri[start] and any(self.p[w] == p for w in self.tri[start]):
            return
        bad, border, stack = {start}, [], [start]
        while stack:
            t = stack.pop()
            for k in range(3):
                n = self.near[t][k]
                if n in bad:
                    continue
                if self.conflict(n, p):
                    bad.add(n)
                    stack.append(n)
                else:
                    border.append((self.tri[t][(k + 1) % 3], self.tri[t][(k + 2) % 3], n))
        border = [e for e in border if e[2] not in bad]
        free = list(bad)
        at: dict[int, int] = {}
        for a, b, outside in border:
            if free:
                t = free.pop()
            else:
                t = len(self.tri)
                self.tri.append(None)
                self.near.append([0, 0, 0])
            self.tri[t] = [a, b, v]
            self.near[t] = [-1, -1, outside]
            own = self.tri[outside]
            self.near[outside][next(k for k in range(3) if own[(k + 1) % 3] == b and own[(k + 2) % 3] == a)] = t
            at[a] = t
        for a, b, _ in border:
            t = at[a]
            self.near[t][0] = at[b]
            self.near[at[b]][1] = t
            if BEYOND not in (a, b):
                self.last = t
        for t in free:
            self.tri[t] = None

    def triangles(self) -> list[tuple[int, int, int]]:
        return [tuple(t) for t in self.tri if t is not None and BEYOND not in t]


def circle(a: Point, b: Point, c: Point) -> tuple[float, float, float]:
    """The centre and the squared radius of the circle through three points."""
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx)
    ux, uy = (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d
    return a[0] + ux, a[1] + uy, ux * ux + uy * uy


def shares(a: Point, b: Point, c: Point, p: Point) -> tuple[float, float, float]:
    """Barycentric coordinates of ``p``."""
    whole = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    u = ((b[0] - p[0]) * (c[1] - p[1]) - (b[1] - p[1]) * (c[0] - p[0])) / whole
    v = ((c[0] - p[0]) * (a[1] - p[1]) - (c[1] - p[1]) * (a[0] - p[0])) / whole
    return u, v, 1 - u - v
