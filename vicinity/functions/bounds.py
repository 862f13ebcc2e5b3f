"""Lower and upper bounds of distances between all rows of two blocks, for searches that leave points out before an expression.

A form reads Arrow columns of payloads into arrays and bounds a value that grows with the distance (equal distances may
have different values only where the distance is 0, and then both bounds allow for it). The bounds leave room for the
rounding of the form and of the expression, so that whatever the expression ranks among the nearest k has a lower bound
at most the k-th smallest upper bound. ``plain`` says which payloads a form can read; all others are left to the expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .distances import FLOOR, TINY

#: Cells of a block of bounds, about.
CELLS = 1 << 20
#: Relative room for the rounding of sums in double precision.
ROOM = 1e-9
#: Larger numbers are left to the expression: their squares might overflow.
BIG = 1e60


def _finite(x: Column) -> Column:
    """Neither null, NaN nor larger than BIG."""
    return F.coalesce(F.abs(x) < BIG, F.lit(False))


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _lengths(column) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Dense:
    """Vectors of one length."""

    def width(self, v: Column) -> Column:
        return F.size(v)

    def plain(self, v: Column, width: int) -> Column:
        return (F.size(v) == width) & F.lit(width > 0) & F.forall(v, _finite)

    def read(self, column, width: int) -> list[np.ndarray]:
        return [_matrix(column, width)]

    def table(self, rows: list[np.ndarray], dims: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        return rows[0], np.square(rows[0]).sum(1)

    def dims(self, rows: list[np.ndarray]) -> None:
        return None


class Ragged:
    """Rows of different lengths one after another, cut as arrays are."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        self.values, self.lengths, self.ends = values, lengths, np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))

    def __len__(self) -> int:
        return len(self.lengths)

    def __getitem__(self, at: slice) -> Ragged:
        a, b, _ = at.indices(len(self))
        return Ragged(self.values[self.ends[a] : self.ends[max(a, b)]], self.lengths[at])


@dataclass
class Sparse:
    """(dim, val) in order of dim. Of a row only the dimensions that queries have enter a product; all enter its norm."""

    def width(self, v: Column) -> Column:
        return F.lit(0)

    def plain(self, v: Column, width: int) -> Column:
        rising = F.sort_array(F.array_distinct(v["dim"])) == v["dim"]
        return v.isNotNull() & F.forall(v, lambda e: e["dim"].isNotNull() & _finite(e["val"])) & rising

    def read(self, column, width: int) -> list[Ragged]:
        """Dimensions and values."""
        flat, lengths = column.flatten(), _lengths(column)
        dim, val = (flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False) for name in ("dim", "val"))
        return [Ragged(dim.astype(np.int64), lengths), Ragged(val.astype(np.float64), lengths)]

    def dims(self, rows: list[Ragged]) -> np.ndarray:
        return np.unique(rows[0].values)

    def table(self, rows: list[Ragged], dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(rows[0])), rows[0].lengths)
        dim, val = rows[0].values, rows[1].values
        at = np.minimum(np.searchsorted(dims, dim), max(len(dims) - 1, 0))
        hit = dims[at] == dim if len(dims) else np.zeros(len(dim), bool)
        m = np.zeros((len(rows[0]), len(dims)))
        m[row[hit], at[hit]] = val[hit]
        return m, np.bincount(row, val * val, minlength=len(m))


@dataclass
class Products:
    """Negated weighted inner products of parts of a payload (name None: the payload itself), of unit vectors if ``unit``."""

    parts: dict[str | None, tuple[Dense | Sparse, float]]
    unit: bool = False

    def _part(self, v: Column, name: str | None) -> Column:
        return v if name is None else v[name]

    def shape(self, v: Column) -> Column:
        """What the payloads of a search must agree on."""
        return F.array(*(kind.width(self._part(v, name)) for name, (kind, _) in self.parts.items()))

    def plain(self, v: Column, shape: list[int]) -> Column:
        out = v.isNotNull()
        for (name, (kind, _)), width in zip(self.parts.items(), shape, strict=True):
            out = out & kind.plain(self._part(v, name), width)
        return F.coalesce(out, F.lit(False))

    def read(self, column, shape: list[int]) -> list[np.ndarray]:
        out = []
        for (name, (kind, _)), width in zip(self.parts.items(), shape, strict=True):
            out += kind.read(column if name is None else column.field(name), width)
        return out

    def _tables(self, rows: list[np.ndarray], dims: list) -> tuple[np.ndarray, np.ndarray]:
        """A table whose products are the values, negated, and the error's share of each row."""
        tables, squares, at = [], 0.0, 0
        for (kind, weight), d in zip(self.parts.values(), dims, strict=True):
            n = 2 if isinstance(kind, Sparse) else 1
            m, square = kind.table(rows[at : at + n], d)
            tables.append(m * np.sqrt(weight))
            squares, at = squares + weight * square, at + n
        m = np.concatenate(tables, 1) if len(tables) > 1 else tables[0]
        norm = np.sqrt(squares)
        if not self.unit:
            return m, norm
        some = squares >= TINY * (1 - ROOM)
        # within rounding of the least norm a product may count or not: the error covers both
        near = np.abs(squares - TINY) <= TINY * ROOM
        return np.divide(m, norm[:, None], out=np.zeros_like(m), where=some[:, None]), np.where(near, 2 / ROOM, 1.0)

    def prepare(self, rows: list[np.ndarray]) -> list[tuple[slice, object]]:
        """Blocks of queries, halved while their table is too wide."""
        todo, out = [slice(0, len(rows[0]))] if len(rows[0]) else [], []
        while todo:
            at = todo.pop()
            part = [r[at] for r in rows]
            dims, i = [], 0
            for kind, _ in self.parts.values():
                dims.append(kind.dims(part[i : i + 2]))
                i += 2 if isinstance(kind, Sparse) else 1
            n = at.stop - at.start
            if n > 1 and (n > 512 or n * sum(len(d) for d in dims if d is not None) > 4 * CELLS):
                todo += [slice(at.start, at.start + n // 2), slice(at.start + n // 2, at.stop)]
            else:
                out.append((at, (dims, *self._tables(part, dims))))
        return out

    def step(self, block) -> int:
        dims, q, _ = block
        return max(1, CELLS // max(len(q), q.shape[1], 1))

    def bounds(self, rows: list[np.ndarray], block) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds: queries by points."""
        dims, q, share = block
        x, other = self._tables(rows, dims)
        d, e = -(q @ x.T), ROOM * share[:, None] * other[None, :]
        return d - e, d + e


@dataclass
class JensenShannon:
    """The divergence from sums in single precision, with the room that those need."""

    vectors: Dense = field(default_factory=Dense)

    def shape(self, v: Column) -> Column:
        return F.array(F.size(v))

    def plain(self, v: Column, shape: list[int]) -> Column:
        # sums of two elements stay normal numbers of single precision, or 0
        return F.coalesce((F.size(v) == shape[0]) & F.lit(shape[0] > 0) & F.forall(v, lambda x: F.coalesce((x == 0) | ((x >= 1e-30) & (x <= 1e30)), F.lit(False))), F.lit(False))

    def read(self, column, shape: list[int]) -> list[np.ndarray]:
        return self.vectors.read(column, shape[0])

    def _rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors, the part of the divergence that each has alone, and the error's share of each."""
        each = x * np.log(np.maximum(x, FLOOR))
        alone = each.sum(1) + np.log(2.0) * x.sum(1)
        return x.astype(np.float32), alone, (x.shape[1] + 32) * 1.2e-7 * (np.abs(each).sum(1) + x.sum(1)) + 1e-25

    def prepare(self, rows: list[np.ndarray]) -> list[tuple[slice, object]]:
        x = rows[0]
        return [(slice(a, min(a + 256, len(x))), self._rows(x[a : a + 256])) for a in range(0, len(x), 256)]

    def step(self, block) -> int:
        return max(1, (1 << 16) // max(1, block[0].shape[1]))

    def bounds(self, rows: list[np.ndarray], block) -> tuple[np.ndarray, np.ndarray]:
        (q, alone, share), (x, own, other) = block, self._rows(rows[0])
        d, both, logs = np.empty((len(q), len(x))), np.empty_like(x), np.empty_like(x)
        for j, row in enumerate(q):
            np.add(x, row, out=both)
            np.maximum(both, np.float32(1e-30), out=both)
            np.log(both, out=logs)
            d[j] = np.einsum("ij,ij->i", both, logs)
        d = (alone[:, None] + own[None, :] - d) / 2
        e = share[:, None] + other[None, :]
        return d - e, np.maximum(d + e, 0)  # what rounds below 0 is 0


@dataclass
class QuadraticForm:
    """The quadratic form of signatures, whose root is the distance. ``similar`` (in place) takes distances of centroids if ``root``, else their squares; ``slope``: how much it changes with these, at most; ``top``: its size, at most (None: that of the distance); ``kind``: the precision of sums over pairs of clusters."""

    similar: Callable[[np.ndarray], np.ndarray]
    slope: float
    top: float | None
    root: bool = True
    kind: type = np.float64

    def shape(self, v: Column) -> Column:
        return F.array(F.coalesce(F.size(F.get(v, F.lit(0))["centroid"]), F.lit(0)))

    def plain(self, v: Column, shape: list[int]) -> Column:
        fits = _finite
        if self.kind is np.float32:  # products of these stay normal numbers
            fits = lambda x: F.coalesce((x == 0) | F.abs(x).between(1e-15, 1e15), F.lit(False))
        return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.lit(shape[0] > 0) & F.forall(v, lambda e: F.coalesce((F.size(e["centroid"]) == shape[0]) & F.forall(e["centroid"], fits) & fits(e["weight"]), F.lit(False))), F.lit(False))

    def read(self, column, shape: list[int]) -> list[np.ndarray]:
        """Centroids (rows, clusters, dimensions) and weights (rows, clusters); clusters that a row lacks have weight 0."""
        flat, lengths = column.flatten(), _lengths(column)
        most = int(lengths.max(initial=0))
        has = np.arange(most)[None, :] < lengths[:, None]
        centroids, weights = np.zeros((len(lengths), most, shape[0])), np.zeros((len(lengths), most))
        if len(flat):
            centroids[has] = _matrix(flat.field(flat.type.get_field_index("centroid")), shape[0])
            weights[has] = flat.field(flat.type.get_field_index("weight")).to_numpy(zero_copy_only=False).astype(np.float64)
        return [centroids, weights]

    def _rows(self, rows: list[np.ndarray], query: bool = False) -> tuple:
        """By cluster, rows whose product with those of the other side is a squared distance; weights, the part of the form that each has alone, their sum and the largest norm."""
        c, w = rows
        square = np.square(c).sum(2)
        alone = np.zeros(len(c))
        for a in range(c.shape[1]):
            for b in range(c.shape[1]):
                d = np.square(c[:, a] - c[:, b]).sum(1)
                alone += w[:, a] * w[:, b] * self.similar(np.sqrt(d) if self.root else d)
        ones = np.ones_like(square)
        sides = (-2 * c, square, ones) if query else (c, ones, square)
        table = np.concatenate((sides[0], sides[1][..., None], sides[2][..., None]), 2).astype(self.kind)
        return np.ascontiguousarray(table.transpose(1, 0, 2)), w, alone, np.abs(w).sum(1), np.sqrt(square.max(1, initial=0))

    def prepare(self, rows: list[np.ndarray]) -> list[tuple[slice, object]]:
        n = len(rows[0])
        return [(slice(a, min(a + 512, n)), self._rows([r[a : a + 512] for r in rows], True)) for a in range(0, n, 512)]

    def step(self, block) -> int:
        return 256

    def bounds(self, rows: list[np.ndarray], block) -> tuple[np.ndarray, np.ndarray]:
        (q, u, mine, heavy, wide), (x, w, own, other, far) = block, self._rows(rows)
        f, least = mine[:, None] + own[None, :], np.full(len(mine), np.inf)
        share = u.astype(self.kind)
        for b in range(len(x)):
            both = np.zeros(f.shape, self.kind)
            for a in range(len(q)):
                d = q[a] @ x[b].T
                np.maximum(d, 0, out=d)
                if self.root:
                    np.minimum(least, d.min(1, initial=np.inf), out=least)
                    np.sqrt(d, out=d)
                d = self.similar(d)
                d *= share[:, a, None]
                both += d
            f -= both * (2 * w[None, :, b])
        reach, unit = wide[:, None] + far[None, :], 2.0 * np.finfo(self.kind).eps
        top = self.top if self.top is not None else reach
        # a squared distance from products is off by a few units of the squared norms
        off = (q.shape[2] + 8) * unit * np.square(reach) + 1e-36
        if self.root:  # its root by the root of those, and by less where no squared distance of the query is near 0
            off = np.minimum(np.sqrt(off), off / np.sqrt(np.maximum(least, 1e-300))[:, None]) + unit * reach
        e = 2 * heavy[:, None] * other[None, :] * (self.slope * off + (len(q) + 8) * unit * top) + np.square(heavy[:, None] + other[None, :]) * ROOM * top
        return f - e, np.maximum(f + e, 0)


def _sqfd(name: str, alpha: float = 1.0) -> QuadraticForm:
    alpha = float(alpha)
    if name == "sqfd_minus_func":
        return QuadraticForm(lambda d: np.negative(d, out=d), 1.0, None, kind=np.float32)
    if alpha <= 0:
        raise ValueError("alpha must be positive")
    kind = np.float32 if 1e-6 <= alpha <= 1e6 else np.float64
    if name == "sqfd_heuristic_func":

        def heuristic(d):
            d += alpha
            return np.reciprocal(d, out=d)

        return QuadraticForm(heuristic, alpha**-2, 1 / alpha, kind=kind)

    def gaussian(d):
        d *= -alpha
        return np.exp(d, out=d)

    return QuadraticForm(gaussian, alpha, 1.0, root=False, kind=kind)


#: Forms of spaces, from their parameters.
BOUNDS: dict[str, Callable] = {
    "cosinesimil": lambda: Products({None: (Dense(), 1.0)}, unit=True),
    "cosinesimil_sparse": lambda: Products({None: (Sparse(), 1.0)}, unit=True),
    "jsdivfast": JensenShannon,
    **{name: lambda name=name, **params: _sqfd(name, **params) for name in ("sqfd_minus_func", "sqfd_heuristic_func", "sqfd_gaussian_func")},
}


def fusion_bounds(weights: dict[str, float], sparse: tuple[str, ...] = ()) -> Products:
    """The form of ``fusion``."""
    return Products({part: (Sparse() if part in sparse else Dense(), float(w)) for part, w in weights.items() if w > FLOOR})
