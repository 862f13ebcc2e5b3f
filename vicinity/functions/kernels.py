"""The same distances between all rows of two blocks, for searches that run inside a task.

Objects are rows of a matrix (dense vectors, distributions, ranks), or lists of Python values (strings, sets, words
of bits, sparse pairs). The first block holds the objects, the second the queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .distances import FLOOR, NO_LOG, TINY, space

#: Spaces with a matrix form that the exact batched scan uses.
BATCHED = ("l1", "l2", "l2sqr", "linf", "negdotprod", "cosinesimil", "angulardist")


#: Cells of the dense form of sparse objects, about.
SPREAD = 1 << 22


def _products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return x @ q.T


def _squared(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * _products(x, q), 0)


def _cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    nx, nq = (x * x).sum(1)[:, None], (q * q).sum(1)[None, :]
    ok = (nx >= TINY) & (nq >= TINY)
    return np.divide(_products(x, q), np.sqrt(nx) * np.sqrt(nq), out=np.zeros((len(x), len(q))), where=ok).clip(-1, 1)


def _logs(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.log(np.maximum(x, FLOOR)), NO_LOG)


def _kl(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sum of x (ln x - ln q), as products."""
    return (x * _logs(x)).sum(1)[:, None] - x @ _logs(q).T


def _kl_general(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return _kl(x, q) + q.sum(1)[None, :] - x.sum(1)[:, None]


def _itakura_saito(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    inverse = np.divide(1.0, q, out=np.zeros_like(q), where=q != 0)
    return x @ inverse.T - _logs(x).sum(1)[:, None] + _logs(q).sum(1)[None, :] - x.shape[1]


def _plogp(x: np.ndarray) -> np.ndarray:
    return np.where(x >= FLOOR, x * np.log(np.maximum(x, FLOOR)), 0.0)


def _js(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(q)))
    for j, row in enumerate(q):
        both = x + row
        out[:, j] = (_plogp(x) + _plogp(row) - np.where(both >= FLOOR, both * np.log(np.maximum(both / 2, FLOOR)), 0.0)).sum(1) / 2
    return np.maximum(out, 0)


def _renyi(x: np.ndarray, q: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    ratio = lambda a, p: np.where(a > 0, np.power(np.maximum(a, FLOOR), p), 0.0)
    inner = ratio(x, alpha) @ ratio(q, 1 - alpha).T
    return np.maximum(0.0, _logs(inner) / (alpha - 1))


def _alpha_beta(x: np.ndarray, q: np.ndarray, alpha: float = 1, beta: float = 1) -> np.ndarray:
    return np.power(x, alpha + 1) @ np.power(q, beta).T


def _lp(x: np.ndarray, q: np.ndarray, p: float) -> np.ndarray:
    if p == -1:
        return np.abs(x[:, None, :] - q[None, :, :]).max(2)
    return np.power(np.power(np.abs(x[:, None, :] - q[None, :, :]), p).sum(2), 1 / p)


def _swapped(f: Callable) -> Callable:
    return lambda x, q, **params: f(q, x, **params).T


def levenshtein(a: bytes, b: bytes) -> int:
    """Edits between two byte strings; a row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    codes, places = np.frombuffer(b, np.uint8), np.arange(len(b) + 1)
    row = places.copy()
    for i, c in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        np.minimum(row[1:] + 1, row[:-1] + (codes != c), out=best[1:])
        # an insertion costs one a step to the right: a running minimum of value - place
        row = np.minimum.accumulate(best - places) + places
    return int(row[-1])


def _each(f: Callable) -> Callable:
    return lambda x, q: np.array([[f(a, b) for b in q] for a in x], np.float64).reshape(len(x), len(q))


def _leven(a: str, b: str) -> int:
    return levenshtein(a.encode(), b.encode())


def _norm_leven(a: str, b: str) -> float:
    longest = max(len(a.encode()), len(b.encode()))
    return _leven(a, b) / longest if longest else 0.0


def _jaccard(x: Sequence, q: Sequence) -> np.ndarray:
    """From sizes and shared items, which are products of memberships of the queries' items."""
    a, b = [np.unique(np.array(v, np.int64)) for v in x], [np.unique(np.array(v, np.int64)) for v in q]
    items = np.unique(np.concatenate([*b, np.zeros(0, np.int64)]))

    def members(sets: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(sets), len(items)), np.float32)
        flat, row = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(len(sets)), [*map(len, sets)])
        at = np.searchsorted(items, flat)
        hit = at < len(items)
        hit[hit] = items[at[hit]] == flat[hit]
        m[row[hit], at[hit]] = 1
        return m

    shared = (members(a) @ members(b).T).astype(np.float64)
    size, other = np.array([*map(len, a)], float)[:, None], np.array([*map(len, b)], float)[None, :]
    every = size + other - shared
    return np.where((size > 0) & (other > 0), 1 - shared / np.maximum(every, 1), 0.0).reshape(len(a), len(b))


def _words(x: Sequence[Sequence[int]]) -> np.ndarray:
    return np.array(list(x), np.int64).astype(np.uint32)


def _hamming(x: Sequence, q: Sequence) -> np.ndarray:
    return np.bitwise_count(_words(x)[:, None, :] ^ _words(q)[None, :, :]).sum(2).astype(np.float64)


def _bit_jaccard(x: Sequence, q: Sequence) -> np.ndarray:
    a, b = _words(x)[:, None, :], _words(q)[None, :, :]
    either = np.bitwise_count(a | b).sum(2).astype(np.float64)
    return np.where(either > 0, 1 - np.bitwise_count(a & b).sum(2) / np.maximum(either, 1), 0.0)


def _sparse(name: str) -> Callable:
    """A dense form over the dimensions that occur in either block."""

    def f(x: Sequence, q: Sequence, **params) -> np.ndarray:
        if len(x) > 1 and len(x) * sum(map(len, x)) > SPREAD:  # wide sets of dimensions: fewer objects at a time
            half = len(x) // 2
            return np.concatenate((f(x[:half], q, **params), f(x[half:], q, **params)))
        rows = [_pairs(v) for v in [*x, *q]]
        place = {d: i for i, d in enumerate(sorted({d for r in rows for d, _ in r}))}
        m = np.zeros((len(rows), max(1, len(place))))
        for i, r in enumerate(rows):
            for d, v in r:
                m[i, place[d]] = v
        return KERNELS[name](m[: len(x)], m[len(x) :], **params)

    return f


def _pairs(v: Sequence) -> list[tuple[int, float]]:
    return [(e["dim"], e["val"]) if isinstance(e, dict) else (e[0], e[1]) for e in v]


def _sparse_product(name: str) -> Callable:
    """Spaces of inner products: the dimensions of the smaller block make an inverted table, the others only enter the norms."""

    def f(x: Sequence, q: Sequence) -> np.ndarray:
        both = [[_pairs(v) for v in side] for side in (x, q)]
        small = min(both, key=lambda side: sum(map(len, side)))
        dims = np.unique(np.array([d for v in small for d, _ in v], np.int64))
        if len(x) > 1 and len(x) * len(dims) > SPREAD:  # fewer objects at a time
            half = len(x) // 2
            return np.concatenate((f(x[:half], q), f(x[half:], q)))
        tables, norms = [], []
        for side in both:
            row = np.repeat(np.arange(len(side)), [*map(len, side)])
            dim, val = np.array([d for v in side for d, _ in v], np.int64), np.array([w for v in side for _, w in v], np.float64)
            at = np.minimum(np.searchsorted(dims, dim), max(len(dims) - 1, 0))
            hit = dims[at] == dim if len(dims) else np.zeros(len(dim), bool)
            m = np.zeros((len(side), len(dims)))
            m[row[hit], at[hit]] = val[hit]
            tables.append(m)
            norms.append(np.bincount(row, val * val, minlength=len(side)))
        p, nx, nq = tables[0] @ tables[1].T, norms[0][:, None], norms[1][None, :]
        if name == "negdotprod":
            return -p
        if name == "querynorm_negdotprod":
            return -p / np.sqrt(np.maximum(nq, TINY))
        cosine = np.divide(p, np.sqrt(nx) * np.sqrt(nq), out=np.zeros_like(p), where=(nx >= TINY) & (nq >= TINY)).clip(-1, 1)
        return np.maximum(0, 1 - cosine) if name == "cosinesimil" else np.arccos(cosine)

    return f


KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "l1": lambda x, q: np.abs(x[:, None, :] - q[None, :, :]).sum(2),
    "l2": lambda x, q: np.sqrt(_squared(x, q)),
    "l2sqr": _squared,
    "linf": lambda x, q: np.abs(x[:, None, :] - q[None, :, :]).max(2),
    "lp": _lp,
    "l2sqr_sift": lambda x, q: np.square(x[:, None, :] - q[None, :, :]).sum(2),
    "cosinesimil": lambda x, q: np.maximum(0, 1 - _cosines(x, q)),
    "angulardist": lambda x, q: np.arccos(_cosines(x, q)),
    "negdotprod": lambda x, q: -_products(x, q),
    "querynorm_negdotprod": lambda x, q: -_products(x, q) / np.sqrt(np.maximum((q * q).sum(1), TINY))[None, :],
    "footrule": lambda x, q: np.abs(x[:, None, :] - q[None, :, :]).sum(2),
    "spearman_rho": lambda x, q: np.square(x[:, None, :] - q[None, :, :]).sum(2),
    "leven": _each(_leven),
    "normleven": _each(_norm_leven),
    "jaccard_sparse": _jaccard,
    "bit_hamming": _hamming,
    "bit_jaccard": _bit_jaccard,
    "renyidiv_slow": _renyi,
    "renyidiv_fast": _renyi,
    "abdiv_slow": _alpha_beta,
    "abdiv_fast": _alpha_beta,
}
for _name, _f in (("kldiv", _kl), ("kldivgen", _kl_general), ("itakurasaito", _itakura_saito)):
    KERNELS |= {_name + "fast": _f, _name + "slow": _f, _name + "fastrq": _swapped(_f)}
for _suffix in ("slow", "fast", "fastapprox"):
    KERNELS |= {"jsdiv" + _suffix: _js, "jsmetr" + _suffix: lambda x, q: np.sqrt(_js(x, q))}
for _base in ("l1", "l2", "linf", "lp"):
    KERNELS[_base + "_sparse"] = _sparse(_base)
for _base in ("cosinesimil", "angulardist", "negdotprod", "querynorm_negdotprod"):
    KERNELS |= {_base + s: _sparse_product(_base) for s in ("_sparse", "_sparse_fast", "_sparse_bin_fast")}


def kernel(name: str, x, q, **params) -> np.ndarray:
    """Distances of all objects x to all queries q."""
    if name not in KERNELS:
        raise ValueError(f"space {name!r} has no block form")
    return KERNELS[name](x, q, **params)


def is_matrix(name: str) -> bool:
    return space(name).kind in ("dense", "dense_uint8", "distribution", "rank")


def block(column, name: str):
    """An Arrow column of payloads as what ``kernel`` takes: a matrix, or an object array."""
    values = column.to_pylist()
    if is_matrix(name):
        return np.array(values, np.float64).reshape(len(values), -1)
    out = np.empty(len(values), object)
    out[:] = values
    return out
