"""Distances as column expressions.

``distance(name, **params)`` gives a function of two payload columns, the object first and the query second; for
spaces that are not symmetric the order matters. Payloads are arrays of doubles (dense, distributions, ranks),
arrays of (dim, val) in order of dim (sparse), sorted arrays of numbers (sets), arrays of 32-bit words (bits),
strings, arrays of (centroid, weight) (signatures), or structs (fusion). Unknown names and parameters are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = Callable[[Column, Column], Column]
#: Twice the smallest normal float: squared norms below it count as zero.
TINY = 2 * 1.1754943508222875e-38
FLOOR = 1.1754943508222875e-38
#: Stands for the logarithm of what is not positive.
NO_LOG = -1e5


@dataclass(frozen=True)
class Space:
    """A named distance: its payload kind, parameters with defaults (None: required), and properties."""

    name: str
    kind: str
    build: Callable[..., Pair]
    params: dict[str, float | str | None] = field(default_factory=dict)
    integer: bool = False
    symmetric: bool = True
    metric: bool = False


SPACES: dict[str, Space] = {}


def register(name: str, kind: str, build: Callable[..., Pair], params: dict | None = None, **flags) -> None:
    """Adds a space; a user's own distance is added the same way."""
    SPACES[name] = Space(name, kind, build, params or {}, **flags)


def space(name: str) -> Space:
    if name not in SPACES:
        raise ValueError(f"unknown space {name!r}; known: {', '.join(sorted(SPACES))}")
    return SPACES[name]


def distance(name: str, **params) -> Pair:
    s = space(name)
    if unknown := set(params) - set(s.params):
        raise ValueError(f"space {name!r} has no parameters {sorted(unknown)}")
    given = {**s.params, **params}
    if missing := [k for k, v in given.items() if v is None]:
        raise ValueError(f"space {name!r} needs {missing}")
    return s.build(**given)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _sum(v: Column, q: Column, f: Pair) -> Column:
    return _total(F.zip_with(v, q, f))


def dot(v: Column, q: Column) -> Column:
    return _sum(v, q, lambda x, y: x * y)


def _log(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NO_LOG))


def _cosine(dots: Column, vv: Column, qq: Column) -> Column:
    """Cosine from products and squared norms, 0 for a vector without length, within [-1, 1]."""
    return F.when((vv < TINY) | (qq < TINY), F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dots / F.sqrt(F.greatest(vv, F.lit(TINY)) * F.greatest(qq, F.lit(TINY))))))


def cosine(v: Column, q: Column) -> Column:
    return _cosine(dot(v, q), dot(v, v), dot(q, q))


# dense


def _l1(v, q):
    return _sum(v, q, lambda x, y: F.abs(x - y))


def _l2_squared(v, q):
    return _sum(v, q, lambda x, y: (x - y) * (x - y))


def _linf(v, q):
    return F.coalesce(F.array_max(F.zip_with(v, q, lambda x, y: F.abs(x - y))), F.lit(0.0))


def _lp(p):
    p = float(p)
    if p == -1:
        return _linf
    if p <= 0:
        raise ValueError("p must be positive, or -1 for the maximum")
    if p == 1:
        return _l1
    if p == 2:
        return lambda v, q: F.sqrt(_l2_squared(v, q))
    return lambda v, q: F.pow(_sum(v, q, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p))


register("l1", "dense", lambda: _l1, metric=True)
register("l2", "dense", lambda: lambda v, q: F.sqrt(_l2_squared(v, q)), metric=True)
register("l2sqr", "dense", lambda: _l2_squared)
register("linf", "dense", lambda: _linf, metric=True)
register("lp", "dense", lambda p: _lp(p), {"p": None})
register("l2sqr_sift", "dense_uint8", lambda: lambda v, q: F.aggregate(F.zip_with(v, q, lambda x, y: ((x - y) * (x - y)).cast("int")), F.lit(0), lambda a, b: a + b), integer=True)
register("cosinesimil", "dense", lambda: lambda v, q: F.greatest(F.lit(0.0), 1 - cosine(v, q)))
register("angulardist", "dense", lambda: lambda v, q: F.acos(cosine(v, q)), metric=True)
register("negdotprod", "dense", lambda: lambda v, q: -dot(v, q))
register("querynorm_negdotprod", "dense", lambda: lambda v, q: -dot(v, q) / F.sqrt(F.greatest(dot(q, q), F.lit(TINY))), symmetric=False)


def _word(dist):
    if dist not in ("l2", "cosine"):
        raise ValueError("dist is l2 or cosine")
    return distance("l2" if dist == "l2" else "cosinesimil")


register("word_embed", "dense", lambda dist: _word(dist), {"dist": None})


# distributions: divergences with guarded logarithms


def _kl(v, q):
    return _sum(v, q, lambda x, y: x * (_log(x) - _log(y)))


def _kl_general(v, q):
    return _sum(v, q, lambda x, y: x * (_log(x) - _log(y)) + y - x)


def _itakura_saito(v, q):
    return _sum(v, q, lambda x, y: F.when(y != 0, x / F.when(y != 0, y)).otherwise(F.lit(0.0)) - (_log(x) - _log(y)) - 1)


def _swapped(f: Pair) -> Pair:
    return lambda v, q: f(q, v)


for _name, _f in (("kldiv", _kl), ("kldivgen", _kl_general), ("itakurasaito", _itakura_saito)):
    for _suffix, _g in (("fast", _f), ("slow", _f), ("fastrq", _swapped(_f))):
        register(_name + _suffix, "distribution", lambda g=_g: g, symmetric=False)


def _plogp(x: Column) -> Column:
    return F.when(x >= FLOOR, x * F.ln(F.greatest(x, F.lit(FLOOR)))).otherwise(F.lit(0.0))


def _js(v, q):
    half = _sum(v, q, lambda x, y: _plogp(x) + _plogp(y) - F.when(x + y >= FLOOR, (x + y) * F.ln(F.greatest((x + y) / 2, F.lit(FLOOR)))).otherwise(F.lit(0.0)))
    return F.greatest(F.lit(0.0), half / 2)


for _suffix in ("slow", "fast", "fastapprox"):
    register("jsdiv" + _suffix, "distribution", lambda: _js)
    register("jsmetr" + _suffix, "distribution", lambda: lambda v, q: F.sqrt(_js(v, q)), metric=True)


def _renyi(alpha):
    alpha = float(alpha)
    if alpha <= 0 or alpha == 1:
        raise ValueError("alpha must be positive and not 1")

    def f(v, q):
        inner = _sum(v, q, lambda x, y: F.when((x > 0) & (y > 0), x * F.pow(x / F.when(y > 0, y), F.lit(alpha - 1))).otherwise(F.lit(0.0)))
        return F.greatest(F.lit(0.0), _log(inner) / (alpha - 1))

    return f


def _alpha_beta(alpha, beta):
    return lambda v, q: _sum(v, q, lambda x, y: F.pow(x, F.lit(float(alpha) + 1)) * F.pow(y, F.lit(float(beta))))


def alpha_beta_proxy(alpha: float = 1, beta: float = 1) -> Pair:
    """The mean of both directions, a symmetric stand-in at indexing time."""
    f = _alpha_beta(alpha, beta)
    return lambda v, q: (f(v, q) + f(q, v)) / 2


for _suffix in ("slow", "fast"):
    register("renyidiv_" + _suffix, "distribution", lambda alpha: _renyi(alpha), {"alpha": 0.5}, symmetric=False)
    register("abdiv_" + _suffix, "distribution", lambda alpha, beta: _alpha_beta(alpha, beta), {"alpha": 1, "beta": 1}, symmetric=False)


# sparse vectors


def _by_dim(x: Column) -> Column:
    return F.map_from_arrays(F.transform(x, lambda e: e["dim"]), F.transform(x, lambda e: e["val"].cast("double")))


def aligned(v: Column, q: Column) -> Column:
    """Values of both vectors at the union of their dimensions, 0 where one has none."""
    return F.map_values(F.map_zip_with(_by_dim(v), _by_dim(q), lambda k, a, b: F.struct(F.coalesce(a, F.lit(0.0)).alias("x"), F.coalesce(b, F.lit(0.0)).alias("y"))))


def _sparse(f: Callable[[Column, Column], Column]) -> Pair:
    """A dense distance over the union of the dimensions."""

    def g(v, q):
        both = aligned(v, q)
        return F.element_at(F.transform(F.array(both), lambda z: f(F.transform(z, lambda e: e["x"]), F.transform(z, lambda e: e["y"]))), 1)

    return g


register("l1_sparse", "sparse", lambda: _sparse(_l1), metric=True)
register("l2_sparse", "sparse", lambda: _sparse(distance("l2")), metric=True)
register("linf_sparse", "sparse", lambda: _sparse(_linf), metric=True)
register("lp_sparse", "sparse", lambda p: _sparse(_lp(p)), {"p": None})
for _base in ("cosinesimil", "angulardist", "negdotprod", "querynorm_negdotprod"):
    for _suffix in ("_sparse", "_sparse_fast", "_sparse_bin_fast"):
        register(_base + _suffix, "sparse", lambda base=_base: _sparse(distance(base)), symmetric=_base[0] != "q")


# sets, bits, ranks


def _jaccard(v, q):
    both = F.size(F.array_intersect(v, q))
    every = F.size(F.array_distinct(v)) + F.size(F.array_distinct(q)) - both
    return F.when((F.size(v) == 0) | (F.size(q) == 0), F.lit(0.0)).otherwise(1 - both / F.greatest(every, F.lit(1)))


def _bits(v, q, f):
    # Spark counts the bits of a 32-bit word with its sign extended to 64
    return F.aggregate(F.zip_with(v, q, lambda x, y: F.bit_count(f(x, y).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit(0), lambda a, b: a + b)


def _bit_jaccard(v, q):
    either = _bits(v, q, lambda x, y: x.bitwiseOR(y))
    return F.when(either > 0, 1 - _bits(v, q, lambda x, y: x.bitwiseAND(y)) / F.greatest(either, F.lit(1))).otherwise(F.lit(0.0))


def _whole(f: Pair) -> Pair:
    return lambda v, q: f(v, q).cast("int")


register("jaccard_sparse", "set", lambda: _jaccard, metric=True)
register("bit_jaccard", "bits", lambda: _bit_jaccard, metric=True)
register("bit_hamming", "bits", lambda: lambda v, q: _bits(v, q, lambda x, y: x.bitwiseXOR(y)), integer=True, metric=True)
register("footrule", "rank", lambda: _whole(_l1), integer=True, metric=True)
register("spearman_rho", "rank", lambda: _whole(_l2_squared), integer=True)


# strings, by bytes


def _as_bytes(s: Column) -> Column:
    """One character for each byte of a string."""
    return F.decode(s.cast("binary"), "ISO-8859-1")


def _leven(v, q):
    return F.levenshtein(_as_bytes(v), _as_bytes(q))


def _norm_leven(v, q):
    longest = F.greatest(F.octet_length(v), F.octet_length(q))
    return F.when(longest > 0, _leven(v, q) / F.greatest(longest, F.lit(1))).otherwise(F.lit(0.0))


register("leven", "string", lambda: _leven, integer=True, metric=True)
register("normleven", "string", lambda: _norm_leven)
register("leven_char", "string", lambda: F.levenshtein, integer=True, metric=True)


# signatures and fusion


def _sqfd(similar: Callable[[Column], Column]) -> Pair:
    """The root of a quadratic form: weights of both signatures (the second one's negated), similarities of centroids."""

    def f(v, q):
        one = lambda s, sign: F.transform(s, lambda e: F.struct(e["centroid"].cast("array<double>").alias("c"), (e["weight"].cast("double") * sign).alias("w")))
        every = F.concat(one(v, 1.0), one(q, -1.0))
        rows = lambda z: _total(F.transform(z, lambda a: _total(F.transform(z, lambda b: a["w"] * b["w"] * similar(F.sqrt(_l2_squared(a["c"], b["c"])))))))
        return F.sqrt(F.greatest(F.lit(0.0), F.element_at(F.transform(F.array(every), rows), 1)))

    return f


register("sqfd_minus_func", "signature", lambda: _sqfd(lambda d: -d))
register("sqfd_heuristic_func", "signature", lambda alpha: _sqfd(lambda d: 1 / (float(alpha) + d)), {"alpha": None})
register("sqfd_gaussian_func", "signature", lambda alpha: _sqfd(lambda d: F.exp(-float(alpha) * d * d)), {"alpha": None})


def fusion(weights: dict[str, float], sparse: tuple[str, ...] = ()) -> Pair:
    """Negated weighted sum of the inner products of struct fields; weights that are not positive count as 0."""

    def f(v, q):
        total = F.lit(0.0)
        for part, w in weights.items():
            if w > FLOOR:
                inner = _sparse(dot)(v[part], q[part]) if part in sparse else dot(v[part], q[part])
                total = total + F.lit(float(w)) * inner
        return -total

    return f
