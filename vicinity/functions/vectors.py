"""Helpers over vector payloads, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distances import NO_LOG, aligned, dot


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def normalized(v: Column) -> Column:
    """The vector at length 1; one without length stays as it is."""
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)), 1)


def first_elements(v: Column, n: int) -> Column:
    """The first ``n`` elements; fewer are an error."""
    return F.when(F.size(v) >= n, F.slice(v, 1, n)).otherwise(F.raise_error(F.lit(f"a vector has fewer than {n} elements")).cast("array<double>"))


def distribution(v: Column, least: float = 1e-3) -> Column:
    """A positive vector of sum 1 from any vector."""
    lifted = F.transform(v, lambda x: F.abs(x) + least)
    return F.element_at(F.transform(F.array(lifted), lambda z: F.transform(z, lambda x: x / F.aggregate(z, F.lit(0.0), lambda a, b: a + b))), 1)


def logs(v: Column) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, F.ln(x)).otherwise(F.lit(NO_LOG)))


def sparse(v: Column, above: float = 0.0) -> Column:
    """Entries of a dense vector whose size is above a bound, as (dim, val); dimensions count from 0."""
    return F.filter(F.transform(v, lambda x, i: F.struct(i.cast("int").alias("dim"), x.alias("val"))), lambda e: F.abs(e["val"]) > above)


def positive_set(v: Column) -> Column:
    return F.filter(F.transform(v, lambda x, i: F.when(x > 0, i.cast("int"))), lambda i: i.isNotNull())


def bit_words(v: Column, n: int) -> Column:
    """Bits of x > 0 packed into 32-bit words; bit i stands in word i div 32 at place i mod 32."""
    bit = lambda i: F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << (i % 32))).otherwise(F.lit(0)).cast("long")
    words = []
    for low in range(0, n, 32):
        total = F.lit(0).cast("long")
        for i in range(low, min(low + 32, n)):
            total = total + bit(i)
        words.append(F.when(total >= 1 << 31, total - (1 << 32)).otherwise(total).cast("int"))
    return F.array(*words)


def ranks(v: Column) -> Column:
    """The rank of each element, from 0; ties by place."""
    order = F.array_sort(F.transform(v, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    back = F.array_sort(F.transform(order, lambda e, r: F.struct(e["i"].alias("i"), r.alias("r"))))
    return F.transform(back, lambda e: e["r"].cast("double"))


def binarized(permutation: Column, threshold: int, n: int) -> Column:
    """Bits of rank >= threshold."""
    return bit_words(F.transform(permutation, lambda r: F.when(r >= threshold, F.lit(1.0)).otherwise(F.lit(0.0))), n)


def hash_trick(v: Column, size: int) -> Column:
    """A sparse vector summed into ``size`` places by its dimensions' remainders."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.aggregate(F.filter(v, lambda e: F.pmod(e["dim"], F.lit(size)) == k), F.lit(0.0), lambda a, e: a + e["val"].cast("double")))


def overlap(*dims: Column) -> Column:
    """The number of dimensions that all of the sets share."""
    both = dims[0]
    for d in dims[1:]:
        both = F.array_intersect(both, d)
    return F.size(both)


def _stats(values: Column, prefix: str) -> dict[str, Column]:
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    mean = F.when(n > 0, total / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))
    spread = F.element_at(F.transform(F.array(mean), lambda m: F.aggregate(values, F.lit(0.0), lambda a, b: a + (b - m) * (b - m))), 1)
    return {f"{prefix}_sum": total, f"{prefix}_mean": mean, f"{prefix}_std": F.when(n > 1, F.sqrt(spread / F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(0.0))}


def overlap_info(v: Column, q: Column) -> dict[str, Column]:
    """How two sparse vectors overlap: shared dimensions, normalised product, and sum, mean and sample deviation of the
    values inside and outside the overlap on either side."""
    dims = lambda s: F.transform(s, lambda e: e["dim"])
    value = lambda e: e["val"].cast("double")
    norm = lambda s: F.aggregate(s, F.lit(0.0), lambda a, e: a + value(e) * value(e))
    both = aligned(v, q)
    dots = F.aggregate(both, F.lit(0.0), lambda a, e: a + e["x"] * e["y"])
    size = F.sqrt(norm(v) * norm(q))
    out = {"overlap_qty": overlap(dims(v), dims(q)), "overlap_dotprod_norm": F.when(size > 0, dots / F.when(size > 0, size)).otherwise(F.lit(0.0))}
    for name, own, other in (("left", v, q), ("right", q, v)):
        inside = F.transform(_inside(own, dims(other), True), value)
        outside = F.transform(_inside(own, dims(other), False), value)
        out |= _stats(inside, f"overlap_{name}") | _stats(outside, f"diff_{name}")
    return out


def _inside(own: Column, dims: Column, wanted: bool) -> Column:
    return F.filter(own, lambda e: F.array_contains(dims, e["dim"]) == F.lit(wanted))


def mean_vector(df: DataFrame, vec: str, *by: str) -> DataFrame:
    """Mean of the vectors at each place (``pos`` from 0), for the whole table or each group."""
    return df.select(*by, F.posexplode(vec).alias("pos", "_x")).groupBy(*by, "pos").agg(F.avg("_x").alias("mean"))


def centered(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """Replaces the vectors by their difference from the mean vector, which is ``dim`` numbers."""
    means = df.agg(*(F.avg(F.get(F.col(vec), F.lit(i))).alias(f"m{i}") for i in range(dim))).select(F.array(*(f"m{i}" for i in range(dim))).alias("_mean"))
    return df.join(F.broadcast(means)).withColumn(vec, F.zip_with(vec, "_mean", lambda x, m: x - m)).drop("_mean")


def bregman_gradient(v: Column, kind: str) -> Column:
    """The gradient of the convex generator of a divergence, element by element."""
    return {"kl": F.transform(v, lambda x: F.ln(x) + 1), "itakurasaito": F.transform(v, lambda x: -1 / x)}[kind]


def bregman_inverse_gradient(v: Column, kind: str) -> Column:
    return {"kl": F.transform(v, lambda x: F.exp(x - 1)), "itakurasaito": F.transform(v, lambda x: -1 / x)}[kind]


def bregman_generator(v: Column, kind: str) -> Column:
    each = {"kl": lambda x: x * F.ln(x), "itakurasaito": lambda x: -F.ln(x)}[kind]
    return F.aggregate(F.transform(v, each), F.lit(0.0), lambda a, b: a + b)
