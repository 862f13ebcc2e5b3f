"""Mixing sources to target weights with soft memberships.

A classifier learns domains from a labelled table and gives every document a posterior over them. Each document
gets a rate from 0 to ``most`` such that the expected tokens of each domain (rate x tokens x posterior, summed) meet
the domain's target: least squares over the relative gaps of the domains, solved by projected gradient steps from rate
1, so that rates move no further than the targets ask. The problem has one unknown for each document, but a step
depends on the few domain totals and their second moments alone: a step is one distributed sum over the narrow table
of tokens and posteriors, scaled by the moments of the rows that are free to move, so that a few steps do; a
document's rate is the replay of these steps, and the driver holds a few numbers for each step, whatever the corpus.

The labelled table here is ``labels``: a document is ``toxic``, else ``clean`` or ``poor`` by its quality. Targets
are shares of the kept tokens. Clean documents stay whole: the other domains are fitted to the clean tokens. Rates
are 1 at most where documents are kept or dropped; a domain that is below its target even whole stays whole, and
``report`` states what each domain got. With a larger ``most`` such a domain's documents are repeated.

Defined results: a text without words has no tokens and gets the rate that its posterior gives; null labels are not
learnt; an id labelled more than once takes its worst domain; without labels all domains are equally likely;
repeated rows get equal rates; a null doc_id is kept or dropped like any (all null ids alike); extra columns stay in ``mixed_documents``;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, durable, flat_bytes, free, mapped, slices, tidy, whole_text, word_hashes, written
from .op10_quality import BLANK, CLASSES, N_CLASSES

DOMAINS = ("clean", "toxic", "poor")
TARGETS = {"clean": 0.97, "toxic": 0.01, "poor": 0.02}
#: Labelled documents that the classifier learns from, at most: those of the smallest hash of their id.
SAMPLE = 6144
#: Words that the classifier looks at: those that tell most about the domain in the sample.
VOCABULARY = 768
#: Steps at most, and the relative gap of a domain's tokens to their target that ends them.
STEPS = 24
CLOSE = 1e-3
L2 = 1e-4
_LETTER = (CLASSES == 1) | (CLASSES == 2) | (CLASSES == 3) | (CLASSES == 4)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHAPE = N_CLASSES + 1


def word_table(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a text column with their rows; the tokens of each row; and each row's shape: log shares of
    character classes and of words that repeat the one before."""
    data, offsets = flat_bytes(column)
    n = len(offsets) - 1
    classes = CLASSES[data]
    row = np.repeat(np.arange(n) * N_CLASSES, np.diff(offsets))
    shape = np.zeros((n, SHAPE), np.float32)
    shape[:, :N_CLASSES] = np.bincount(row + classes, minlength=n * N_CLASSES).reshape(n, N_CLASSES) / np.maximum(np.diff(offsets), 1)[:, None]
    word, of, _ = word_hashes(_LOWER[data], offsets, _LETTER[data])
    again = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    count = np.bincount(of, minlength=n)
    shape[:, N_CLASSES] = np.bincount(of[1:][again], minlength=n) / np.maximum(count, 1)
    blank = BLANK[data]
    starts = ~blank
    starts[1:] &= blank[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = ~blank[first]
    tokens = np.bincount(np.searchsorted(offsets, np.flatnonzero(starts), "right") - 1, minlength=n)
    return word, of, tokens, np.log1p(shape * 100)


@dataclass
class Domains:
    """A multinomial logistic model over the presence of chosen words and a text's shape."""

    words: np.ndarray
    weights: np.ndarray

    def design(self, word: np.ndarray, of: np.ndarray, shape: np.ndarray) -> np.ndarray:
        x = np.ones((len(shape), len(self.words) + SHAPE + 1), np.float32)
        x[:, len(self.words) : -1] = shape
        x[:, : len(self.words)] = 0
        if len(self.words) and len(word):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            hit = self.words[at] == word
            x[of[hit], at[hit]] = 1
        return x

    def posterior(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights
        e = np.exp(z - z.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True)).astype(np.float64)


def _told(present: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Mutual information of each word's presence with the domain."""
    n, out = len(labels), np.zeros(present.shape[1])
    for side in (present, ~present):
        p_side = side.mean(0)
        for d in range(k):
            joint, p_d = side[labels == d].sum(0) / n, (labels == d).mean()
            with np.errstate(divide="ignore", invalid="ignore"):
                out += np.where(joint > 0, joint * np.log(joint / (p_side * p_d)), 0)
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, k: int = len(DOMAINS), steps: int = 600) -> Domains:
    """Fits on (distinct word hashes, shape) of each labelled document."""
    if not len(labels):
        return Domains(np.zeros(0, np.uint64), np.zeros((SHAPE + 1, k), np.float32))
    word = np.concatenate([w for w, _ in rows])
    of = np.repeat(np.arange(len(rows)), [len(w) for w, _ in rows])
    known, count = np.unique(word, return_counts=True)
    known = known[count >= max(3, len(rows) // 1000)]
    told = np.zeros(len(known))
    for low in range(0, len(known), 512):
        part = known[low : low + 512]
        at = np.minimum(np.searchsorted(part, word), len(part) - 1)
        hit = part[at] == word
        present = np.zeros((len(rows), len(part)), bool)
        present[of[hit], at[hit]] = True
        told[low : low + 512] = _told(present, labels, k)
    model = Domains(np.sort(known[np.argsort(-told, kind="stable")[:VOCABULARY]]), np.zeros((0, k), np.float32))
    x = model.design(word, of, np.stack([s for _, s in rows]))
    y = np.eye(k, dtype=np.float32)[labels]
    scale = np.maximum(x.std(0), 0.05)
    scale[-1] = 1
    x /= scale
    w, speed = np.zeros((x.shape[1], k), np.float32), np.zeros((x.shape[1], k), np.float32)
    top = x[0] / np.linalg.norm(x[0])
    for _ in range(12):  # largest curvature, by power iteration
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top)
    rate = 1.8 / (float(np.linalg.norm(x @ top) ** 2) / len(x) * 0.5 + 1e-3)
    for _ in range(steps):
        ahead = w + 0.9 * speed
        z = x @ ahead
        e = np.exp(z - z.max(1, keepdims=True))
        speed = 0.9 * speed - 0.5 * rate * (x.T @ (e / e.sum(1, keepdims=True) - y) / len(x) + L2 * ahead)
        w = w + speed
    model.weights = (w / scale[:, None]).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Domains:
    """Fits the domains of ``labels`` on ``size`` documents at most; the driver gets their distinct words and shapes."""
    domain = F.when(F.col("toxic") == 1, DOMAINS.index("toxic")).when(F.col("quality") == 1, DOMAINS.index("clean")).otherwise(DOMAINS.index("poor"))
    pick = F.xxhash64("doc_id", F.lit(5))
    known = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = known.groupBy("doc_id").agg(F.max(F.when(domain == 1, 2).when(domain == 2, 1).otherwise(0)).alias("worst")).orderBy(pick, "doc_id").limit(size)
    chosen = chosen.select("doc_id", F.when(F.col("worst") == 2, 1).when(F.col("worst") == 1, 2).otherwise(0).alias("_domain"))
    rows = docs.select("doc_id", whole_text().alias("_text")).join(F.broadcast(chosen), "doc_id").orderBy(pick, "doc_id", F.xxhash64("_text")).limit(size)

    def count(batches):
        for batch in batches:
            for a, b in slices(batch, "_text"):
                part = batch.slice(a, b - a)
                word, of, _, shape = word_table(part.column("_text"))
                cut = np.searchsorted(of, np.arange(len(shape) + 1))
                yield pa.RecordBatch.from_arrays([part.column("_domain"), pa.array([np.unique(word[i:j]).tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary())], ["domain", "words", "shape"])

    got = mapped(rows.select("_domain", "_text"), count, "domain int, words binary, shape binary").toArrow()
    pairs = [(np.frombuffer(w.as_py(), np.uint64), np.frombuffer(s.as_py(), np.float32)) for w, s in zip(got.column("words"), got.column("shape"), strict=True)]
    domains = got.column("domain").to_numpy()
    model = fit(pairs, domains)
    del pairs, got
    tidy(docs.sparkSession)
    return model


def with_posteriors(df: DataFrame, model: Domains, text: str = "text") -> DataFrame:
    """Adds ``_tokens`` and ``_posterior`` (an array in the order of ``DOMAINS``); all columns stay."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("_tokens", "_posterior", "_whole")]

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "_whole"):
                part = batch.slice(a, b - a)
                word, of, tokens, shape = word_table(part.column("_whole"))
                p = sent.value.posterior(sent.value.design(word, of, shape))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(tokens, pa.int64()), pa.array(list(p), pa.list_(pa.float64()))], [*kept, "_tokens", "_posterior"])

    own = df.select(*(F.col(f"`{c}`") for c in kept))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields)
    return mapped(df.select(*(F.col(f"`{c}`") for c in kept), whole_text(text).alias("_whole")), run, f"{fields}_tokens long, _posterior array<double>")


@dataclass
class Plan:
    """What each step takes off a rate for one unit of posterior; replaying the steps gives a document's rate."""

    most: float
    steps: list[np.ndarray]

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        r = np.ones(len(posterior))
        for g in self.steps:
            r = np.clip(r - posterior @ g, 0, self.most)
        return r


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _totals(rows: DataFrame, plan: Plan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At the plan's rates: expected tokens of each domain, and second moments of the posteriors (tokens x posterior x
    posterior) over rows whose rate is not 0. A few numbers for each task, summed."""

    def run(batches):
        total, moments = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                p, t = _matrix(batch.column("_posterior")), batch.column("_tokens").to_numpy()
                r = plan.rates(p)
                total += (r * t) @ p
                moments += p.T @ (p * (t * (r > 0))[:, None])
        flat = np.concatenate((total, moments.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "total"])

    sums = mapped(rows.select("_tokens", "_posterior"), run, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    found = {r["at"]: r["total"] for r in sums.collect()}
    flat = np.array([found.get(i, 0.0) for i in range(k + k * k)])
    return flat[:k], flat[k:].reshape(k, k)


def _shares(targets: dict[str, float] | None, domains: tuple[str, ...]) -> np.ndarray:
    share = np.array([(targets or TARGETS)[d] for d in domains], float)
    if (share < 0).any() or not share.sum():
        raise ValueError("targets are nonnegative shares")
    return share / share.sum()


def solve(rows: DataFrame, targets: dict[str, float] | None = None, domains: tuple[str, ...] = DOMAINS, whole: str = DOMAINS[0], most: float = 1.0) -> Plan:
    """Projected gradient steps until every domain is within ``CLOSE`` of its target or cannot come nearer.

    A domain's target is its share over that of the ``whole`` domain, times that domain's tokens.
    """
    share, w = _shares(targets, domains), domains.index(whole)
    if not share[w]:
        raise ValueError(f"domain {whole!r} is to stay whole and needs a share")
    if most < 1:
        raise ValueError("rates start at 1")
    others = [i for i in range(len(domains)) if i != w]
    ratio = share / share[w]
    plan, before, taken = Plan(float(most), []), None, np.zeros(len(domains))
    while len(plan.steps) < STEPS:
        now, moments = _totals(rows, plan, len(domains))
        gap = now - ratio * now[w]
        # where rates are 1 at most, a domain below its target is left alone: all that was taken off it can come back, no more
        active = [i for i in others if most > 1 or gap[i] > 0 or taken[i] > 0]
        if not now.sum() or (np.abs(gap[active]) <= CLOSE * ratio[active] * now[w]).all() or before is not None and np.abs(now - before).max() <= 1e-9 * now.sum():
            break
        # the gaps' change for one unit off the rates along each domain's posterior, over the rows that can move
        slope = (moments - ratio[:, None] * moments[w][None, :])[np.ix_(active, active)]
        ridge = 1e-9 * max(float(np.trace(np.abs(slope))), 1e-30)
        step = np.zeros(len(domains))
        step[active] = np.clip(np.linalg.solve(slope + ridge * np.eye(len(active)), gap[active]), -most, most)
        if most <= 1:
            step = np.maximum(step, -taken)
        plan.steps.append(step)
        taken += step
        before = now
    return plan


def report(rated: DataFrame, targets: dict[str, float] | None = None, domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """One row for each domain: its target share, its expected tokens at the rates, their share, and the relative gap.

    Takes rows with ``_tokens``, ``_posterior`` and ``_rate``; a table without tokens has shares of null.
    """
    share = _shares(targets, domains)
    sums = [F.coalesce(F.sum(F.col("_rate") * F.col("_tokens") * F.col("_posterior")[i]), F.lit(0.0)).alias(f"_s{i}") for i in range(len(domains))]
    total = sum((F.col(f"_s{i}") for i in range(1, len(domains))), F.col("_s0"))
    cells = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(float(share[i])).alias("target"), F.col(f"_s{i}").alias("tokens"), F.when(total > 0, F.col(f"_s{i}") / total).alias("share")) for i, d in enumerate(domains)))
    out = rated.agg(*sums).select(F.explode(cells).alias("_c")).select("_c.*")
    return out.withColumn("gap", F.when(F.col("target") > 0, F.col("share") / F.col("target") - 1))


def with_rates(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds ``_rate`` to rows with posteriors."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            p = _matrix(batch.column("_posterior")) if batch.num_rows else np.zeros((0, len(DOMAINS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(plan.rates(p))], [*names, "_rate"])

    return mapped(rows, run, "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields) + "_rate double")


def chance(*key: str) -> Column:
    """A number from 0 to 1 that follows from the key."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit("mix")), 11) / F.lit(float(1 << 53))


def copies(rate: Column, *key: str) -> Column:
    """How often a document of this rate is kept: the whole part of it, and once more with its fraction as chance."""
    return (F.floor(rate) + (chance(*key) < rate - F.floor(rate)).cast("int")).cast("int")


def mixed_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = 1.0) -> DataFrame:
    """Keeps each document as often as its rate says, decided by a hash of its id; columns stay.

    Documents and posteriors are written once to the shared folder, so texts are read for words once: the steps read
    the narrow columns of that table, and the result its rows.
    """
    inner = {c: name for c, name in zip(docs.columns, free(docs, *(f"own{i}" for i in range(len(docs.columns)))), strict=True)}
    model = train(docs, labels)
    rows = written(with_posteriors(docs.withColumnsRenamed(inner), model, inner["text"]), "posteriors")
    times = copies(F.col("_rate"), inner["doc_id"])
    kept = with_rates(rows, solve(rows, targets, most=most)).withColumn("_times", times).where("_times > 0")
    if most > 1:
        kept = kept.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times"))))
    return kept.select(*(F.col(f"`{name}`").alias(c) for c, name in inner.items()))


def op5_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = durable(with_posteriors(docs.select("doc_id", F.col("text").alias("_of")), model, "_of").drop("_of"))
    rated = with_rates(rows, solve(rows))
    return rated.select("doc_id", F.col("_tokens").alias("tokens"), *(F.col("_posterior")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), F.col("_rate").alias("rate"), copies(F.col("_rate"), "doc_id").alias("kept"))


QUERIES = {"op5_mixing_rates": op5_mixing_rates}
ORACLE_SQL: dict[str, str] = {}
