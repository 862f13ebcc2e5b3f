"""N-gram Jaccard join by chosen paths.

Documents are sets of shingles of five words. Equal sets become one representative. Representatives are split
recursively on sampled shared tokens: a path picks hash functions, and a set goes where its least token under them
leads, so two sets stay together with the probability of their similarity. Buckets of ``SMALL`` sets are compared
by brute force on signatures; larger ones are split again, to ``DEPTH`` tokens. Independent runs repeat this until
a pair at the threshold is met with the target recall; sets whose buckets were split deeper run on. Pairs that the buckets suggest make candidate groups; within
a candidate group every pair of sets is compared exactly, in square blocks that are dealt out separately, so a group
of any size has exact link counts, while no pair is ever a row. A shingle is 32 bits of its hash there: two sets of
a and b shingles count about a * b / 2^32 shared ones too many (below 0.0001 for texts of 600 words).

The result has one row for each document: its class (the least doc_id that it reaches over links) and the number of
other documents that it is linked to, copies counted.

Defined results: words are runs of ASCII letters and digits and anything outside ASCII, A-Z as small letters; a
text of one to four words is one shingle; a text without words (null or empty) is linked to nothing and is a class
of its own; a null doc_id is its own class unless linked; repeated rows are copies of each other; ties keep the
least doc_id; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import components, documents, durable, flat_bytes, forest, free, groups, mapped, mixed, slices, tidy, whole_text, word_hashes, written

WORDS = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.999
#: Minimum hashes of a set, each a sampled token.
TOKENS = 64
#: The same for sets that take a further turn: enough for all runs that paths of full depth ask for.
MORE_TOKENS = 128
SMALL = 48
DEPTH = 6
#: Signature agreement below which a pair in a bucket is not suggested: four standard deviations under the threshold.
SUGGEST = THRESHOLD - 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)
#: Sets of a block: a group of G sets is dealt out as G / BLOCK copies of each set, and a unit's matrices have BLOCK^2 numbers.
BLOCK = 2048
#: Row numbers that are broadcast, at most.
SENT = 1 << 20
SET_SCHEMA = "rid long, doc_id long, set_key binary, n_shingles int, signature binary, shingles binary"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD = mixed(np.arange(1, MORE_TOKENS + WORDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each text, sorted within the text, end to end; and the offsets of the texts."""
    data, offsets = flat_bytes(column)
    n = len(offsets) - 1
    data = _LOWER[data]
    word, row, _ = word_hashes(data, offsets, _INSIDE[data])
    count = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    made = np.maximum(count - (WORDS - 1), np.minimum(count, 1))
    start = np.repeat(first - np.concatenate(([0], np.cumsum(made)))[:-1], made) + np.arange(made.sum())
    size = np.repeat(np.minimum(count, WORDS), made)
    value = np.zeros(len(start), np.uint64)
    padded = np.append(word, np.zeros(WORDS, np.uint64))
    with np.errstate(over="ignore"):
        for j in range(WORDS):
            value += np.where(size > j, padded[start + j], np.uint64(0)) * _ODD[TOKENS + j]
        value = mixed(value + size.astype(np.uint64))
    of = np.repeat(np.arange(n), made)
    by = np.lexsort((value, of))
    value = value[by]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (of[1:] != of[:-1]))) if len(value) else np.zeros(0, bool)
    value, of = value[new], of[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n))))


def signatures(values: np.ndarray, offsets: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """The least hash of each set under each of ``tokens`` hash functions; empty sets have zeros."""
    out = np.zeros((len(offsets) - 1, tokens), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        with np.errstate(over="ignore"):
            for t in range(tokens):
                out[full, t] = np.minimum.reduceat((values * _ODD[t if t < TOKENS else t + WORDS]) >> np.uint64(32), offsets[full])
    return out


def set_table(docs: DataFrame, text: str = "text", kept: tuple[str, ...] = ()) -> DataFrame:
    """Sets and signatures of every document, written to the shared folder. ``rid`` numbers the rows."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "_text"):
                part = batch.slice(a, b - a)
                values, offsets = shingle_sets(part.column("_text"))
                signs = signatures(values, offsets)
                short = values.astype(np.uint32)
                keys, bodies = [], []
                for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    keys.append(hashlib.blake2b(values[i:j].tobytes(), digest_size=16).digest())
                    bodies.append(np.unique(short[i:j]).tobytes())
                sizes = [len(x) // 4 for x in bodies]
                own = [part.column("rid"), part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, *(part.column(c) for c in kept)], [*(x.split()[0] for x in SET_SCHEMA.split(", ")), *kept])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), whole_text(text).alias("_text"), *kept)
    more = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return written(mapped(rows, run, SET_SCHEMA + more), "sets")


def runs_for(recall: float, similarity: float = THRESHOLD, depth: int = 3) -> int:
    """Runs after which a pair of this similarity shared a bucket with at least this probability.

    A path of ``depth`` tokens keeps the pair with the similarity to that power; most buckets are small after one, and
    sets with deeper paths take further turns.
    """
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth)))


def missed(depth: int, similarity: float = THRESHOLD) -> float:
    """Logarithm of the probability that a pair is parted before its path has ``depth`` tokens."""
    return math.log(1 - similarity**depth)


def fresh_signatures(sets: DataFrame, turn: int) -> DataFrame:
    """Signatures (rid, signature) under hash functions that no other turn uses, from the shingles."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "shingles"):
                part = batch.slice(a, b - a)
                bodies = [np.frombuffer(x.as_py(), np.uint32) for x in part.column("shingles")]
                offsets = np.concatenate(([0], np.cumsum([*map(len, bodies)]))).astype(np.int64)
                with np.errstate(over="ignore"):
                    values = mixed(np.concatenate(bodies).astype(np.uint64) + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([part.column("rid"), pa.array([x.tobytes() for x in signatures(values, offsets, MORE_TOKENS)], pa.binary())], ["rid", "signature"])

    return mapped(sets.select("rid", "shingles"), run, "rid long, signature binary")


def chosen_paths(sets: DataFrame, runs: int, rows: int | None = None, small: int = SMALL, depth: int = DEPTH, turn: int = 0, tokens: int = TOKENS) -> tuple[DataFrame, DataFrame]:
    """Leaves of the recursive splits of all runs: ``leaf``, ``deep`` (it is still large) and ``rid``; no leaf has one set only.
    And the splits that each set went through: ``rid`` and ``more``, what each adds to the logarithm of missing a pair.

    Runs and depths use tokens of their own, so that runs are independent. Only paths and row numbers are dealt out;
    signatures are looked up again for the buckets that are split on. ``rows``: sets expected.
    """
    if runs * depth > tokens:
        raise ValueError("runs share tokens")
    most = None if rows is None else rows * runs
    token = lambda d: F.substring("signature", (F.col("run") * depth + (d - 1)) * 4 + 1, F.lit(4))
    begun = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    level = durable(sets.select("rid", "signature", begun).select("rid", "run", F.xxhash64("run", F.lit(8 + turn), token(1)).alias("path")), most)
    leaves = None
    splits = level.where("false").select("rid", F.lit(0.0).alias("more"))
    for d in range(1, depth + 1):
        sizes = durable(level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), rows)
        last = d == depth
        done = level.join(sizes if last else sizes.where(F.col("size") <= small), "path").select(F.col("path").alias("leaf"), (F.lit(last) & (F.col("size") > small)).alias("deep"), "rid")
        leaves = done if leaves is None else leaves.unionByName(done)
        large = sizes.where(F.col("size") > small)
        if last or large.isEmpty():
            break
        level = durable(level.join(large, "path").join(sets, "rid").select("rid", "run", F.xxhash64("path", token(d + 1)).alias("path")), most)
        splits = splits.unionByName(level.select("rid", F.lit(missed(d + 1) - missed(d)).alias("more")))
    return leaves, splits


def candidates(signed: DataFrame, shingles: DataFrame, recall: float, rows: int) -> DataFrame:
    """Links that span the similar sets of every leaf, over as many turns of runs as the depth of the paths asks for.

    A set whose paths were split often has a lower chance to meet its pairs; such sets take further turns among
    themselves, with fresh tokens, until each of them meets a pair at the threshold with the target recall. (A pair
    is safe as soon as one of its sets is, as both follow the same path for as long as they are together.)
    """
    goal = math.log(1 - recall)
    tokens, turn, sets, pairs = TOKENS, 0, signed, None
    runs = min(runs_for(recall), tokens // DEPTH)
    short = signed.select("rid", F.lit(0.0).alias("miss"))
    while True:
        leaves, splits = chosen_paths(sets, runs, rows, turn=turn, tokens=tokens)
        found = suggested(durable(leaves, rows * runs), sets)
        pairs = found if pairs is None else pairs.unionByName(found)
        more = splits.groupBy("rid").agg(F.sum("more").alias("more"))
        short = durable(short.join(more, "rid", "left").select("rid", (F.col("miss") + runs * missed(1) + F.coalesce("more", F.lit(0.0))).alias("miss")).where(F.col("miss") > goal), rows)
        rows = short.count()
        if not rows:
            return pairs.distinct() if turn else pairs
        tidy(signed.sparkSession)
        turn, tokens = turn + 1, MORE_TOKENS
        runs = tokens // DEPTH
        # a checked number of row numbers is broadcast, so that shingles stay where they are
        left = short.select("rid")
        sets = durable(fresh_signatures(shingles.join(F.broadcast(left) if rows <= SENT else left, "rid"), turn))


def suggested(leaves: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that span the similar sets of each leaf; sets that share a path of full depth are linked unseen."""

    def run(batches):
        for table in groups(batches, "leaf"):
            rid = table.column("rid").to_numpy()
            signs = np.frombuffer(b"".join(x.as_py() for x in table.column("signature")), np.uint32).reshape(len(rid), -1)
            near = (signs[:, None, :] == signs[None, :, :]).sum(2) >= SUGGEST * signs.shape[1]
            left, right = np.nonzero(np.triu(near, 1))
            root = forest(len(rid), left, right)
            own = np.flatnonzero(root != np.arange(len(rid)))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(rid[own]), pa.array(rid[root[own]])], ["a", "b"])

    seen = mapped(leaves.where("not deep").join(sets, "rid").select("leaf", "rid", "signature").repartition("leaf").sortWithinPartitions("leaf"), run, "a long, b long")
    deep = leaves.where("deep")
    unseen = deep.join(deep.groupBy("leaf").agg(F.min("rid").alias("b")), "leaf").select(F.col("rid").alias("a"), "b").where("a <> b")
    return seen.unionByName(unseen).distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Sizes of all intersections of two lists of distinct numbers, by products of membership matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    place_a, place_b = np.searchsorted(common, a), np.searchsorted(common, b)
    row_a, row_b = np.repeat(np.arange(len(left)), [*map(len, left)]), np.repeat(np.arange(len(right)), [*map(len, right)])
    hit_a = place_a < len(common)
    hit_a[hit_a] = common[place_a[hit_a]] == a[hit_a]
    hit_b = place_b < len(common)
    hit_b[hit_b] = common[place_b[hit_b]] == b[hit_b]
    place_a, row_a, place_b, row_b = place_a[hit_a], row_a[hit_a], place_b[hit_b], row_b[hit_b]
    for low in range(0, len(common), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        for m, place, row in ((x, place_a, row_a), (y, place_b, row_b)):
            here = (place >= low) & (place < low + width)
            m[row[here], place[here] - low] = 1
        out += x @ y.T
    return out


def exact_links(members: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Compares all sets of each ``unit`` (one block, or a block with another) exactly.

    Takes rows of unit, side (0, or 1 for the other block), rid, copies and shingles. Gives for each set and unit the
    documents that it is linked to and one set (``to``) that stands for its linked part of the unit.
    """

    def run(batches):
        for table in groups(batches, "unit"):
            side, rid, copies = (table.column(c).to_numpy() for c in ("side", "rid", "copies"))
            sets = [np.frombuffer(x.as_py(), np.uint32) for x in table.column("shingles")]
            size = np.array([*map(len, sets)], np.float32)
            first, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            own = not len(other)
            if own:
                other = first
            shared = shared_counts([sets[i] for i in first], [sets[i] for i in other])
            linked = shared >= threshold * (size[first][:, None] + size[other][None, :] - shared) - 1e-4
            if own:
                np.fill_diagonal(linked, False)
            links = np.zeros(len(rid), np.int64)
            links[first] += linked @ copies[other]
            if not own:
                links[other] += copies[first] @ linked
            i, j = np.nonzero(np.triu(linked) if own else linked)
            by = np.argsort(rid, kind="stable")
            place = np.empty(len(rid), np.int64)
            place[by] = np.arange(len(rid))
            root = by[forest(len(rid), place[first[i]], place[other[j]])]
            to = np.empty(len(rid), np.int64)
            to[by] = rid[root]
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(links[some]), pa.array(to[some])], ["rid", "links", "to"])

    return mapped(members.select("unit", "side", "rid", "copies", "shingles").repartition("unit").sortWithinPartitions("unit"), run, "rid long, links long, to long")


def in_units(grouped: DataFrame, block: int = BLOCK) -> DataFrame:
    """Deals the sets (rid, root) of candidate groups to units: one for a small group, each pair of blocks for a larger one."""
    sizes = grouped.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks >= 1")
    rows = grouped.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    with_block = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.xxhash64("root", F.least("block", k), F.greatest("block", k)).alias("unit"), (F.col("block") > k).cast("int").alias("side")))
    return rows.select("rid", F.explode(with_block).alias("_u")).select("rid", "_u.unit", "_u.side")


def classes(sets: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """For each row of a set table: its class and link count (``rid``, ``doc_id``, ``class_id``, ``n_links``, ``first`` of its class)."""
    by_set = sets.where("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct("rid")).alias("_least"), F.count("*").alias("copies")).select(F.col("_least.rid").alias("rid"), "set_key", "copies")
    n = sets.count()
    tidy(sets.sparkSession)
    reps = durable(by_set, n)
    full = sets.select("rid", "signature", "shingles")
    signed = full.select("rid", "signature").join(reps.select("rid"), "rid")
    pairs = candidates(signed, full, recall, n)
    tidy(sets.sparkSession)
    grouped = durable(components(pairs, rows=n).withColumnRenamed("node", "rid"), n)
    near = full.select("rid", "shingles").join(grouped.select("rid"), "rid").join(reps.select("rid", "copies"), "rid")
    found = durable(exact_links(in_units(grouped).join(near, "rid")))
    tidy(sets.sparkSession)
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("to").alias("b")), rows=n).withColumnRenamed("node", "rid")
    labelled = reps.join(counts, "rid", "left").join(roots, "rid", "left").select("set_key", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "rid").alias("root"))
    rows = sets.select("rid", "doc_id", F.when(F.col("n_shingles") > 0, F.col("set_key")).alias("set_key")).join(labelled, "set_key", "left").select("rid", "doc_id", F.coalesce("root", -1 - F.col("rid")).alias("root"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"))
    rows = durable(rows, n)
    least = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min_by("rid", F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("_first"))
    return rows.join(least, "root").select("rid", "doc_id", "class_id", "n_links", (F.col("rid") == F.col("_first")).alias("first"))


def near_duplicates(docs: DataFrame, text: str = "text", recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each document: doc_id, class_id and n_links."""
    return classes(set_table(docs, text), recall).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """The documents without near duplicates: of every class the one with the least doc_id stays, all columns as they are.

    Rows that are equal in all columns count as one document, without words too.
    """
    mark = F.struct(F.md5(whole_text().cast("binary")).alias("h"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("x")).alias("_mark")
    sets = set_table(docs.select("doc_id", "text", mark), kept=("_mark",))
    kept = classes(sets, recall).where("first").select("rid")
    marks = durable(sets.select("rid", "doc_id", "_mark").join(kept, "rid").select(F.col("doc_id").alias("_kept_id"), F.col("_mark.h").alias("_kept_h"), F.col("_mark.x").alias("_kept_x")))
    h, x = free(docs, "h", "x")
    rows = docs.withColumns({h: F.md5(whole_text().cast("binary")), x: F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))})
    out = rows.join(marks, F.col("doc_id").eqNullSafe(marks["_kept_id"]) & (rows[h] == marks["_kept_h"]) & (rows[x] == marks["_kept_x"]), "left_semi")
    if docs.count() != sets.select("doc_id", "_mark").distinct().count():
        out = out.dropDuplicates(["doc_id", h, x])
    return out.drop(h, x)


def op4_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {"op4_chosen_path_join": op4_chosen_path_join}
#: The same result from all pairs that share a shingle; links are closed to classes by recursion.
ORACLE_SQL = {
    "op4_chosen_path_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
sh AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
e AS (SELECT doc_id, len(s) AS n, md5_number(unnest(s)) AS g FROM sh),
m AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e SEMI JOIN m USING (g)),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce(x.least, d.doc_id)) AS class_id, coalesce(y.n, 0) AS n_links FROM documents d LEFT JOIN (SELECT a, min(b) AS least FROM r GROUP BY a) x ON x.a = d.doc_id LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) y ON y.a = d.doc_id
"""
}
