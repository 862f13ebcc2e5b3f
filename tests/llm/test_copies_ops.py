"""Repeated strings and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vicinity.llm import op3_repeats as op3
from vicinity.llm import op4_near_duplicates as op4
from vicinity.llm._common import components

from .conftest import texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_interval_expansion():
    r = random.Random(3)
    for _ in range(120):
        alphabet = r.choice([b"ab", b"abcdef", bytes(range(256))])
        base = [bytes(r.choice(alphabet) for _ in range(r.randint(1, 150))) for _ in range(4)]
        parts = [b"".join(r.choice(base)[r.randint(0, 20) :][: r.randint(1, 120)] for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))] + [b"a" * r.randint(0, 200)]
        parts, n = [x for x in parts if x], r.choice([15, 20, 33, 64])
        count = Counter(x[i : i + n] for x in parts for i in range(len(x) - n + 1))
        want = [i <= len(x) - n and count[x[i : i + n]] > 1 for x in parts for i in range(len(x))]
        got = op3.repeated_starts(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(x) for x in parts]), n)
        assert got.tolist() == want


def test_finer_buckets_change_nothing():
    r = random.Random(12)
    word = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    passage = word(90)
    parts = [word(r.randint(40, 120)) + passage[r.randint(0, 9) :] + word(r.randint(0, 90)) for _ in range(200)] + [b"ab" * 100, word(20)]
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    for chunk in (300, 5000):
        assert (op3.repeats_in(data, offsets, 64, chunk=chunk) == op3.repeated_starts(data, offsets[1:], 64)).all()


def contexts(parts, n, gram):
    """Distinct contexts of the buckets' runs of texts, end to end, their offsets, and which stand once."""
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    row, _, a, z, _ = op3.bucket_runs(data, offsets, n, gram)
    count = Counter(data[offsets[i] + x : offsets[i] + y + n].tobytes() for i, x, y in zip(row, a, z, strict=True))
    return np.frombuffer(b"".join(count), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in count]))), np.array([x == 1 for x in count.values()])


@pytest.mark.parametrize("chunk", [op3.CHUNK, 700])
def test_windows_left_out_do_not_repeat(chunk, monkeypatch):
    monkeypatch.setattr(op3, "CHUNK", chunk)
    r = random.Random(8)
    for _ in range(60):
        alphabet, n, gram = r.choice([b"ab", b"abcdefgh ", bytes(range(256))]), r.choice([33, 64, 91]), r.choice([8, 9, 16])
        word = lambda n: bytes(r.choice(alphabet) for _ in range(n))  # noqa: B023, E731
        base = [word(r.randint(20, 300)) for _ in range(4)] + [word(5) * 30]
        parts = [word(r.randint(0, 60)) + r.choice(base)[r.randint(0, 20) :][: r.randint(20, 300)] + word(r.randint(0, 60)) for _ in range(20)] + base[:2]
        data, offsets, once = contexts(parts, n, gram)
        if len(data):
            own = np.repeat(once, np.diff(offsets))
            assert (op3.repeats_of_once(data, offsets, once, n, gram) == op3.repeated_starts(data, offsets[1:], n))[own].all()


def test_windows_without_a_common_half_are_not_expanded(monkeypatch):
    r = random.Random(9)
    word = lambda n: bytes(r.randint(97, 122) for _ in range(n))
    seen, expand = [], op3.repeats_in
    monkeypatch.setattr(op3, "repeats_in", lambda data, *rest: seen.append(len(data)) or expand(data, *rest))
    short, long = word(210), word(420)
    for shared, most in ((short, 0), (long, 2 * 1200)):
        data, offsets, once = contexts([word(600) + shared + word(600) for _ in range(2)], op3.LENGTH, op3.GRAM)
        again = op3.repeats_of_once(data, offsets, once, op3.LENGTH, op3.GRAM)
        assert again.sum() == (0 if shared is short else 2 * 21)
        assert sum(seen) <= most


def removed(rows, n=op3.LENGTH):
    count = Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(hashlib.md5(b[i : i + n]).digest() for i in range(len(b) - n + 1))
    out = Counter()
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if count[hashlib.md5(b[i : i + n]).digest()] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        out[d, len(b), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()] += 1
    return out


def passages(rows, n=op3.PASSAGE):
    """Of each row: runs of words that a repeated string of n words covers, and their words."""
    count, out = Counter(), Counter()
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    for d, w in split:
        mask = np.zeros(len(w) + 1, int)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                mask[i : i + n] = 1
        out[d, int((np.diff(np.concatenate(([0], mask))) == 1).sum()), int(mask.sum())] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "docs", "hot"])
def test_repeats(which, request, monkeypatch):
    if which == "hot":
        monkeypatch.setattr(op3, "HOT", 500)
        monkeypatch.setattr(op3, "HOT_WINDOWS", 400)
    df = request.getfixturevalue("docs" if which == "hot" else which)
    got = op3.remove_repeats(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == removed(texts(df))
    assert Counter((r.doc_id, r.n_passages, r.passage_words) for r in got) == passages(texts(df))


def test_passages_below_the_byte_length(spark):
    r = random.Random(6)
    words = lambda n: [r.choice("abcdefghijklmnop") * r.randint(1, 5) + str(r.randint(0, 99)) for _ in range(n)]
    shared, short = words(55), words(50)
    rows = [(1, " ".join(words(80) + shared + words(9))), (2, "\n".join(shared + words(200))), (3, " ".join(words(60) + short)), (4, " ".join(short + words(70))), (5, " ".join(words(300)))]
    got = {x.doc_id: (x.n_passages, x.passage_words) for x in op3.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 55), 2: (1, 55), 3: (0, 0), 4: (0, 0), 5: (0, 0)}


def test_repeats_within_and_across(spark):
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, period = word(450), word(37)
    rows = [(1, word(200) + passage + word(90)), (2, passage + word(700)), (3, word(30) + passage[:399] + word(500)), (4, period * 30), (5, word(399)), (6, word(300) + passage[20:430] + "é" * 300), (7, "é" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op3.remove_repeats(df, with_bytes=True).collect()
    assert Counter((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == removed(rows)
    assert all(hashlib.sha256(x.kept).hexdigest() == x.kept_sha256 for x in got)


def test_repeats_of_nothing(none):
    assert op3.remove_repeats(none).count() == 0


def shingles(text):
    w = re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w)))))


def linked(rows):
    """Sorted (doc_id, class, links), from all pairs of rows."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, holders = Counter(), defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for i, b in enumerate(h) for a in h[:i])
    for (a, b), c in shared.items():
        if c >= 0.8 * (len(sets[a]) + len(sets[b]) - c):
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return Counter((d, min(ids[find(i)], default=None), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_near_duplicates(which, request):
    df = request.getfixturevalue(which)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in op4.near_duplicates(df).collect()) == linked(texts(df))


def test_large_group_in_blocks(spark, monkeypatch):
    """A group that is split on, dealt to blocks, and dense."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        words[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"{r.random()}" for _ in range(40))) for i in range(20)]
    monkeypatch.setattr(op4, "BLOCK", 32)
    monkeypatch.setattr(op4, "SMALL", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op4.classes(op4.set_table(df))
    assert Counter((x.doc_id, x.class_id, x.n_links) for x in got.collect()) == linked(rows)


def test_recall_of_pairs_in_a_crowd(spark):
    """Pairs of similarity 0.8 among texts that share half of their words: their buckets are split to the end."""
    r = random.Random(4)
    own = lambda n: [f"{r.getrandbits(48):x}" for _ in range(n)]
    shared, rows = own(49), []
    for i in range(800):
        a = shared + own(45)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(a[:-10] + own(10)))]
    got = op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(x.n_links == 0 for x in got) <= 0.003 * len(rows)


def test_units_of_blocks(spark):
    grouped = spark.createDataFrame([(i, 0) for i in range(100)], "rid long, root long")
    units = op4.in_units(grouped, 16).collect()
    met = defaultdict(lambda: ([], []))
    for u in units:
        met[u.unit][u.side].append(u.rid)
    pairs = Counter()
    for a, b in met.values():
        pairs.update(frozenset((x, y)) for i, x in enumerate(a) for y in (b or a[:i]))
    assert set(pairs.values()) == {1} and len(pairs) == 100 * 99 // 2


def test_one_of_each(odd, docs, none):
    for df in (odd, docs):
        kept, rows = op4.one_of_each(df), texts(df)
        assert kept.columns == df.columns
        classes = {c for _, c, _ in linked(rows) if c is not None}
        assert {r.doc_id for r in kept.collect()} - {None} == classes
    assert op4.one_of_each(none).count() == 0
    assert op4.near_duplicates(none).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(150)] + [(500, i) for i in range(501, 540)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_hubs_of_components(spark, monkeypatch):
    from vicinity.llm import _common

    monkeypatch.setattr(_common, "HUB", 3)
    r = random.Random(2)
    links = [(7, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(r.randint(300, 330), r.randint(300, 330)) for _ in range(40)] + [(159, 200)]
    got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
