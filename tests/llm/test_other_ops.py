"""Media, sharding, mixing, tokenisation, quality and the pipeline."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from vicinity.llm import op5_mixing as op5
from vicinity.llm import op6_media as op6
from vicinity.llm import op7_sharding as op7
from vicinity.llm import op9_sentencepiece as op9
from vicinity.llm import op10_quality as op10

from .conftest import texts


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    r = random.Random(1)
    keys = [r.getrandbits(64) for _ in range(500)] + [0, 1, (1 << 64) - 1]
    for n, got in zip((1, 24, 25, 1000), op7.jump_hash(np.array(keys, np.uint64), 1, 24, 25, 1000), strict=True):
        assert got.tolist() == [jump(k, n) for k in keys]


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_shards(which, request):
    df = request.getfixturevalue(which)
    got = op7.shard_documents(df).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts(df))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, op7.SHARDS)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


@pytest.mark.parametrize("n", [64, 1024, 1088, 64 * 33, 1 << 16])
def test_container_round_trip(n):
    data = os.urandom(n)
    media = op6.write_container(data)
    scan = op6.scan_container(media)
    assert scan.samples(media) == data
    assert (scan.codec, scan.handler, scan.duration) == ("raw ", "vide", n // 64 * op6.TICKS)
    for (a, b), k in zip(scan.key_ranges().tolist(), scan.keys.tolist(), strict=True):
        assert media[a:b] == data[64 * k : 64 * k + 64]
    for cut in range(0, len(media) - n, 37):
        assert op6.scan_container(media[:cut]).codec is None
    paths = [p for p, _, _ in op6.walk(media)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths


def test_variable_samples():
    """A track with sizes of its own, 32-bit offsets, two chunk runs and no table of key frames."""
    pack = op6.struct.pack
    sizes, chunks = [3, 5, 2, 4], [[0, 1], [2], [3]]
    head = op6.box(b"ftyp", b"isom")

    def movie(offsets):
        table = op6.box(b"stbl", op6.full(b"stsd", pack(">I", 1), op6.box(b"avc1", bytes(78))), op6.full(b"stsz", pack(">II4I", 0, 4, *sizes)), op6.full(b"stsc", pack(">I6I", 2, 1, 2, 1, 2, 1, 1)), op6.full(b"stco", pack(">I3I", 3, *offsets)), op6.full(b"stts", pack(">I2I", 1, 4, 10)))
        return op6.box(b"moov", op6.box(b"trak", op6.box(b"mdia", op6.full(b"mdhd", pack(">IIIII", 0, 0, 90, 0, 0)), op6.box(b"minf", table))))

    start = len(head) + len(movie([0, 0, 0])) + 8
    data = bytes(range(14))
    offsets = [start, start + 8, start + 10]
    media = head + movie(offsets) + op6.box(b"mdat", data)
    scan = op6.scan_container(media)
    assert (scan.codec, scan.timescale, scan.duration, scan.samples(media)) == ("avc1", 90, 40, data)
    assert scan.key_ranges().tolist() == [[start, start + 3], [start + 3, start + 8], [start + 8, start + 10], [start + 10, start + 14]]
    assert chunks


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_stored_texts(which, request):
    df = request.getfixturevalue(which)
    got = op6.store_texts(df).collect()
    pad = lambda b: b + bytes(-len(b) % 64 if b else 64)
    want = Counter((i, len(b), len(pad(b)), hashlib.sha256(pad(b)).hexdigest(), zlib.crc32(pad(b)[-64:])) for i, t in texts(df) for b in [(t or "").encode()])
    assert all(len(r.key_starts) == len(r.key_ends) > 0 and r.codec and r.n_samples >= len(r.key_starts) and all(a < z <= r.media_bytes for a, z in zip(r.key_starts, r.key_ends, strict=True)) for r in got)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want


def test_scanned_column(spark):
    media = op6.write_container(b"x" * 64)
    df = spark.createDataFrame([(1, bytearray(media)), (2, None), (3, bytearray(b"junk"))], "id long, m binary")
    assert [(r.id, r.codec, r.n_samples) for r in op6.scan_media(df, "m").orderBy("id").collect()] == [(1, "raw ", 1), (2, None, 0), (3, None, 0)]


@pytest.fixture(scope="module")
def tokenizers():
    path = op9.model_path()
    with open(path, "rb") as f:
        return op9.Tokenizer(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encodes_as_the_library(tokenizers):
    own, library = tokenizers
    r = random.Random(1)
    parts = ["the", "in", "er", " ", "  ", "a", "b", "th", "e", "▁", "ing", "é", "日", "\n", "0", "<", "t", "h", "<s>", "\x00"]
    cases = ["", " ", "  ", " a", "a ", "▁", "▁▁a ▁", "a\tb\nc", "日本語テスト", "😀 😀", "é" * 50, "the" * 400, " " * 3000, "a" * 5000, "</s> <unk> <0x0A>", "﻿x", "\x7f    z"]
    cases += ["".join(r.choice(parts) for _ in range(r.randint(1, 200))) for _ in range(1500)] + ["".join(r.choice(parts) for _ in range(3000)).replace(" ", "") for _ in range(3)]
    got = own.encode(cases)
    assert got == library.encode(cases, add_eos=True)
    assert [own.decode(x) for x in got] == [library.decode(x) for x in got]


def test_heap_agrees_with_rounds(tokenizers):
    own, _ = tokenizers
    words = ["▁internationalization", "▁thethethe", "▁" * 40, "▁aaaaaaaaaaaaab"]
    every, ends = own._rounds(words)
    assert [every[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [own._heap(w) for w in words]


@pytest.mark.parametrize("which", ["odd", "docs", "none"])
def test_encoded_texts(which, request, tokenizers):
    df, (_, library) = request.getfixturevalue(which), tokenizers
    got = op9.encode_texts(df.select("doc_id", "text")).collect()
    want = Counter()
    for i, t in texts(df):
        ids = library.encode(t or "", add_eos=True)
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert all(len(r["ids"]) == r.n_tokens for r in got)


def test_quality_on_held_out(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in op10.op10_quality_neighbours(spark, folder).collect()}
    rows = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(r.predicted, q) for r, q in rows if r.held_out]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def brute_score(model, counts):
    z = model.project(counts[None])[0].astype(np.float64)
    near = sorted(((float(np.float32(z.astype(np.float32) @ v)), -i) for i, v in enumerate(model.vectors)), reverse=True)[: op10.NEIGHBOURS]
    w = np.maximum([s for s, _ in near], 0) ** 8
    return (w * [model.labels[-i] for _, i in near]).sum() / w.sum()


def test_votes_against_brute_force(docs, labels):
    import pyarrow as pa

    model = op10.train(docs, labels)
    sample = [t for _, t in texts(docs)][:20]
    counts = op10.term_counts(pa.array(sample))
    assert model.score(counts) == pytest.approx([brute_score(model, c) for c in counts], abs=1e-3)


def test_quality_of_odd_rows(odd, none, labels):
    model = op10.train(odd, labels)
    got = op10.score_texts(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if not r.text]
    assert empty == [model.prior] * len(empty)
    assert op10.score_texts(none, op10.train(none, labels)).count() == 0
    assert op10.train(odd, labels.where("false")).prior == 0.5


def least_change(p, t, share):
    """Rates from 0 to 1 that meet the shares with the least change from 1, by bisection over one multiplier after another."""
    ratio = share / share[0]
    q = p[:, 1:] - p[:, :1] * ratio[1:]
    at = np.zeros(q.shape[1])
    for _ in range(200):
        for d in range(len(at)):
            low, high = -50.0, 50.0
            for _ in range(60):
                at[d] = (low + high) / 2
                low, high = (at[d], high) if (np.clip(1 - q @ at, 0, 1) * t) @ q[:, d] > 0 else (low, at[d])
    return np.clip(1 - q @ at, 0, 1)


def test_mixing_meets_targets(docs, labels):
    rows = op5.with_posteriors(docs.select("doc_id", "text"), op5.train(docs, labels)).cache()
    p, t = np.array([r._posterior for r in rows.collect()]), np.array([r._tokens for r in rows.collect()])
    whole = t @ p / (t @ p).sum()
    for part in ((0.5, 0.4), (0.2, 0.9)):
        share = np.array([0, whole[1] * part[0], whole[2] * part[1]])
        share[0] = 1 - share.sum()
        targets = dict(zip(op5.DOMAINS, share.tolist(), strict=True))
        plan = op5.solve(rows, targets)
        rate, best = plan.rates(p), least_change(p, t, share)
        assert (rate >= 0).all() and (rate <= 1).all() and len(plan.steps) < op5.STEPS
        got = (rate * t) @ p
        assert got / got.sum() == pytest.approx(share, rel=0.005)
        assert t @ (rate - 1) ** 2 <= 1.1 * (t @ (best - 1) ** 2) + 1e-6
        said = {r.domain: r for r in op5.report(op5.with_rates(rows, plan), targets).collect()}
        assert all(abs(r.gap) < 0.005 for r in said.values())


def test_targets_out_of_reach(docs, labels):
    rows = op5.with_posteriors(docs.select("doc_id", "text"), op5.train(docs, labels)).cache()
    targets = {"clean": 0.2, "toxic": 0.0, "poor": 0.8}
    said = {r.domain: r for r in op5.report(op5.with_rates(rows, op5.solve(rows, targets)), targets).collect()}
    assert said["poor"].gap < -0.5 and said["clean"].gap > 1
    mixed = {"clean": 0.3, "toxic": 0.002, "poor": 0.698}  # one domain in reach, one not
    plan = op5.solve(rows, mixed)
    said = {r.domain: r for r in op5.report(op5.with_rates(rows, plan), mixed).collect()}
    assert len(plan.steps) < 8 and said["toxic"].tokens / said["clean"].tokens == pytest.approx(0.002 / 0.3, rel=0.005) and said["poor"].gap < 0
    plan = op5.solve(rows, targets, most=1e6)
    said = {r.domain: r for r in op5.report(op5.with_rates(rows, plan), targets).collect()}
    assert abs(said["poor"].gap) < 0.01 and abs(said["clean"].gap) < 0.01


def test_rates_are_realised(docs, labels):
    targets = {"clean": 0.5, "toxic": 0.0, "poor": 0.5}
    got = op5.mixed_documents(docs, labels, targets, most=50.0)
    once = op5.mixed_documents(docs, labels, targets)
    assert got.columns == docs.columns and got.count() > docs.count() > once.count()
    assert once.count() == once.select("doc_id").distinct().count()


def test_mixing_keeps_clean_and_drops_toxic(spark, small):
    folder = small.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r.kept for r in op5.op5_mixing_rates(spark, folder).collect()}
    marks = spark.read.parquet(f"{folder}/labels.parquet").collect()
    clean = [got[r.doc_id] for r in marks if r.quality == 1 and r.toxic == 0]
    toxic = [got[r.doc_id] for r in marks if r.toxic == 1]
    assert np.mean(clean) >= 0.97 and np.mean(toxic) <= 0.2


def test_mixing_of_odd_rows(odd, none, labels):
    got = op5.mixed_documents(odd, labels)
    assert got.columns == odd.columns and got.count() <= odd.count()
    assert op5.mixed_documents(none, labels).count() == 0
    even = op5.train(odd, labels.where("false"))
    assert all(r._posterior == pytest.approx([1 / 3] * 3) for r in op5.with_posteriors(odd, even).collect())


def test_pipeline(spark, small, docs):
    kept, counts = docs, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, small)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert tuple(kept.columns) == corpus_pipeline.COLUMNS
            kept = kept.cache()
        counts.append(kept.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] >= counts[4] == counts[5] > 0
    run = corpus_pipeline.run(spark, small)
    assert Counter((r.doc_id, r.ids_sha256) for r in run.collect()) == Counter((r.doc_id, r.ids_sha256) for r in kept.collect())
    original = dict(texts(docs))
    assert run.where(F.col("doc_id").isin([i for i, t in original.items() if t])).count() == counts[5]


def test_pipeline_of_odd_rows(spark, small, odd, none):
    from vicinity.llm._common import tables_so_far

    for df in (odd, none):
        docs = df
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, small)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        rows = docs.collect()
        assert len(rows) <= df.count()
        assert all(r.n_tokens >= 1 for r in rows)
    before = tables_so_far()
    assert corpus_pipeline.run(spark, small).count() > 0
    assert tables_so_far() == before + 1
