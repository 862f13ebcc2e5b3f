"""SentencePiece encoding and decoding by vectorised merge rounds.

A model of the library's BPE kind is read from its protocol buffer. Text becomes words (no piece of such a model
has a space mark after another symbol, so merges never cross from one word into the next); the distinct words
of a slice become one flat numpy array of symbols. Each round looks up the rank of every adjacent pair, takes
the minimum of each word by a segmented reduction, merges the leftmost pairs of that rank at once, and compacts
the array, until no pair remains. All places of a pair merge in the same round only where no piece that a merge
could newly offer ranks better than the pair itself; else the leftmost one merges alone, as the library's agenda
would do. Words above ``LONG_WORD`` symbols, for which rounds would take quadratic time, run the same merges from
a heap.

Defined results: a null or empty text is the end id alone and decodes to an empty text; characters outside the
vocabulary become byte pieces, or the unknown id where the model has none; repeated rows give equal values; extra
columns are kept by ``encode_texts`` and an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, mapped, slices, whole_text

MODEL = "piece_bpe_32k.model"
MARK = "▁"
LONG_WORD = 1024
#: Distinct words that a worker remembers, about; when there are more, only those of a few symbols stay.
MEMORY = 150_000
COMMON = 7
NONE = np.iinfo(np.int32).max
#: Piece types, fixed by the model format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        kind = key & 7
        if kind == 0:
            value, at = number(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = number(at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Tokenizer:
    """Encodes and decodes with a BPE model given as bytes."""

    def __init__(self, model: bytes):
        parts = list(_fields(model))
        pieces = [dict(_fields(value)) for n, value in parts if n == 1]
        trainer = dict(_fields(next((v for n, v in parts if n == 2), b"")))
        normal = dict(_fields(next((v for n, v in parts if n == 3), b"")))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model is not of the BPE kind")
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or trainer.get(24, 0):
            raise ValueError("the model normalises text in a way that is not supported")
        self.texts = [p[1].decode() for p in pieces]
        kinds = [p.get(3, NORMAL) for p in pieces]
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        scores = [struct.unpack("<f", p[2])[0] if 2 in p else 0.0 for p in pieces]
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, kinds, strict=True)) if k == NORMAL}
        self.unknown = kinds.index(UNKNOWN)
        self.end = trainer.get(42, 2)
        self.bytes = [self.texts.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in kinds and trainer.get(35, 0) else None
        surface = {UNKNOWN: b" \xe2\x81\x87 ", CONTROL: b""}
        self.surfaces = [bytes([int(t[3:5], 16)]) if k == BYTE else surface.get(k, t.replace(MARK, " ").encode()) for t, k in zip(self.texts, kinds, strict=True)]
        if any(MARK in t.lstrip(MARK) for t in self.ids):
            raise ValueError("a piece spans words")
        self.decimal = [str(i) for i in range(len(pieces))]
        self._tables(scores)
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, int] | None = None

    def _tables(self, scores: list[float]) -> None:
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        rank = {i: order[scores[i]] for i in self.ids.values()}
        size = len(self.texts)
        shared = len(self.ids) > len(order)
        alone = np.ones(size, bool)
        if shared:
            seen: dict[int, int] = {}
            for i, r in rank.items():
                if r in seen:
                    alone[[i, seen[r]]] = False
                seen[r] = i
        keys, made = [], []
        for text, i in self.ids.items():
            for cut in range(1, len(text)):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                for part in (a, b):
                    if part is not None and rank[i] <= rank[part]:
                        alone[part] = False
                if a is not None and b is not None:
                    keys.append(a * size + b)
                    made.append(i)
        self._spread(np.array(keys, np.int64), np.array(made, np.int32))
        self.rank = np.full(size, NONE, np.int32)
        self.rank[list(rank)] = list(rank.values())
        self.together = alone
        self.chars = {t: i for t, i in self.ids.items() if len(t) == 1}
        #: Symbol of each code point: its piece, or -1 - code point.
        self.points = -1 - np.arange(0x110000, dtype=np.int64)
        self.points[[*map(ord, self.chars)]] = list(self.chars.values())

    def _spread(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Deals the pairs to an open hash table: each takes the first free place from its own on."""
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.place_key, self.place_made, self.probes = np.full(size, -2, np.int64), np.full(size, -1, np.int32), 0
        while len(keys):
            at = (self._home(keys) + self.probes) & (size - 1)
            free = self.place_key[at] == -2
            first = np.unique(np.where(free, at, -1), return_index=True)
            take = first[1][first[0] >= 0]
            self.place_key[at[take]], self.place_made[at[take]] = keys[take], made[take]
            left = np.ones(len(keys), bool)
            left[take] = False
            keys, made, self.probes = keys[left], made[left], self.probes + 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Pieces that adjacent symbols form, -1 for none."""
        made = np.full(len(left), -1, np.int32)
        ask = np.flatnonzero(inside & (left >= 0) & (right >= 0))
        key = left[ask] * len(self.texts) + right[ask]
        at = self._home(key)
        for _ in range(self.probes):
            held = self.place_key[at]
            hit = held == key
            made[ask[hit]] = self.place_made[at[hit]]
            on = ~hit & (held != -2)
            if not on.any():
                break
            ask, key, at = ask[on], key[on], (at[on] + 1) & (len(self.place_key) - 1)
        return made

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words after all merges, end to end, -1 - code point for characters without a piece; and the
        words' ends."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.points[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            made = np.append(self._pairs(symbols[:-1], symbols[1:], word[:-1] == word[1:]), -1)
            ranks = np.where(made >= 0, self.rank[made], NONE)
            count = np.diff(np.append(first, len(symbols)))
            least = np.repeat(np.minimum.reduceat(ranks, first), count)
            going = least != NONE
            done.append((symbols[~going], word[~going]))
            symbols, word, made, hit = symbols[going], word[going], made[going], (ranks == least)[going]
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # runs of neighbouring hits: every second one merges; pieces that must merge alone: the first of the word
            run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1] + 1)))
            offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            leading = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            lone = np.zeros(len(words), bool)
            lone[word[at[~self.together[made[at]]]]] = True
            at = at[np.where(lone[word[at]], leading, offset % 2 == 0)]
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        every, of = np.concatenate([x for x, _ in done]), np.concatenate([w for _, w in done])
        by = np.argsort(of, kind="stable")
        return every[by], np.cumsum(np.bincount(of, minlength=len(words)))

    def _heap(self, word: str) -> list[int]:
        """The same merges for one long word."""
        symbols = [self.chars.get(c, -1 - ord(c)) for c in word]
        if self.pairs is None:
            full = self.place_key >= 0
            self.pairs = dict(zip(self.place_key[full].tolist(), self.place_made[full].tolist(), strict=True))
        table = self.pairs
        before, after = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        gone = bytearray(len(symbols))
        size, heap = len(self.texts), []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(symbols) and symbols[a] >= 0 and symbols[b] >= 0 and (piece := table.get(symbols[a] * size + symbols[b])) is not None:
                heapq.heappush(heap, (int(self.rank[piece]), a, b, symbols[a], symbols[b], piece))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, x, y, piece = heapq.heappop(heap)
            if gone[a] or gone[b] or symbols[a] != x or symbols[b] != y or after[a] != b:
                continue
            symbols[a], gone[b], after[a] = piece, 1, after[b]
            if after[b] < len(symbols):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def _spelt(self, symbols: list[int]) -> bytes:
        """The ids of a word's symbols, four bytes each."""
        out: list[int] = []
        for s in symbols:
            out += [s] if s >= 0 else [self.bytes[b] for b in chr(-1 - s).encode()] if self.bytes else [self.unknown]
        return np.array(out, np.int32).tobytes()

    def words(self, text: str) -> list[str]:
        """Words of a text, each without its first space mark."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " ":
            return [w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each text's end id last; and the offsets of the texts."""
        split = [self.words(t) for t in texts]
        known = self.known
        if len(known) > MEMORY:
            kept = {w: ids for w, ids in known.items() if len(w) <= COMMON}
            known.clear()
            known |= kept if len(kept) < MEMORY // 2 else {}
        new = list(set(chain.from_iterable(split)).difference(known))
        short = [w for w in new if len(w) < LONG_WORD]
        flat, ends = self._rounds([MARK + w for w in short])
        ids, start = flat.astype(np.int32).tobytes(), 0
        odd = set(np.searchsorted(ends, np.flatnonzero(flat < 0), "right").tolist())
        for i, (w, end) in enumerate(zip(short, (4 * ends).tolist(), strict=True)):
            known[w] = ids[start:end] if i not in odd else self._spelt(flat[start // 4 : end // 4].tolist())
            start = end
        for w in new:
            if len(w) >= LONG_WORD:
                known[w] = self._spelt(self._heap(MARK + w))
        end_id = np.array([self.end], np.int32).tobytes()
        parts = [b"".join([*map(known.__getitem__, words), end_id]) for words in split]
        offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in parts], dtype=np.int64)))
        return np.frombuffer(b"".join(parts), np.int32), offsets

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, the end id last."""
        flat, offsets = self.encode_flat(texts)
        every = flat.tolist()
        return [every[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: piece surfaces end to end, without the space that encoding puts first."""
        return b"".join(map(self.surfaces.__getitem__, ids)).removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[int, Tokenizer] = {}


def tokenizer(model: bytes) -> Tokenizer:
    """The tokenizer of a model, made once in each worker."""
    if (key := hash(model)) not in _loaded:
        _loaded[key] = Tokenizer(model)
    return _loaded[key]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def encode_texts(df: DataFrame, text: str = "text", path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, by default, ``ids`` to every row."""
    with open(path or model_path(), "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the input's size
    clash = {"_text", "n_tokens", "ids_sha256", "decoded_sha256", "ids"}
    kept = [c for c in df.columns if c not in clash]

    def run(batches):
        t = tokenizer(model.value)
        for batch in batches:
            for a, b in slices(batch, "_text"):
                part = batch.slice(a, b - a)
                ids = t.encode([x or "" for x in part.column("_text").to_pylist()])
                out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(" ".join(map(t.decimal.__getitem__, x)).encode()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.decode(x).encode()).hexdigest() for x in ids])]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *out], [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*(F.col(f"`{c}`") for c in kept)).schema.fields)
    schema = ", ".join(filter(None, (fields, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)))
    return mapped(df.select(*(F.col(f"`{c}`") for c in kept), whole_text(text).alias("_text")), run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(documents(spark, sf_dir).select("doc_id", F.col("text").alias("_of")), "_of", with_ids=False).drop("_of")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
