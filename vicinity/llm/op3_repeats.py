"""Exact removal of repeated byte strings by suffix order and interval expansion.

A byte goes if it is covered by a string of ``LENGTH`` bytes that also starts anywhere else. Every window of that
length belongs to a bucket that follows from its content alone: the least hash of the ``GRAM``-byte strings in it.
Neighbouring windows of a bucket make one context, so each window start is in one context and equal windows are in
equal buckets. Buckets that occur once are done; the contexts of the others are cut from the texts, equal contexts
become one with a count, and buckets are worked off in chunks: the contexts of a chunk are joined, their suffixes
sorted and the Burrows-Wheeler transform taken. Before that, windows are left out that share no half with another:
every window holds its bucket's least string and has half of its other bytes on one side of it, so equal windows
have that half in common too. From intervals of suffixes that share a few bytes, breadth-first backward extension
finds the intervals that share one byte more, and so the common prefix of neighbouring suffixes by increasing value;
it stops at ``LENGTH``. Neighbours whose common prefix is still unknown then are repeats.

The same is done a second time over words: passages of ``PASSAGE`` words or more (over fifty) that also start
elsewhere, wherever lines break, are counted beside; they are no reason to remove a byte.

A bucket of more than ``HOT`` window starts (a short string that very many different texts share) is not brought
together: a hash of each of its windows is counted, with sums before the shuffle, and joined back to the places.

Equal texts are worked on once; a text that occurs again is covered entirely if it is long enough. No shuffle has
more than the texts once, the contexts of repeated buckets, and narrow rows.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep all bytes; overlapping and adjoining
covered strings are one span; repeated rows cover each other; a null doc_id stays null; extra columns do not matter;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, flat_bytes, groups, mapped, mixed, slices, whole_text, written

LENGTH = 400
GRAM = 64
#: Words of a passage, at least, and words of the strings that deal its windows to buckets.
PASSAGE = 51
PASSAGE_GRAM = 8
#: String lengths by which a bucket of many contexts is split again, in bytes and in words.
FINER = {LENGTH: (32, 16, 8), PASSAGE: (4, 2)}
#: Window starts of a bucket that is brought together in one task, at most.
HOT = 1 << 22
#: Windows that are broadcast because very many texts have them, at most (three numbers each).
HOT_WINDOWS = 16384
#: Window starts of a context at most, and bytes of a chunk, about.
PIECE = 1 << 15
CHUNK = 1 << 20
#: Bits of a symbol, symbols of a packed word, and the common prefixes below which packed words are compared directly:
#: for bytes, and for words (numbered within a chunk).
BYTES_FORM = (9, 7, 14)
WORDS_FORM = (31, 2, 2)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a rolling polynomial before each place and at the end, and the factors that take a place's turn out."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_BYTES[data] if data.dtype == np.uint8 else data) * up, out=sums[1:])
    return sums, down


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes (or words, given as hashes), by a rolling polynomial."""
    n = len(data) - gram + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums, down = _rolling(data)
    with np.errstate(over="ignore"):
        return mixed((sums[gram:] - sums[:-gram]) * down[:n])


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from minima of twice as many in each step."""
    if len(values) < width:
        return np.zeros(0, values.dtype)
    have = 1
    while have < width:
        more = min(have, width - have)
        values, have = np.minimum(values[:-more], values[more:]), have + more
    return values


def bucket_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows in the same bucket: row, bucket, first start and last start within the row, and
    whether the least string stands more than once in the run, so that the run may repeat itself."""
    hashes, width = gram_hashes(data, gram), length - gram + 1
    keys = window_least(hashes, width)
    starts = np.maximum(np.diff(offsets) - length + 1, 0)
    if not starts.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, bool)
    # runs begin where a row does, where the key changes and every ``PIECE`` starts; starts whose window leaves the row are none
    own = offsets[:-1][starts > 0]
    cut = np.concatenate(([True], keys[1:] != keys[:-1]))
    cut[own] = True
    for i in np.flatnonzero(starts > PIECE):
        cut[offsets[i] : offsets[i] + starts[i] : PIECE] = True
    cut &= np.repeat(np.tile([True, False], len(starts)), np.stack((starts, np.diff(offsets) - starts), axis=1).ravel())[: len(keys)]
    begin = np.flatnonzero(cut)
    row = np.searchsorted(offsets, begin, "right") - 1
    first = begin - offsets[row]
    last = np.minimum(np.append(begin[1:], len(keys)) - 1 - offsets[row], starts[row] - 1)
    # the least strings of all windows: those whose hash is the largest minimum of the windows around them
    edge = np.full(width - 1, ~np.uint64(0))
    least = np.flatnonzero(~window_least(np.concatenate((edge, ~keys, edge)), width) == hashes)
    low = np.searchsorted(least, begin, "left")
    count = np.searchsorted(least, begin + (last - first) + width, "left") - low
    run = np.repeat(np.arange(len(first)), count)
    at = least[np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())]
    key = keys[begin]
    many = np.bincount(run[hashes[at] == key[run]], minlength=len(first)) > 1
    return row, key.view(np.int64), first, last, many


def suffix_order(data: np.ndarray, left: np.ndarray, depth: int, bits: int, pack: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the contexts in order of at least ``depth`` symbols, and the first ``pack`` symbols of each as one word.

    A suffix stops at the end of its context, ``left`` symbols further; an end is smaller than any symbol and differs
    from every other. Order comes by doubling: suffixes that are still equal are sorted by the ranks further on.
    """
    n = len(data)
    word, have = np.zeros(n + 2 * pack, np.int64), 1
    word[:n] = data
    word[:n] += 1
    while have < pack:
        more = min(have, pack - have)
        word = (word[:-have] << (bits * more)) | (word[have:] >> (bits * (have - more)))
        have += more
    word = word[:n]
    near = np.flatnonzero(left < pack)
    beyond = bits * (pack - left[near])
    word[near] = (word[near] >> beyond) << beyond
    order = np.argsort(word)
    held = word[order]
    # of the places in the order that are still open: where a group begins, and the first place of each one's group
    new = np.concatenate(([True], held[1:] != held[:-1]))
    at = np.arange(n)
    own = np.flatnonzero(new)[np.cumsum(new) - 1]
    rank = np.zeros(n + 2 * max(depth, pack), np.int32 if n < 1 << 30 else np.int64)
    rank[order] = own
    while have < depth:
        shared = ~(new & np.append(new[1:], True))
        at, own = at[shared], own[shared]
        if not len(at):
            break
        places = order[at]
        # what ended before has its place as rank, all others have the rank of what follows
        second = np.where(left[places] <= have, places, n + rank[places + have].astype(np.int64))
        by = np.argsort(own * (2 * n + 1) + second)
        places, second = places[by], second[by]
        order[at] = places
        new = np.concatenate(([True], (second[1:] != second[:-1]) | (own[1:] != own[:-1])))
        own = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        rank[places] = own
        have *= 2
    return order, word


def _shared_head(words: np.ndarray, order: np.ndarray, left: np.ndarray, n: int, form: tuple[int, int, int]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, as far as the form's head."""
    bits, pack, head = form
    total = np.zeros(n - 1, np.int8)
    far = left[order]
    for part in range(head // pack):
        w = np.where(far > part * pack, words[np.minimum(order + part * pack, n - 1)], 0)
        differ = w[1:] ^ w[:-1]
        if part:
            differ[total < part * pack] = np.iinfo(np.int64).max
        for j in range(pack):
            total += differ < 1 << (bits * j)
    return np.minimum(total, np.minimum(far[1:], far[:-1]))


def repeated_starts(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether the ``length`` symbols from each place on also start at another place; ``ends`` are the contexts' ends.

    Symbols are bytes, or words by their hashes."""
    n = len(data)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    form, many = (BYTES_FORM, 256) if data.dtype == np.uint8 else (WORDS_FORM, n)
    head_size = form[2]
    if length <= head_size:
        raise ValueError(f"length must be above {head_size}")
    if data.dtype != np.uint8:
        data = np.unique(data, return_inverse=True)[1]
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
    left = left.astype(np.int32 if n < 1 << 30 else np.int64)
    order, words = suffix_order(data, left, length, *form[:2])
    # common prefix of the suffixes i - 1 and i; those below the head directly, -1: not known yet
    known = np.full(n + 1, -1, np.int32)
    known[0] = known[n] = 0
    head = _shared_head(words, order, left, n, form)
    known[1:n][head < head_size] = head[head < head_size]
    # the transform: the symbol before each suffix (``many`` at a context's start), and where the suffix one longer stands
    begins = np.zeros(n, bool)
    begins[0] = True
    begins[ends[:-1][ends[:-1] < n]] = True
    before = np.where(begins[order], many, data[order - 1].astype(np.int64))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]
    edge = np.flatnonzero(known[1:] == head_size - 1) + 1
    bounds = np.flatnonzero(known[:n] >= 0)
    lows = bounds[np.searchsorted(bounds, edge, "left") - 1] if len(edge) else edge
    lb, rb = lows, edge - 1
    for value in range(head_size, length):
        if not len(lb):
            break
        width = rb - lb + 1
        one = width == 1
        single = lb[one]
        single = single[before[single] < many]
        starts, stops = [step[single]], [step[single]]
        if not one.all():
            wide_lb, wide = lb[~one], width[~one]
            of = np.repeat(np.arange(len(wide)), wide)
            rows = np.repeat(wide_lb - np.cumsum(wide) + wide, wide) + np.arange(wide.sum())
            ok = before[rows] < many
            of, rows = of[ok], rows[ok]
            key = of * many + before[rows]
            sort = np.argsort(key, kind="stable")
            key, rows = key[sort], rows[sort]
            if len(key):
                cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                starts.append(np.minimum.reduceat(step[rows], cut))
                stops.append(np.maximum.reduceat(step[rows], cut))
        lb, rb = np.concatenate(starts), np.concatenate(stops)
        fresh = known[rb + 1] < 0
        lb, rb = lb[fresh], rb[fresh]
        known[rb + 1] = value
    near = known < 0
    out[order] = near[:-1] | near[1:]
    return out


def repeats_in(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, level: int = 0, chunk: int = CHUNK) -> np.ndarray:
    """``repeated_starts`` of contexts of any size: more than a few chunks are dealt to finer buckets first.

    Finer buckets follow from other, shorter strings of the window, so equal windows stay together here too.
    """
    if len(data) <= 4 * chunk or level == len(FINER.get(length, FINER[LENGTH])):
        return repeated_starts(data, offsets[1:], length)
    parts = []
    for low in range(0, len(offsets) - 1, 512):
        own = offsets[low : low + 513]
        row, key, a, z, _ = bucket_runs(data[own[0] : own[-1]], own - own[0], length, FINER.get(length, FINER[LENGTH])[level])
        parts.append((key, own[row] + a, z - a + 1))
    key, begin, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(key, kind="stable")
    key, begin, count = key[by], begin[by], count[by]
    out = np.zeros(len(data), bool)
    edges = [*np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist(), len(key)]
    held, size = edges[0], 0
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        size += int((count[a:z] + length - 1).sum())
        if size >= chunk or z == len(key):
            lengths = count[held:z] + length - 1
            inner = np.concatenate(([0], np.cumsum(lengths)))
            places = np.repeat(begin[held:z] - inner[:-1], lengths) + np.arange(inner[-1])
            hit = repeats_in(data[places], inner, length, level + 1, chunk)
            out[places[hit]] = True
            held, size = z, 0
    return out


def _halves(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The halves around each place of each context's least string: on which side, hash, context, and first and last
    start of the windows that have this half whole (and the smaller part of the other)."""
    (sums, down), size = _rolling(data), np.diff(offsets)
    hashes = np.full(len(data), ~np.uint64(0))
    with np.errstate(over="ignore"):
        hashes[: len(data) - gram + 1] = mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    # strings that reach over a context's end
    hashes[np.repeat(offsets[1:], gram - 1) - np.tile(np.arange(1, gram), len(size))] = ~np.uint64(0)
    at = np.flatnonzero(hashes == np.repeat(np.minimum.reduceat(hashes, offsets[:-1]), size))
    of = np.searchsorted(offsets, at, "right") - 1
    low, high = offsets[of], offsets[of + 1] - length
    half = (length - gram + 1) // 2
    parts = []
    # windows have ``half`` symbols or more before the string, or fewer and so ``rest`` or more behind it
    for side, first, last, begin, reach in ((0, at + gram - length, at - half, at - half, half + gram), (1, at - half + 1, at, at, length - half + 1)):
        first, last = np.maximum(first, low), np.minimum(last, high)
        some = np.flatnonzero(first <= last)
        begin = begin[some]
        with np.errstate(over="ignore"):
            key = mixed((sums[begin + reach] - sums[begin]) * down[begin])
        parts.append((np.full(len(some), side), key, of[some], first[some], last[some]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def may_repeat(data: np.ndarray, offsets: np.ndarray, once: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of window starts (first, last; none crosses contexts) outside of which no window of a context that was seen
    ``once`` repeats: the others have no half in common with another place. All windows of a context must hold its
    least ``gram`` symbols, as those of a bucket's runs do; windows of contexts that came more often are repeats anyway,
    and are here only where one seen once has the same half.
    """
    parts, a = [], 0
    while a < len(offsets) - 1:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        side, key, of, first, last = _halves(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a], length, gram)
        parts.append((side, key, of + a, first + offsets[a], last + offsets[a]))
        a = z
    side, key, of, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.lexsort((key, side))
    new = np.concatenate(([True], (key[by][1:] != key[by][:-1]) | (side[by][1:] != side[by][:-1])))
    group, begins = np.cumsum(new) - 1, np.flatnonzero(new)
    met = (np.diff(np.append(begins, len(by))) > 1) & np.logical_or.reduceat(once[of[by]], begins)
    first, last, of = (x[by][met[group]] for x in (first, last, of))
    # overlapping and adjoining ranges of a context are one
    by = np.argsort(first, kind="stable")
    first, last, of = first[by], np.maximum.accumulate(last[by]), of[by]
    new = np.flatnonzero(np.concatenate(([True], (first[1:] > last[:-1] + 1) | (of[1:] != of[:-1])))[: len(first)])
    return first[new], last[np.append(new[1:], len(first))[: len(new)] - 1]


def repeats_of_once(data: np.ndarray, offsets: np.ndarray, once: np.ndarray, length: int, gram: int) -> np.ndarray:
    """``repeats_in`` of the windows that may repeat; it holds for the contexts that were seen ``once``."""
    out = np.zeros(len(data), bool)
    first, last = may_repeat(data, offsets, once, length, gram)
    if len(first):
        lengths = last - first + length
        inner = np.concatenate(([0], np.cumsum(lengths)))
        places = np.repeat(first - inner[:-1], lengths) + np.arange(inner[-1])
        out[places[repeats_in(data[places], inner, length)]] = True
    return out


WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, the rows' offsets among them, and where each word starts and ends."""
    inside = WORD[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    # words never cross rows
    some = np.diff(offsets) > 0
    edge, last = offsets[:-1][some], offsets[1:][some] - 1
    begins[edge], stops[last] = inside[edge], inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    sums, down = _rolling(data)
    with np.errstate(over="ignore"):
        word = mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_BASE))
    return word, np.searchsorted(start, offsets), start, end


def _tagged(bucket: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of bytes (kind 0) and of words (1) in one column: the kind is the last bit."""
    return (bucket & ~np.int64(1)) | np.int64(kind)


def all_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs over bytes and over words: row, tagged bucket, first byte and end of the run's context, window starts, and
    whether it may repeat itself."""
    row, bucket, a, z, many = bucket_runs(data, offsets)
    word, cut, start, end = _words(data, offsets)
    w_row, w_bucket, first, last, w_many = bucket_runs(word, cut, PASSAGE, PASSAGE_GRAM)
    begin, stop = start[cut[w_row] + first] - offsets[w_row], end[cut[w_row] + last + PASSAGE - 1] - offsets[w_row]
    both = lambda x, y: np.concatenate((x, y))
    return both(row, w_row), both(_tagged(bucket, 0), _tagged(w_bucket, 1)), both(a, begin), both(z + LENGTH, stop), both(z - a + 1, last - first + 1), both(many, w_many)


RUNS = "th binary, bucket long, a int, z int, starts int, many boolean"


def runs_table(texts: DataFrame) -> DataFrame:
    """The runs of all texts (th, data), written to the shared folder."""

    def run(batches):
        for batch in batches:
            for i, j in slices(batch, "data"):
                part = batch.slice(i, j - i)
                row, bucket, a, z, starts, many = all_runs(*flat_bytes(part.column("data")))
                yield pa.RecordBatch.from_arrays([part.column("th").take(pa.array(row)), pa.array(bucket), *(pa.array(x, pa.int32()) for x in (a, z, starts)), pa.array(many)], [x.split()[0] for x in RUNS.split(", ")])

    return written(mapped(texts, run, RUNS), "runs")


def _cut(texts: DataFrame, bodies: bool) -> DataFrame:
    """Contexts of texts with ``runs``: the bucket and the content's hash, with the distinct contents of a batch and
    their counts (``body``, ``n``), or with the place of each (``th``, ``a``)."""
    names = ("bucket", "ch", "body", "n") if bodies else ("bucket", "ch", "th", "a")
    kinds = (pa.int64(), pa.binary(), *((pa.binary(), pa.int64()) if bodies else (pa.binary(), pa.int32())))

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("runs").is_valid())
            for i, j in slices(batch, "data", 4 * CHUNK):
                part = batch.slice(i, j - i)
                out: list[tuple] = []
                seen: dict[tuple[int, bytes], list] = {}
                for th, data, runs in zip(part.column("th").to_pylist(), part.column("data").to_pylist(), part.column("runs").to_pylist(), strict=True):
                    for x in runs:
                        if x["hot"]:
                            continue
                        body = data[x["a"] : x["z"]]
                        key = (x["bucket"], hashlib.blake2b(body, digest_size=16).digest())
                        if bodies:
                            seen.setdefault(key, [body, 0])[1] += 1
                        else:
                            out.append((*key, th, x["a"]))
                out += [(*k, *v) for k, v in seen.items()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], list(names))

    # all of these columns go in, so that every use of the texts has the same plan and Spark shuffles them once
    return mapped(texts.select("th", "data", "copies", "runs"), run, "bucket long, ch binary, " + ("body binary, n long" if bodies else "th binary, a int"))


def _hot_windows(texts: DataFrame, counted: bool) -> DataFrame:
    """Windows of hot runs by two hashes of their content: how many a batch has (``n``), or the place of each (``th``,
    ``kind``, ``low``, ``stop``)."""
    schema = "g long, h long, " + ("n long" if counted else "th binary, kind int, low int, stop int")

    def windows(data: bytes, runs: list):
        flat = np.frombuffer(data, np.uint8)
        for kind in (0, 1):
            own = [x for x in runs if x["hot"] and (x["bucket"] & 1) == kind]
            if not own:
                continue
            if kind:
                word, _, start, end = _words(flat, np.array([0, len(flat)]))
                g, symbols = gram_hashes(word, PASSAGE), word
                low, stop = start[: len(g)], end[PASSAGE - 1 :]
            else:
                g, symbols = gram_hashes(flat, LENGTH), mixed(_BYTES[flat] ^ np.uint64(_BASE))
                low = np.arange(len(g))
                stop = low + LENGTH
            h = gram_hashes(symbols ^ np.uint64(0x5851F42D4C957F2D), PASSAGE if kind else LENGTH)
            at = np.unique(np.concatenate([np.arange(i, i + x["starts"]) for x in own for i in [int(np.searchsorted(low, x["a"]))]]))
            yield kind, g[at].view(np.int64), (h[at] ^ np.uint64(kind)).view(np.int64), low[at], stop[at]

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("runs").is_valid())
            for i, j in slices(batch, "data"):
                part = batch.slice(i, j - i)
                for th, data, copies, runs in zip(*(part.column(c).to_pylist() for c in ("th", "data", "copies", "runs")), strict=True):
                    for kind, g, h, low, stop in windows(data, runs):
                        n = len(g)
                        own = [pa.array(np.full(n, copies), pa.int64())] if counted else [pa.array([th] * n, pa.binary()), pa.array(np.full(n, kind), pa.int32()), pa.array(low, pa.int32()), pa.array(stop, pa.int32())]
                        yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(h), *own], [x.split()[0] for x in schema.split(", ")])

    return mapped(texts.select("th", "data", "copies", "runs"), run, schema)


def hot_hits(texts: DataFrame) -> DataFrame:
    """Places of windows of hot runs that occur again: (th, kind, a, lows, ends)."""
    again = _hot_windows(texts, True).groupBy("g", "h").agg(F.sum("n").alias("n")).where("n > 1")
    # a window that very many texts have is broadcast (at most HOT_WINDOWS of them), so that it is no hot key
    limit = again.agg(F.greatest(F.lit(100), F.ceil(F.sum("n") / HOT_WINDOWS))).first()[0] or 100
    often, rest, places = F.broadcast(again.where(F.col("n") > limit)), again.where(F.col("n") <= limit), _hot_windows(texts, False)
    met = places.join(often, ["g", "h"], "left_semi").unionByName(places.join(often, ["g", "h"], "left_anti").join(rest, ["g", "h"], "left_semi"))
    return met.groupBy("th", "kind").agg(F.collect_list("low").alias("lows"), F.collect_list("stop").alias("ends")).select("th", "kind", F.lit(0).alias("a"), "lows", "ends")


def found_repeats(contexts: DataFrame) -> DataFrame:
    """Repeats in each distinct context (bucket, ch, n, body): where runs of repeated windows start and what they cover ends."""

    def settle(held: list[pa.Table], kind: int):
        table = pa.concat_tables(held).combine_chunks()
        data, offsets = flat_bytes(table.column("body").combine_chunks())
        if kind:
            symbols, cut, start, end = _words(data, offsets)
            length, gram = PASSAGE, PASSAGE_GRAM
        else:
            symbols, cut, length, gram = data, offsets, LENGTH, GRAM
        more = table.column("n").to_numpy() > 1
        again = repeats_of_once(symbols, cut, ~more, length, gram)
        size = np.diff(cut)
        copied = np.repeat(more, size)
        place = np.arange(len(symbols)) - np.repeat(cut[:-1], size)
        hit = (again | copied) & (place <= np.repeat(size, size) - length)
        edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
        # a run never crosses contexts: the last symbols of each are no starts
        low, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + length - 1
        of = np.searchsorted(cut, low, "right") - 1
        if kind:
            low, stop = start[low], end[stop - 1]
        some = np.unique(of)
        at = np.searchsorted(of, some)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.append(at, len(of)), pa.int32()), pa.array((v - offsets[of]).astype(np.int32)))
        if len(some):
            picked = table.select(["bucket", "ch"]).take(pa.array(some)).combine_chunks()
            yield pa.RecordBatch.from_arrays([picked.column("bucket").combine_chunks(), picked.column("ch").combine_chunks(), lists(low), lists(stop)], ["bucket", "ch", "lows", "ends"])

    def run(batches):
        held, size = ([], []), [0, 0]
        for table in groups(batches, "bucket"):
            kind = table.column("bucket")[0].as_py() & 1
            held[kind].append(table)
            size[kind] += sum(len(x) for x in table.column("body").to_pylist()) if table.num_rows < 4 else table.column("body").nbytes
            if size[kind] >= CHUNK:
                yield from settle(held[kind], kind)
                held[kind].clear()
                size[kind] = 0
        for kind in (0, 1):
            if held[kind]:
                yield from settle(held[kind], kind)

    return mapped(contexts.select("bucket", "ch", "n", "body").sortWithinPartitions("bucket"), run, "bucket long, ch binary, lows array<int>, ends array<int>")


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long, kept binary"


def _merged(data: bytes, spans: list[tuple[int, int]], words: bool) -> list[list[int]]:
    """Spans that overlap or adjoin (as words: with nothing but blanks between) as one."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and (a <= out[-1][1] or words and data[out[-1][1] : a].isspace()):
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return out


def cleaned(texts: DataFrame, with_bytes: bool = False) -> DataFrame:
    """Removes what the found runs (``hits``) and copies cover: th and the result of each text."""
    names = [x.split()[0] for x in RESULT.split(", ")][: None if with_bytes else -1]

    def run(batches):
        for batch in batches:
            for i, j in slices(batch, "data"):
                part = batch.slice(i, j - i)
                out: list[tuple] = []
                for data, copies, hits in zip(part.column("data").to_pylist(), part.column("copies").to_pylist(), part.column("hits").to_pylist(), strict=True):
                    n = len(data)
                    if copies > 1:
                        spans, passages = [[0, n]] if n >= LENGTH else [], [[0, n]] if len(data.split()) >= PASSAGE else []
                    else:
                        spans, passages = (_merged(data, [(h["a"] + low, h["a"] + stop) for h in hits or () if h["kind"] == kind for low, stop in zip(h["lows"], h["ends"], strict=True)], kind == 1) for kind in (0, 1))
                    edges = [0, *(x for s in spans for x in s), n]
                    kept = b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)) if spans else data
                    out.append((n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), len(passages), sum(len(data[a:z].split()) for a, z in passages), kept)[: len(names)])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("th"), *(pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=False))], ["th", *names])

    schema = "th binary, " + ", ".join(RESULT.split(", ")[: len(names)])
    return mapped(texts.select("th", "data", "copies", "hits"), run, schema)


def remove_repeats(docs: DataFrame, text: str = "text", with_bytes: bool = False) -> DataFrame:
    """For each document: doc_id and what is left after the removal (the kept bytes too, if asked for)."""
    rows = docs.select("doc_id", whole_text(text).cast("binary").alias("data")).withColumn("th", F.coalesce(F.unhex(F.md5("data")), F.lit(b"").cast("binary")))
    runs = runs_table(rows.select("th", "data"))
    # a bucket is of interest if two places are in it, or one that may repeat itself; copies of a text are the same place
    place = F.xxhash64("th", "a")
    hot = F.sum("starts") > HOT
    shared = runs.groupBy("bucket").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("many").alias("many"), hot.alias("hot")).where("x < y or many").select("bucket", "hot")
    any_hot = not runs.groupBy("bucket").agg(hot.alias("hot")).where("hot").isEmpty()
    by_text = runs.join(shared, "bucket").groupBy("th").agg(F.collect_set(F.struct("bucket", "a", "z", "starts", "hot")).alias("runs"))
    texts = rows.groupBy("th").agg(F.first("data").alias("data"), F.count("*").alias("copies"))
    with_runs = texts.join(by_text, "th")
    distinct = _cut(with_runs, True).repartition("bucket").groupBy("bucket", "ch").agg(F.first("body").alias("body"), F.sum("n").alias("n"))
    found = found_repeats(distinct)
    met = _cut(with_runs, False).join(found, ["bucket", "ch"]).select("th", F.col("bucket").bitwiseAND(F.lit(1)).cast("int").alias("kind"), "a", "lows", "ends")
    if any_hot:
        met = met.unionByName(hot_hits(with_runs))
    hits = met.groupBy("th").agg(F.collect_list(F.struct("kind", "a", "lows", "ends")).alias("hits"))
    done = cleaned(texts.join(hits, "th", "left"), with_bytes)
    return rows.select("doc_id", "th").join(done, "th").drop("th")


def op3_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op3_repeated_strings": op3_repeated_strings}
#: The same result from digests of all windows, and the islands of their starts.
ORACLE_SQL = {
    "op3_repeated_strings": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
s AS (SELECT doc_id, unnest(range(0, n - 399)) AS s, h FROM n WHERE n >= 400),
k AS (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 800)) AS g FROM s),
m AS (SELECT g FROM k GROUP BY g HAVING count(*) > 1),
t AS (SELECT k.doc_id, s FROM k SEMI JOIN m USING (g)),
o AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM t),
i AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM o),
p AS (SELECT doc_id, i, min(s) AS a, max(s) + 400 AS z FROM i GROUP BY doc_id, i),
g AS (SELECT p.doc_id, i, a, z, lag(z, 1, 0) OVER (PARTITION BY p.doc_id ORDER BY a) AS y FROM p),
c AS (SELECT g.doc_id, sum(z - a) AS gone, count(*) AS spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM g JOIN n USING (doc_id) GROUP BY g.doc_id),
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\t-\r ]+') AS w FROM documents),
ws AS (SELECT doc_id, unnest(range(1, len(w) - 49)) AS s, w FROM w WHERE len(w) > 50),
wk AS (SELECT doc_id, s, md5_number(array_to_string(w[s : s + 50], ' ')) AS g FROM ws),
wm AS (SELECT g FROM wk GROUP BY g HAVING count(*) > 1),
wt AS (SELECT wk.doc_id, s FROM wk SEMI JOIN wm USING (g)),
wo AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 51 OR lag(s) OVER (PARTITION BY doc_id ORDER BY s) IS NULL THEN 1 ELSE 0 END AS new FROM wt),
wi AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS i FROM wo),
wp AS (SELECT doc_id, i, max(s) + 51 - min(s) AS n FROM wi GROUP BY doc_id, i),
wc AS (SELECT doc_id, count(*) AS passages, sum(n) AS words FROM wp GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(passages, 0) AS n_passages, CAST(coalesce(words, 0) AS BIGINT) AS passage_words FROM n LEFT JOIN c USING (doc_id) LEFT JOIN wc USING (doc_id)
"""
}
