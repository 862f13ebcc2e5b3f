"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of ``GRAM`` UTF-8 bytes has a hash; of each ``WINDOW`` neighbouring hashes the smallest is chosen, the
rightmost one among equals, and kept with its byte position. So two texts that share ``GRAM + WINDOW - 1`` bytes
share a chosen hash, and shorter than ``GRAM`` bytes nothing is matched. The window minimum is taken by doubling
(least of two neighbours, four, eight ...), and a text is worked through in blocks that overlap by a window, so
what is held at a time does not grow with the text.

The next document in order of doc_id comes by window functions over ranges of ids: boundaries are ids that occur,
a boundary's rows go into both ranges, and the first rows of all follow the last range. No range is a fixed share
of the table, and none is taken whole by the driver.

Defined results: a null text is empty; an empty text has no hashes and is like an empty text only; a text shorter
than a gram has the hash of the whole as its only one; a null doc_id comes first; equal ids follow each other in
order of a hash of the text; one document alone is its own next; an empty table gives an empty table; other columns
are kept by ``fingerprint`` (a clashing one is replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, whole_text
from ._spans import within

GRAM = 8
WINDOW = 8
BLOCK = 2048
#: Rows of a range of ids, about, and ranges at most.
RANGE_ROWS = 1000
MOST_RANGES = 1 << 16
_PLACES = 1 << 16
CHOSEN = "array<struct<hash:bigint,at:bigint>>"


def _least(values: Column, width: int) -> Column:
    """The minimum of ``width`` values from each on, of fewer at the end."""
    got, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        got = _doubled(got, step)
        reach += step
    return got


def _doubled(values: Column, step: int) -> Column:
    def both(v: Column) -> Column:
        return F.zip_with(v, F.slice(v, F.lit(1 + step), F.size(v)), lambda a, b: F.least(a, b))

    return within(values, both)


def winnow(data: Column, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> Column:
    """Chosen hashes of a binary column with their positions, in order of position."""
    if gram < 1 or window < 1 or block + window > _PLACES:
        raise ValueError("gram and window must be positive, and a block must fit the position bits")

    def of_block(body: Column, j: Column) -> Column:
        low = j * block

        def chosen(part: Column) -> Column:
            grams = F.greatest(F.octet_length(part) - (gram - 1), F.lit(1))
            # high bits: hash; low bits: the further right, the smaller
            packed = F.transform(F.sequence(F.lit(1), grams), lambda i: F.shiftrightunsigned(F.xxhash64(F.substring(part, i, F.lit(gram))), 17) * _PLACES + (_PLACES - i))
            least = F.array_distinct(F.slice(_least(packed, window), F.lit(1), F.greatest(grams - (window - 1), F.lit(1))))
            return F.transform(least, lambda v: F.struct(F.shiftright(v, 16).alias("hash"), (low + (_PLACES - 1) - v.bitwiseAND(F.lit(_PLACES - 1))).cast("long").alias("at")))

        return within(F.substring(body, low + 1, F.lit(block + window + gram - 2)), chosen)

    def of_text(body: Column) -> Column:
        windows = F.greatest(F.octet_length(body) - (gram + window - 2), F.lit(1))
        blocks = F.sequence(F.lit(0), F.floor((windows - 1) / block).cast("int"))
        # a hash chosen at the end of a block may be chosen at the start of the next one too
        return within(F.flatten(F.transform(blocks, lambda j: of_block(body, j))), lambda x: F.filter(x, lambda s, i: (i == 0) | (F.get(x, i - 1)["at"] != s["at"])))

    return F.when(F.octet_length(data) > 0, within(data, of_text)).otherwise(F.array().cast(CHOSEN))


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda s: s["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of all hashes of two fingerprints, given as distinct hashes; 1 for two empty ones."""

    def of(shared: Column) -> Column:
        every = F.size(a) + F.size(b) - shared
        return F.when(every > 0, shared / every).otherwise(F.lit(1.0))

    return within(F.size(F.array_intersect(a, b)), of)


def rewinnow(chosen: Column, data: Column, same: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Chosen hashes of a text whose first ``same`` bytes are those of a text with the given chosen hashes.

    Only what follows the last window within these bytes is hashed: choices move to the right with the window, so
    what stands before that window's choice is as it was.
    """
    last = same - (gram + window - 1)

    def spliced(tail: Column) -> Column:
        moved = F.transform(tail, lambda s: F.struct(s["hash"].alias("hash"), (s["at"] + last).alias("at")))
        return F.concat(F.filter(chosen, lambda s: s["at"] < F.element_at(tail, 1)["at"] + last), moved)

    tail = winnow(F.substring(data, last + 1, F.octet_length(data)), gram, window)
    return F.when(last > 0, within(tail, spliced)).otherwise(winnow(data, gram, window))


def fingerprint(df: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the chosen hashes and byte positions of every whole text."""
    return df.withColumn(name, winnow(whole_text(text).cast("binary")))


def _ranges(df: DataFrame, key: str) -> tuple[list[int], int | None, bool]:
    """Keys that start a range (after the first one), the least key, and whether some key is null."""
    n, known, least = df.agg(F.count("*"), F.count(key), F.min(key)).first()
    count = min(-(-known // RANGE_ROWS), MOST_RANGES)
    if count < 2:
        return [], least, known < n
    at = df.agg(F.percentile_approx(key, [i / count for i in range(1, count)], max(10_000, 10 * count))).first()[0]
    return sorted({x for x in at if x > least}), least, known < n


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds are not above the key, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def search(values: Column) -> Column:
        at, step = F.lit(0), 1 << (len(bounds).bit_length() - 1)
        while step:
            at = _forward(values, key, at, step, len(bounds))
            step >>= 1
        return at

    return F.when(key.isNull(), F.lit(0)).otherwise(within(table, search))


def _forward(values: Column, key: Column, at: Column, step: int, size: int) -> Column:
    return within(at, lambda a: F.when((a + step <= size) & (F.get(values, a + step - 1) <= key), a + step).otherwise(a))


def in_ranges(df: DataFrame, key: str, tie: Column) -> tuple[DataFrame, Window]:
    """Rows dealt to ranges of ``key`` with those of the next range's start behind them (``_guest``), and the window in order."""
    bounds, least, nulls = _ranges(df, key)
    own = _range_of(F.col(key), bounds)
    k = F.col("_range")
    starts = F.when(k > 0, F.get(F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), k - 1)) if bounds else F.lit(None)
    first = F.col(key).isNull() if nulls else F.col(key) == F.lit(least)
    guest = F.when(first, F.array(F.lit(len(bounds)))).when(F.col(key) == starts, F.array(k - 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(F.array(F.struct(k.alias("range"), F.lit(0).alias("guest"))), F.transform(guest, lambda r: F.struct(r.alias("range"), F.lit(1).alias("guest"))))
    dealt = df.withColumn("_range", own).withColumn("_tie", tie).withColumn("_to", F.explode(places)).withColumns({"_range": F.col("_to.range"), "_guest": F.col("_to.guest")}).drop("_to")
    return dealt, Window.partitionBy("_range").orderBy("_guest", F.col(key).asc_nulls_first(), "_tie")


def edited_texts(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Each text and what it becomes (``edited``, after ``same`` equal bytes) when the next one's start replaces its last
    quarter, in ranges of doc_id.

    A range's guests (``_guest``) have no edited text; they stay for what follows the range in the returned order.
    """
    rows = docs.select("doc_id", whole_text().alias("text"))
    dealt, order = in_ranges(rows, "doc_id", F.xxhash64("text"))
    n = F.char_length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.left(F.col("text"), n - tail), F.left(F.coalesce(F.col("_next"), F.lit("")), tail))
    return dealt.withColumn("_next", F.lead("text").over(order)).withColumns({"edited": F.when(F.col("_guest") == 0, edited).otherwise(F.lit("")), "same": F.when(F.col("_guest") == 0, F.octet_length(F.left(F.col("text"), n - tail))).otherwise(F.lit(0))}).drop("_next"), order


def compared(docs: DataFrame) -> DataFrame:
    """Digests of each document's and its edited text's fingerprint, and how like it the edited and the next text are."""
    texts, order = edited_texts(docs)
    at = ["doc_id", "_range", "_guest", "_tie"]
    prints = texts.select(*at, F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), winnow(F.col("text").cast("binary")).alias("_chosen"), F.col("edited").cast("binary").alias("_data"), "same")
    prints = prints.withColumn("_edited", rewinnow(F.col("_chosen"), F.col("_data"), F.col("same"))).drop("_data", "same")
    sets = prints.withColumns({"_own": hashes(F.col("_chosen")), "_other": hashes(F.col("_edited"))})
    # only the hashes wait for the row before; digests and the first likeness are settled here
    settled = sets.select(*at, "n_chars", "edited_sha256", _digest(F.col("_chosen")).alias("fingerprint"), _digest(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_other")).alias("near_edited"), "_own")
    followed = settled.withColumn("_after", F.lead("_own").over(order)).where(F.col("_guest") == 0)
    return followed.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(F.col("_own"), F.col("_after")).alias("near_next"), F.size("_own").cast("long").alias("n_hashes"))


def _digest(chosen: Column) -> Column:
    """128 bits of all chosen hashes and positions, in hexadecimal."""
    half = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), chosen))), 16, "0")
    return F.concat(half(1), half(2))


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))


QUERIES = {"op1_winnowing": op1_winnowing}
ORACLE_SQL: dict[str, str] = {}
