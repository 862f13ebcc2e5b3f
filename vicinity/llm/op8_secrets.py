"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they stand: values assigned to a secret's name (``assign``), access identifiers
of a known form (``access``) and long hexadecimal strings (``hex``). Weak candidates say little alone: key-like
strings of mixed characters (``key``), account and client names (``id``), service addresses (``endpoint``). They
are joined by interval: two parts are linked if at most ``REACH`` code points and no blank line lie between them.
A weak key is reported if it is linked to an identifier or an endpoint, a weak identifier if it is linked to a
secret, an endpoint if it is linked to a secret and some identifier too. Weak candidates that overlap a strong
span are not reported again.

The join runs within the row as arrays, in n log n of the row's candidates: nothing is shuffled and no row grows
with another one's text.
Defined results: a null or empty text has no spans; repeated rows give equal spans; ties in position order by
kind; other columns stay as they are (a clashing ``secrets`` column is replaced); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, free, whole_text
from ._spans import match_spans, scanned, within

#: Kinds in the order of equal starts.
KINDS = ("assign", "access", "hex", "key", "id", "endpoint")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KEY = "(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
ID = r"""(?i)(?<![a-z0-9])(?:user_?name|user|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}"""
ENDPOINT = r"""(?i)(?<![a-z0-9])(?:https?|wss?|ftps?|sftp|ssh|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?)://[^\x00-\x20"'<>`\x7F]+"""
REACH = 240
PLACEHOLDER = "[SECRET]"
SPAN = "array<struct<start:int,rank:int,end:int>>"


def _kind(text: Column, pattern: str, kind: str) -> Column:
    rank = F.lit(KINDS.index(kind))
    return F.transform(match_spans(text, F.lit(pattern)), lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), s["end"].alias("end"), s["hit"].alias("hit")))


def _mixed(hit: Column) -> Column:
    """Whether a key-like string mixes capitals, small letters and digits."""
    return hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")


#: What takes part in linking: its class among names, addresses, secrets and blank lines, and its range.
EVENT = "struct<at:int,part:int,start:int,end:int,rank:int>"
NAMES, ADDRESSES, SECRETS, BLANK = range(4)
_PART = {"assign": SECRETS, "access": NAMES, "hex": SECRETS, "key": SECRETS, "id": NAMES, "endpoint": ADDRESSES}
#: Of the events up to a place: the last end of each part, and the start of the last blank line.
_BEFORE = "struct<p0:int,p1:int,p2:int,blank:int>"
#: Of the events from a place on: the first start of each part, and the start of the last blank line before that.
_AFTER = "struct<p0:struct<start:int,blank:int>,p1:struct<start:int,blank:int>,p2:struct<start:int,blank:int>>"


def _linked(spans: Column, text: Column) -> Column:
    """The weak ones among spans (start, rank, end) that stand near the parts they need.

    Spans and blank lines are put in one order. What lies nearest on the left is the part with the largest end so
    far, on the right the part with the smallest start from here on; two scans give both for every span, so the work
    is n log n. Whatever else of a part lies within reach without a blank line between, its nearest one does too.
    """
    part = F.array(*(F.lit(_PART[k]) for k in KINDS))
    blank = F.transform(match_spans(text, F.lit("\n(?=\n)")), lambda b: F.struct((b["start"] + 2).alias("at"), F.lit(BLANK).alias("part"), b["start"].alias("start"), (b["start"] + 2).alias("end"), F.lit(-1).alias("rank")))
    own = F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.get(part, s["rank"]).alias("part"), s["start"].alias("start"), s["end"].alias("end"), s["rank"].alias("rank")))
    # a blank line counts from its end on, and comes before a span that starts there
    ordered = F.array_sort(F.concat(F.transform(blank.cast(f"array<{EVENT}>"), lambda e: F.struct((e["at"] * 2).alias("at"), e["part"].alias("part"), e["start"].alias("start"), e["end"].alias("end"), e["rank"].alias("rank"))), F.transform(own.cast(f"array<{EVENT}>"), lambda e: F.struct((e["at"] * 2 + 1).alias("at"), e["part"].alias("part"), e["start"].alias("start"), e["end"].alias("end"), e["rank"].alias("rank")))).cast(f"array<{EVENT}>"))

    def seen(events: Column) -> Column:
        first = F.transform(events, lambda e: F.struct(*(F.when(e["part"] == p, e["end"]).alias(f"p{p}") for p in range(3)), F.when(e["part"] == BLANK, e["start"]).alias("blank")))
        before = scanned(first, lambda x, y: F.struct(*(F.greatest(x[n], y[n]).alias(n) for n in ("p0", "p1", "p2", "blank"))), _BEFORE)

        def ahead(b: Column) -> Column:
            starts = F.transform(events, lambda e, i: F.struct(*(F.when(e["part"] == p, F.struct(e["start"].alias("start"), F.get(b, i)["blank"].alias("blank"))).alias(f"p{p}") for p in range(3))))
            after = scanned(starts, lambda x, y: F.struct(*(F.least(x[n], y[n]).alias(n) for n in ("p0", "p1", "p2"))), _AFTER, back=True)
            return F.zip_with(F.zip_with(events, b, lambda e, v: F.struct(e.alias("e"), v.alias("b"))), after, lambda l, a: F.struct(l["e"].alias("e"), l["b"].alias("b"), a.alias("a")))

        return within(before, ahead)

    def near(x: Column, p: int) -> Column:
        e, end, nxt = x["e"], x["b"][f"p{p}"], x["a"][f"p{p}"]
        apart = lambda blank, since: blank.isNotNull() & (blank >= since)
        left = end.isNotNull() & (e["start"] - end <= REACH) & ~apart(x["b"]["blank"], end)
        right = nxt.isNotNull() & (nxt["start"] - e["end"] <= REACH) & ~apart(nxt["blank"], e["end"])
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    def reported(x: Column) -> Column:
        rank = x["e"]["rank"]
        return (
            F.when(rank == KINDS.index("key"), near(x, NAMES) | near(x, ADDRESSES))
            .when(rank == KINDS.index("id"), near(x, SECRETS))
            .when(rank == KINDS.index("endpoint"), near(x, SECRETS) & near(x, NAMES))
            .otherwise(F.lit(False))
        )

    found = F.filter(within(ordered, seen), reported)
    return F.transform(found, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["rank"].alias("rank"), x["e"]["end"].alias("end")))


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``secrets``, an array of (start, end, kind, strong) in order of start and kind, in code points."""
    df = df.drop("secrets")
    names = free(df, "body", "strong", "keys", "ids", "ends", "any")
    body, strong_, keys, ids, ends, any_ = map(F.col, names)
    strong = F.concat(
        F.filter(_kind(body, ASSIGN, "assign"), lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= ASSIGN_LEAST),
        _kind(body, ACCESS, "access"),
        _kind(body, HEX, "hex"),
    )
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))).cast(SPAN)
    # strong spans in order of start with the last end so far: what overlaps none of them ends before the next one starts
    apart = lambda spans: F.when(F.size(strong_) == 0, spans).otherwise(_apart(spans, strong_))
    weak = lambda pattern, kind: apart(bare(_kind(body, pattern, kind)))
    none = F.array().cast(SPAN)
    # address and name patterns only matter where the other part is there
    rows = df.withColumn(names[0], whole_text(text)).withColumn(names[1], bare(strong))
    rows = rows.withColumn(names[2], apart(bare(F.filter(_kind(body, KEY, "key"), lambda s: _mixed(s["hit"])))))
    rows = rows.withColumn(names[5], (F.size(keys) > 0) | (F.size(strong_) > 0))
    rows = rows.withColumn(names[3], F.when(any_, weak(ID, "id")).otherwise(none)).withColumn(names[4], F.when(any_, weak(ENDPOINT, "endpoint")).otherwise(none))
    found = F.when(F.size(keys) + F.size(ids) + F.size(ends) > 0, _linked(F.concat(strong_, keys, ids, ends), body).cast(SPAN)).otherwise(none)
    table = F.array(*map(F.lit, KINDS))
    out = F.transform(F.array_sort(F.concat(strong_, found)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(table, s["rank"]).alias("kind"), (s["rank"] < 3).alias("strong")))
    return rows.withColumn("secrets", out).drop(*names)


def _apart(spans: Column, strong: Column) -> Column:
    """The spans that overlap none of ``strong``: both in one order, a scan to each side."""
    event = "struct<start:int,own:int,end:int,rank:int>"
    tagged = lambda x, own: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["rank"].alias("rank")))
    ordered = F.array_sort(F.concat(tagged(strong, 0), tagged(spans, 1)).cast(f"array<{event}>"))

    def of(events: Column) -> Column:
        last = scanned(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"])), lambda x, y: F.greatest(x, y), "int")
        first = scanned(F.transform(events, lambda e: F.when(e["own"] == 0, e["start"])), lambda x, y: F.least(x, y), "int", back=True)
        both = F.zip_with(F.zip_with(events, last, lambda e, l: F.struct(e.alias("e"), l.alias("last"))), first, lambda x, f: F.struct(x["e"].alias("e"), x["last"].alias("last"), f.alias("first")))
        clear = F.filter(both, lambda x: (x["e"]["own"] == 1) & (x["last"].isNull() | (x["last"] <= x["e"]["start"])) & (x["first"].isNull() | (x["first"] >= x["e"]["end"])))
        return F.transform(clear, lambda x: F.struct(x["e"]["start"].alias("start"), x["e"]["rank"].alias("rank"), x["e"]["end"].alias("end"))).cast(SPAN)

    return within(ordered, of)


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of ``secrets`` (overlapping ones as one) in the text by a placeholder."""
    body = whole_text(text)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        text_so_far = F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit(PLACEHOLDER))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], text_so_far).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(F.col("secrets"), start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.char_length(body))))
    return df.withColumn(text, F.when(F.size("secrets") > 0, cut).otherwise(F.col(text)))


def digest(df: DataFrame) -> DataFrame:
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return df.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(F.filter(spans, lambda s: s["strong"])).cast("binary"), 256).alias("base_sha256"), said(spans).alias("spans"))


def op8_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_secrets(documents(spark, sf_dir).select("doc_id", "text")))


QUERIES = {"op8_secret_links": op8_secret_links}
ORACLE_SQL: dict[str, str] = {}
