"""Readers and writers of the text layouts of vector data, one object a line.

Every reader gives (id, label, payload): ids count from 0 in line order, a ``label:N`` prefix becomes the label
(null without one). Separators are blanks, tabs, commas and colons. A line that does not parse is an error that
names its line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = r"^label:(-?[0-9]+)\s+"
SPLIT = r"[\s,:]+"


def numbered(df: DataFrame) -> DataFrame:
    """Adds ``id`` from 0 in the order of the rows: counts of the partitions before, and places within one."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["p"]: r["n"] for r in marked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one number a partition
    starts, total = {}, 0
    for p in sorted(counts):
        starts[p] = total
        total += counts[p]
    if not starts:
        return marked.withColumn("id", F.lit(0).cast("long")).drop("_m")
    table = F.create_map(*(F.lit(x) for p, s in starts.items() for x in (p, s)))
    return marked.withColumn("id", (F.element_at(table, part) + place).cast("long")).drop("_m")


def _lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = numbered(spark.read.text(path)).where(F.trim("value") != "")
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    label = F.regexp_extract("value", LABEL, 1)
    return rows.select("id", F.when(label != "", label).cast("int").alias("label"), F.trim(F.regexp_replace("value", LABEL, "")).alias("body"))


def _numbers(body: Column) -> Column:
    return F.split(body, SPLIT).cast("array<double>")


def _checked(ok: Column, what: str, value: Column, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}, line "), F.col("id").cast("string"))).cast(kind))


def read_dense(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Vectors of one width, that of the first line."""
    rows = _lines(spark, path, limit).withColumn("vec", _numbers(F.col("body")))
    first = rows.orderBy("id").select(F.size("vec")).first()
    width = first[0] if first else 0
    return rows.select("id", "label", _checked(F.size("vec") == width, f"expected {width} elements", F.col("vec"), "array<double>").alias("vec"))


def read_sparse(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``id val id val ...``; ids must differ."""
    rows = _lines(spark, path, limit).withColumn("_n", _numbers(F.col("body")))
    entries = F.array_sort(F.transform(F.sequence(F.lit(1), F.size("_n") - 1, F.lit(2)), lambda i: F.struct(F.element_at("_n", i.cast("int")).cast("int").alias("dim"), F.element_at("_n", (i + 1).cast("int")).alias("val"))))
    dims = F.transform(entries, lambda e: e["dim"])
    return rows.select("id", "label", _checked((F.size("_n") % 2 == 0) & (F.size(F.array_distinct(dims)) == F.size(dims)), "odd or repeated entries", entries, "array<struct<dim:int,val:double>>").alias("vec"))


def read_sets(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return _lines(spark, path, limit).select("id", "label", F.array_sort(F.split("body", SPLIT).cast("array<int>")).alias("items"))


def read_bits(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``0 1 1 0 ...``; other tokens are errors. Bit i stands in word i div 32 at place i mod 32."""
    rows = _lines(spark, path, limit).withColumn("_b", F.split("body", SPLIT))
    ok = ~F.exists("_b", lambda t: ~t.isin("0", "1"))
    word = lambda w: F.aggregate(F.transform(F.slice("_b", w * 32 + 1, F.lit(32)), lambda t, i: F.when(t == "1", F.expr("bigint(1)") * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size("_b") - 1) / 32).cast("int")), lambda w: signed(word(w)))
    return rows.select("id", "label", _checked(ok, "a bit is 0 or 1", words, "array<int>").alias("words"), F.size("_b").alias("nbits"))


def read_strings(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``label:N text``; the label must be there."""
    rows = _lines(spark, path, limit)
    return rows.select("id", _checked(F.col("label").isNotNull(), "no label", F.col("label"), "int").alias("label"), F.col("body").alias("s"))


def read_sift(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """128 whole numbers from 0 to 255, and their squared norm."""
    rows = _lines(spark, path, limit).withColumn("vec", F.split("body", SPLIT).cast("array<int>"))
    ok = (F.size("vec") == 128) & ~F.exists("vec", lambda x: (x < 0) | (x > 255))
    return rows.select("id", "label", _checked(ok, "expected 128 bytes", F.col("vec"), "array<int>").alias("vec")).withColumn("sqnorm", F.aggregate("vec", F.lit(0), lambda a, x: a + x * x))


def read_words(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``word v1 v2 ...``; the word is the external id."""
    rows = numbered(spark.read.text(path)).where(F.trim("value") != "")
    if limit is not None:
        rows = rows.orderBy("id").limit(limit)
    return rows.select("id", F.regexp_extract("value", r"^(\S+)", 1).alias("extern_id"), _numbers(F.trim(F.regexp_replace("value", r"^\S+\s+", ""))).alias("vec"))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """Records parted by blank lines; each line of a record is a centroid and its weight last. The first block is a header."""
    blocks = numbered(spark.read.option("lineSep", "\n\n").text(path)).where(F.trim("value") != "").where("id > 0")
    lines = F.filter(F.split(F.trim("value"), "\n"), lambda x: F.trim(x) != "")
    cluster = lambda x: F.element_at(F.transform(F.array(F.split(F.trim(x), SPLIT).cast("array<double>")), lambda n: F.struct(F.slice(n, F.lit(1), F.size(n) - 1).alias("centroid"), F.element_at(n, -1).alias("weight"))), 1)
    return blocks.select((F.col("id") - 1).alias("id"), F.transform(lines, cluster).alias("clusters"))


def read_weights(lines: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Index-time and query-time weights of fusion parts from lines ``part index_weight query_weight``."""
    index, query = {}, {}
    for n, line in enumerate(lines, 1):
        if not line.strip():
            continue
        parts = line.split()
        if len(parts) != 3 or parts[0] in index:
            raise ValueError(f"expected a part and two weights, line {n}")
        index[parts[0]], query[parts[0]] = float(parts[1]), float(parts[2])
    return index, query


def read_texmex(spark: SparkSession, path: str, kind: str = "f") -> DataFrame:
    """Binary vectors, each with its width first: ``f`` floats, ``i`` whole numbers, ``b`` bytes."""
    import numpy as np
    import pandas as pd

    size, dtype = {"f": (4, "<f4"), "i": (4, "<i4"), "b": (1, "u1")}[kind]

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                at, i = 0, 0
                rows = []
                while at < len(data):
                    width = int(np.frombuffer(data, "<i4", 1, at)[0])
                    rows.append((i, np.frombuffer(data, dtype, width, at + 4).astype(float).tolist()))
                    at, i = at + 4 + width * size, i + 1
                yield pd.DataFrame(rows, columns=["id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "id long, vec array<double>")


SPARSE_BINARY = "id long, extern_id string, vec array<struct<dim:int,val:float>>"


def read_sparse_binary(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian records: a count of objects, then for each an id (length and bytes) and a counted list of (uint32, float)."""
    import struct

    import pandas as pd

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                (n,), at, out = struct.unpack_from("<I", data, 0), 4, []
                for i in range(n):
                    (size,) = struct.unpack_from("<I", data, at)
                    name = data[at + 4 : at + 4 + size].decode()
                    at += 4 + size
                    (count,) = struct.unpack_from("<I", data, at)
                    at += 4
                    pairs = [struct.unpack_from("<If", data, at + 8 * j) for j in range(count)]
                    at += 8 * count
                    out.append((i, name, [{"dim": d, "val": v} for d, v in sorted(pairs)]))
                yield pd.DataFrame(out, columns=["id", "extern_id", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SPARSE_BINARY)


def fusion_parts(head: bytes) -> tuple[int, list[tuple[bool, int]]]:
    """Records and, for each part of a record, whether it is sparse and its width, from the start of a file."""
    import struct

    n, parts = struct.unpack_from("<II", head, 0)
    return n, [(bool(flag), width) for flag, width in (struct.unpack_from("<II", head, 8 + 8 * i) for i in range(parts))]


#: Parts of a combined record, at most.
MOST_PARTS = 256


def read_fusion(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian records of several vectors: id, extern_id and ``vec``, a struct of parts ``p0``, ``p1`` ...

    A file starts with the number of records and of parts, and a sparsity flag and a width for each part. A record has
    an id (length and bytes), then its parts: a counted list of (uint32, float), or the floats of a dense one.
    """
    import struct

    import numpy as np
    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")
    first = files.select(F.substring("content", 1, 8 + 8 * MOST_PARTS).alias("h")).first()
    if first is None:
        raise ValueError("no file of records")
    _, parts = fusion_parts(bytes(first["h"]))
    if len(parts) > MOST_PARTS:
        raise ValueError(f"at most {MOST_PARTS} parts")
    kinds = ", ".join(f"p{i}: array<struct<dim:int,val:float>>" if sparse else f"p{i}: array<float>" for i, (sparse, _) in enumerate(parts))

    def run(frames):
        for frame in frames:
            for data in frame["content"]:
                n, own = fusion_parts(data)
                if own != parts:
                    raise ValueError("files of different parts")
                at, out = 8 + 8 * len(parts), []
                for i in range(n):
                    (size,) = struct.unpack_from("<I", data, at)
                    name = data[at + 4 : at + 4 + size].decode()
                    at += 4 + size
                    record = {}
                    for k, (sparse, width) in enumerate(parts):
                        if sparse:
                            (count,) = struct.unpack_from("<I", data, at)
                            pairs = sorted(struct.unpack_from("<If", data, at + 4 + 8 * j) for j in range(count))
                            record[f"p{k}"] = [{"dim": d, "val": v} for d, v in pairs]
                            at += 4 + 8 * count
                        else:
                            record[f"p{k}"] = np.frombuffer(data, "<f4", width, at).tolist()
                            at += 4 * width
                    out.append((i, name, record))
                yield pd.DataFrame(out, columns=["id", "extern_id", "vec"])

    return files.mapInPandas(run, f"id long, extern_id string, vec struct<{kinds}>")


def read_fusion_weights(lines: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Index-time and query-time weights of the parts of such records, from one line for each kind: ``queryWeights:``
    or ``indexWeights:`` and as many numbers as there are parts."""
    found: dict[str, list[float]] = {}
    for line in lines:
        name, colon, rest = line.strip().partition(":")
        if colon and name in ("queryWeights", "indexWeights"):
            found[name] = [float(x) for x in rest.replace(",", " ").split()]
    if len(found) != 2 or not found["queryWeights"] or len(found["queryWeights"]) != len(found["indexWeights"]):
        raise ValueError("expected as many query weights as index weights, and at least one")
    named = lambda values: {f"p{i}": v for i, v in enumerate(values)}
    return named(found["indexWeights"]), named(found["queryWeights"])


def _labelled(body: Column, label: bool) -> Column:
    return F.concat(F.coalesce(F.concat(F.lit("label:"), F.col("label").cast("string"), F.lit(" ")), F.lit("")), body) if label else body


def write_dense(df: DataFrame, path: str, payload: str = "vec") -> None:
    """One vector a line, every digit kept."""
    body = F.array_join(F.transform(payload, lambda x: x.cast("string")), " ")
    df.select(_labelled(body, "label" in df.columns)).write.text(path)


def write_sparse(df: DataFrame, path: str, payload: str = "vec") -> None:
    body = F.array_join(F.transform(payload, lambda e: F.concat_ws(" ", e["dim"].cast("string"), e["val"].cast("string"))), " ")
    df.select(_labelled(body, "label" in df.columns)).write.text(path)


def write_strings(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit("label:"), F.coalesce("label", F.lit(0)).cast("string"), F.lit(" "), F.col("s"))).write.text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Metrics as tab-separated text with a header."""
    df.coalesce(1).write.option("sep", "\t").option("header", True).csv(path)


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*(F.rand(seed + i) for i in range(dim))).alias("vec"))


def gaussian(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*(F.randn(seed + i) for i in range(dim))).alias("vec"))


def histograms(spark: SparkSession, n: int, dim: int, seed: int = 0) -> DataFrame:
    """Points spread evenly over the simplex."""
    from ..functions.vectors import distribution

    raw = spark.range(n).select("id", F.array(*(-F.ln(F.rand(seed + i)) for i in range(dim))).alias("vec"))
    return raw.withColumn("vec", distribution(F.col("vec"), 0.0))
