"""Removal of long byte strings that an earlier document has, by suffix sorting.

Every window of `window` bytes belongs to the least of its hashed k-grams, its anchor; equal windows have equal
anchors. So the corpus is cut into runs of windows around an anchor, and only runs whose anchor occurs in two
documents or more go on. Runs of equal bytes are one context, with the first and the last document that has it;
neighbouring runs that no other run can equal in part are one context together. The contexts of an anchor are laid end to end and suffix-sorted by linear grouping: suffixes are grouped by their
Lyndon prefix, the groups are processed from the greatest down along previous-smaller pointers, and each suffix then
takes the next place of its group, with no recursive renaming. Neighbours with a common prefix of a whole window are
occurrences of one string, and the least document among them is its first: every removal follows from this order.

An anchor with many contexts is split: each half of the window places around it shares a longer string, which takes
the anchor's part, until no group is larger than a sort may be.
"""

from __future__ import annotations

import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored
from .jvm import register
from .suffix_kernel import PACKAGE, SOURCE

#: Bytes of a window and of a k-gram; bytes that are suffix-sorted together, about (few, so that a sort stays in the cache); bytes of contexts of one anchor that aren't split.
WINDOW, GRAM, SORTED_BYTES, GROUP_BYTES = 50, 16, 1 << 16, 1 << 20
#: The runs of an anchor of more documents than this are aggregated before they are shuffled, and each is a context of its own.
FREQUENT = 1000
#: A join is hashed if no partition of one of its sides, whose rows are hashes and places, is larger than this.
HASHED_BYTES = 64 << 20

_LONG, _INT = T.LongType(), T.IntegerType()


def _rows(*fields: tuple[str, T.DataType]) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(*f) for f in fields]))


_PIECE = (("h", _LONG), ("c", _LONG), ("first", _LONG), ("last", _LONG), ("a", _INT), ("b", _INT))
_TOLD = _rows(("h", _LONG), ("c", _LONG), ("a", _INT), ("b", _INT), ("low", _LONG))
_RUNS = _rows(("h", _LONG), ("c", _LONG), ("frequent", T.BooleanType()))
_CONTEXTS = _rows(("h", _LONG), ("c", _LONG), ("first", _LONG), ("last", _LONG), ("at", _INT), ("bytes", T.BinaryType()), ("pieces", _rows(*_PIECE)))
_CUT = T.StructType([T.StructField("n_bytes", _LONG), T.StructField("n_removed", _LONG), T.StructField("spans", T.ArrayType(_INT)), T.StructField("kept_sha256", T.StringType())])


def install(spark: SparkSession) -> None:
    """Registers the kernel's functions with this session."""
    register(spark, SOURCE, PACKAGE, {"marlstone_hashes": ("Hashes", T.ArrayType(_LONG)), "marlstone_runs": ("Runs", _RUNS), "marlstone_pick": ("Pick", _CONTEXTS), "marlstone_earlier": ("Earlier", _TOLD), "marlstone_cut": ("Cut", _CUT), "marlstone_suffix_order": ("Order", T.ArrayType(_INT))})


def _stored(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name, HASHED_BYTES)


def _halves(contexts: DataFrame, window: int) -> DataFrame:
    """h, c, shift and the contexts that the two halves of each context's windows are: h2, c2, at, g, first, last, bytes.

    All windows of a context have the g bytes at place `at`. Those that start close before it share what follows
    too, and the others what stands before.
    """
    half, ends = F.floor((F.lit(window) - F.col("g")) / 2).cast("int"), F.length("bytes") - window
    low = F.greatest(F.col("at") - half, F.lit(0))
    high = F.least(ends, F.col("at") - half - 1)
    part = lambda valid, shift, size, at, g: F.when(valid, F.struct(shift.alias("shift"), F.substring("bytes", shift + 1, size).alias("bytes"), at.alias("at"), g.alias("g")))
    near = part(ends >= low, low, F.length("bytes") - low, F.col("at") - low, window - half)
    far = part(high >= 0, F.lit(0), high + window, F.col("at") - half - 1, F.col("g") + half + 1)
    parts = contexts.select("h", "c", "first", "last", F.posexplode(F.array(near, far)).alias("side", "p")).where("p is not null")
    parts = parts.select("h", "c", "first", "last", "side", "p.*")
    shared = F.xxhash64(F.substring("bytes", F.col("at") + 1, F.col("g")), "side")
    return parts.select("h", "c", "shift", shared.alias("h2"), F.conv(F.substring(F.md5("bytes"), 1, 15), 16, 10).cast("long").alias("c2"), "at", "g", "first", "last", "bytes")


def _told(contexts: DataFrame, window: int) -> DataFrame:
    """contexts: h, c, first, last, at, g, bytes, pieces. h, c, a, b, low: the windows of a piece that a document before its last one has, and the least such document."""
    sizes = contexts.where("at >= 0").groupBy("h").agg(F.sum(F.length("bytes") + 1).alias("size"))
    hot = _stored(sizes.where(F.col("size") > GROUP_BYTES).select("h"), "hot")
    few, split = contexts, hot.limit(1).count() > 0
    if split:
        few = contexts.join(hot, "h", "left_anti")
    total = few.agg(F.sum(F.length("bytes") + 1)).first()[0] or 0
    bucket = F.pmod("h", F.lit(max(1, -(-total // SORTED_BYTES))))
    laid = few.groupBy(bucket.alias("bucket")).agg(F.collect_list(F.struct("h", "c", "first", "last", "bytes", "pieces")).alias("all"))
    told = _stored(laid.select(F.explode(F.call_function("marlstone_earlier", "all", F.lit(window))).alias("r")).select("r.*"), "told")
    if split:
        halves = _stored(_halves(contexts.where("at >= 0").join(hot, "h"), window), "halves")
        own = halves.groupBy(F.col("h2").alias("h"), F.col("c2").alias("c")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first(F.struct("at", "g", "bytes")).alias("x"))
        inner = _stored(own.select("h", "c", "first", "last", "x.at", "x.g", "x.bytes", F.lit(None).cast(_rows(*_PIECE)).alias("pieces")), "contexts")
        deeper = _told(inner, window).withColumnsRenamed({"h": "h2", "c": "c2"})
        shift = halves.select("h", "c", "h2", "c2", "shift").join(deeper, ["h2", "c2"])
        found = _stored(shift.select("h", "c", (F.col("a") + F.col("shift")).alias("a"), (F.col("b") + F.col("shift")).alias("b"), "low"), "told")
        drop_stored(halves, inner)
        told = told.unionByName(found)
    drop_stored(hot)
    return told


def earlier_ranges(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """rows: d (long), u (a hash of d and t), t (binary). u and its ranges: h, c, and the first and last start inside the run of these bytes that a smaller d has."""
    spark = rows.sparkSession
    install(spark)
    sizes = (F.lit(window), F.lit(gram))
    hashes = rows.select("u", F.explode(F.call_function("marlstone_hashes", "t", *sizes)).alias("h"))
    shared = _stored(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") > FREQUENT).alias("frequent")), "anchors")
    # lists and ranges of a row have nothing twice, however often the row is repeated
    wanted = hashes.join(shared, "h").groupBy("u").agg(F.collect_set(F.when(~F.col("frequent"), F.col("h"))).alias("hs"), F.collect_set(F.when(F.col("frequent"), F.col("h"))).alias("often"))
    wanted = _stored(wanted, "wanted")
    drop_stored(shared)

    # h and c, 128 bits, stand for the bytes of a run
    runs = rows.join(wanted, "u").select("d", "u", F.explode(F.call_function("marlstone_runs", "t", *sizes, "hs", "often")).alias("r")).select("d", "u", "r.*")
    runs = _stored(runs, "runs")
    drop_stored(wanted)
    told = [F.min("d").alias("first"), F.max("d").alias("last"), F.min("u").alias("u")]
    # the anchors that aren't frequent have few rows, so all contents of one can meet
    anchor = Window.partitionBy("h")
    few = runs.where("not frequent").repartition("h").groupBy("h", "c").agg(*told)
    few = few.select("*", F.count(F.lit(1)).over(anchor).alias("m"), F.min("first").over(anchor).alias("low"), F.max("last").over(anchor).alias("high")).where("low < high")
    firsts = few.select("h", "c", "first", "last", "u", (F.col("m") == 1).alias("single"))
    firsts = firsts.unionByName(runs.where("frequent").groupBy("h", "c").agg(*told).withColumn("single", F.lit(False)))
    own_lists = _stored(firsts.groupBy("u").agg(F.collect_list(F.struct("h", "c", "first", "last", "single")).alias("cs")), "own")
    # contexts of a row that repeats are there as often as the row
    often = rows.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u", F.lit(True).alias("repeats"))
    own = own_lists.join(often, "u", "left").select("u", "cs", F.coalesce("repeats", F.lit(False)).alias("repeats"))
    picked = rows.select("u", "t").join(own, "u").select("repeats", F.explode(F.call_function("marlstone_pick", "t", *sizes, "cs")).alias("p"))
    picked = _stored(picked.select("repeats", "p.*", F.lit(gram).alias("g")), "contexts")
    drop_stored(own_lists)
    again = picked.where("repeats").groupBy("h", "c").agg(F.first(F.struct("first", "last", "at", "bytes", "pieces", "g")).alias("x")).select("h", "c", "x.*")
    contexts = picked.where("not repeats").drop("repeats").unionByName(again)

    told = _told(contexts, window)
    drop_stored(picked)
    found = runs.select("d", "u", "h", "c").join(told, ["h", "c"]).where("low < d").groupBy("u").agg(F.collect_set(F.struct("h", "c", "a", "b")).alias("ranges"))
    ranges = _stored(found, "ranges")
    drop_stored(runs, told)
    return ranges


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans.

    Texts are UTF-8 bytes; a null text is empty and a text shorter than the window loses nothing. Bytes covered by a
    window that also starts in a document with a smaller doc_id are removed; windows are judged on the input. spans:
    start and end of each maximal removed run, in bytes. Rows with one doc_id are one document: none is smaller than
    another; a row that repeats gives equal results. A null doc_id counts as 2^63 - 1, the greatest. No rows: no
    rows. Other columns of docs are ignored.
    """
    t = F.coalesce(F.col("text").cast("binary"), F.lit(bytearray()))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("d"), t.alias("t"), F.col("doc_id").cast("long").alias("doc_id"))
    rows = rows.withColumn("u", F.xxhash64("d", "t"))
    ranges = earlier_ranges(rows.select("d", "u", "t"), window, gram)
    cut = rows.join(ranges, "u", "left").select("doc_id", F.call_function("marlstone_cut", "t", "ranges", F.lit(window), F.lit(gram)).alias("cut"))
    return cut.select("doc_id", "cut.n_bytes", "cut.n_removed", (F.size("cut.spans") / 2).cast("long").alias("n_spans"), "cut.kept_sha256", "cut.spans")
