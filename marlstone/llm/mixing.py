"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in native expressions.

A document's key is an exponential variable divided by its quality weight. Each source takes complete epochs first,
then the documents with the smallest keys until their sizes reach the rest of the source's budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop_stored, stored

#: A source's keys are dealt into so many parts at least for the prefix sums, and one for so many rows of all sources.
PARTS, PART_ROWS = 4096, 100_000
#: Least and greatest quality weight; a part holds at most their quotient times its share of a source.
LEAST_WEIGHT, MOST_WEIGHT = 0.25, 1.0
#: A table with one short row per source is broadcast up to so many sources and bytes of their names; beyond, it is joined through a shuffle.
BROADCAST_SOURCES, BROADCAST_NAMES = 50_000, 4 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """1 where the mean word has 3 to 13 characters, its spaces counted; less the farther it is from that, LEAST_WEIGHT at least and for a null."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    fit = F.least(F.lit(MOST_WEIGHT), mean / F.lit(3.0), F.lit(13.0) / F.greatest(mean, F.lit(1e-9)))
    return F.when(text.isNull(), F.lit(LEAST_WEIGHT)).otherwise(F.greatest(F.lit(LEAST_WEIGHT), fit))


def exponential(name: Column, seed: str) -> Column:
    """-ln(u) with u in (0, 1) from the first 52 bits of an MD5 of the seed and the name: the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52)))


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, in code point order of the sources, null last: ranges of sources are numbered apart."""
    order = F.col("source").asc_nulls_last()
    ranged = stored(sizes.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranged.withColumn("own", own).join(F.broadcast(before), "range").select("source", "source_size", (F.col("before") + F.col("own")).alias("rank"))


def targets(sizes: DataFrame, pattern: Sequence[float], share: float, cap: float) -> DataFrame:
    """sizes: a row per source (source, source_size). Adds target and epochs.

    Sources in code point order, null last, weigh pattern, repeated. They share `share` of all sizes by weight; a
    target stops at cap times its source's size and the excess goes to the others by weight, until none is above.
    Each round of that is a sum over the sources; nothing needs all of them in one place.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (F.pmod("rank", F.lit(len(pattern))) + 1).cast("int"))
    s = stored(_ranked(sizes).select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(cap))).alias("most")), "weighed")
    everything = (s.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    level, full = -1.0, -1
    while True:  # the level rises with every round, and each makes at least one source full
        below = F.col("most") < F.lit(level) * F.col("w")
        told = s.agg(F.sum(F.when(below, F.col("most"))), F.sum(F.when(~below, F.col("w"))), F.count(F.when(below, 1))).first()
        if told[2] == full or not told[1]:
            break
        full, level = told[2], (everything - (told[0] or 0.0)) / told[1]
    s = s.select("source", "source_size", F.when(F.col("source_size") > 0, F.least(F.col("most"), F.lit(level) * F.col("w"))).otherwise(F.lit(0.0)).alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return s.select("*", epochs.alias("epochs"))


def mix(docs: DataFrame, pattern: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", keep: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies, and the columns named in keep.

    docs: doc_id, text, source. weight: a column of quality weights, held between LEAST_WEIGHT and MOST_WEIGHT (null:
    the least); without it they follow from the text. size: words of the text (null: 0). copies: how often the mix takes the document;
    taken: its words, repeats counted. A document is selected for the last, partial epoch if the middle of its
    words lies before the end of the budget, so a source misses its target by half a document at most. Rows of one
    doc_id and weight go together; rows without an id go together if they have one text; a null source is a source. Sources without words take
    nothing. No rows: no rows. Columns of docs that aren't in keep are ignored.

    The keys and sizes are written once. Sizes are summed by source and part of the key range before anything is
    sorted: only the one part of a source in which its budget ends is sorted, and the decision comes back as one row
    per source.
    """
    size = word_count(F.col("text"))
    told = quality_weight(F.col("_text"), F.col("_size")) if weight is None else F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(F.col("_weight"), F.lit(0.0))))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text").alias("_text"), size.alias("_size"), *([] if weight is None else [F.col(weight).cast("double").alias("_weight")]), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    name = F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("_text", F.lit("")).cast("binary"))))
    rows = rows.withColumn("_key", exponential(name, seed) / told)
    units = stored(rows.select("_source", "_key", "_id", "_size"), "units")
    n_parts = max(PARTS, units.count() // PART_ROWS)
    dealt = lambda df: df.withColumn("_part", F.least(F.floor((1 - F.exp(-F.col("_key") * LEAST_WEIGHT)) * n_parts), F.lit(n_parts - 1)).cast("int"))
    # without columns to keep, the units are all that the result needs
    rows = dealt(rows if keep else units)
    units = dealt(units).select(F.col("_source").alias("source"), F.col("_part").alias("part"), F.col("_key").alias("key"), F.col("_id").alias("id"), F.col("_size").alias("size"))

    parts = stored(units.groupBy("source", "part").agg(F.sum("size").alias("size")), "parts")
    sizes = stored(parts.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    count, letters = sizes.agg(F.count(F.lit(1)), F.sum(F.octet_length("source"))).first()
    small = F.broadcast if count <= BROADCAST_SOURCES and (letters or 0) <= BROADCAST_NAMES else (lambda df: df)
    sources = targets(sizes, pattern, share, cap)
    after = F.sum("size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    running = parts.select("source", "part", (after - F.col("size")).alias("before"), after.alias("after"))
    rest = (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest")
    named = stored(sources.select(F.col("source").alias("of"), "source_size", "target", "epochs", rest), "targets")
    last = running.join(small(named), F.col("source").eqNullSafe(F.col("of"))).where((F.col("before") < F.col("rest")) & (F.col("after") >= F.col("rest"))).select("of", F.col("part").alias("last_part"), "before", "rest")
    last = stored(last, "last")

    inside = units.join(small(last), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("last_part")))
    inside = inside.groupBy("of", "last_part", "rest", "before", "key", "id").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("of").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(order) - F.col("size") / 2
    ends = inside.withColumn("middle", middle).groupBy("of", "last_part").agg(F.max(F.when(F.col("middle") < F.col("rest"), F.struct("key", F.coalesce("id", F.lit(-(1 << 63))).alias("id")))).alias("end"))

    # one row per source from here on
    told = stored(named.join(ends.withColumnRenamed("of", "of2"), F.col("of").eqNullSafe(F.col("of2")), "left").select("of", "source_size", "target", "epochs", "last_part", "end"), "told")
    drop_stored(parts, sizes, named, last)
    out = rows.join(small(told), F.col("_source").eqNullSafe(F.col("of")), "left")
    mine = F.struct(F.col("_key").alias("key"), F.coalesce("_id", F.lit(-(1 << 63))).alias("id"))
    picked = (F.col("_part") < F.col("last_part")) | ((F.col("_part") == F.col("last_part")) & F.col("end").isNotNull() & (mine <= F.col("end")))
    copies = (F.col("epochs") + F.when(picked, 1).otherwise(0)).cast("long")
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (copies * F.col("_size")).alias("taken"), copies.alias("copies"), *[F.col(f"_keep_{c}").alias(c) for c in keep if c != "doc_id"])
