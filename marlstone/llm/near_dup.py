"""Near-duplicate documents by BagMinHash signatures of word shingles, banding, and verified multiset overlap.

A text is the bag of its shingles. Each shingle has Poisson processes of points in time: one over the weights [0, 1)
and one over each doubled range [1, 2), [2, 4), ... above, each seeded by the shingle and the range. A point has a
component of the signature and a weight level; a text sees the points whose level is below its own count of the
shingle. The signature keeps the first time of each component, so two signatures agree in a component with the
probability of the bags' weighted Jaccard similarity. A process stops once its time exceeds the latest entry of the
signature, which is why most shingles cost one or two points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, ship, stored, trim
from .decontaminate import words_of

#: Words of a shingle; the least similarity of a link.
SHINGLE, SIMILARITY = 5, 0.8
#: Components of a signature: BANDS bands of ROWS. Two bags of similarity 0.8 share no band with probability 0.0002.
BANDS, ROWS = 16, 4
#: Rounds in which each bucket is compared with one member, before the pairs that are left are compared.
STAR_ROUNDS = 3
#: Buckets of at most this many bags are expanded into pairs; larger ones are compared in blocks of about so many bags and so many items at most.
PAIRED, BLOCK, BLOCK_ITEMS = 12, 1024, 1 << 19
#: Distinct shingles that a block's product takes at a time.
STRIPE = 2048
#: Bytes of text hashed at a time.
CHUNK = 1 << 20
_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_GOLDEN), -1, 1 << 64))
        one = np.ones(1, dtype=np.uint64)
        _POWERS[:] = [np.concatenate((one, np.cumprod(np.full(n, b, dtype=np.uint64)))) for b in (_GOLDEN, inverse)]
    return _POWERS[0], _POWERS[1]


def shingles(texts: list[str | bytes | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and 64-bit hashes of all shingles: size consecutive words, or all words of a shorter text."""
    joined = [b" ".join(words_of(t)) for t in texts]
    buffer = np.frombuffer(b"\n".join([*joined, b""]), dtype=np.uint8)
    breaks = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.concatenate(([0], breaks[:-1] + 1))
    document = np.cumsum(buffer[breaks] == 10) - (buffer[breaks] == 10)
    solid = starts < breaks  # a text without words leaves an empty one
    starts, ends, document = starts[solid], breaks[solid], document[solid]
    n = np.bincount(document, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    rank = np.arange(len(starts)) - first[document]
    begin = np.flatnonzero((rank + size <= n[document]) | ((rank == 0) & (n[document] < size)))
    last = np.minimum(begin + size, first[document[begin]] + n[document[begin]]) - 1
    power, inverse = _powers(len(buffer) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)])))
    a, b = starts[begin], ends[last]
    return document[begin], mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))


def bags(document: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their counts, ordered by document."""
    order = np.lexsort((shingle, document))
    document, shingle = document[order], shingle[order]
    new = np.flatnonzero(np.concatenate(([True], (document[1:] != document[:-1]) | (shingle[1:] != shingle[:-1])))) if len(order) else np.zeros(0, dtype=np.int64)
    return document[new], shingle[new], np.diff(np.concatenate((new, [len(order)])))


def bag_minhash(document: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, size: int = BANDS * ROWS) -> np.ndarray:
    """n signatures; a document without shingles has infinities."""
    signature = np.full(n * size, np.inf)
    owner, seed, rate, level = [], [], [], []
    low, k = 0, 0
    while len(document):  # the ranges [0, 1), [1, 2), [2, 4), ...: those that start below a shingle's count
        width = max(1, low)
        owner.append(document)
        seed.append(mix(shingle + np.uint64((k + 1) * int(_GOLDEN) & (1 << 64) - 1)))
        rate.append(np.full(len(document), float(width)))
        level.append((count - low) / width)
        low += width
        k += 1
        more = count > low
        document, shingle, count = document[more], shingle[more], count[more]
    if not owner:
        return signature.reshape(n, size)
    owner, seed, rate, level = map(np.concatenate, (owner, seed, rate, level))
    time, state = np.zeros(len(owner)), seed
    while len(owner):
        state = state + _GOLDEN
        r = mix(state)
        time = time - np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        keep = time < signature.reshape(n, size).max(axis=1)[owner]
        owner, state, rate, level, time = owner[keep], state[keep], rate[keep], level[keep], time[keep]
        r = mix(r[keep] ^ _M2)
        seen = (r >> np.uint64(32)).astype(np.float64) * 2.0**-32 < level
        component = (r & np.uint64(0xFFFFFFFF)) % np.uint64(size)
        np.minimum.at(signature, (owner * size + component.astype(np.int64))[seen], time[seen])
    return signature.reshape(n, size)


def _keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of a signature."""
    part = signature.view(np.uint64).reshape(-1, bands, rows)
    key = np.zeros(part.shape[:2], dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _GOLDEN
    for i in range(rows):
        key = mix(key ^ part[:, :, i]) * _GOLDEN
    return key.view(np.int64)


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Parts of a column (first, end, texts) of CHUNK bytes and what the last text is longer."""
    start, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t.as_py())
        size += len(part[-1] or "")
        if size >= CHUNK or i == len(texts) - 1:
            yield start, i + 1, part
            start, part, size = i + 1, [], 0
    trim()


def _bag_names(document: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> pa.Array:
    """A 128-bit hash of each bag; null for one without shingles."""
    size = np.bincount(document, weights=count, minlength=n).astype(np.uint64)
    halves = np.empty((n, 2), dtype=np.uint64)
    for k, m in enumerate((_M1, _M2)):
        total = np.zeros(n, dtype=np.uint64)
        np.add.at(total, document, mix(mix(shingle * _GOLDEN + m) ^ (count.astype(np.uint64) * m)))
        halves[:, k] = mix(total + size)
    offsets = pa.py_buffer(np.arange(0, 16 * n + 1, 16, dtype=np.int32).tobytes())
    names = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(halves.tobytes())])
    return pa.array(names.to_pylist(), pa.binary(), mask=size == 0) if (size == 0).any() else names


def _sketch(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _chunks(batch.column("t")):
                n = b - a
                own = bags(*shingles(texts, size))
                keys = _keys(bag_minhash(*own, n, bands * rows), bands, rows)
                sizes = np.bincount(own[0], weights=own[2], minlength=n).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), batch.column("x").slice(a, n), _bag_names(*own, n), pa.array(sizes), lists], names=["doc_id", "x", "bag", "n", "keys"])

    return run


def _items(size: int):
    """bag and items: the shingles of a text, the second and later of one shingle hashed with their number; so bags overlap as these sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _chunks(batch.column("t")):
                n = b - a
                document, shingle, count = bags(*shingles(texts, size))
                which = np.repeat(np.arange(len(count)), count)
                number = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
                items = np.where(number == 0, shingle[which], mix(shingle[which] + number.astype(np.uint64) * _M1)).view(np.int64)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(document, weights=count, minlength=n).astype(np.int64)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_bag_names(document, shingle, count, n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(items))], names=["bag", "items"])

    return run


def components(links: DataFrame) -> DataFrame:
    """links: a, b (a <> b). Each linked node with the least node of its component: node, label.

    Labels go to neighbours and then jump to the label's own label, so the rounds grow with the logarithm of a
    component's width. Each round is written out; the driver sees one count.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("least"))
        hooked = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = hooked.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        fresh = stored(fresh, "labels")
        drop_stored(labels)
        labels = fresh
        if labels.where("old <> label").limit(1).count() == 0:
            drop_stored(both)
            return labels.select("node", "label")


def _verify(pairs: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """pairs: a, b (bags). Those whose bags overlap enough."""
    x, y = items.select(F.col("bag").alias("a"), F.col("items").alias("x")), items.select(F.col("bag").alias("b"), F.col("items").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _rows(docs: DataFrame) -> DataFrame:
    """docs with x, a hash of the text; doc_id and x name a row up to repetition."""
    return docs.withColumn("x", F.xxhash64(F.col("text").cast("binary")))


def _same_row(a: DataFrame, b: DataFrame):
    return (a["x"] == b["x"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _classify(docs: DataFrame, similarity: float, size: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, x, t (binary). Sketches (doc_id, x, bag), and bag with first: null flag, doc_id and x of its class's first row. Both are stored."""
    ship(docs.sparkSession)
    made = docs.mapInArrow(_sketch(bands, rows, size), "doc_id long, x long, bag binary, n long, keys array<long>")
    made = stored(made, "sketches")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "x"))
    found = stored(made.where("bag is not null").groupBy("bag").agg(rep.alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")), "bags")
    # what is aggregated by key is written before it is joined, so that adaptive execution can split a hot key's bags
    keys = found.select("bag", "n", F.explode("keys").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"), "shared")
    buckets = stored(keys.join(shared, "key"), "buckets")
    drop_stored(shared)

    wanted = buckets.select("bag").distinct().join(found.select("bag", "rep"), "bag").select("rep.doc_id", "rep.x")
    items = docs.join(wanted, _same_row(docs, wanted), "left_semi").select("t").mapInArrow(_items(size), "bag binary, items array<long>")
    items = stored(items.groupBy("bag").agg(F.first("items").alias("items")), "items")

    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        now = buckets.withColumn("label", F.col("bag")) if labels is None else buckets.join(labels.withColumnRenamed("node", "bag"), "bag", "left").withColumn("label", F.coalesce("label", "bag"))
        if turn < STAR_ROUNDS:
            hubs = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("bag", F.lit(turn)), F.col("bag").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))).alias("h"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "h.hub", "h.hub_n", "h.hub_label")
            hubs = stored(hubs, "hubs")
            pairs = now.join(hubs, "key").where("label <> hub_label").where(F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n")).select(F.least("bag", "hub").alias("a"), F.greatest("bag", "hub").alias("b")).distinct()
            new = stored(_verify(pairs, items, similarity), "new-links")
            over = hubs.limit(1).count() == 0
            drop_stored(hubs)
        else:
            new, over = stored(_rest(now, items, similarity), "new-links"), True
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            if labels is not None:
                drop_stored(labels)
            labels = components(links)
        else:
            drop_stored(new)
        if over:
            break

    classes = found.select("bag", "rep")
    if labels is not None:
        joined = classes.join(labels.withColumnRenamed("node", "bag"), "bag", "left").select("bag", "rep", F.coalesce("label", "bag").alias("label"))
        least = stored(joined.groupBy("label").agg(F.min("rep").alias("first")), "least")
        classes = joined.join(least, "label").select("bag", "first")
    else:
        classes = classes.withColumnRenamed("rep", "first")
    classes = stored(classes, "classes")
    if labels is not None:
        drop_stored(labels, links, least)
    drop_stored(found, buckets, items)
    return made.select("doc_id", "x", "bag"), classes


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id (the least doc_id of its class), representative.

    A class is a connected component of links; a link joins two texts whose bags of shingles have a weighted Jaccard
    similarity of `similarity` or more. Words are runs of letters and digits, A-Z lower-cased. Texts with equal bags
    are one bag before anything is compared. A text without words (null, empty) is in a class of its own. A null
    doc_id is in the class of its text but never names it; such a row isn't a representative, and its class_id is
    null if no id is in the class. Rows with one doc_id and different texts are different texts, in different classes
    unless they are linked. Other columns are ignored. No rows: no rows.

    No bucket is expanded into pairs at first: in each round all bags of a bucket are compared with one of them, and
    verified links merge components. A bucket whose bags still lie in different components is then compared whole:
    as pairs if it has at most PAIRED bags, else two blocks of bags at a time, as a product of their incidence
    matrices, which gives at most one link per bag. So no candidate is dropped and no task holds a whole bucket.
    """
    narrow = _rows(docs.select(F.col("doc_id").cast("long"), "text")).select("doc_id", "x", F.col("text").cast("binary").alias("t"))
    made, classes = _classify(narrow, similarity, size, bands, rows)
    out = made.join(classes, "bag", "left")
    alone = F.col("bag").isNull()
    first = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.x") == F.col("x"))
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), (F.col("doc_id").isNotNull() & F.coalesce(alone | first, F.lit(False))).alias("representative"))


def _block_links(similarity: float):
    """Links between bags of two blocks in different components: as many as join components, no more."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n, bags_, label = len(rows), rows["bag"].to_numpy(), pd.factorize(rows["label"].map(bytes), sort=True)[0]
        sizes = rows["items"].map(len).to_numpy()
        owner = np.repeat(np.arange(n), sizes)
        _, element, often = np.unique(np.concatenate(rows["items"].to_list()), return_inverse=True, return_counts=True)
        shared = often > 1  # others are in no overlap
        number = np.cumsum(shared) - 1
        here = shared[element]
        owner, element = owner[here], number[element[here]]
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        overlap = np.zeros((n, n), dtype=np.float32)
        for low in range(0, int(shared.sum()), STRIPE):
            a, b = np.searchsorted(element, [low, low + STRIPE])
            some = np.zeros((n, STRIPE), dtype=np.float32)
            some[owner[a:b], element[a:b] - low] = 1
            overlap += some @ some.T
        linked = overlap >= similarity * (sizes[:, None] + sizes[None, :] - overlap) - 1e-3
        linked &= label[:, None] < label[None, :]
        i, j = np.nonzero(linked)
        exact = overlap[i, j].astype(np.int64)
        sure = exact >= similarity * (sizes[i] + sizes[j] - exact)
        i, j = i[sure], j[sure]
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up] if up in parent else up
                x = up
            return x

        pairs, at = np.unique(np.stack([label[i], label[j]]), axis=1, return_index=True)
        out = []
        for p, q, k in zip(*pairs.tolist(), at.tolist(), strict=True):
            if (p := root(p)) != (q := root(q)):
                parent[q] = p
                out.append((bags_[i[k]], bags_[j[k]]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def _rest(now: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """now: key, bag, n, label. Verified links between bags of a bucket in different components, enough to join them."""
    open_ = now.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "members", "total")
    open_ = stored(open_, "open")
    left = now.join(open_, "key").select("key", "members", "total", "bag", "n", "label")
    few = left.where(F.col("members") <= PAIRED)
    other = few.select("key", *[F.col(c).alias(f"other_{c}") for c in ("bag", "n", "label")])
    pairs = few.join(other, "key").where("bag < other_bag and label <> other_label")
    pairs = pairs.where(F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")).select(F.col("bag").alias("a"), F.col("other_bag").alias("b")).distinct()
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_ITEMS))
    many = left.where(F.col("members") > PAIRED).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("bag"), F.col("blocks")))
    many = many.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    many = many.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "bag", "label").join(items, "bag")
    blocked = many.groupBy("key", "i", "j").applyInPandas(_block_links(similarity), "a binary, b binary")
    return _verify(pairs, items, similarity).unionByName(blocked)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without the near duplicates, with all columns: of each class one row stays.

    It is the row of the least doc_id (rows without an id come last), and of several such texts the one of the least
    hash. Of rows with one doc_id and one text any one stays. Rows with one doc_id and texts of different classes
    stay apart, and so do rows without an id whose texts nothing else has. Texts without words all stay.
    """
    columns = docs.columns
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`").alias(c) for c in columns if c != "text"]).alias("_row"))
    whole = _rows(whole)
    made, classes = _classify(whole.select("doc_id", "x", F.col("text").cast("binary").alias("t")), similarity, size, bands, rows)
    first = classes.select("first.doc_id", "first.x").distinct()
    told = made.where("bag is not null").join(first, _same_row(made, first), "left_semi").groupBy("doc_id", "x").agg(F.count(F.lit(1)).alias("n"))
    told = told.unionByName(made.where("bag is null").select("doc_id", "x", F.lit(1).cast("long").alias("n")).distinct())
    told = stored(told, "kept")
    once, again = told.where("n = 1"), told.where("n > 1")
    out = whole.join(once, _same_row(whole, once), "left_semi")
    if again.limit(1).count():
        out = out.unionByName(whole.join(again, _same_row(whole, again), "left_semi").dropDuplicates(["doc_id", "x"]))
    return out.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in columns])
