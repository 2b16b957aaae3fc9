"""Benchmark decontamination with an FM-index per training shard.

The words of a shard's documents are indexed (suffix array, Burrows-Wheeler transform, wavelet matrix, sampled suffix
positions). Every window of the benchmark is searched backwards through the ranks of the wavelet matrix, its
occurrences are located by walking to a sampled position, and the word spans of a document are merged for removal.

Words that no benchmark item has can't be part of a match: runs of them are one separator in the index.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, ship, stored, trim

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Words of documents in one index, positions between sampled suffixes, bytes of benchmark text searched in one pass.
SHARD_WORDS, SAMPLE, BLOCK_BYTES = 400_000, 8, 8 << 20
#: Words of an item that are one piece; pieces overlap by what a window may cross.
PIECE_WORDS = 50_000
END, GAP, FIRST = 0, 1, 2
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SPACED = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_ASCII_LOWER = {b: b + 32 for b in range(65, 91)}


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words, A-Z lower-cased, as UTF-8; a null has none."""
    raw = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return raw.translate(_SPACED).split() if raw else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of words_of(text) stand, in characters."""
    return [m.span() for m in _WORD.finditer(text.translate(_ASCII_LOWER))]


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """The order of all suffixes of text, whose last symbol is its least and occurs once.

    The first sort takes as many symbols as fit in 62 bits; then only the suffixes that still tie are sorted, by the
    rank of the suffix that follows the part they share.
    """
    n, bits = len(text), max(1, int(sigma - 1).bit_length())
    step = max(1, min(62 // bits, 8))
    key = np.zeros(n, dtype=np.int64)
    for i in range(step):
        key <<= bits
        if i < n:
            key[: n - i] |= text[i:]
    order = np.argsort(key)
    key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    while True:
        single = first & np.concatenate((first[1:], [True]))
        tied = np.flatnonzero(~single)
        if not len(tied):
            return order
        suffixes = order[tied]
        after = suffixes + step
        key = rank[suffixes] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        key, suffixes = key[by], suffixes[by]
        order[tied] = suffixes
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        first[tied] = fresh
        rank[suffixes] = np.maximum.accumulate(np.where(fresh, tied, 0))
        step *= 2


class WaveletMatrix:
    """Rank and access on a sequence of symbols, for arrays of positions at once."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (symbols >> level) & 1
            ones = np.zeros(len(symbols) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            low = bit == 0
            symbols = np.concatenate((symbols[low], symbols[~low]))

    def down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` of the sequence falls in the last level if one follows the bits of symbol."""
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros, strict=True):
            k = ones[at]
            at = np.where((symbol >> level) & 1, zeros + k, at - k)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position at."""
        return self.down(symbol, at) - self.down(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), dtype=np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            k = ones[at]
            bit = ones[at + 1] - k
            symbol = symbol * 2 + bit
            at = np.where(bit, zeros + k, at - k)
        return symbol


class FMIndex:
    """text: symbols from GAP on; END is added."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        text = np.concatenate((text, [END])).astype(np.int64)
        order = suffix_array(text, sigma)
        self.n = len(text)
        self.bwt = WaveletMatrix(text[order - 1], sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.sampled = order % sample == 0
        self.before = np.concatenate(([0], np.cumsum(self.sampled)))
        self.positions = order[self.sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """windows: a row of symbols each. The interval of suffixes that start with each; empty where start = end."""
        live = np.arange(len(windows))
        low, high = np.zeros(len(windows), dtype=np.int64), np.full(len(windows), self.n, dtype=np.int64)
        for column in reversed(range(windows.shape[1])):
            symbol = windows[live, column]
            base = self.less[symbol] - self.bwt.down(symbol, np.zeros(len(live), dtype=np.int64))
            low[live] = base + self.bwt.down(symbol, low[live])
            high[live] = base + self.bwt.down(symbol, high[live])
            live = live[low[live] < high[live]]
        found = np.zeros(len(windows), dtype=bool)
        found[live] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the index."""
        out, steps = np.empty(len(rows), dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows]
            out[live[done]] = self.positions[self.before[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            symbol = self.bwt.access(rows)
            rows = self.less[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out


def _split(window: int):
    """item and words of its pieces, joined; `short` if the item has fewer words than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                w = words_of(text.as_py())
                starts = range(0, max(1, len(w) - window + 1), PIECE_WORDS) if w else ()
                parts = [b" ".join(w[i : i + PIECE_WORDS + window - 1]) for i in starts]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], names=["item", "piece", "words"])

    return run


def _pack(window: int):
    """The pieces of a block as one row of packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [(i.as_py(), w.as_py()) for batch in batches for i, w in zip(batch.column("item"), batch.column("words"), strict=True)]
        if pieces:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(pack(pieces, window), protocol=5)], pa.binary())], names=["packed"])

    return run


def pack(pieces: list[tuple[str, bytes]], window: int = WINDOW) -> dict:
    """pieces: item and its words, joined. The distinct words, all words as numbers, and of each piece its item, start and length."""
    ids: dict[bytes, int] = {}
    items: dict[str, int] = {}
    streams, own = [], []
    for item, joined in pieces:
        w = joined.split()
        streams.append(np.fromiter((ids.setdefault(x, len(ids) + FIRST) for x in w), dtype=np.int32, count=len(w)))
        own.append(items.setdefault(item, len(items)))
    lengths = np.array([len(x) for x in streams], dtype=np.int64)
    return {"words": b" ".join(ids), "stream": np.concatenate(streams), "lengths": lengths, "own": np.array(own, dtype=np.int32), "items": list(items), "window": window}


class Phrases:
    """The windows of a block of benchmark items. They are places in the items' words; nothing is stored for each."""

    def __init__(self, packed: dict):
        self.ids = {w: i + FIRST for i, w in enumerate(packed["words"].split())}
        self.stream, self.items, window = packed["stream"], packed["items"], packed["window"]
        lengths = packed["lengths"]
        first = np.cumsum(lengths) - lengths
        self.sigma = len(self.ids) + FIRST
        sizes = np.minimum(lengths, window)
        self.shortest = int(sizes.min(initial=window))
        self.by_length = []
        for n in np.unique(sizes):
            piece = np.flatnonzero(sizes == n)
            count = lengths[piece] - n + 1
            which = np.repeat(np.arange(len(piece)), count)
            starts = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + first[piece][which]
            self.by_length.append((int(n), starts.astype(np.int32), packed["own"][piece][which]))

    def hits(self, texts: list[list[bytes]]) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of the texts, laid end to end, are hit, and the items with a window in each text that has one."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        total = int(starts[-1])
        none, out = np.zeros(total, dtype=bool), {}
        symbols = np.fromiter((s for t in texts for s in map(self.ids.get, t, repeat(GAP))), dtype=np.int64, count=total)
        # one GAP between texts, and one for each run of words that no item has; `at` maps back to the words
        place = np.flatnonzero(symbols != GAP)
        if not len(place):
            return none, out
        owner = np.repeat(np.arange(len(texts)), lengths)[place]
        new = np.concatenate(([False], (np.diff(place) > 1) | (np.diff(owner) > 0)))
        runs = np.cumsum(new)
        long_enough = np.bincount(runs)[runs] >= self.shortest
        place, runs = place[long_enough], runs[long_enough]
        if not len(place):
            return none, out
        new = np.concatenate(([False], np.diff(runs) > 0))
        to = np.arange(len(place)) + np.cumsum(new)
        text = np.full(int(to[-1]) + 2, GAP, dtype=np.int64)
        at = np.zeros(len(text), dtype=np.int64)
        text[to], at[to] = symbols[place], place
        index = FMIndex(text, self.sigma)
        absent = np.bincount(text, minlength=self.sigma)[self.stream] == 0
        missing = np.concatenate(([0], np.cumsum(absent, dtype=np.int32)))
        edges = np.zeros(total + 1, dtype=np.int64)
        for n, begin, item in self.by_length:
            here = np.flatnonzero(missing[begin + n] == missing[begin])  # windows all of whose words the shard has
            low, high = index.search(self.stream[begin[here][:, None] + np.arange(n)])
            sizes = high - low
            if not sizes.any():
                continue
            which = np.repeat(here, sizes)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
            first = at[index.locate(rows)]
            np.add.at(edges, first, 1)
            np.add.at(edges, first + n, -1)
            document = np.searchsorted(starts, first, side="right") - 1
            for pair in np.unique(document * len(self.items) + item[which]):
                out.setdefault(int(pair) // len(self.items), set()).add(self.items[int(pair) % len(self.items)])
        return np.cumsum(edges[:-1]) > 0, out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    out, last = [], 0
    for a, b in spans:
        out += [text[last:a], "\n"]
        last = b
    return "".join([*out, text[last:]])


_SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """One row per row of docs with the columns of docs but text, n_words, n_hit, items, spans and, if cut, text.

    docs: text and any other columns, which pass through. benchmark: item_id, text. items: sorted item ids (strings)
    that have a window in the document. spans: merged character ranges from the first to the last word of each hit
    run. cut: text comes back with the spans replaced by a line end (untouched where there is none). Null texts and
    texts without words have 0 words and no hits; items that are null, have a null id or no words have no window;
    repeated items count once. An empty benchmark or no documents are no special case.

    The benchmark goes to the executors in blocks of about block_bytes of words, packed there and passed on one by
    one; a long item is several pieces. Each shard of documents is searched block after block and a worker holds one
    block at a time, so nothing is shuffled and memory is bounded whatever the size of either side.
    """
    import pyspark.sql.types as T

    spark = docs.sparkSession
    ship(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    pieces = stored(items.mapInArrow(_split(window), "item string, piece long, words binary"), "pieces")
    size = pieces.agg(F.sum(F.length("words"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    passed = []
    for k in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == k).coalesce(1).mapInArrow(_pack(window), "packed binary")
        passed += [spark.sparkContext.broadcast(bytes(r["packed"])) for r in own.collect()]  # one row
    drop_stored(pieces)
    clash = {"text", "n_words", "n_hit", "items", "spans"}
    others = [f for f in docs.schema.fields if f.name not in clash]
    names = {f.name: f"c{i}" for i, f in enumerate(others)}
    rows = docs.select(F.col("text").alias("t"), *[F.col(f"`{a}`").alias(b) for a, b in names.items()])
    fields = [T.StructField(b, docs.schema[a].dataType) for a, b in names.items()]
    schema = T.StructType([*([T.StructField("t", T.StringType())] if cut else []), *fields, *T._parse_datatype_string(_SCHEMA).fields])
    rows = rows.mapInArrow(_search(passed, cut, list(names.values())), schema)
    return rows.select(*[F.col(b).alias(a) for a, b in names.items()], "n_words", "n_hit", "items", "spans", *([F.col("t").alias("text")] if cut else []))


def _blocks(passed: list) -> Iterator[Phrases]:
    """The blocks one after the other; only a single one stays in memory."""
    for b in passed:
        phrases = Phrases(pickle.loads(b.value))
        vars(b).pop("_value", None)
        yield phrases


def _search(passed: list, cut: bool, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = list(_blocks(passed)) if len(passed) == 1 else None
        for batch in batches:
            texts, start = batch.column("t").cast(pa.binary()), 0
            while start < batch.num_rows:
                words, count, end = [], 0, start
                while end < batch.num_rows and (count < SHARD_WORDS or end == start):
                    words.append(words_of(texts[end].as_py()))
                    count += len(words[-1])
                    end += 1
                hit, items = np.zeros(count, dtype=bool), {}
                for phrases in single if single is not None else _blocks(passed):
                    more, found = phrases.hits(words)
                    hit |= more
                    for d, own in found.items():
                        items.setdefault(d, set()).update(own)
                yield _found(batch.slice(start, end - start), texts.slice(start, end - start), words, hit, items, cut, others)
                start = end
            trim()

    return run


def _found(part: pa.RecordBatch, texts: pa.Array, words: list[list[bytes]], hit: np.ndarray, items: dict[int, set[str]], cut: bool, others: list[str]) -> pa.RecordBatch:
    n, lengths = len(words), [len(w) for w in words]
    starts = np.cumsum([0, *lengths])
    ranges: list[list[dict]] = [[] for _ in range(n)]
    new = {}
    for d in items:
        own = np.concatenate(([False], hit[starts[d] : starts[d + 1]], [False]))
        turns = np.flatnonzero(own[1:] != own[:-1]).reshape(-1, 2)
        text = texts[d].as_py().decode("utf-8", "replace")
        at = word_spans(text)
        chars = [(at[a][0], at[b - 1][1]) for a, b in turns]
        ranges[d] = [{"start": a, "end": b} for a, b in chars]
        if cut:
            new[d] = _without(text, chars).encode("utf-8", "replace")
    columns = {c: part.column(c) for c in others}
    if cut:
        t = part.column("t")
        if new:  # the bytes of the others stay as they are, valid or not
            t = pa.array([new.get(d, x) for d, x in enumerate(texts.to_pylist())], pa.binary()).view(pa.string())
        columns = {"t": t} | columns
    columns |= {
        "n_words": pa.array(lengths, pa.int64()),
        "n_hit": pa.array([int(hit[starts[d] : starts[d + 1]].sum()) if d in items else 0 for d in range(n)], pa.int64()),
        "items": pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
        "spans": pa.array(ranges, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    }
    return pa.RecordBatch.from_pydict(columns)
