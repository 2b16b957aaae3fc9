"""Token counts by prefix dynamic programming over a byte-fallback BPE piece model.

For every prefix of a text the last token of that prefix's encoding is found from the prefixes before it, so the
token count of every prefix is known from one pass: truncation and budget questions need no second encoding. A token
is the last one of a prefix if it is itself a piece and stands next to the last token of the shorter prefix exactly
as the library would cut the two. Texts are cut where no piece can cross (before runs of the space mark and around
line ends), and the counts of a segment are kept in a bounded table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

MARK = "▁"
#: Entries of the bounded tables of a worker, and the longest segment that is kept.
SEGMENTS, PAIRS, LONGEST_KEPT = 600_000, 1_000_000, 64


class PrefixCounter:
    """Counts as SentencePieceProcessor(model_file=path).encode(text) gives them, for every prefix of a text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a BPE model with byte fallback, a dummy prefix and no normalization is needed")
        spec.add_dummy_prefix = False
        self._bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark after another character")
        self._pieces = [p.piece for p in proto.pieces]
        self._ends = ahocorasick.Automaton()  # yields the pieces that end at each character, longest first
        for (piece, i), cut in zip(pieces.items(), self._bare.encode(list(pieces)), strict=True):
            if cut == [i]:  # a piece that is cut further when it stands alone is in no encoding
                self._ends.add_word(piece, (len(piece), i))
        self._ends.make_automaton()
        if any("\n" in p for p in pieces):
            raise ValueError("a piece has a line end")
        self._cut = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall
        self._segments: dict[str, bytes] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _fits(self, left: int, right: int) -> bool:
        if len(self._pairs) >= PAIRS:
            self._pairs.clear()
        fits = self._pairs[left, right] = self._bare.encode(self._pieces[left] + self._pieces[right]) == [left, right]
        return fits

    def _deltas(self, segment: str) -> bytes:
        """For each character: by how much the count of the prefix that ends with it exceeds the one before."""
        n, known, done = len(segment), self._pairs, 0
        last, count = [-1] * (n + 1), [0] * (n + 1)

        def alone(end: int) -> None:
            """Characters up to end that are in no piece: their bytes, and no piece crosses them."""
            for i in range(done, end):
                count[i + 1] = count[i] + len(segment[i].encode("utf-8", "surrogatepass"))

        for at, (length, piece) in self._ends.iter(segment):
            if done > at:
                continue
            if done < at:
                alone(at)
                done = at
            start = at + 1 - length
            left = last[start]  # -1: the start, or a character that is in no piece
            if left >= 0 and (fits := known.get((left, piece))) is None:
                fits = self._fits(left, piece)
            if left < 0 or fits:
                done = at + 1
                last[done], count[done] = piece, count[start] + 1
        alone(n)
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:], strict=False)])

    def deltas(self, text: str) -> bytes:
        """One signed byte for the dummy prefix and each character of text; none for an empty text."""
        if not text:
            return b""
        known, out = self._segments, []
        for s in self._cut(MARK + text.replace(" ", MARK)):
            d = known.get(s)
            if d is None:
                d = self._deltas(s)
                if len(s) <= LONGEST_KEPT:
                    if len(known) >= SEGMENTS:
                        known.clear()
                    known[s] = d
            out.append(d)
        return b"".join(out)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Element i: tokens of text[:i]; element 0 is 0."""
        counts = np.cumsum(np.frombuffer(self.deltas(text), dtype=np.int8), dtype=np.int64)
        if len(counts):
            counts[0] = 0
        return counts if len(counts) else np.zeros(1, dtype=np.int64)


def tokens_at(deltas: bytes, n: int) -> int:
    """Tokens of the prefix of n characters, from stored deltas."""
    return int(np.frombuffer(deltas[: n + 1], dtype=np.int8).sum(dtype=np.int64)) if n and deltas else 0


def longest_within(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens, from stored deltas."""
    counts = np.cumsum(np.frombuffer(deltas, dtype=np.int8), dtype=np.int64)
    if not len(counts):
        return 0
    counts[0] = 0
    return int(np.flatnonzero(counts <= budget)[-1])


def count_tokens(docs: DataFrame, model: str, budget: int = 4096, prefixes: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, within and, if prefixes, deltas.

    within: characters of the longest prefix of at most budget tokens. deltas: one signed byte for the dummy prefix
    and each character; their running sum is the token count of every prefix (tokens_at, longest_within). Null text
    counts as empty: 0 tokens; bytes that aren't UTF-8 count as the replacement character. Whole texts, of any length; repeated rows give repeated rows; other columns are
    ignored. Each row is computed alone, so nothing is shuffled.
    """
    fields = [("doc_id", "long"), ("n_bytes", "long"), ("n_tokens", "long"), ("within", "long")] + [("deltas", "binary")] * prefixes

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(model)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_py() or b""
                text = raw.decode("utf-8", "replace")
                d = counter.deltas(text)
                n = int(np.frombuffer(d, dtype=np.int8).sum(dtype=np.int64))
                row = (i, len(raw), n, len(text) if n <= budget else longest_within(d, budget))
                rows.append(row + (d,) * prefixes)
            kinds = {"long": pa.int64(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], kinds[k]) for _, k in fields], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in fields))
