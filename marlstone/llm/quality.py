"""Quality rules: base counts of a text, and compression bands.

zstandard ratios (bytes before by bytes after) of the whole text and of fixed chunks lie inside a band for prose;
repetitive text compresses too well and noise too little. The limits depend on the length, since short inputs carry
the frame's overhead and long ones offer more to repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: (bytes from, least ratio, least ratio of a wide text, greatest ratio) of whole texts; one below the first length isn't judged.
#: Least: under ordinary prose of that length and, but for wide texts, over base64 from 128 bytes, random letters and
#: digits from 768 and random letters from 1,024; shorter ones have the ratios of prose. Greatest: about the 99th
#: percentile of formulaic prose (docstrings).
WHOLE = (
    (64, 0.72, 0.72, 2.5), (128, 0.95, 0.72, 2.5), (192, 1.05, 0.8, 2.5), (256, 1.2, 1.0, 2.5), (384, 1.28, 1.05, 2.6),
    (512, 1.43, 1.1, 2.9), (640, 1.46, 1.1, 3.0), (768, 1.5, 1.15, 3.2), (896, 1.54, 1.15, 3.3), (1024, 1.645, 1.2, 3.4), (1152, 1.655, 1.2, 3.4),
    (1280, 1.67, 1.25, 3.6), (1536, 1.685, 1.3, 3.7), (2048, 1.75, 1.4, 4.0), (4096, 1.85, 1.7, 4.6), (8192, 2.0, 1.75, 4.8),
    (16384, 2.05, 1.8, 5.0), (65536, 2.1, 1.8, 5.4),
)
#: Chunks of CHUNK bytes, the last one shorter, are judged as texts of their length, from 256 bytes on; the share of bytes in chunks outside that a text may have.
CHUNK, CHUNKS, OUTSIDE = 4096, tuple(x for x in WHOLE if 256 <= x[0] <= 4096), 0.5
#: A text is wide if more than this share of its bytes is beyond ASCII: few characters in many bytes, so short prose compresses less.
WIDE = 1 / 3
LEVEL = 3
_SYMBOLS = re.compile(rb"[#*$%&|<>]")
_SKIPPED = bytes([0x20, *range(9, 14)])
_ASCII = bytes(range(128))
FIELDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "ratio": pa.float64(), "outside": pa.float64()}


def limits(bands: tuple, raw: bytes) -> tuple[float, float] | None:
    found = next((x for x in reversed(bands) if len(raw) >= x[0]), None)
    if found is None:
        return None
    wide = not raw.isascii() and len(raw.translate(None, _ASCII)) > WIDE * len(raw)
    return found[2 if wide else 1], found[3]


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more, the first occurrence included; each word counts once."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    m = len(ids)
    pairs = np.unique(w[:-2] * m + w[1:-1], return_inverse=True)[1].astype(np.int64)
    _, inverse, counts = np.unique(pairs * m + w[2:], return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    if not hit.any():
        return 0
    marks = np.zeros(n, dtype=bool)
    for k in range(3):
        marks[k : n - 2 + k] |= hit
    return int(marks.sum())


def base(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of a UTF-8 text."""
    words = text.split()
    solid = text.translate(None, _SKIPPED)
    chars = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if not x.isspace() and x]
    repeats = repeat_words(words)
    n = len(words)
    return n, chars, len(_SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


class Bands:
    """The compression verdict, with one compressor for all texts of a task."""

    def __init__(self, level: int = LEVEL):
        import zstandard

        self._compressor = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)

    def ratio(self, raw: bytes) -> float:
        return len(raw) / len(self._compressor.compress(raw)) if raw else 0.0

    def judge(self, raw: bytes) -> tuple[bool, float, float]:
        """Kept, the whole text's ratio, and the share of its bytes in chunks outside their band."""
        whole, n = self.ratio(raw), len(raw)
        band = limits(WHOLE, raw)
        kept = band is None or band[0] <= whole <= band[1]
        outside = 0
        for at in range(0, n, CHUNK):
            chunk = raw[at : at + CHUNK]
            if (own := limits(CHUNKS, chunk)) and not own[0] <= self.ratio(chunk) <= own[1]:
                outside += len(chunk)
        share = outside / n if n else 0.0
        return kept and share <= OUTSIDE, whole, share


def judge_quality(docs: DataFrame, level: int = LEVEL) -> DataFrame:
    """One row per row of docs (doc_id, text): the FIELDS. Bytes that aren't UTF-8 count as the replacement character.

    Words are `[^\\x20\\x09-\\x0D]+`. A null or empty text has no words, so base_failed is true and kept false. kept is
    false if base_failed; otherwise it is the verdict of the bands. Whole texts of any length; repeated rows give
    repeated rows; other columns are ignored. Each row is computed alone: nothing is shuffled.
    """

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(level)
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw.as_py() or b""
                counts = base(raw)
                kept, whole, share = bands.judge(raw)
                rows.append((i, *counts, kept and not counts[-1], whole, share))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))

    spark_types = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, ", ".join(f"{n} {spark_types[k]}" for n, k in FIELDS.items()))
