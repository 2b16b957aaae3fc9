"""Language identification: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters. Its score for a language is the sum of the log probabilities of its hashed character
pairs and triples in that language's training texts. Languages that hardly ever use the word's script are out. The
Viterbi path over the words pays a penalty for each switch, so a text of several languages is cut into spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, trim

#: Buckets of hashed pairs and of hashed triples, the penalty of a switch (natural log), the smoothing count.
BUCKETS, SWITCH, SMOOTH = 1 << 15, 6.0, 0.5
#: The model is fitted on about so many documents of each language, drawn by a hash of doc_id, and on so many languages: those of most documents.
SAMPLE_PER_LANGUAGE, MOST_LANGUAGES = 2000, 256
#: A script must have this share of a language's training words to be one of its scripts.
SCRIPT_SHARE = 0.001
#: Characters of texts whose words are scored at a time; longer texts are scored in pieces of about so many.
CHUNK = 1 << 20
#: First and last code points of letters of the commoner scripts (Unicode block ranges).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
UNDETERMINED = "und"
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and the number of its script (0: none of SCRIPTS)."""
    if not _TABLES:
        script = np.zeros(0x110000, dtype=np.int8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for first, last in ranges:
                script[first : last + 1] = k
        _TABLES[:] = [np.array([chr(i).isalpha() for i in range(0x110000)]), script]
    return _TABLES[0], _TABLES[1]


def pieces(text: str, size: int = 0) -> Iterator[tuple[int, str, int, bool]]:
    """Parts of a text cut where no letter stands: offset, part, how much of its start the one before has too, last."""
    at, n = 0, len(text)
    while True:
        end = min(at + (size or CHUNK), n)
        while end < n and text[end].isalpha():
            end += 1
        skip = min(at, 2)  # the pairs and triples of a word reach back as far
        yield at - skip, text[at - skip : end], skip, end == n
        if end == n:
            return
        at = end


class Words:
    """The words of lower-cased texts, laid end to end: document, first and last character, script, and hashed n-grams."""

    def __init__(self, texts: list[str]):
        is_letter, script = _tables()
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = is_letter[codes]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        self.first, self.last = edges[::2], edges[1::2]
        self.document = np.searchsorted(self.starts, self.first, side="right") - 1
        self.script = script[codes[self.first]] if len(self.first) else np.zeros(0, dtype=np.int8)
        c = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
        two = np.concatenate(([np.uint64(32)], c[:-1])) * np.uint64(0x9E3779B1) + c
        shift = np.uint64(64 - int(BUCKETS).bit_length() + 1)
        self.pairs = ((two * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32)
        two += np.concatenate(([np.uint64(32)] * 2, c[:-2]))[: len(c)] * np.uint64(0x85EBCA6B)
        self.triples = ((two * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32) + np.int32(BUCKETS)

    def sums(self, table: np.ndarray) -> np.ndarray:
        """For each word and language: the sum of table over its pairs and triples, the one after its end included."""
        out = np.empty((len(self.first), table.shape[1]), dtype=np.float64)
        for k in range(table.shape[1]):
            own = np.concatenate(([0.0], np.cumsum(table[self.pairs, k].astype(np.float64) + table[self.triples, k])))
            out[:, k] = own[np.minimum(self.last + 1, len(self.pairs))] - own[self.first]
        return out


class Model:
    """languages, log probabilities (2 * BUCKETS x languages), and which scripts each language uses."""

    def __init__(self, languages: list[str], log_p: np.ndarray, scripts: np.ndarray):
        self.languages, self.log_p, self.scripts = languages, log_p, scripts

    def _scores(self, words: Words) -> np.ndarray:
        scores = words.sums(self.log_p)
        allowed = self.scripts[words.script]
        allowed |= ~allowed.any(axis=1, keepdims=True)
        scores[~allowed] = -1e6
        return scores

    def paths(self, texts: Iterable[str], switch: float = SWITCH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of words: number of the text, first and last character in the lower-cased text, and number of the language by the best path.

        About CHUNK characters are scored at a time, of a long text too. The words of a text come in their order.
        """
        part, where, size = [], [], 0
        for i, t in enumerate(texts):
            t = t.lower()
            if len(t) > CHUNK:
                yield from self._long(i, t, switch)
                continue
            part.append(t)
            where.append(i)
            size += len(t)
            if size >= CHUNK:
                yield self._short(part, where, switch)
                part, where, size = [], [], 0
        if part:
            yield self._short(part, where, switch)

    def _short(self, part: list[str], where: list[int], switch: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words = Words(part)
        start = words.starts[words.document]
        state = viterbi(self._scores(words), words.document, switch)
        return np.array(where, dtype=np.int64)[words.document], words.first - start, words.last - start, state

    def _long(self, i: int, text: str, switch: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """A path is settled up to the last word whose language is beyond doubt; the words behind it wait for the next piece."""
        before, scores, spans = -1, np.zeros((0, len(self.languages))), np.zeros((0, 2), dtype=np.int64)
        for offset, piece, skip, last in pieces(text):
            words = Words([piece])
            new = words.first >= skip
            scores = np.concatenate((scores, self._scores(words)[new]))
            spans = np.concatenate((spans, np.stack((words.first, words.last), axis=1)[new] + offset))
            sure = np.flatnonzero(certain(scores, switch))
            end = len(scores) if last else int(sure[-1]) + 1 if len(sure) else 0
            if end:
                state = viterbi(scores[:end], np.zeros(end, dtype=np.int64), switch, before)
                yield np.full(end, i), spans[:end, 0], spans[:end, 1], state
                before, scores, spans = int(state[-1]), scores[end:], spans[end:]


def certain(scores: np.ndarray, switch: float) -> np.ndarray:
    """Rows whose best state is on every best path: going there and back costs less than any other state there."""
    if scores.shape[1] < 2:
        return np.ones(len(scores), dtype=bool)
    two = np.partition(scores, -2, axis=1)[:, -2:]
    return two[:, 1] - two[:, 0] > 2 * switch


def viterbi(scores: np.ndarray, document: np.ndarray, switch: float, before: int = -1) -> np.ndarray:
    """The best state of each row; rows of a document follow each other. before: the state before the first row, if any.

    The certain rows cut the documents into stretches that don't depend on each other; all advance a row at a time
    together.
    """
    n, k = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.concatenate(([True], document[1:] != document[:-1]))
    sure = certain(scores, switch)
    cut = new | np.concatenate(([False], sure[:-1]))
    first = np.flatnonzero(cut)
    length = np.diff(np.concatenate((first, [n])))
    by = np.argsort(-length, kind="stable")
    first, length = first[by], length[by]
    live = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # stretches with more rows than t
    known = np.where(new[first], -1, scores[first - 1].argmax(axis=1))
    known[first == 0] = before
    value = scores[first] - np.where((known >= 0)[:, None] & (known[:, None] != np.arange(k)), switch, 0.0)
    switched = np.zeros((n, k), dtype=bool)
    best_before = np.zeros(n, dtype=np.int16)
    for t in range(1, int(length[0])):
        m = live[t]
        at = first[:m] + t
        old = value[:m]
        best = old.argmax(axis=1)
        floor = old[np.arange(m), best][:, None] - switch
        switched[at] = old < floor
        best_before[at] = best
        value[:m] = np.maximum(old, floor) + scores[at]
    state = value.argmax(axis=1)
    out = np.zeros(n, dtype=np.int64)
    for t in range(int(length[0]) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        out[at] = state[:m]
        state[:m] = np.where(switched[at, state[:m]], best_before[at], state[:m])
    return out


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each language in a partition: how often each bucket occurs, and words by script at buckets from -1 down."""
    seen: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for language, text in zip(batch["lang"], batch["text"], strict=True):
            total = seen.setdefault(language, np.zeros(2 * BUCKETS, dtype=np.int64))
            for _, piece, skip, _ in pieces(bytes(text).decode("utf-8", "replace").lower()):
                words = Words([piece])
                new = words.first >= skip
                first, last = words.first[new], words.last[new]
                inside = np.zeros(len(words.pairs) + 1, dtype=np.int64)
                np.add.at(inside, first, 1)
                np.add.at(inside, np.minimum(last + 1, len(words.pairs)), -1)
                inside = np.cumsum(inside[:-1]) > 0
                total += np.bincount(words.pairs[inside], minlength=2 * BUCKETS) + np.bincount(words.triples[inside], minlength=2 * BUCKETS)
                scripts.setdefault(language, np.zeros(len(SCRIPTS) + 1, dtype=np.int64))[:] += np.bincount(words.script[new], minlength=len(SCRIPTS) + 1)
    for language, total in seen.items():
        at, some = np.flatnonzero(total), np.flatnonzero(scripts[language])
        yield pd.DataFrame({"lang": language, "bucket": np.concatenate((at, -1 - some)), "n": np.concatenate((total[at], scripts[language][some]))})


def _learned(counts: pd.DataFrame) -> pd.DataFrame:
    """The log probabilities of one language as bytes, and which scripts it uses."""
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    table, scripts = np.zeros(2 * BUCKETS), np.zeros(len(SCRIPTS) + 1)
    grams = bucket >= 0
    table[bucket[grams]], scripts[-1 - bucket[~grams]] = n[grams], n[~grams]
    halves = [np.log((half + SMOOTH) / (half.sum() + SMOOTH * BUCKETS)) for half in (table[:BUCKETS], table[BUCKETS:])]
    uses = scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum())
    return pd.DataFrame({"lang": [counts["lang"].iloc[0]], "log_p": [np.concatenate(halves).astype(np.float32).tobytes()], "scripts": [uses.tolist()]})


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, languages: int = MOST_LANGUAGES) -> Model:
    """docs: doc_id, text, lang. Rows with a null text, lang or doc_id teach nothing; no rows make an empty model.

    The sample takes a document if a hash of its id falls below per_language / documents of its language. Of more
    labels than `languages` those of most documents are learned, in doubt the first by name; the others are never
    predicted. Counts are summed and turned into probabilities on the executors; the driver gets one row of 256 KiB
    per language.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "lang").where("text is not null and lang is not null and doc_id is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not sizes:
        return Model([], np.zeros((2 * BUCKETS, 0), dtype=np.float32), np.zeros((len(SCRIPTS) + 1, 0), dtype=bool))
    ship(docs.sparkSession)
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30) < share
    counts = rows.where(F.col("lang").isin(list(sizes)) & drawn).select("text", "lang").mapInPandas(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    told = counts.groupBy("lang").applyInPandas(_learned, "lang string, log_p binary, scripts array<boolean>").collect()
    told = sorted(told, key=lambda r: r["lang"])
    if not told:
        return fit(docs.limit(0))
    log_p = np.stack([np.frombuffer(bytes(r["log_p"]), dtype=np.float32) for r in told], axis=1)
    return Model([r["lang"] for r in told], log_p, np.array([r["scripts"] for r in told], dtype=bool).T)


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, spans: bool = False) -> DataFrame:
    """One row per row of docs with the columns of docs, lang_pred, score and, if spans, lang_spans.

    lang_pred: the language with most letters on the best path; und if the text is null or has no letter, or the
    model is empty. score: its share of the letters (0 for und). lang_spans: character ranges in the lower-cased
    text and their languages. Only the text is read for a prediction. Whole texts of any length, a long one in
    pieces whose path goes on from one to the next; other columns pass through, except ones named as the results, which are
    replaced.
    """
    import pyspark.sql.types as T

    new = ["lang_pred", "score"] + ["lang_spans"] * spans
    others = [f for f in docs.schema.fields if f.name not in new]
    rows = docs.select(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(others)])
    at = next(i for i, f in enumerate(others) if f.name == "text")
    known = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = known.value
        names = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            n = batch.num_rows
            raw = batch.column(at).cast(pa.binary())  # bytes that aren't UTF-8 are read as the replacement character
            texts = ((t.as_py() or b"").decode("utf-8", "replace") for t in raw)
            letters = np.zeros((n, len(names)), dtype=np.int64)
            out: list[list[dict]] = [[] for _ in range(n if spans else 0)]
            for document, first, last, state in m.paths(texts, switch) if m.languages else ():
                np.add.at(letters, (document, state), last - first)
                if spans and len(state):
                    cut = np.flatnonzero(np.concatenate(([True], (state[1:] != state[:-1]) | (document[1:] != document[:-1]))))
                    for a, b in zip(cut, [*(cut[1:] - 1), len(state) - 1], strict=True):
                        own, lang = out[int(document[a])], names[state[a]]
                        if own and own[-1]["lang"] == lang:
                            own[-1]["end"] = int(last[b])
                        else:
                            own.append({"start": int(first[a]), "end": int(last[b]), "lang": lang})
            total = letters.sum(axis=1)
            best = np.where(total > 0, letters.argmax(axis=1), len(names) - 1)
            columns = [*batch.columns, pa.array(names[best].tolist(), pa.string()), pa.array(letters[np.arange(n), best] / np.maximum(total, 1), pa.float64())]
            if spans:
                columns.append(pa.array(out, pa.list_(span)))
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(others))] + new)
            trim()

    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(others)]
    tail = "lang_pred string, score double" + ", lang_spans array<struct<start:int,end:int,lang:string>>" * spans
    done = rows.mapInArrow(run, T.StructType([*fields, *T._parse_datatype_string(tail).fields]))
    return done.select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(others)], *new)


def held_out(doc_id: Column, parts: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by parts; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(False))
