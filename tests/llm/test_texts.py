"""Decontamination, suffix sorting, language, quality, near duplicates and token counts against plain Python."""

import base64
import hashlib
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, language_id, near_dup, quality, suffix_dedup, token_counts


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# decontamination
def test_fm_index():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 120)
        text = [rng.randint(1, 4) for _ in range(n)]
        full = [*text, 0]
        assert decontaminate.suffix_array(np.array(full), 5).tolist() == sorted(range(n + 1), key=lambda i: full[i:])
        index = decontaminate.FMIndex(np.array(text), 5)
        windows = np.array([[rng.randint(1, 4) for _ in range(3)] for _ in range(6)])
        low, high = index.search(windows)
        for k, w in enumerate(windows.tolist()):
            assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == [i for i in range(n - 2) if full[i : i + 3] == w]


def brute_leaks(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def test_decontamination(spark, odd, empty, corpus, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 15)  # most items are several pieces
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    extra = [(900, "seven EIGHT nine"), (901, None), (None, "one two"), (902, "!!"), (903, "one two three four five six seven eight nine ten"), (903, "zß")]
    both = benchmark.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    for df in (corpus, odd):
        want = brute_leaks([(r.doc_id, r.text) for r in df.collect()], items + extra)
        for block in (decontaminate.BLOCK_BYTES, 2000):
            got = decontaminate.find_leaks(df, both, block_bytes=block).collect()
            assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=str) == want
    cut = decontaminate.find_leaks(corpus, benchmark, cut=True).select("doc_id", "text", "n_hit").collect()
    told = {r.doc_id: r.text for r in corpus.collect()}
    assert all((r.text == told[r.doc_id]) == (r.n_hit == 0) for r in cut)
    assert not [x for x in brute_leaks([(r.doc_id, r.text) for r in cut], items) if x[2]]
    assert decontaminate.find_leaks(empty, benchmark).count() == 0
    assert decontaminate.find_leaks(odd, benchmark.limit(0)).where("n_hit > 0").count() == 0


# suffix sorting
def brute_cut(docs, window=50):
    first = {}
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)):
        for i in range(len(t) - window + 1):
            first.setdefault(t[i : i + window], d)
    out = []
    for d, t in docs:
        marks = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if first[t[i : i + window]] != d:
                marks[i : i + window] = b"\1" * window
        spans = sum(1 for i, m in enumerate(marks) if m and (i == 0 or not marks[i - 1]))
        out.append((d, len(t), sum(marks), spans, hashlib.sha256(bytes(b for b, m in zip(t, marks, strict=True) if not m)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_order(spark):
    suffix_dedup.install(spark)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 40))) for _ in range(80)] + [b"a" * 300, b"ab" * 200, b"mississippi", b""] + [bytes(rng.choice(b"abcd") for _ in range(2000))]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, t binary")
    for r in df.select("i", F.expr("marlstone_suffix_order(t)").alias("o")).collect():
        assert r.o == sorted(range(len(texts[r.i])), key=lambda k, t=texts[r.i]: t[k:])


@pytest.mark.parametrize("group", [1 << 20, 60, 400])
def test_substring_removal(spark, odd, empty, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 4096)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", group // 20)
    rng = random.Random(7)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(40, 130))) for _ in range(20)]
    docs = [(i, "".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("xyzé ") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    phrase = "one very common phrase of words"
    docs += [(200 + i, "".join(rng.choice("klm") for _ in range(rng.randint(15, 45))) + phrase + "".join(rng.choice("nop") for _ in range(rng.choice([3, 20, 45])))) for i in range(60)]
    docs += [(300, "ab" * 200), (301, "ab" * 90), (302, "a" * 120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").unionByName(odd.where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1000).select("doc_id", "text", "d", "t", "c"), allowMissingColumns=True)
    got = suffix_dedup.dedup_substrings(df).collect()
    want = brute_cut([(r.doc_id, (r.text or "").encode()) for r in df.collect()])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == want
    if group == 400:
        assert suffix_dedup.dedup_substrings(empty).count() == 0
        assert suffix_dedup.dedup_substrings(odd).count() == odd.count()


def test_substring_removal_of_repeated_rows_and_null_ids(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, often = make(90), make(300)
    docs = [(1, make(50) + shared), (2, often), (3, shared + often[:120])] + [(None, make(20) + shared + make(30) + often[100 + i :]) for i in range(40)] + [(None, make(150)) for _ in range(40)]
    once = spark.createDataFrame(docs, "doc_id long, text string")
    df = once.unionByName(spark.range(10_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(often).alias("text")))
    df = df.unionByName(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(shared + often).alias("text")))
    want = Counter(brute_cut([*((d, t.encode()) for d, t in docs), (2, often.encode()), (None, (shared + often).encode())]))
    want[next(k for k in want if k[0] == 2)] += 9_999
    want[next(k for k in want if k[0] is None and k[1] == 390 and k[2] == 390)] += 2_999
    got = suffix_dedup.dedup_substrings(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


# language
def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores, document = rng.normal(size=(14, 3)) * 3, np.array([0] * 5 + [2] * 1 + [3] * 8)
    got = language_id.viterbi(scores, document, 2.0)
    from itertools import product

    for d in (0, 2, 3):
        own = scores[document == d]
        best = max(product(range(3), repeat=len(own)), key=lambda p: sum(own[i, s] for i, s in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False)))
        assert tuple(got[document == d]) == best


    sharp = rng.normal(size=(400, 4)) * 6
    rows = np.repeat(np.arange(8), 50)
    cost = lambda path, d, switch: sum(sharp[d * 50 + i, s] for i, s in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
    for switch in (0.5, 3.0):
        assert 20 < language_id.certain(sharp, switch).sum() < 400 if switch < 1 else True
        got = language_id.viterbi(sharp, rows, switch)
        for d in range(8):
            assert abs(cost(got[rows == d].tolist(), d, switch) - cost(brute_path(sharp[rows == d], switch), d, switch)) < 1e-9


def brute_path(scores, switch):
    """The best path by plain dynamic programming."""
    best = [(float(s), [k]) for k, s in enumerate(scores[0])]
    for row in scores[1:]:
        best = [max(((v - switch * (p[-1] != k) + float(s), [*p, k]) for v, p in best), key=lambda x: x[0]) for k, s in enumerate(row)]
    return max(best, key=lambda x: x[0])[1]


def brute_words(text):
    """Of each word: its letters, its script, and the buckets of its pairs and triples."""
    script = language_id._tables()[1]
    lowered = (text or "").lower()
    c = [ord(x) if x.isalpha() else 32 for x in lowered] + [32]
    mask, shift, at = (1 << 64) - 1, 64 - language_id.BUCKETS.bit_length() + 1, 0
    prior = lambda i: c[i] if i >= 0 else 32
    bucket = lambda x: ((x * 0x9E3779B97F4A7C15) & mask) >> shift
    while at < len(c):
        end = at
        while c[end] != 32:
            end += 1
        if end > at:
            grams = []
            for i in range(at, end + 1):
                two = (prior(i - 1) * 0x9E3779B1 + c[i]) & mask
                grams += [bucket(two), bucket((two + prior(i - 2) * 0x85EBCA6B) & mask) + language_id.BUCKETS]
            yield end - at, int(script[c[at]]), grams
        at = end + 1


def brute_counts(docs):
    counts, scripts = {}, {}
    for lang, text in docs:
        if lang is not None and text is not None:
            own, used = counts.setdefault(lang, Counter()), scripts.setdefault(lang, Counter())
            for _, script, grams in brute_words(text):
                used[script] += 1
                own.update(grams)
    return counts, scripts


def brute_language(model, text):
    """Language and score of a text, word by word."""
    scores, sizes = [], []
    for size, script, grams in brute_words(text):
        total = model.log_p[grams].astype(np.float64).sum(axis=0)
        allowed = model.scripts[script]
        scores.append(np.where(allowed | ~allowed.any(), total, -1e6))
        sizes.append(size)
    if not scores:
        return "und", 0.0
    letters = Counter()
    for k, n in zip(brute_path(np.array(scores), language_id.SWITCH), sizes, strict=True):
        letters[k] += n
    best = max(letters.values())
    return model.languages[min(k for k, v in letters.items() if v == best)], best / sum(sizes)


@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_language_against_word_by_word(spark, corpus, odd, monkeypatch, chunk):
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    model = language_id.fit(corpus)
    monkeypatch.setattr(language_id, "CHUNK", 1 << 20)
    again = language_id.fit(corpus)
    counts, scripts = brute_counts([(r.lang, r.text) for r in corpus.collect()])
    for k, lang in enumerate(again.languages):
        for half in (slice(0, language_id.BUCKETS), slice(language_id.BUCKETS, 2 * language_id.BUCKETS)):
            n = np.array([counts[lang][b] for b in range(half.start, half.stop)])
            assert np.allclose(again.log_p[half, k], np.log((n + language_id.SMOOTH) / (n.sum() + language_id.SMOOTH * language_id.BUCKETS)))
        assert again.scripts[:, k].tolist() == [scripts[lang][x] >= max(1, language_id.SCRIPT_SHARE * scripts[lang].total()) for x in range(len(again.scripts))]
    assert (model.log_p == again.log_p).all() and (model.scripts == again.scripts).all()
    texts = {(r.doc_id, r.text) for df in (corpus, odd) for r in df.collect() if len(r.text or "") < 6000}
    texts |= {(900 + i, " ".join((t or "")[:150] for _, t in sorted(texts, key=str)[i : i + 6])) for i in range(20)}
    order = sorted(texts, key=str)
    monkeypatch.setattr(language_id, "CHUNK", chunk)
    letters = np.zeros((len(order), len(model.languages)), dtype=np.int64)
    for document, first, last, state in model.paths(t or "" for _, t in order):
        np.add.at(letters, (document, state), last - first)
    for (_, t), own in zip(order, letters, strict=True):
        want = brute_language(model, t)
        got = ("und", 0.0) if not own.sum() else (model.languages[int(own.argmax())], own.max() / own.sum())
        assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-12
    if chunk > 300:
        df = spark.createDataFrame(order, "doc_id long, text string")
        told = Counter((r.doc_id, r.lang_pred, round(r.score, 12)) for r in language_id.identify(df, model).collect())
        assert told == Counter((i, b[0], round(b[1], 12)) for i, t in order for b in [brute_language(model, t)])


def test_language_with_many_labels(spark):
    rows = [(i, f"words of label{i % 300} and text{i % 300}", f"l{i % 300:03}") for i in range(900)]
    df = spark.createDataFrame(rows + [(1000, "words", None)], "doc_id long, text string, lang string")
    model = language_id.fit(df, languages=20)
    assert model.languages == [f"l{i:03}" for i in range(20)]
    assert len(language_id.fit(df).languages) == language_id.MOST_LANGUAGES
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'ff61fe62' AS STRING) AS text")
    assert language_id.identify(bad, model).count() == 1


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    rows = language_id.identify(docs, model).withColumn("held", language_id.held_out(F.col("doc_id"))).select("doc_id", "lang", "lang_pred", "held", "score").collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    got = {r.doc_id: r for r in language_id.identify(odd, model, spans=True).select("doc_id", "lang_pred", "score", "lang_spans").collect()}
    assert got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0 and got[3].lang_spans == []
    mixed = spark.createDataFrame([(1, docs.where("lang = 'en'").first().text[:400] + "\n" + docs.where("lang = 'de'").first().text[:400])], "doc_id long, text string")
    assert {"en", "de"} <= {s.lang for s in language_id.identify(mixed, model, spans=True).first().lang_spans}
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}


# quality
def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def brute_kept(text):
    """The verdict from the limits as they are written."""
    import zstandard

    raw = (text or "").encode()
    if brute_base(text)[-1]:
        return False
    wide = lambda b: sum(x > 127 for x in b) > len(b) / 3
    squeezed = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(b))

    def outside(b, bands):
        band = max((x for x in bands if x[0] <= len(b)), default=None)
        return band is not None and not band[2 if wide(b) else 1] <= squeezed(b) <= band[3]

    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    bad = sum(len(c) for c in chunks if outside(c, [x for x in quality.WHOLE if 256 <= x[0] <= 4096]))
    return not outside(raw, quality.WHOLE) and bad <= 0.5 * len(raw)


def test_quality_verdicts(spark, corpus, odd):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9)))
    some = [r.text for r in corpus.collect() if r.text]
    made = [" ".join(rng.choice([word(), rng.choice(some)[:200], "again and again", base64.b64encode(rng.randbytes(30)).decode(), "слово других языков"]) for _ in range(rng.choice([20, 60, 200, 900]))) for _ in range(150)]
    df = spark.createDataFrame([(5000 + i, t) for i, t in enumerate(made)], "doc_id long, text string").unionByName(corpus.select("doc_id", "text")).unionByName(odd.select("doc_id", "text"))
    told = Counter((r.doc_id, brute_kept(r.text)) for r in df.collect())
    assert Counter((r.doc_id, r.kept) for r in quality.judge_quality(df).collect()) == told
    assert len({kept for (i, kept) in told if i and i >= 5000}) == 2


def test_quality(spark, odd, empty, corpus):
    noise = "".join(random.Random(1).choice("".join(map(chr, range(0x4E00, 0x9FFF)))) + " " * (i % 4 == 0) for i in range(4000))
    rest = spark.createDataFrame([(500, "ab cd\n" * 300), (501, noise), (502, "a b c a b c x\n \na b"), (503, "same line\nsame line\n　\n　")], "doc_id long, text string")
    for df in (corpus, odd, rest):
        told = Counter((r.doc_id, *brute_base(r.text)) for r in df.collect())
        got = quality.judge_quality(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == told
        assert not any(r.kept and r.base_failed for r in got)
    clean = [r for r in quality.judge_quality(corpus).collect() if not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    bands = quality.Bands()
    import os

    assert not bands.judge(b"the same words again and again. " * 400)[0] and not bands.judge(os.urandom(20000))[0]
    assert quality.judge_quality(empty).count() == 0


SIZES = (512, 768, 1024, 1279, 1536, 2048, 3000, 4096, 6800, 8192, 16384, 22000, 40000, 65536, 200000)


@pytest.mark.parametrize("size", SIZES)
def test_bands_reject_noise_and_repetition(size):
    bands, rng = quality.Bands(), random.Random(size)
    noise = {"base64": base64.encodebytes(rng.randbytes(size))}
    for name, alphabet, least in (("mixed", string.ascii_letters + string.digits, 512), ("digits", string.ascii_lowercase + string.digits, 768), ("letters", string.ascii_lowercase, 1024)):
        if size >= least:
            noise[name] = " ".join("".join(rng.choices(alphabet, k=rng.randint(2, 9))) for _ in range(size // 3)).encode()
    three = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(9)) for _ in range(3)]
    noise["repeats"] = " ".join(rng.choice(three) for _ in range(size // 20)).encode()
    for name, raw in noise.items():
        assert len(raw) >= size and not bands.judge(raw[:size])[0], name
    if size > quality.CHUNK:  # chunk by chunk too
        assert all(bands.judge(raw[:size])[2] > quality.OUTSIDE for name, raw in noise.items())


def test_bands_keep_prose(corpus):
    bands = quality.Bands()
    texts = [r.text for r in corpus.collect() if r.text and not quality.base(r.text.encode())[-1]]
    assert all(bands.judge(t.encode())[0] for t in texts)
    real = re.sub(r"\s+", " ", " ".join(filter(None, (x.__doc__ for m in (random, re, hashlib, string, base64, zlib) for x in (m, *vars(m).values()) if getattr(x, "__module__", m.__name__) == m.__name__)))).encode()
    assert all(bands.judge(real[:n])[0] for n in (1024, 2048, 4096))


# near duplicates
def test_bag_minhash_is_unbiased():
    rng = random.Random(3)
    a = Counter({rng.getrandbits(63): rng.choice([1, 1, 2, 5, 9]) for _ in range(200)})
    b = Counter({k: max(1, v + rng.choice([-1, 0, 3])) for k, v in a.items() if rng.random() < 0.9})
    document = np.array([0] * len(a) + [1] * len(b))
    s = near_dup.bag_minhash(document, np.array([*a, *b], dtype=np.uint64), np.array([*a.values(), *b.values()]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - sum((a & b).values()) / sum((a | b).values())) < 0.04


def brute_classes(docs):
    bags = {}
    for i, t in docs:
        w = words(t)
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4) if w else 0))
    parent = {i: i for i in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(bags)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            a, b = bags[x], bags[y]
            if a and b and min(len(a), len(b)) and a.keys() & b.keys() and sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                p, q = find(x), find(y)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("rounds", [3, 0])
def test_near_duplicates(spark, corpus, monkeypatch, rounds):
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", rounds)
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    made = []
    for i in range(30):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(300)] = f"z{rng.randint(0, 99)}"
        made.append((10_000 + i, " ".join(w)))
    df = corpus.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_classes([(r.doc_id, r.text) for r in df.collect()])
    if rounds:
        kept = [r.doc_id for r in near_dup.keep_one(df).collect()]
        assert sorted(kept) == sorted(set(got.values()))


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    classes = {r.doc_id: r.class_id for r in rows}
    assert classes[1] == classes[2] == 1 and classes[3] == 3 and classes[4] == 4 and classes[None] is None
    assert near_dup.near_duplicates(empty).count() == 0
    assert near_dup.keep_one(odd).columns == odd.columns


def test_near_duplicates_without_ids_and_with_one_id_twice(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    a, b, c = text(120), text(80), text(60)
    near = " ".join([*a[:60], "changed", *a[61:]])
    rows = [(1, " ".join(a)), (None, near), (2, " ".join(b)), (2, " ".join(c)), (0, " ".join(c)), (None, " ".join(text(50))), (3, " ".join(b)), (3, " ".join(b)), (4, ""), (4, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.representative) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (None, 1, False), (2, 2, True), (2, 0, False), (0, 0, True), (None, None, False), (3, 2, False), (3, 2, False), (4, 4, True), (4, 4, True), (None, None, False)], key=str)
    kept = Counter((r.doc_id, r.text) for r in near_dup.keep_one(df).collect())
    assert kept == Counter([rows[0], rows[2], rows[4], rows[5], rows[8], rows[9], rows[10]])
    twice = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b))], "doc_id long, text string")
    assert near_dup.keep_one(twice).count() == 2
    again = near_dup.keep_one(df.unionByName(df).where("text is not null and text <> ''"))
    assert Counter((r.doc_id, r.text) for r in again.collect()) == Counter([rows[0], rows[2], rows[4], rows[5]])


def test_near_duplicates_in_hot_buckets(spark, monkeypatch):
    """Many texts share bands without being similar; blocks of few items and pairs of none give what all pairs give."""
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "BLOCK_ITEMS", 4000)
    rng = random.Random(12)
    common = [f"c{i}" for i in range(200)]
    docs = []
    for i in range(60):
        own = [f"d{i}x{k}" for k in range(70)]
        docs.append((2 * i, " ".join(common + own)))
        if i % 3 == 0:
            own[rng.randrange(70)] = "else"
            docs.append((2 * i + 1, " ".join(common + own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()} == brute_classes(docs)


# token counts
def test_token_counts(spark, odd, empty, corpus):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    counter = token_counts.PrefixCounter(path)
    rng = random.Random(4)
    texts = ["", " ", "   a  b ", "a\nb\t", "中文 😀 x", "</s> <s> <unk>", "\x00▁▁ x", "a" * 70, *("".join(rng.choice("abcdeéß  \n.,12中") for _ in range(rng.randint(1, 40))) for _ in range(300))]
    for t in texts:
        assert counter.prefix_counts(t).tolist() == [len(library.encode(t[:i])) for i in range(len(t) + 1)]
        d = counter.deltas(t)
        assert all(token_counts.tokens_at(d, i) == len(library.encode(t[:i])) for i in range(0, len(t) + 1, 7))
    for df in (corpus, odd):
        told = Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in df.collect())
        got = token_counts.count_tokens(df, path, budget=20, prefixes=True).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == told
        text = {r.doc_id: r.text or "" for r in df.collect()}
        assert all(r.within == max(i for i, n in enumerate(counter.prefix_counts(text[r.doc_id])) if n <= 20) for r in got)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_bytes_that_are_not_utf8(spark):
    import public_tokenizers

    bad = spark.sql("SELECT * FROM VALUES (1L, CAST(X'ff61fe20626162' AS STRING)), (2L, 'clean text of some words') AS t(doc_id, text)")
    benchmark = spark.createDataFrame([(1, "text of")], "item_id long, text string")
    assert token_counts.count_tokens(bad, public_tokenizers.path("piece_bpe_32k.model")).count() == 2
    assert quality.judge_quality(bad).count() == 2 and near_dup.keep_one(bad).count() == 2
    assert {r.doc_id: r.n_hit for r in decontaminate.find_leaks(bad, benchmark, cut=True).collect()} == {1: 0, 2: 2}
    assert suffix_dedup.dedup_substrings(bad).count() == 2
