"""The stages of the pipeline, and run(), against plain Python on a small table, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from test_native import brute_copies, jump
from test_texts import brute_classes, brute_language

import corpus_pipeline
from marlstone.llm import language_id

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_rows(rows, model):
    kept = []
    for r in rows:
        lang, score = brute_language(model, r[1])
        if lang != "und" and score >= 0.5:
            kept.append(r)
    return kept


def distinct_rows(rows):
    classes = brute_classes([(r[0], r[1]) for r in rows])
    return [r for r in rows if classes[r[0]] == r[0]]


def clean_rows(rows, items):
    windows = set()
    cut = lambda t: [(m[0], *m.span()) for m in re.finditer(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    for _, t in items:
        w = [x for x, _, _ in cut(t)]
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    out = []
    for i, t, lang, source, n in rows:
        w, hit = cut(t), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(x for x, _, _ in w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
        new, last = "", 0
        for k in sorted(hit):
            if k - 1 not in hit:
                new += t[last : w[k][1]] + "\n"
            last = w[k][2]
        out.append((i, new + t[last:], lang, source, len(new + t[last:])) if hit else (i, t, lang, source, n))
    return out


def mixed_rows(rows):
    whole = {r[0]: r for r in rows}
    return [whole[i] for i, _, _, _, copies, _ in brute_copies([(r[0], r[1], r[3]) for r in rows]) for _ in range(copies)]


def sharded_rows(rows):
    shards = defaultdict(list)
    for r in rows:
        raw = (r[1] or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        shards[jump(r[0], 24)].append((hashlib.md5(f"{r[0]}:{size}:{crc}".encode()).hexdigest(), r[0], size, crc))
    return [(i, size, crc, "key", shard, slot, jump(i, 25)) for shard, own in shards.items() for slot, (_, i, size, crc) in enumerate(sorted(own))]


def test_each_stage_and_run_against_plain_python(spark, corpus):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    model = language_id.fit(corpus)
    plain = [lambda rows: language_rows(rows, model), distinct_rows, lambda rows: clean_rows(rows, items), mixed_rows, sharded_rows]
    docs, want = corpus.select(*COLUMNS), [tuple(r) for r in corpus.select(*COLUMNS).collect()]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain, strict=True):
        docs, want = stage(spark, docs, FOLDER).cache(), brute(want)
        assert Counter(tuple(r) for r in docs.collect()) == Counter(want), name
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == Counter(want)


def test_without_labels_every_text_with_a_letter_stays(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "123 !", None), (3, None, None), (4, "слова", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, FOLDER).collect()) == [1, 4]


def test_odd_rows_and_no_rows(spark, odd, empty):
    clash = odd.withColumn("score", F.lit("clash")).withColumn("copies", F.lit("clash")).withColumn("n_hit", F.lit("clash"))
    for docs in (clash, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            assert all(r["score"] == r["n_hit"] == r["copies"] == "clash" for r in out.collect() if docs is clash)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
