"""URL filter, sharding, mixing and licences against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.llm import licenses, mixing, sharding, url_filter
from marlstone.llm.queries import URL_RULES


def jump(key, shards):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 1000])
def test_jump_hash(spark, shards):
    df = spark.range(-20, 200).select((F.col("id") * 123456789012).alias("k"))
    assert all(r.s == jump(r.k, shards) for r in df.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect())


def test_only_the_new_shard_takes_rows(spark):
    got = spark.range(5000).select(sharding.jump_hash(F.col("id"), 9).alias("a"), sharding.jump_hash(F.col("id"), 10).alias("b")).collect()
    assert all(r.a == r.b or r.b == 9 for r in got) and 300 < sum(r.a != r.b for r in got) < 700


def test_sharding(spark, odd, empty, corpus, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 3)
    monkeypatch.setattr(sharding, "COPIES", 7)
    assert sharding.shard(empty, 24).count() == 0
    strided = spark.range(0, 4096 * 500, 4096).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    nulls = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 90).alias("text"))
    for df in (odd, corpus, strided, nulls.unionByName(strided)):
        rows, told = sharding.shard(df, 24).collect(), df.select("doc_id", "text").collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()), jump(r.doc_id or 0, 24), jump(r.doc_id or 0, 25)) for r in told)
        assert Counter((r.doc_id, r["size"], r.text_crc32, r["shard"], r.grown_shard) for r in rows) == want
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def brute_copies(rows, pattern=(5, 2, 1), share=1.5, cap=2.0):
    """For each row (doc_id, text, source): doc_id, size, source_size, target, copies, text."""
    sizes = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), t) for i, t, s in rows]
    total = defaultdict(int)
    for _, s, n, _ in sizes:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: pattern[k % len(pattern)] for k, s in enumerate(order)}
    left, full, target = share * sum(total.values()), set(), {}
    while True:  # reshare until no source is above its cap
        open_ = [s for s in order if s not in full]
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > cap * total[s]]
        if not over:
            break
        for s in over:
            full.add(s)
            target[s] = cap * total[s]
        left = share * sum(total.values()) - sum(target.values())
    for s in open_:
        target[s] = left * weight[s] / w if total[s] else 0.0
    out = []
    for s in order:
        own = []
        for i, src, n, t in sizes:
            if src == s:
                name = "null:" + hashlib.md5((t or "").encode()).hexdigest() if i is None else i
                u = (int(hashlib.md5(f"mix{name}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
                mean = None if t is None else max(len(t) / max(n, 1), 1e-9)
                quality = 0.25 if t is None else max(0.25, min(1.0, mean / 3, 13 / mean))
                own.append((-math.log(u) / quality, i, n, t))
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest, before = target[s] - epochs * total[s], 0
        for _, i, n, t in sorted(own, key=lambda x: (x[0], -(1 << 63) if x[1] is None else x[1])):
            out.append((i, n, total[s], round(target[s], 6), epochs + (before + n / 2 < rest and rest > 0), t))
            before += n
    return out


def brute_mix(rows):
    return sorted(((i, n, of, target, n * copies) for i, n, of, target, copies, _ in brute_copies(rows)), key=str)


def test_mixing(odd, empty, corpus):
    assert mixing.mix(empty).count() == 0
    got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(corpus).collect()), key=str)
    assert got == brute_mix([(r.doc_id, r.text, r.source) for r in corpus.collect()])
    rows = mixing.mix(odd, keep=["source"]).collect()
    assert len(rows) == odd.count() and all(r.taken <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd, keep=["source"]).collect()))


def test_mixing_without_ids_and_of_many_sources(spark, monkeypatch):
    docs = [(None, " ".join(f"word{k}" for k in range(i % 40 + 5)) + f" {i}", f"s{i % 3}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), keep=["source"]).collect()
    target, taken = {r.source: r.target for r in got}, Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 45 for s in target) and {r.taken // r["size"] for r in got} <= {0, 1, 2}
    many = [(i, " ".join(["some"] * (i * i % 90 + 1)) + " text", f"host{i % 211}" if i % 7 else None) for i in range(1500)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    for limit in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        got = sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect()), key=str)
        assert got == brute_mix([(r.doc_id, r.text, r.source) for r in df.collect()])
    weighed = df.withColumn("good", F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.25))
    share = mixing.mix(weighed.withColumn("source", F.lit("a")), (1,), 0.4, weight="good").where("taken > 0").agg(F.avg(F.col("doc_id") % 2)).first()[0]
    assert share < 0.35


URLS = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/7", "http://example.com/en/75?x=/de/", "http://a.example.com/en/8", "http://xexample.com/en/", "ftp://b.net/de/8", "http://example.net/de/8", "http://sub.example.net/de/89#f", "http://org/es/", "http://a.org/ES/", "http://a.org:80/es/", "http://É.ORG/es/x", "http://a.com?/en/", "http://com/en/1://x"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else "allow"


def test_url_filter(spark, monkeypatch):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, key string")
    pages = pages.unionByName(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select((F.col("page_id") + 100).alias("page_id"), "url"), allowMissingColumns=True)
    told = {r.page_id: r.url for r in pages.collect()}
    for limit in (url_filter.MOST_BYTES, 0):  # a filter of one block passes nearly everything
        monkeypatch.setattr(url_filter, "MOST_BYTES", limit)
        got = url_filter.judge_urls(pages, rules).collect()
        assert len(got) == len(told) and all((r.host, r.path, r.rule, r.verdict) == judged(told[r.page_id]) for r in got)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("most", [url_filter.MOST_BYTES, 320])
def test_blocked_bloom_has_no_false_negatives(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BYTES", most)
    listed = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".com/x")).alias("url"))
    got = url_filter.judge_urls(pages, listed).groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"block": 3000, "allow": 3000}


def brute_licence(files):
    """id -> licence, origin, by dense TF-IDF."""
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    df = Counter(w for _, _, t in files for w in set(words(t)))
    n = len(files)
    known = {w for _, t in licenses.TEMPLATES for w in words(t)}
    idf = lambda w: math.log((n + 2) / (df[w] + 1)) if w in known else math.log(n + 2)
    vector = lambda t: {w: c * idf(w) for w, c in Counter(words(t)).items()}

    def cosine(a, b):
        return sum(x * b.get(w, 0) for w, x in a.items()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))

    made = [(name, vector(t)) for name, t in licenses.TEMPLATES]
    own, governed = {}, {}
    for i, path, t in files:
        found, noted = [], 0
        for line in (t or "").split("\n"):
            if v := vector(line):
                best = min(((-round(cosine(v, m), 9), name) for name, m in made), default=None)
                if -best[0] >= licenses.COSINE:
                    found.append(best)
                    noted += len(words(line))
        if found:
            own[i] = min(found)
            if path is not None and noted >= licenses.FILE_SHARE * len(words(t)):
                d = re.sub("/?[^/]*$", "", path)
                governed[d] = min(governed.get(d, min(found)), min(found))
    out = {}
    for i, path, _ in files:
        out[i] = (own[i][1], "own") if i in own else (None, None)
        d = None if i in own or path is None else re.sub("/?[^/]*$", "", path)
        while d is not None:
            if d in governed:
                out[i] = (governed[d][1], "inherited")
                break
            d = re.sub("/?[^/]*$", "", d) if d else None
    return out


def test_licences(spark, odd, empty):
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "some words here"), (3, "a/b/d.txt", "text text\nLicensed under CC BY-NC 4.0.\nmore words that fill the file up and up"), (4, "x/y", None), (5, None, "Licensed under CC BY 4.0."), (6, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (7, "a/z", ""), (8, "a/b/q/r", "licensed to kill, released version"), (9, "top", "none")]
    df = spark.createDataFrame(files, "id long, path string, text string")
    got = {r.id: (r.licence, r.origin) for r in licenses.scan_licences(df).collect()}
    assert got == brute_licence(files)
    again = licenses.scan_licences(df.unionByName(df).unionByName(df.where("id in (1, 3)"))).collect()  # repeated rows change nothing
    assert Counter((r.id, r.licence, r.origin) for r in again) == Counter({(i, *v): 3 if i in (1, 3) else 2 for i, v in got.items()})
    assert got[2] == ("Apache-2.0", "inherited") and got[3] == ("CC-BY-NC-4.0", "own") and got[7] == ("MIT", "inherited") and got[4] == (None, None)
    plain = odd.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "text", "key", "n")
    assert licenses.scan_licences(plain).count() == odd.count()
    assert licenses.scan_licences(empty.select(F.col("doc_id").alias("id"), F.col("source").alias("path"), "text")).count() == 0


def test_licences_beyond_single_lines(spark):
    mit = (licenses.TEXTS / "MIT.txt").read_text()
    wrapped = "# Use of this source code is governed by\n# a BSD-style license that can be found\n# in the LICENSE file.\n\n" + "value = other(thing)\n" * 60
    files = [
        (1, "m/LICENSE", mit.replace("<year> <copyright holders>", "2021 The Authors")),
        (2, "m/src/a.c", "int main"),
        (3, "n/b.c", "// Copyright 2021 The Authors. Released under the MIT License."),
        (4, "n/c.c", "Copyright 2020 Example Corp. All rights reserved. Licensed under the Apache License, Version 2.0."),
        (5, "n/d.c", "some plain words stand before Released under the MIT License. and some more of them stand after it"),
        (6, "n/e.py", wrapped),
        (7, "n/f.py", "# SPDX-License-Identifier: GPL-3.0-or-later\nx = 1"),
        (8, "q/g.py", "# SPDX-License-Identifier: ISC\nx = 1"),
        (9, "g/COPYING", (licenses.TEXTS / "GPL-3.0.txt").read_text()),
        (10, "g/x/y", None),
        (11, "h/a", "the license of the source is a matter of this file and of that work"),
        (12, "k/LICENSE", "Licensed under the\nApache License,\nVersion 2.0."),
        (13, "k/z", ""),
        (14, "p/a.c", "// This work is licensed under the GNU General Public License, version 2."),
        (15, "p/b.c", "// This work is licensed under the GNU General Public License, version 3."),
        (16, "r/LICENSE", (licenses.TEXTS / "Apache-2.0.txt").read_text()),
        (17, "r/a", "x"),
        (18, "s/LICENSE", (licenses.TEXTS / "BSD-3-Clause.txt").read_text().replace("<year> <owner>", "2019 Someone")),
        (19, "s/a", "x"),
        (20, "t/a", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ]
    files += [(100 + i, f"o/{i}", f"other words of file {i}") for i in range(100)]
    got = {r.id: (r.licence, r.origin) for r in licenses.scan_licences(spark.createDataFrame(files, "id long, path string, text string")).collect()}
    assert {i: v for i, v in got.items() if i < 100} == {
        1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "own"), 4: ("Apache-2.0", "own"), 5: ("MIT", "own"), 6: ("BSD-3-Clause", "own"), 7: ("GPL-3.0", "own"),
        8: (None, None), 9: ("GPL-3.0", "own"), 10: ("GPL-3.0", "inherited"), 11: (None, None), 12: ("Apache-2.0", "own"), 13: ("Apache-2.0", "inherited"), 14: ("GPL-2.0", "own"), 15: ("GPL-3.0", "own"), 16: ("Apache-2.0", "own"), 17: ("Apache-2.0", "inherited"),
        18: ("BSD-3-Clause", "own"), 19: ("BSD-3-Clause", "inherited"), 20: ("LGPL-2.1", "own"),
    }
    assert all(got[100 + i] == (None, None) for i in range(100))
