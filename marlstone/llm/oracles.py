"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licenses import TEMPLATES

_RULES = "(VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),('example.net','/de/8','block'),('org','/es/','block')) r(h,p,v)"
_AZ = "translate(%s,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
_TERM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_TEMPLATES = "(VALUES " + ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES)) + ") k(template, licence, text)"

ORACLES = {
    "op1_url_filter": f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url,'://')>0 THEN substr(url, instr(url,'://')+3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, {_AZ % "regexp_extract(coalesce(rest,''),'^[^/?#]*')"} AS host, regexp_extract(regexp_replace(coalesce(rest,''),'^[^/?#]*',''),'^[^?#]*') AS path FROM u),
m AS (SELECT s.*, h||p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h)+length(p) DESC NULLS LAST, length(h) DESC) AS k FROM s LEFT JOIN {_RULES} ON (host=h OR ends_with(host,'.'||h)) AND starts_with(path,p))
SELECT page_id, host, path, rule, coalesce(v,'allow') AS verdict FROM m WHERE k=1""",
    "op2_decontaminate": f"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all({_AZ % "text"}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents),
bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_AZ % "text"}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bi AS (SELECT DISTINCT item, least(len(w),10) AS n, array_to_string(w[i:i+9],' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w)-9,1)+1)) AS i FROM bw WHERE len(w)>0)),
ns AS (SELECT DISTINCT n FROM bi),
di AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1],' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w)-n+2)) AS i FROM dw, ns WHERE len(w)>=n)),
h AS (SELECT doc_id, i, di.n, item FROM di JOIN bi ON di.win=bi.win AND di.n=bi.n),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS k FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(joined,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op9_mixing": """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text,'[^\\x20\\x09-\\x0D]+')),0) AS size, coalesce(CAST(doc_id AS VARCHAR),'null:'||md5(coalesce(text,''))) AS name, length(text)::DOUBLE/greatest(coalesce(len(regexp_extract_all(text,'[^\\x20\\x09-\\x0D]+')),0),1) AS mean FROM documents),
k AS (SELECT *, -ln((CAST('0x'||substr(md5('mix'||name),1,13) AS BIGINT)+0.5::DOUBLE)/4503599627370496.0::DOUBLE)/(CASE WHEN mean IS NULL THEN 0.25::DOUBLE ELSE greatest(0.25::DOUBLE, least(1.0::DOUBLE, mean/3.0::DOUBLE, 13.0::DOUBLE/greatest(mean, 1e-9::DOUBLE))) END) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE,2.0::DOUBLE,1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)-1)%3)+1] AS w, source_size*2.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER ()*1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most/w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))/sum(w) OVER (ORDER BY most/w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
t AS (SELECT source, source_size, CASE WHEN source_size>0 THEN least(most, max(lev) OVER ()*w) ELSE 0 END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size>0 THEN CAST(floor(target/source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
m AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target-e.epochs*e.source_size AS rest, sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS UNBOUNDED PRECEDING)-k.size/2.0::DOUBLE AS middle FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((epochs+CASE WHEN middle<rest THEN 1 ELSE 0 END)*size AS BIGINT) AS taken, CAST(epochs+CASE WHEN middle<rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM m""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, CAST(strlen(coalesce(text,'')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, 2*i+1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n-49)) AS i FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE first < doc_id),
gap AS (SELECT doc_id, i, CASE WHEN i <= max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM gap),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
piece AS (SELECT doc_id, a AS pos, substr(h, 2*prev+1, 2*(a-prev)) AS kept FROM (SELECT d.doc_id, h, a, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS prev FROM span JOIN d USING (doc_id))
  UNION ALL SELECT doc_id, n + 1, substr(h, 2*coalesce(b,0)+1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(kept, '' ORDER BY pos))) AS kept_sha256 FROM piece GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(b-a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed,0) AS n_removed, coalesce(n_spans,0) AS n_spans, kept_sha256 FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)""",
    "op6_sharding": """
WITH RECURSIVE j(doc_id, n, b, j, k) AS (
  SELECT doc_id, n, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(doc_id AS HUGEINT) FROM (SELECT DISTINCT doc_id FROM documents), (VALUES (24),(25)) s(n)
  UNION ALL SELECT doc_id, n, j, CAST(floor((j+1) * (2147483648.0::DOUBLE / CAST(k2 // 8589934592::HUGEINT + 1 AS DOUBLE))) AS BIGINT), k2 FROM (SELECT *, (k * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE j < n)),
h AS (SELECT doc_id, max(CASE WHEN n=24 THEN b END) AS shard, max(CASE WHEN n=25 THEN b END) AS grown FROM j WHERE j >= n GROUP BY doc_id),
r AS (SELECT doc_id, CAST(strlen(coalesce(text,'')) + 8 AS BIGINT) AS size, hex(encode(coalesce(text,''))) AS x FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(x)//2), lambda i: CAST('0x'||substr(x, 2*i+1, 2) AS BIGINT))), lambda a, y: list_reduce([xor(a, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, v: xor(u >> 1, 3988292384::BIGINT * (u & 1)))), 4294967295::BIGINT) AS text_crc32 FROM r)
SELECT c.doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY md5(coalesce(CAST(c.doc_id AS VARCHAR), '') || ':' || size || ':' || text_crc32), c.doc_id, size, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM c JOIN h ON c.doc_id = h.doc_id""",
    "op7_near_dup": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_AZ % "text"}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-4, 1)+1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN t ta ON x = ta.doc_id JOIN t tb ON y = tb.doc_id WHERE 10 * m >= 8 * (ta.n + tb.n - m)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, least(d.doc_id, min(r.b)) AS class_id, least(d.doc_id, min(r.b)) = d.doc_id AS representative FROM documents d LEFT JOIN r ON r.a = d.doc_id GROUP BY d.doc_id""",
    "op8_licenses": f"""
WITH f AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, coalesce(text,'') AS text FROM documents),
n AS (SELECT count(*) AS n FROM f),
tt AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM {_TEMPLATES}) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_TERM}')) AS term FROM f) WHERE term IN (SELECT term FROM tt) GROUP BY term),
idf AS (SELECT DISTINCT tt.term, ln((n.n + 2)::DOUBLE / (coalesce(df, 0) + 1)) AS idf FROM tt LEFT JOIN df ON tt.term = df.term, n),
tv AS (SELECT template, licence, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS norm FROM tt JOIN idf USING (term)),
u AS (SELECT DISTINCT doc_id, path, text FROM f),
lines AS (SELECT doc_id, path, text, unnest(string_split(text, chr(10))) AS line FROM u),
lt AS (SELECT line, term, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '{_TERM}')) AS term FROM (SELECT DISTINCT line FROM lines)) GROUP BY ALL),
lv AS (SELECT line, lt.term, tf, tf * coalesce(idf, ln(n.n + 2)) AS w FROM lt LEFT JOIN idf ON lt.term = idf.term, n),
ln_ AS (SELECT line, sqrt(sum(w * w)) AS norm, sum(tf) AS words FROM lv GROUP BY line),
sc AS (SELECT line, words, licence, round(sum(lv.w * tv.w / tv.norm) / any_value(ln_.norm), 9) AS score FROM lv JOIN tv ON lv.term = tv.term JOIN ln_ USING (line) GROUP BY line, words, template, licence),
bl AS (SELECT line, words, licence, score FROM sc WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, licence) = 1),
own AS (SELECT doc_id, path, text, licence, score, sum(words) OVER (PARTITION BY doc_id, path, text) AS noted FROM lines JOIN bl USING (line) QUALIFY row_number() OVER (PARTITION BY doc_id, path, text ORDER BY score DESC, licence) = 1),
g AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS above, licence, score FROM own WHERE noted >= 0.5 * len(regexp_extract_all(lower(text), '{_TERM}')) QUALIFY row_number() OVER (PARTITION BY above ORDER BY score DESC, licence) = 1),
dirs AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS dir FROM f),
near AS (SELECT dir, above, g.licence, g.score FROM dirs JOIN g ON above = '' OR above = dir OR starts_with(dir, above || '/') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT f.doc_id, f.path, CASE WHEN own.licence IS NOT NULL THEN own.licence ELSE near.licence END AS licence, CASE WHEN own.licence IS NOT NULL THEN own.score ELSE near.score END AS score, CASE WHEN own.licence IS NOT NULL THEN 'own' WHEN near.dir IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN own.licence IS NULL THEN near.above END AS licence_path
FROM f LEFT JOIN own ON f.doc_id IS NOT DISTINCT FROM own.doc_id AND f.path = own.path AND f.text = own.text LEFT JOIN near ON regexp_replace(f.path, '/?[^/]*$', '') = near.dir""",
}
