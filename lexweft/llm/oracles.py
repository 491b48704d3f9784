"""SQL for those registered queries whose results SQL can express."""

from __future__ import annotations

from .sharding import PRIME, round_keys

_HOST = "translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's')"

OP1 = f"""
WITH u AS (SELECT DISTINCT url, {_HOST} AS host, {_PATH} AS path FROM pages WHERE url IS NOT NULL),
parts AS (SELECT url, host, path, string_split(host, '.') AS h FROM u),
tokens AS (SELECT DISTINCT url, token FROM (
  SELECT url, unnest(list_concat(
    list_transform(range(len(h)), lambda i: 'h:' || array_to_string(h[CAST(i AS BIGINT) + 1:], '.')),
    ['p:' || regexp_extract(path, '^/([^/]+)/', 1), 'x:' || lower(regexp_extract(path, '[.]([A-Za-z0-9]+)$', 1)), 's:' || lower(regexp_extract(url, '^([A-Za-z]+)://', 1))],
    list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda q: 'q:' || split_part(q, '=', 1)))) AS token FROM parts)
  WHERE length(token) > 2),
known AS (SELECT doc_id, bool_or(coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1) AS block FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
labelled AS (SELECT url, CAST(block AS INTEGER) AS block FROM u JOIN known ON doc_id = TRY_CAST(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})', 1) AS BIGINT)),
n AS (SELECT count(*) AS n, greatest(0.001, 20.0 / count(*)) AS least FROM labelled),
t AS (SELECT url, token, block FROM tokens JOIN labelled USING (url)),
sets AS (
  SELECT [token] AS needs, count(*) AS c, sum(block) AS b FROM t GROUP BY ALL
  UNION ALL SELECT [x.token, y.token], count(*), sum(x.block) FROM t x JOIN t y ON x.url = y.url AND x.token < y.token GROUP BY ALL
  UNION ALL SELECT [x.token, y.token, z.token], count(*), sum(x.block) FROM t x JOIN t y ON x.url = y.url AND x.token < y.token JOIN t z ON y.url = z.url AND y.token < z.token GROUP BY ALL),
rules AS (SELECT needs, array_to_string(needs, '&') AS rule, b::DOUBLE / c AS confidence FROM sets, n WHERE b >= n.least * n.n AND b::DOUBLE / c >= 0.7),
mined AS (SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM rules s WHERE s.rule != r.rule AND len(list_intersect(s.needs, r.needs)) = len(s.needs) AND s.confidence >= r.confidence)),
met AS (SELECT u.url, m.rule, m.confidence FROM (SELECT url, list(token) AS own FROM tokens GROUP BY url) u JOIN mined m ON len(list_intersect(u.own, m.needs)) = len(m.needs)),
fired AS (SELECT url, rule AS mined_rule, confidence FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY confidence DESC, rule) AS r FROM met) WHERE r = 1),
stated AS (SELECT * FROM (VALUES ('com', '/', 'com/', 'allow'), ('example.com', '/en/', 'example.com/en/', 'block'), ('www.example.com', '/en/', 'www.example.com/en/', 'allow'), ('net', '/es/', 'net/es/', 'block'), ('net', '/fr/', 'net/fr/', 'block')) s(h, p, rule, verdict)),
fits AS (SELECT url, rule, verdict FROM (SELECT u.url, s.rule, s.verdict, row_number() OVER (PARTITION BY u.url ORDER BY length(s.rule) DESC, s.rule DESC) AS r
  FROM u JOIN stated s ON (u.host = s.h OR ends_with(u.host, '.' || s.h)) AND starts_with(u.path, s.p)) WHERE r = 1)
SELECT p.page_id, {_HOST.replace('url', 'p.url')} AS host, {_PATH.replace('url', 'p.url')} AS path, f.rule, coalesce(f.verdict, CASE WHEN m.mined_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, m.mined_rule, m.confidence
FROM pages p LEFT JOIN fits f ON f.url = p.url LEFT JOIN fired m ON m.url = p.url"""

OP2 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN least USING (doc_id)"""


# Every alignment of a document with an item that a mask hits, compared word by word.
OP4 = r"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM documents),
b AS (SELECT *, len(w) AS n FROM (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x != '') AS w FROM benchmark)),
i AS (SELECT * FROM b WHERE n >= 5),
ds AS (SELECT doc_id, text, p, unnest([[w[p], w[p + 1], w[p + 2]], [w[p], w[p + 1], '*', w[p + 3], w[p + 4]]]) AS seed FROM (SELECT *, unnest(range(1, len(w) - 1)) AS p FROM d)),
bs AS (SELECT item_id, w, p, unnest([[w[p], w[p + 1], w[p + 2]], [w[p], w[p + 1], '*', w[p + 3], w[p + 4]]]) AS seed FROM (SELECT *, unnest(range(1, n - 1)) AS p FROM i)),
hits AS (SELECT DISTINCT ds.doc_id, ds.text, bs.item_id, bs.w AS item, ds.p - bs.p AS off FROM ds JOIN bs ON ds.seed = bs.seed AND NOT list_contains(list_transform(ds.seed, lambda x: x IS NULL), true)),
pairs AS (SELECT h.doc_id, h.text, h.item_id, h.off, len(h.item) AS n, list_transform(range(1, len(h.item) + 1), lambda k: CASE WHEN h.off + k >= 1 AND d.w[h.off + k] = h.item[k] THEN 1 ELSE 0 END) AS same
  FROM hits h JOIN d ON d.doc_id IS NOT DISTINCT FROM h.doc_id AND d.text = h.text),
counted AS (SELECT *, CAST(list_sum(same) AS INTEGER) AS matched, list_max(list_transform(range(0, greatest(n - 24, 0) + 1), lambda c: list_sum(same[c + 1:c + 24]))) AS best FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY matched DESC, off, n DESC) AS r FROM counted WHERE matched >= 0.75 * n OR best >= 21)
SELECT doc_id, item_id, CAST(off AS INTEGER) AS "offset", matched, CAST(n AS INTEGER) AS item_words FROM ranked WHERE r = 1
UNION ALL SELECT d.doc_id, b.item_id, 0, CAST(n AS INTEGER), CAST(n AS INTEGER) FROM d JOIN b ON d.w = b.w WHERE n BETWEEN 1 AND 4"""


def _feistel(source: str, keys: list[int]) -> str:
    """SQL that applies the permutation to x of a source with g, x, n and bits."""
    sql = f"SELECT g, n, bits, x >> bits AS l, x & ((1 << bits) - 1) AS r FROM ({source})"
    for k in keys:
        m = f"((r + {k}) % {PRIME})"
        sql = f"SELECT g, n, bits, r AS l, xor(l, (({m} * {m} + {k}) % {PRIME}) & ((1 << bits) - 1)) AS r FROM ({sql})"
    return f"SELECT g, n, bits, (l << bits) | r AS x FROM ({sql})"


def op5(shards: int = 8, seed: int = 20) -> str:
    """Checksums bit by bit, row numbers by window, and cycle walking by recursion."""
    keys = round_keys(seed)
    return f"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM documents),
crc AS (SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, CASE WHEN text IS NOT NULL THEN xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) END AS text_crc32 FROM b CROSS JOIN tab),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS g, count(*) OVER () AS n FROM crc),
placed AS (SELECT g, n, g AS x, (SELECT min(i) FROM range(1, 31) t(i) WHERE (1::BIGINT << CAST(2 * i AS INTEGER)) >= n) AS bits FROM ranked),
walk AS ({_feistel('SELECT g, n, bits, x FROM placed', keys)} UNION ALL {_feistel('SELECT g, n, bits, x FROM walk WHERE x >= n', keys)})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM ranked JOIN walk USING (g) WHERE x < ranked.n"""


OP7 = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON c.vec_id != q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d) WHERE rank <= 10"""

# Words, weights and the level at which sources are full: the level is the highest that any number of full sources gives.
OP12 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(concat_ws(':', '42', CAST(doc_id AS VARCHAR), text)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
o AS (SELECT 3 * source_size AS cap, weight, sum(3 * source_size) OVER w AS capped, sum(weight) OVER () - sum(weight) OVER w AS rest FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (SELECT max(level) AS level FROM (SELECT sum(source_size)::DOUBLE / sum(weight) AS level FROM s UNION ALL SELECT ((SELECT sum(source_size) FROM s) - capped)::DOUBLE / rest FROM o WHERE rest > 0)),
t AS (SELECT source, source_size, CASE WHEN level * weight > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE level * weight END AS target FROM s, level),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before FROM d),
c AS (SELECT doc_id, size, source_size, target, epochs, greatest(0, least(CAST(floor(target + 0.5) AS BIGINT) - epochs * source_size - before, size)) AS cut FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, epochs * size + cut AS taken, epochs, cut FROM c"""


_GRAM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Checksums byte by byte over all runs of one to three words.
OP13 = rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, {_GRAM_WORDS} AS w FROM documents),
t AS (SELECT {_GRAM_WORDS} AS w FROM benchmark),
g AS (SELECT row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS g FROM (SELECT row, w FROM d UNION ALL SELECT NULL, w FROM t)),
n AS (SELECT row, g, count(*) AS n FROM g GROUP BY ALL),
b AS (SELECT g, list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM (SELECT DISTINCT g FROM n)),
k AS (SELECT g, xor(list_reduce(b, lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS k FROM b CROSS JOIN tab),
f AS (SELECT row, k, sum(n) AS n FROM n JOIN k USING (g) GROUP BY ALL),
sums AS (SELECT k, coalesce(sum(n) FILTER (row IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (row IS NULL), 0) AS t FROM f GROUP BY k),
a AS (SELECT sum(s)::DOUBLE AS all_s, sum(t)::DOUBLE AS all_t FROM sums),
gains AS (SELECT k, floor(1000 * ln((t::DOUBLE + 1) * (all_s + 10000) / ((s::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM sums, a),
weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM f JOIN gains USING (k) WHERE row IS NOT NULL GROUP BY row),
scored AS (SELECT doc_id, len(w) AS words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weights USING (row)),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS r, count(*) OVER () AS able FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * able // 100 THEN r END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE words < 20"""

ORACLES = {"op1_url_filters": OP1, "op2_ngram_join": OP2, "op4_decontamination": OP4, "op5_sharding": op5(), "op7_nearest_neighbours": OP7, "op12_source_mixing": OP12, "op13_importance_resampling": OP13}
