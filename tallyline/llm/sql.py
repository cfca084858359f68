"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

# Pairs that share a shingle, their Jaccard similarity over whole sets, and the least id reachable over the links.
def linked_sql(size: int, percent: int, columns: str) -> str:
    return rf"""WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {size - 1}], ' ') FOR i IN range(1, len(w) - {size - 2})]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id{columns}
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY 1) USING (doc_id)"""


SQL["op2_minhash_near_dedup"] = linked_sql(3, 85, ", d.doc_id = least_id AS kept")
SQL["op12_count_vector_rtree"] = linked_sql(4, 85, "")

SQL["op7_suffix_array_decontamination"] = rf"""WITH d AS (
    SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS t
    FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
m AS (SELECT d.doc_id, k, z.n, array_to_string(w[k:k + z.n - 1], ' ') AS t
    FROM (SELECT DISTINCT n FROM p) z, d, unnest(range(1, len(w) - z.n + 2)) AS u(k)),
f AS (SELECT m.doc_id, m.k, p.n, p.item_id FROM m JOIN p ON m.n = p.n AND m.t = p.t),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM f) GROUP BY 1),
j AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM f GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)"""

# All phrases of 1 to 5 words within pieces; a phrase that no longer one exceeds in count is not held by it.
SQL["op13_phrase_collocations"] = rf"""WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, w[i:i + k - 1] AS w FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, w, array_to_string(w, ' ') AS phrase, count(*)::HUGEINT AS f FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM p GROUP BY 1),
c AS (SELECT lang, w, phrase, f AS a, unnest(range(1, len(w))) AS k FROM f WHERE len(w) > 1),
s AS (SELECT c.lang, c.w, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score
    FROM c JOIN f x ON x.lang = c.lang AND x.w = c.w[:k] JOIN f y ON y.lang = c.lang AND y.w = c.w[k + 1:] JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT DISTINCT lang, w[i:j] AS w, f FROM (SELECT *, unnest(range(i + 1, len(w) + 1)) AS j FROM (SELECT *, unnest(range(1, len(w))) AS i FROM f)) WHERE j - i + 1 < len(w)),
d AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.w = b.w AND o.f >= b.a)),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM z WHERE rank <= 2000"""

# CRC-32 byte by byte over a table of 256 remainders; words one edit apart share a word with one place blanked or left out.
SQL["op11_trie_spelling"] = rf"""WITH RECURSIVE
t AS (SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
o AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n FROM o WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, xor(list_reduce(
    [4294967295] || flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END FOR c IN string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, '')]),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, t),
r AS (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
k AS (SELECT word, n, k, word[:k] || word[k + 2:] AS less FROM w, unnest(range(length(word))) AS u(k)),
pairs AS (
    SELECT a.word, b.word AS near FROM k a JOIN k b ON a.k = b.k AND a.less = b.less AND a.word <> b.word
    UNION SELECT k.word, w.word FROM k JOIN w ON w.word = k.less
    UNION SELECT w.word, k.word FROM k JOIN w ON w.word = k.less),
b AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS best, max(w.n) AS best_n FROM pairs p JOIN w ON w.word = p.near GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form,
    CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
way AS (SELECT word, word AS root FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f e ON e.word = way.root WHERE e.form IS NULL"""
