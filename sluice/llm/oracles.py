"""DuckDB SQL for those queries of this subpackage that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str, lower: bool = True) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text}, '{pattern}')"


OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", SPACED)} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(least.b, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(least.b, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON least.a = d.doc_id
"""

OP6 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text", PLAIN)} AS w FROM documents),
b AS (SELECT item_id, {_words("text", PLAIN)} AS w FROM benchmark),
v AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
c AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT r, i, c.n, item_id FROM c JOIN v ON c.g = v.g AND c.n = v.n),
k AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""

OP7 = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(verdict, h, p) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id, host, path ORDER BY len(h || p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""

OP8 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_words("text", SPACED, lower=False)} AS w FROM documents),
g AS MATERIALIZED (
  SELECT r, doc_id, i, array_to_string(w[i : i + 49], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
m AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s),
gone AS MATERIALIZED (
  SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM g JOIN m ON g.s = m.s WHERE m.least < g.doc_id),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (
  SELECT x.r, string_agg(word, ' ' ORDER BY x.p) AS kept FROM x LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p
  WHERE gone.p IS NULL GROUP BY x.r),
c AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r) LEFT JOIN c USING (r)
"""

_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))))"
_FIELD = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return f"sha256({' || '.join(_FIELD.format(x) for x in fields)})"


#: levels and tops: all nodes, n of them on the level; sides and over: what stands around a leaf's way up.
OP12 = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce('+' || lang, '') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_leaf("text")} END AS candidate FROM documents),
l AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d),
levels AS (
  SELECT tree, 0 AS level, i, leaf AS h, n FROM l
  UNION ALL SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM levels WHERE n > 1 GROUP BY tree, level, i // 8, n),
t AS MATERIALIZED (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, h, n FROM t
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, i // 8, n),
sides AS (
  SELECT l.tree, l.i, level, coalesce(string_agg(h, '' ORDER BY s.i) FILTER (s.i < l.i >> (3 * level)), '') AS b,
    coalesce(string_agg(h, '' ORDER BY s.i) FILTER (s.i > l.i >> (3 * level)), '') AS a
  FROM l JOIN levels s ON s.tree = l.tree AND s.i // 8 = l.i >> (3 * level + 3) AND s.n > 1 GROUP BY l.tree, l.i, level),
over AS (
  SELECT t.tree, level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < t.i >> (3 * level)), '') AS b,
    coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > t.i >> (3 * level)), '') AS a
  FROM t JOIN tops s ON s.i // 8 = t.i >> (3 * level + 3) AND s.n > 1 GROUP BY t.tree, level),
paths AS MATERIALIZED (
  SELECT tree, i, level, b, a FROM sides
  UNION ALL SELECT l.tree, l.i, 1000 + level, b, a FROM l JOIN over ON over.tree = l.tree),
steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree, i ORDER BY level) AS k FROM paths),
fold AS (
  SELECT tree, i, 0 AS k, candidate AS h FROM l
  UNION ALL SELECT f.tree, f.i, s.k, sha256(b || h || a) FROM fold f JOIN steps s ON s.tree = f.tree AND s.i = f.i AND s.k = f.k + 1),
proofs AS (SELECT tree, i, sha256(string_agg(b || a, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY tree, i),
folded AS (SELECT tree, i, max_by(h, k) AS folded_root FROM fold GROUP BY tree, i),
root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, t.h AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN t USING (tree) JOIN root ON true LEFT JOIN proofs ON proofs.tree = l.tree AND proofs.i = l.i JOIN folded ON folded.tree = l.tree AND folded.i = l.i
"""

#: Sources sorted by how soon they are at three times their words; classes by the bits of the size, longest first.
OP13 = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, len({_words("text", SPACED, lower=False)}) AS size,
    (CAST('0x' || left(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(text, '')), 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
f AS (
  SELECT *, coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, (sum(source_size) OVER ())::BIGINT AS total
  FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST)),
l AS (SELECT min_by((total - 3 * capped) / rest, capped) FILTER (WHERE (total - 3 * capped) / rest * w <= 3 * source_size) AS share FROM f),
t AS MATERIALIZED (SELECT source, source_size, least(share * w, (3 * source_size)::DOUBLE) AS target FROM s, l),
c AS (SELECT source, length(bin(size)) AS bits, sum(size)::BIGINT AS words FROM d WHERE size > 0 GROUP BY ALL),
g AS (
  SELECT c.*, target, coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
    (sum(words * bits) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS below
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WINDOW o AS (PARTITION BY c.source ORDER BY bits DESC)),
rate AS (SELECT source, coalesce(max_by((target - 3 * above) / below, bits) FILTER (WHERE (target - 3 * above) / below * bits <= 3), 3.0) AS rate FROM g GROUP BY source),
e AS MATERIALIZED (
  SELECT d.*, source_size, target, CASE WHEN size = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE, rate * length(bin(size))) END AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN rate ON d.source IS NOT DISTINCT FROM rate.source),
x AS MATERIALIZED (
  SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p,
    greatest(target - (sum(floor(e)::BIGINT * size) OVER (PARTITION BY source))::BIGINT, 0.0::DOUBLE) AS room FROM e),
q AS (SELECT *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS x FROM x WHERE p > 0),
k AS MATERIALIZED (
  SELECT *, CASE WHEN (sum(size) OVER (PARTITION BY source ORDER BY x, u, doc_id NULLS FIRST, size, r))::BIGINT <= room THEN 1 ELSE 0 END AS extra FROM q),
gap AS (SELECT source, any_value(room) - sum(extra * size)::BIGINT AS gap FROM k GROUP BY source),
one AS (
  SELECT r FROM (
    SELECT r, gap, abs(gap - size) AS miss, row_number() OVER (PARTITION BY k.source ORDER BY abs(gap - size), x, u, doc_id NULLS FIRST, size, r) AS j
    FROM k JOIN gap ON k.source IS NOT DISTINCT FROM gap.source WHERE extra = 0) WHERE j = 1 AND miss < gap)
SELECT x.doc_id, x.size, x.source_size, x.target, (x.size * (x.whole + coalesce(k.extra, 0) + CASE WHEN one.r IS NULL THEN 0 ELSE 1 END))::BIGINT AS taken
FROM x LEFT JOIN k USING (r) LEFT JOIN one ON one.r = x.r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_dedup_chosen_path": OP5,
        "op6_decontaminate_wu_manber": OP6,
        "op7_url_filter_trie": OP7,
        "op8_substring_dedup_lsm": OP8,
        "op12_merkle_multiproof": OP12,
        "op13_mix_pareto": OP13,
    }
