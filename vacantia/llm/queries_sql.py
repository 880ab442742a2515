"""The queries of the subpackage in DuckDB SQL, where SQL can express their results; for checks only."""

_DECONTAMINATE_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM benchmark
), doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
  FROM documents
), item_shingles AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)
), sizes AS (
  SELECT item_id, count(*) AS n_shingles FROM item_shingles GROUP BY item_id
), doc_shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)
)
SELECT d.doc_id, t.item_id, n_shingles, count(*) AS n_shared
FROM doc_shingles d JOIN item_shingles t USING (s) JOIN sizes USING (item_id)
GROUP BY d.doc_id, t.item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

_LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
      unnest(range(0, len(string_split(text, chr(10))))) AS i
    FROM documents WHERE text IS NOT NULL)
), ahead AS (
  SELECT doc_id, i, line, lead(line, 1) OVER w AS line2, lead(line, 2) OVER w AS line3
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), placed AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, line2, line3 ORDER BY doc_id, i) AS n
  FROM ahead WHERE line3 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM placed WHERE n > 1
), marked AS (
  SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT removed), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_HOST = r"""translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _strength(level: str, name: str) -> str:
    """The moment estimate over a level's members, as a table of one row."""
    return f"""
{name}_sums AS (
  SELECT count(*) AS m, sum(n)::DOUBLE AS n, sum(bad) / sum(n)::DOUBLE AS p, sum(n * n)::DOUBLE AS n2,
    sum(bad * bad / n::DOUBLE) AS b2 FROM {level} WHERE n > 0
), {name} AS (
  SELECT CASE WHEN p * (1 - p) <= 0 OR n - n2 / n - (m - 1) <= 0 THEN 10000.0
    WHEN b2 - n * p * p - p * (1 - p) * (m - 1) <= 0 THEN 10000.0
    ELSE least(greatest(p * (1 - p) * (n - n2 / n - (m - 1)) / (b2 - n * p * p - p * (1 - p) * (m - 1)) - 1, 1.0), 10000.0)
    END AS s FROM {name}_sums
)"""


_HOST_SQL = rf"""
WITH parts AS (
  SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), counts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(quality) AS n, coalesce(sum(1 - quality), 0)::BIGINT AS bad
  FROM parts LEFT JOIN labels ON page_id = doc_id GROUP BY host
), domains AS (
  SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM counts GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix
), {_strength("counts", "of_host")}, {_strength("domains", "of_domain")}, {_strength("suffixes", "of_suffix")},
suffix_rates AS (
  SELECT suffix, (bad + (SELECT s FROM of_suffix) * (SELECT sum(bad) / sum(n)::DOUBLE FROM suffixes))
    / (n + (SELECT s FROM of_suffix)) AS rate FROM suffixes
), domain_rates AS (
  SELECT domain, (bad + (SELECT s FROM of_domain) * rate) / (n + (SELECT s FROM of_domain)) AS rate
  FROM domains JOIN suffix_rates USING (suffix)
), hosts AS (
  SELECT host, n + (SELECT s FROM of_host) AS size, (bad + (SELECT s FROM of_host) * rate) / (n + (SELECT s FROM of_host)) AS mean
  FROM counts JOIN domain_rates USING (domain)
), judged AS (
  SELECT page_id, p.host, path, mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)) AS bound,
    CASE WHEN (p.host = 'example.org' OR p.host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (p.host = 'example.org' OR p.host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (p.host = 'org' OR p.host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts p JOIN hosts USING (host)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce(bound, 0) >= 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_WARC_SQL = """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), carried AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS carrier FROM told
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN carrier <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN carrier <> page_id THEN carrier END AS refers_to
FROM carried
"""

_VECTORS_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size
  FROM embeddings WHERE embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id
  WHERE a.size > 0 AND b.size > 0 AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.9
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

_REPEATS_SQL = rf"""
WITH texts AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 20], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS i FROM texts)
), placed AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM windows
), gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 20)) AS i FROM placed WHERE n > 1
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM texts
), kept AS (
  SELECT e.doc_id, count(*) FILTER (g.i IS NOT NULL) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (g.i IS NULL), '') AS left_over
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_JACCARD_SQL = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM texts WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes x ON a.doc_id = x.doc_id JOIN sizes y ON b.doc_id = y.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT d.doc_id, coalesce(max(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id
"""

def _round(n: int) -> str:
    """Centroids after round ``n``, from those before it; squares of small integers are exact in doubles."""
    return f"""
near{n} AS (
  SELECT vec_id, q, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.vec_id, v.q, c.cluster,
      list_dot_product(v.q, v.q) + list_dot_product(c.q, c.q) - 2 * list_dot_product(v.q, c.q) AS d
    FROM whole v CROSS JOIN c{n - 1} c) GROUP BY vec_id, q
), sums{n} AS (
  SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
    SELECT cluster, unnest(range(0, 64)) AS i, unnest(q)::BIGINT AS x FROM near{n}) GROUP BY cluster, i
), moved{n} AS (
  SELECT cluster, list((((s - ((s % n + n) % n)) // n))::DOUBLE ORDER BY i) AS q FROM sums{n} GROUP BY cluster
), c{n} AS (SELECT o.cluster, coalesce(m.q, o.q) AS q FROM c{n - 1} o LEFT JOIN moved{n} m USING (cluster))"""


_CLUSTERS_SQL = f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, q
  FROM (SELECT q, sha256('1:' || vec_id) AS h FROM whole ORDER BY h LIMIT 16)
), {", ".join(map(_round, range(1, 5)))},
named AS (
  SELECT cluster, sha256(array_to_string(list_transform(q, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256 FROM c3
)
SELECT vec_id, cluster::INTEGER AS cluster, d::BIGINT AS distance,
  (sum(d::BIGINT) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d::BIGINT) OVER ())::BIGINT AS inertia,
  centroid_sha256
FROM near4 JOIN named USING (cluster)
"""

_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
_SEARCH_SQL = f"""
WITH texts AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT doc_id, len(w) AS n FROM texts WHERE len(w) > 0),
told AS (SELECT count(*)::HUGEINT AS docs, sum(n)::HUGEINT AS terms FROM sizes),
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM texts) GROUP BY doc_id, term),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, told GROUP BY term, docs
), placed AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms)::BIGINT AS m FROM sizes, told),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN placed USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""

_EXACT_SQL = """
WITH told AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM told WINDOW same AS (PARTITION BY text_sha256)
"""

ORACLES: dict[str, str] = {
    "op1_decontaminate": _DECONTAMINATE_SQL,
    "op2_host_reputation": _HOST_SQL,
    "op3_warc": _WARC_SQL,
    "op6_vector_cells": _VECTORS_SQL,
    "op7_suffix_repeats": _REPEATS_SQL,
    "op8_jaccard_join": _JACCARD_SQL,
    "op9_line_dedup": _LINE_DEDUP_SQL,
    "op11_pivot_clusters": _CLUSTERS_SQL,
    "op12_ranked_search": _SEARCH_SQL,
    "op13_chunk_recipes": _EXACT_SQL,
}
