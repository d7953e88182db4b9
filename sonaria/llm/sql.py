"""SQL of the queries that it can express, for an engine with lists, regular expressions and recursion."""

from __future__ import annotations

SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""WITH RECURSIVE
    d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: md5(array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [md5(array_to_string(w, ' '))] ELSE [] END)) AS g FROM d),
    sets AS (SELECT g, min(doc_id) AS node, count(*) AS n_copies FROM s WHERE len(g) > 0 GROUP BY g),
    e AS (SELECT node, len(g) AS size, unnest(g) AS x FROM sets),
    near AS (SELECT a.node AS u, b.node AS v FROM e a JOIN e b ON a.x = b.x AND a.node <> b.node GROUP BY a.node, b.node, a.size, b.size HAVING count(*) >= 0.8::DOUBLE * (a.size + b.size - count(*)) - 1e-9),
    reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u),
    classes AS (SELECT u, min(v) AS least FROM reach GROUP BY u), links AS (SELECT u, count(*) AS n FROM near GROUP BY u)
    SELECT doc_id, CASE WHEN len(s.g) = 0 THEN doc_id ELSE least(node, coalesce(c.least, node)) END AS class_id, coalesce(l.n, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
    FROM s LEFT JOIN sets ON s.g = sets.g LEFT JOIN classes c ON c.u = node LEFT JOIN links l ON l.u = node"""

OP7 = f"""WITH d AS (SELECT doc_id, {SPACED} AS w FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
    bad AS (SELECT doc_id, i FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM bad),
    words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
    kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words WHERE (doc_id, p) NOT IN (SELECT (doc_id, p) FROM gone) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH d AS (SELECT doc_id, {ALNUM} AS w FROM documents), b AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
    grams AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b WHERE len(w) > 0))),
    win AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM grams) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, item_id, i, k FROM win JOIN grams USING (k, g)),
    n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
    who AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (doc_id) LEFT JOIN who USING (doc_id)"""

#: A prime, and a number whose powers modulo it weigh the bytes of a window.
PRIME, BASE = (1 << 61) - 1, 1_000_003


def _power(base: int) -> str:
    """base to the power p modulo PRIME, for p below 2**24, by the bits of p."""
    out = "1::HUGEINT"
    for k in range(24):
        out = f"({out}) * CASE WHEN (p >> {k}) & 1 = 1 THEN {pow(base, 1 << k, PRIME)}::HUGEINT ELSE 1::HUGEINT END % {PRIME}"
    return out


#: Windows of 400 bytes are compared by a 61-bit hash from running sums.
OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS x FROM documents),
    b AS (SELECT doc_id, unnest(range(0, len(x))) AS p, unnest(x) AS x FROM d),
    w AS (SELECT p, {_power(BASE)} AS up, {_power(pow(BASE, -1, PRIME))} AS down FROM (SELECT DISTINCT p FROM b)),
    s AS (SELECT doc_id, p, x, down, sum((('0x' || x)::INTEGER + 1) * up % {PRIME}) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM b JOIN w USING (p)),
    win AS (SELECT doc_id, p, x, (lead(s, 399) OVER o - lag(s, 1, 0::HUGEINT) OVER o) % {PRIME} * down % {PRIME} AS h FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
    flag AS (SELECT doc_id, p, x, CASE WHEN h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 THEN 1 ELSE 0 END AS bad FROM win),
    gone AS (SELECT doc_id, p, x, max(bad) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS g FROM flag),
    runs AS (SELECT *, CASE WHEN g = 1 AND lag(g, 1, 0) OVER (PARTITION BY doc_id ORDER BY p) = 0 THEN 1 ELSE 0 END AS first FROM gone),
    t AS (SELECT doc_id, sum(g)::BIGINT AS n, sum(first)::BIGINT AS r, string_agg(x, '' ORDER BY p) FILTER (WHERE g = 0) AS k FROM runs GROUP BY doc_id)
    SELECT doc_id, len(x) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(r, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

SQL = {"op2_jaccard_join": OP2, "op7_substring_dedup": OP7, "op8_suffix_dedup": OP8, "op10_decontamination": OP10}
