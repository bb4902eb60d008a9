"""SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from .warc import DIGITS

_DIGITS = " || ".join(f"substr('{DIGITS}', 1 + ((('0x' || substr(sha1, {i}, 10))::BIGINT >> {k}) & 31)::INT, 1)" for i in (1, 11, 21, 31) for k in range(35, -1, -5))

OP3 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha1 FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY sha1) AS keeper FROM p)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM keeper AND keeper IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""

#: Equal sets are one class before pairs are made; what each class reaches is followed link by link.
OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d WHERE len(w) >= 4),
run AS (SELECT doc_id, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3 FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
item AS (
  SELECT DISTINCT doc_id, x || ' ' || x1 || ' ' || x2 || ' ' || x3 AS t FROM run WHERE x3 IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(t, chr(10) ORDER BY t)) AS k FROM item GROUP BY doc_id),
class AS (SELECT k, min(doc_id) AS rep, min(n) AS n FROM sets GROUP BY k),
part AS (SELECT rep, n, t FROM class JOIN item ON doc_id = rep),
edge AS (
  SELECT a.rep AS a, b.rep AS b FROM part a JOIN part b ON a.t = b.t AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT rep AS a, rep AS b FROM class UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
least_of AS (SELECT a AS rep, min(b) AS component FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, d.doc_id = coalesce(l.component, d.doc_id) AS kept
FROM d LEFT JOIN sets s USING (doc_id) LEFT JOIN class c USING (k) LEFT JOIN least_of l USING (rep) WHERE d.doc_id IS NOT NULL
"""


OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY row),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
m AS (SELECT row, 100 - 50 + (50 * n * nn) // ll AS m FROM d, c),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3, "op4_near_dedup": OP4, "op13_ranked_search": OP13}
