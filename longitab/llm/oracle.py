"""DuckDB SQL for the registered queries of this package that SQL can express."""

from __future__ import annotations

#: Words of a host that the url query's pattern rules block (fixed values).
UNWANTED = ("spam", "casino", "pills", "viagra", "porn", "phishing", "malware", "warez")

_A2Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: Exact links through common shingles; the closure is taken by repeated joins.
OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A2Z}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS t
      FROM w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS g(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
walk AS (SELECT DISTINCT a AS doc_id, a AS other FROM edge UNION SELECT w.doc_id, e.b FROM walk w JOIN edge e ON w.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM walk GROUP BY doc_id) c USING (doc_id)
"""

OP2 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (SELECT doc_id, norm, first_value(doc_id) OVER g AS keep_id, row_number() OVER g AS nr,
             count(*) OVER (PARTITION BY norm) AS group_size
      FROM d WINDOW g AS (PARTITION BY norm ORDER BY chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, nr = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""

OP9 = rf"""
WITH u AS (SELECT page_id,
                  translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) ELSE '' END, {_A2Z}) AS host,
                  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
p AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL OR regexp_matches(host, '(^|[.-])({"|".join(UNWANTED)})([.-]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""

OP10 = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A2Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_A2Z}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t
        FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS g(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
       FROM dw, sizes, unnest(generate_series(1, len(w) - n + 1)) AS g(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, n, item_id FROM pos JOIN win USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(generate_series(i, i + n - 1)) AS g(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A2Z}), {_TERM}) AS w FROM documents),
stat AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_A2Z}), {_TERM})) AS t FROM benchmark),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stat GROUP BY t, n_docs),
part AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS s FROM tf JOIN w USING (t), stat),
score AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN part USING (t) GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM score QUALIFY rank <= 10
"""

_BIT = "lambda c, _: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"  # fixed value: polynomial of CRC-32
_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), "
        f"lambda h, b: list_reduce(list_prepend(xor(h, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {_BIT}))")


def _fields(text: str) -> str:
    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({c} AS VARCHAR))), ':', {c}) END"
    return f"sha256(concat({', '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))}))"


#: Trees level by level, proofs and folds along the way of each row; ``way`` holds a source's levels, then the root's.
OP12 = f"""
WITH RECURSIVE d AS (SELECT *, xor({_CRC}, 4294967295) % 2 = 0 AS changed, replace(text, chr(10), '') AS now FROM documents),
leaf AS (SELECT doc_id, source, coalesce('=' || source, '-') AS key, {_fields('text')} AS leaf,
                CASE WHEN changed THEN {_fields('now')} ELSE {_fields('text')} END AS now FROM d),
place AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM leaf),
low AS (SELECT key, 0 AS lvl, pos, n, leaf AS h FROM place
        UNION ALL SELECT key, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY key, lvl, pos // 3, n),
sub AS (SELECT key, h, row_number() OVER (ORDER BY encode(key)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, pos, n, h FROM sub
         UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 3, n),
root AS (SELECT h FROM high WHERE n = 1),
lows AS (SELECT x.key, x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
                coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
         FROM low x JOIN low y ON x.key = y.key AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL),
highs AS (SELECT x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos < x.pos), '') AS l,
                 coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (y.pos > x.pos), '') AS r
          FROM high x JOIN high y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 WHERE x.n > 1 GROUP BY ALL),
up AS (SELECT key, pos AS own, 0 AS lvl, pos, now AS h, '' AS proof FROM place
       UNION ALL SELECT u.key, u.own, u.lvl + 1, u.pos // 3, sha256(concat(l, h, r)), concat(proof, l, r)
       FROM up u JOIN lows USING (key, lvl, pos)),
ends AS (SELECT key, own, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM up GROUP BY ALL),
on_ AS (SELECT e.key, own, 0 AS lvl, s.pos, e.h, proof FROM ends e JOIN sub s USING (key)
        UNION ALL SELECT key, own, o.lvl + 1, o.pos // 3, sha256(concat(l, h, r)), concat(proof, l, r) FROM on_ o JOIN highs USING (lvl, pos)),
done AS (SELECT key, own, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM on_ GROUP BY ALL)
SELECT doc_id, leaf, sub.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = root.h AS verified
FROM place JOIN done ON done.key = place.key AND own = place.pos JOIN sub ON sub.key = place.key, root
"""

ORACLE = {"op1_near_dedup": OP1, "op2_exact_dedup": OP2, "op9_url_rules": OP9, "op10_decontamination": OP10, "op11_ball_tree": OP11,
          "op12_merkle": OP12}
