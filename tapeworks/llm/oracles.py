"""DuckDB SQL for the registered queries that SQL can express, written from their definitions."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT rid, i + k AS pos FROM rep, (SELECT unnest(range(35)) AS k)),
word AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT word.rid, count(gone.pos) AS n_removed, string_agg(word.word, ' ' ORDER BY word.pos) FILTER (gone.pos IS NULL) AS s FROM word LEFT JOIN gone USING (rid, pos) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT rid, doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM d WHERE text IS NOT NULL),
flat AS (SELECT rid, doc_id, text, pos, trim(translate(raw, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ') AS f FROM raw),
line AS (SELECT rid, doc_id, text, pos, regexp_replace(f, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM flat WHERE f <> ''),
leaf AS (SELECT *, string_split(line, ' ') AS t FROM line),
forms AS (SELECT len(t) || ' ' || array_to_string(t[1:3], ' ') AS leaf, line, any_value(t) AS t, count(*) AS n FROM leaf GROUP BY 1, 2),
top1 AS (SELECT leaf, max(struct_pack(n := n, line := line)).line AS tpl FROM forms GROUP BY 1 HAVING count(*) > 1),
j1 AS (SELECT f.*, tpl, len(list_filter(range(1, len(t) + 1), lambda i: t[i] = string_split(tpl, ' ')[i])) >= 0.7 * len(t) AS same FROM forms f JOIN top1 USING (leaf)),
left1 AS (SELECT leaf, line, t, n FROM j1 WHERE NOT same),
top2 AS (SELECT leaf, max(struct_pack(n := n, line := line)).line AS tpl FROM left1 GROUP BY 1 HAVING count(*) > 1),
j2 AS (SELECT f.*, tpl, len(list_filter(range(1, len(t) + 1), lambda i: t[i] = string_split(tpl, ' ')[i])) >= 0.7 * len(t) AS same FROM left1 f JOIN top2 USING (leaf)),
known AS (SELECT line, tpl FROM j1 WHERE same UNION SELECT line, tpl FROM j2 WHERE same),
named AS (SELECT l.rid, l.doc_id, l.text, l.pos, coalesce(k.tpl, l.line) AS tpl FROM leaf l LEFT JOIN known k USING (line)),
busy AS (SELECT tpl FROM (SELECT DISTINCT tpl, doc_id, text FROM named) GROUP BY 1 HAVING count(*) >= 5),
gone AS (SELECT rid, list(pos) AS g FROM named SEMI JOIN busy USING (tpl) GROUP BY 1),
cut AS (SELECT d.*, g, array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(g, i)), lambda i: ls[i]), chr(10)) AS kept FROM d LEFT JOIN gone USING (rid)),
said AS (SELECT *, coalesce(g IS NOT NULL AND length(kept) < 0.5 * length(text), false) AS is_copy FROM cut)
SELECT doc_id, coalesce(len(ls), 0)::INTEGER AS n_lines, (CASE WHEN is_copy OR g IS NULL THEN 0 ELSE len(g) END)::INTEGER AS n_dropped, is_copy,
  sha256(CASE WHEN g IS NULL OR is_copy THEN text ELSE kept END) AS kept_sha256 FROM said
"""

_FITS = "(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
_RULES = [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow")]  # longest first where two can fit


def _case(then: int) -> str:
    return "CASE " + " ".join(f"WHEN {_FITS.format(d=r.split('/')[0], p=r[r.index('/'):])} THEN '{(r, v)[then]}'" for r, v in _RULES) + " END"


def _host_path(url: str) -> str:
    rest = f"split_part(split_part(regexp_extract({url}, '^.*?://(.*)$', 1, 's'), '#', 1), '?', 1)"
    host = f"split_part({rest}, '/', 1)"
    return f"coalesce(translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(substr({rest}, length({host}) + 1), '') AS path"


URLS = rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {_host_path('url')}, regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*', lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*'))) AS vertex FROM pages),
tag AS (SELECT url, vertex, unnest([
  regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
  regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is')]) AS link FROM p),
edge AS (SELECT vertex AS src, split_part(CASE WHEN link LIKE '%://%' THEN link WHEN starts_with(link, '/') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || link END, '#', 1) AS dst FROM tag WHERE link <> ''),
both_ways AS (SELECT src, dst FROM edge WHERE dst IS NOT NULL UNION SELECT dst, src FROM edge WHERE dst IS NOT NULL),
reach AS (SELECT src AS a, src AS b FROM both_ways UNION SELECT reach.a, both_ways.dst FROM reach JOIN both_ways ON reach.b = both_ways.src),
judged AS (SELECT a, host, path FROM (SELECT a, {_host_path('b')} FROM reach)),
carried AS (SELECT a, CASE WHEN bool_or({_case(1)} = 'block') AND NOT coalesce(bool_or({_case(1)} = 'allow'), false) THEN 'block' ELSE 'allow' END AS v FROM judged GROUP BY 1)
SELECT page_id, host, path, {_case(0)} AS rule, coalesce({_case(1)}, v, 'allow') AS verdict FROM p LEFT JOIN carried ON vertex = a
"""

NEAR = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
low AS (SELECT a, least(a, min(b)) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
"""

PACKAGES = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""

UPPER, TERMS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERMS}') AS t FROM documents),
c AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, coalesce(sum(len(t)), 0)::BIGINT AS n_words FROM d),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{TERMS}')) AS term FROM benchmark),
p AS (SELECT rid, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d) SEMI JOIN item USING (term) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term),
s AS (SELECT item_id, rid, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_words))))::BIGINT AS score FROM p JOIN w USING (term) JOIN item USING (term), c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES = {"op1_substring_dedup": SUBSTRING, "op2_line_dedup": LINES, "op3_url_filter": URLS, "op10_near_dedup": NEAR, "op11_warc_packages": PACKAGES, "op13_lexical_search": RANKED}
