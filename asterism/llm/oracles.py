"""DuckDB SQL for those queries of this subpackage that SQL can express on whole tables."""

from .licenses import CONTAINMENT, PUNCTUATION, SHINGLE, TEMPLATES
from .urls import BLOCK, HOSTS, RULES

_RULES = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in RULES)
_HOSTS = ", ".join(f"('{h}')" for h in HOSTS)

_QUOTE = "'"
_TEMPLATES = ", ".join(f"({i}, '{name}', '{text.replace(_QUOTE, _QUOTE * 2)}')" for i, (name, text) in enumerate(TEMPLATES))


_SAID = "<|im_end|><|im_start|>assistant ok"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _shingles(text: str) -> str:
    plain = f"translate(lower({text}), '{PUNCTUATION.replace(_QUOTE, _QUOTE * 2)}', '')"
    words = f"list_filter(string_split_regex({plain}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"(SELECT list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))) FROM (SELECT {words} AS w))"


SQL: dict[str, str] = {
    "op3_license_scans": f"""
WITH t(template, license, text) AS (VALUES {_TEMPLATES}),
templates AS (SELECT template, license, {_shingles("text")} AS s FROM t),
docs AS (SELECT doc_id, {_shingles("text")} AS s FROM documents WHERE text IS NOT NULL),
pairs AS (SELECT doc_id, license, template, list_intersect(d.s, t.s) AS found, len(t.s) AS total FROM docs d, templates t),
held AS (SELECT *, len(found) / total AS containment FROM pairs WHERE len(found) / total >= {CONTAINMENT})
SELECT doc_id, license, template, len(found) AS shared, total, containment FROM held m
WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.doc_id = m.doc_id AND o.containment > m.containment AND list_has_all(o.found, m.found))
""",
    "op4_url_filters": f"""
WITH rules(verdict, host, path, rule) AS (VALUES {_RULES}),
listed(host) AS (VALUES {_HOSTS}),
parsed AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
hosts AS (SELECT DISTINCT host FROM parsed),
bad AS (SELECT DISTINCT h.host FROM hosts h JOIN listed l ON h.host = l.host OR ends_with(h.host, '.' || l.host)),
paths AS (SELECT DISTINCT host, path FROM parsed),
ranked AS (
  SELECT p.host, p.path, r.rule, r.verdict,
         row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.rule) DESC, length(r.host) DESC) AS n
  FROM paths p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, r.rule,
       coalesce(r.verdict, CASE WHEN b.host IS NULL THEN 'allow' ELSE '{BLOCK}' END) AS verdict
FROM parsed p
LEFT JOIN (SELECT * FROM ranked WHERE n = 1) r ON p.host = r.host AND p.path = r.path
LEFT JOIN bad b ON p.host = b.host
""",
    "op6_substring_dedup": f"""
WITH docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
owner AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
late AS (SELECT doc_id, i FROM windows JOIN owner USING (k) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM late)),
marks AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM docs LEFT JOIN marks USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM kept
""",
    "op7_chat_formatting": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_SAID}' UNION ALL SELECT -1, 1, 'assistant', '{_SAID}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
""",
    "op9_minhash_near_dedup": f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM docs),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common, any_value(a.n) AS an, any_value(b.n) AS bn
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 80 * (an + bn - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, least(a, min(b)) AS component FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM sets LEFT JOIN least USING (doc_id)
""",
}
