"""SQL (DuckDB) for the operators' queries that SQL can express."""

from __future__ import annotations

from tessera.llm import licenses

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _licenses() -> str:
    known = ", ".join(f"('{sentence}', '{name}')" for name, sentence in licenses.SENTENCES.items())
    rules = ", ".join(f"('{name}', {k}, '{''.join(f'<{x}>' for x in ids)}')" for k, (name, ids) in enumerate(licenses.RULES))
    return rf"""
WITH known(sentence, name) AS (VALUES {known}), rules(license, rule, ids) AS (VALUES {rules}),
pieces AS (
  SELECT doc_id, string_split_regex(text, '\n|[.!?;]+(\s|$)') AS s FROM documents WHERE text IS NOT NULL
), sentences AS (
  SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM pieces
), plain AS (
  SELECT doc_id, pos, trim(regexp_replace(lower(s), '[^a-z0-9\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) AS sentence
  FROM sentences WHERE s SIMILAR TO '(?is).*(licen[cs]e|permi|redistribut|warranty|cc|spdx).*'
), seqs AS (
  SELECT doc_id, string_agg('<' || name || '>', '' ORDER BY pos) AS seq
  FROM plain JOIN known USING (sentence) GROUP BY doc_id
)
SELECT doc_id, license, CAST(rule AS INTEGER) AS rule,
       CAST((length(seq) - length(replace(seq, ids, ''))) / length(ids) AS INTEGER) AS n_matches
FROM seqs, rules WHERE contains(seq, ids)
"""


ORACLE_SQL["op7_licenses"] = _licenses()
