"""Pieces of DuckDB SQL: postings of the test tables, query compilation and ranking."""

from __future__ import annotations

from ..operators.query import SearchOptions

UNNEST = "unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))"
QUOTES = "'^[\"''`]|[\"''`]$'"
TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"

WORDS = f"postings AS (SELECT DISTINCT term, page_id FROM (SELECT doc_id AS page_id, {UNNEST} AS term FROM documents) WHERE strlen(term) BETWEEN 1 AND 63)"

META = """postings AS (SELECT DISTINCT term, page_id FROM (
    SELECT doc_id AS page_id, 'LANG:' || unnest(regexp_extract_all(lang, '[\\p{L}\\p{N}]+')) AS term FROM documents
    UNION ALL SELECT doc_id, 'SOURCE:' || unnest(regexp_extract_all(source, '[\\p{L}\\p{N}]+')) FROM documents
    UNION ALL SELECT doc_id, 'n_chars=' || n_chars FROM documents
    UNION ALL SELECT doc_id, 'quality=' || quality FROM labels JOIN documents USING (doc_id)
    UNION ALL SELECT doc_id, 'toxic=' || toxic FROM labels JOIN documents USING (doc_id)
  ) WHERE term IS NOT NULL AND strlen(term) BETWEEN 1 AND 63)"""


def decode(sql: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        sql = f"replace({sql}, '{entity}', '{char}')"
    return sql


def plain(sql: str = "html") -> str:
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->", "(?s)<[^>]*>"):
        sql = f"regexp_replace({sql}, '{pattern}', ' ', 'g')"
    return f"trim(regexp_replace({decode(sql)}, '[ \\t\\r\\n]+', ' ', 'g'))"


TAGGED = f"""postings AS (SELECT DISTINCT term, page_id FROM (
    SELECT page_id, unnest(regexp_extract_all({plain()}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM pages
    UNION ALL SELECT page_id, 'TITLE:' || unnest(regexp_extract_all({decode(TITLE)}, '[\\p{{L}}\\p{{N}}]+')) FROM pages
  ) WHERE strlen(term) BETWEEN 1 AND 63)"""

_TAG = "CASE WHEN instr({t}, ':') > 1 AND (instr({t}, '=') = 0 OR instr({t}, ':') < instr({t}, '=')) THEN instr({t}, ':') ELSE 0 END"

PARTS = f"""tags AS (SELECT term, page_id, {_TAG.format(t="term")} AS tag, instr(term, '=') AS eq FROM postings),
  parts AS (SELECT term, page_id, CASE WHEN tag > 0 THEN substr(term, 1, tag - 1) END AS field, CASE WHEN tag > 0 THEN substr(term, tag + 1) ELSE term END AS value,
    CASE WHEN eq > 1 THEN substr(term, 1, eq - 1) END AS meta_name,
    CASE WHEN eq > 1 AND regexp_full_match(substr(term, eq + 1), '-?[0-9]+') THEN try_cast(substr(term, eq + 1) AS BIGINT) END AS meta_num FROM tags)"""


def raw_values(rows: list[tuple[int, int, str]], only: str | None = None) -> str:
    cells = ", ".join(f"({q}, {k}, '{raw.replace(chr(39), chr(39) * 2)}')" for q, k, raw in rows)
    if only:
        return f"SELECT k, raw FROM (VALUES {cells}) v(q, k, raw)"
    return f"query_terms AS (SELECT * FROM (VALUES {cells}) v(query_id, ord, raw))"


def compiled(o: SearchOptions, weak: list[str] | None = None) -> str:
    sensitive = {"sensitive": "true", "insensitive": "false", "smart": "lower(value) <> value"}[o.case]
    occ = "CASE left(raw, 1) WHEN '+' THEN '+' WHEN '-' THEN '-' ELSE '{}' END".format("+" if o.all_terms else "")
    weak_list = ", ".join(f"'{w.lower()}'" for w in weak or [])
    is_weak = f"lower(value) IN ({weak_list})" if weak else "false"
    limit = "coalesce(CASE WHEN kind = 'gt' THEN substr(text, instr(text, '>') + 1) END, CASE WHEN kind = 'lt' THEN substr(text, instr(text, '<') + 1) END)"
    return f"""q1 AS (SELECT query_id, ord, {occ} AS occ, CASE WHEN left(raw, 1) IN ('+', '-') THEN substr(raw, 2) ELSE raw END AS body FROM query_terms),
  q2 AS (SELECT *, trim(regexp_replace(body, {QUOTES}, '', 'g')) AS text FROM q1),
  q3 AS (SELECT query_id, ord, occ, text, (text <> body OR {str(o.whole_words).lower()}) AS quoted, {_TAG.format(t="text")} AS tag,
    CASE WHEN instr(text, '=') > 1 THEN 'eq' WHEN instr(text, '>') > 1 THEN 'gt' WHEN instr(text, '<') > 1 THEN 'lt' ELSE '' END AS sized FROM q2 WHERE text <> ''),
  q4 AS (SELECT *, CASE WHEN tag > 0 THEN substr(text, 1, tag - 1) END AS field, CASE WHEN tag > 0 THEN substr(text, tag + 1) ELSE text END AS value FROM q3),
  q5 AS (SELECT *, CASE WHEN (CASE WHEN sized <> '' THEN length(text) ELSE length(value) END) <= {o.exact_size} THEN 'exact_cs'
      WHEN {sensitive} THEN CASE WHEN quoted THEN 'exact_cs' ELSE 'partial_cs' END WHEN quoted THEN 'exact_ci' ELSE 'partial_ci' END AS mode FROM q4),
  q6 AS (SELECT *, CASE WHEN sized <> '' THEN sized WHEN text = '*' AND mode = 'exact_cs' THEN 'all' WHEN tag > 0 THEN 'field' ELSE 'word' END AS kind FROM q5),
  q7 AS (SELECT *, CASE WHEN kind = 'gt' THEN substr(text, 1, instr(text, '>') - 1) WHEN kind = 'lt' THEN substr(text, 1, instr(text, '<') - 1) END AS name,
      {limit} AS rest, (CASE WHEN {is_weak} THEN {o.weak_weight} WHEN field = 'TITLE' THEN {o.title_weight} WHEN field = 'KEYWORDS' THEN {o.keywords_weight}
      WHEN field = 'DESCRIPTION' THEN {o.description_weight} ELSE {o.text_weight} END)::INTEGER AS weight FROM q6),
  q8 AS (SELECT *, try_cast(regexp_extract(rest, '^[+-]?[0-9]+') AS BIGINT) AS n FROM q7),
  compiled AS (SELECT query_id, ord, occ, text, field, value, kind, mode, name, CASE WHEN n <> 0 OR starts_with(rest, '0') THEN n END AS bound, weight,
      (CASE occ WHEN '+' THEN weight + {o.mandatory_bonus} WHEN '-' THEN -{o.exclusion_penalty} ELSE weight END)::INTEGER AS signed,
      {o.mandatory_bonus} AS bonus, {str(o.right_partial_only).lower()} AS only_prefix FROM q8)"""


def _within(own: str, query: str) -> str:
    return f"CASE WHEN only_prefix THEN starts_with({own}, {query}) ELSE contains({own}, {query}) END"


RANKED = f"""hits AS (
    SELECT DISTINCT query_id, ord, page_id FROM compiled c JOIN parts p ON CASE
      WHEN kind = 'all' THEN true
      WHEN kind = 'eq' THEN CASE WHEN mode LIKE '%cs' THEN term = text ELSE lower(term) = lower(text) END
      WHEN kind = 'gt' THEN meta_num > bound AND CASE WHEN mode LIKE '%cs' THEN meta_name = name ELSE lower(meta_name) = lower(name) END
      WHEN kind = 'lt' THEN meta_num < bound AND CASE WHEN mode LIKE '%cs' THEN meta_name = name ELSE lower(meta_name) = lower(name) END
      WHEN kind = 'field' THEN p.field = c.field AND CASE mode WHEN 'exact_cs' THEN p.value = c.value WHEN 'exact_ci' THEN lower(p.value) = lower(c.value)
        WHEN 'partial_cs' THEN {_within("p.value", "c.value")} ELSE {_within("lower(p.value)", "lower(c.value)")} END
      ELSE CASE mode WHEN 'exact_cs' THEN term = text WHEN 'exact_ci' THEN lower(term) = lower(text)
        WHEN 'partial_cs' THEN {_within("term", "text")} ELSE {_within("lower(term)", "lower(text)")} END END),
  found AS (SELECT * FROM hits UNION SELECT b.query_id, b.ord, h.page_id FROM compiled b JOIN compiled f ON b.query_id = f.query_id AND b.mode = f.mode
      AND b.kind = 'word' AND f.kind = 'field' AND lower(b.text) = lower(f.value) JOIN hits h ON h.query_id = f.query_id AND h.ord = f.ord),
  totals AS (SELECT query_id, sum(CASE WHEN occ = '+' THEN bonus ELSE 0 END)::INTEGER AS threshold, sum(weight)::INTEGER AS max_quality FROM compiled GROUP BY query_id),
  lost AS (SELECT query_id FROM compiled c WHERE occ = '+' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.query_id = c.query_id AND f.ord = c.ord)),
  scores AS (SELECT f.query_id, f.page_id, sum(signed)::INTEGER AS score FROM found f JOIN compiled c ON f.query_id = c.query_id AND f.ord = c.ord GROUP BY ALL),
  above AS (SELECT s.*, threshold, max_quality, score - threshold AS q FROM scores s JOIN totals t ON s.query_id = t.query_id
      WHERE score > threshold AND s.query_id NOT IN (SELECT query_id FROM lost)),
  placed AS (SELECT *, (row_number() OVER w - 1)::INTEGER AS position, count(*) OVER (PARTITION BY query_id) AS n,
      sum(q) OVER (PARTITION BY query_id ORDER BY score DESC, page_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)::BIGINT AS before
      FROM above WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, page_id)),
  gapped AS (SELECT *, CASE WHEN position > 0 THEN (before // least(position, 3) - q) // (5 - least(position, 3)) ELSE 0 END AS gap,
      least(10, ((CASE WHEN n > 10000 THEN 30 WHEN n > 5000 THEN 20 ELSE 10 END) * position) // n) AS weak FROM placed),
  results AS (SELECT query_id, page_id, score, position,
      (CASE WHEN position = 0 THEN (q * 100) // max_quality ELSE greatest(1, ((q + gap) * 100) // max_quality - weak) END)::INTEGER AS quality_pct FROM gapped)"""
