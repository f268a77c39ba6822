"""Oracle SQL for DuckDB, one for each query of the catalog that SQL can say."""

from __future__ import annotations

from stylescout.functions.text import STYLE_PROPERTIES, WS
from stylescout.plans.forms import FORMS

_Q = "\"''`"  # quotes inside an SQL literal
_HELP = "(cn|clsx|class[nN]ames|twMerge|cx)"

_LINES = r"""lines AS (
  SELECT file, unnest(a) AS text, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS line
  FROM (SELECT 'doc/' || doc_id AS file, regexp_split_to_array(text, '\r?\n') AS a FROM documents))"""
_LOCS = rf"""{_LINES}, raw AS (
  SELECT file, line, text, unnest(t) AS class, generate_subscripts(t, 1) AS rp
  FROM (SELECT *, regexp_split_to_array(text, '([{_Q}{{}}()<>=,;]|{WS})+') AS t FROM lines)), firsts AS (
  SELECT file, line, class, any_value(text) AS text, min(rp) AS rp FROM raw WHERE class <> '' GROUP BY file, line, class), locs AS (
  SELECT *, CAST(line AS BIGINT) * 2147483648 + row_number() OVER (PARTITION BY file, line ORDER BY rp) - 1 AS emit_seq FROM firsts), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY file, class ORDER BY emit_seq) AS loc_rank FROM locs), fc AS (
  SELECT file, class, min(emit_seq) AS first_seq FROM locs GROUP BY file, class)"""
_CONTEXT = rf"substr(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g'), 1, 140)"


def _clean(x: str) -> str:
    """One pass of token cleaning."""
    x = rf"regexp_replace({x}, '(?i)^{_HELP}\(', '')"
    x = rf"regexp_replace(regexp_replace({x}, '^\[([{_Q}])', '\1'), '([{_Q}])\]$', '\1')"
    return rf"regexp_replace({x}, '^[{_Q}{{(.]*|[{_Q}}}),;]*$', '', 'g')"


def _tokens(x: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({x}, '{WS}+'), lambda t: {_clean('t')}), lambda t: t <> '')"


_TERMS = f"""{_LOCS}, allterms AS (
  SELECT query_id, unnest(t) AS class, generate_subscripts(t, 1) AS rp FROM (SELECT item_id AS query_id, {_tokens("text")} AS t FROM benchmark)), once AS (
  SELECT query_id, class, min(rp) AS rp FROM allterms GROUP BY query_id, class), terms AS (
  SELECT query_id, class, row_number() OVER (PARTITION BY query_id ORDER BY rp) - 1 AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM once), hits AS (
  SELECT query_id, file, pos, class, n FROM terms JOIN fc USING (class))"""
_SCORED = f"""{_TERMS}, scored AS (
  SELECT query_id, file, count(*) AS m, any_value(n) AS n, count(*)::DOUBLE / any_value(n) AS score FROM hits GROUP BY query_id, file)"""
_BEST = f"""{_SCORED}, perline AS (
  SELECT query_id, file, line, count(*) AS k FROM hits JOIN ranked USING (file, class) WHERE loc_rank <= 8 GROUP BY query_id, file, line), bestlines AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY line) AS r
  FROM (SELECT *, max(k) OVER (PARTITION BY query_id, file) AS most FROM perline) WHERE k = most)"""
_REFINED = f"""{_SCORED}, full_lines AS (
  SELECT query_id, file, line, count(*) AS k FROM hits JOIN locs USING (file, class) GROUP BY query_id, file, line), refined AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY line) AS r
  FROM (SELECT *, max(k) OVER (PARTITION BY query_id, file) AS most FROM full_lines) WHERE k = most), refined_files AS (
  SELECT query_id, file, any_value(most) AS most, string_agg(line::VARCHAR, '|' ORDER BY line) AS lines FROM refined WHERE r <= 12 GROUP BY query_id, file)"""
_PHRASES = rf"""phrase_hits AS (
  SELECT query_id, file, line, text, lower(phrase) AS p, unnest(list_filter(range(1, length(text) - length(phrase) + 2), lambda i: substr(lower(text), i, length(phrase)) = lower(phrase))) AS place
  FROM asked JOIN lines ON contains(lower(text), lower(phrase)) WHERE length(phrase) >= 2), phrase_files AS (
  SELECT query_id, file, count(*) AS hits, min((line, place)) AS head FROM phrase_hits GROUP BY query_id, file)"""
_MERGED = rf"""{_REFINED}, asked AS (
  SELECT item_id AS query_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS phrase FROM benchmark WHERE NOT contains(text, chr(10))), {_PHRASES}, rates AS (
  SELECT query_id, avg(CASE WHEN class IN (SELECT class FROM fc) THEN 1.0::DOUBLE ELSE 0.0 END) < 0.6 AS prose FROM terms GROUP BY query_id), qw AS (
  SELECT DISTINCT item_id AS query_id, regexp_replace(unnest(regexp_split_to_array(lower(text), '([,;]|{WS})+')), '^[.,;:!?{_Q}]+|[.,;:!?{_Q}]+$', '', 'g') AS word
  FROM benchmark JOIN rates ON item_id = query_id AND prose), qwords AS (
  SELECT *, count(*) OVER (PARTITION BY query_id) AS n_words FROM qw WHERE length(word) >= 2), tk AS (
  SELECT query_id, file, line, any_value(n_words) AS n_words, count(*) AS k FROM qwords JOIN lines ON contains(lower(text), word) GROUP BY query_id, file, line), texts AS (
  SELECT query_id, file, 1.0::DOUBLE AS ts, hits AS mc, 1 AS tc, 1 AS ml, true AS ph FROM phrase_files
  UNION ALL SELECT query_id, file, max(k)::DOUBLE / any_value(n_words), max(k), any_value(n_words), max(k), false FROM tk ANTI JOIN phrase_files USING (query_id, file) GROUP BY query_id, file), merged AS (
  SELECT query_id, file, CASE WHEN s.m IS NULL THEN t.ts WHEN t.ph THEN 1.0::DOUBLE ELSE s.score END AS score, coalesce(s.m, t.mc) AS matched_count,
    coalesce(s.n, t.tc) AS total_input_count, CASE WHEN s.m IS NULL THEN t.ml WHEN t.ph THEN greatest(r.most, s.n) ELSE r.most END AS max_line_matches,
    CASE WHEN s.m IS NULL THEN 'text' WHEN t.mc IS NOT NULL THEN 'both' ELSE 'class' END AS match_type, coalesce(t.ts, 0) AS ts
  FROM (SELECT * FROM scored WHERE score >= 0.3::DOUBLE) s LEFT JOIN refined_files r USING (query_id, file) FULL OUTER JOIN texts t USING (query_id, file)), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN prose THEN (match_type = 'class')::INTEGER ELSE (match_type = 'text')::INTEGER END,
    CASE WHEN (prose AND match_type <> 'class') OR (NOT prose AND match_type = 'text') THEN ts ELSE 0 END DESC,
    CASE WHEN prose OR match_type <> 'text' THEN score END DESC, CASE WHEN prose OR match_type <> 'text' THEN max_line_matches END DESC,
    CASE WHEN prose OR match_type <> 'text' THEN matched_count END DESC, file) AS rank FROM merged JOIN rates USING (query_id))"""
_ORDERS = """items AS (
  SELECT 'order/' || l_orderkey AS file, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS line, p_name,
    list_concat(string_split(p_name, ' '), [lower(p_type), lower(replace(p_brand, '#', '-')), 'w-[' || p_size || 'px]']) AS c
  FROM lineitem JOIN part ON l_partkey = p_partkey), oloc AS (
  SELECT file, line, p_name AS context, unnest(c) AS class, CAST(line AS BIGINT) * 1000 + generate_subscripts(c, 1) - 1 AS emit_seq FROM items)"""
_SETS = f"""{_ORDERS}, orank AS (
  SELECT *, row_number() OVER (PARTITION BY file, class ORDER BY emit_seq) AS r FROM oloc), sets AS (
  SELECT file, line, arg_min(context, emit_seq) AS context, list_sort(list(DISTINCT class)) AS classes FROM orank WHERE r <= 8 GROUP BY file, line HAVING count(DISTINCT class) >= 3)"""
_GROUPS = f"""{_SETS}, dups AS (
  SELECT classes, count(*) AS n_occurrences, count(DISTINCT file) AS n_files FROM sets GROUP BY classes HAVING count(DISTINCT file) >= 2)"""
_PARTS = """parts AS (
  SELECT 'part/' || p_partkey || '.tsx' AS file, p_name, p_size, 'export const P = () =>' || chr(10) || '  <div className={cn("' AS head,
    '", on && "w-[' || p_size || 'px]")} style={{ fontSize: ' || p_size || ' }} />;' || chr(10) AS tail FROM part)"""
_EDITED = f"""{_PARTS}, words AS (
  SELECT file, head, tail, p_name, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM parts), marked AS (
  SELECT *, lower(w) IN ('red', 'bolt') AS hit FROM words), numbered AS (
  SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY file, hit ORDER BY i) END AS k FROM marked), edits AS (
  SELECT file, any_value(head) AS head, any_value(tail) AS tail, any_value(p_name) AS p_name, string_agg(CASE WHEN NOT hit THEN w WHEN k = 1 THEN 'blue-1 blue-2' END, ' ' ORDER BY i) AS new
  FROM numbered GROUP BY file HAVING bool_or(hit))"""
#: A line with blanks for all that ends a token; the documents hold no other white space.
_BLANKED = "translate(text, chr(34) || chr(39) || chr(96) || '{}()<>=,;' || chr(9) || chr(13), repeat(' ', 14))"


def _fold(words: str, text: str) -> str:
    """The least place of any word, where a 0 counts as not set."""
    return f"list_reduce(list_transform({words}, lambda w: instr({text}, w) - 1), lambda a, i: CASE WHEN i <> -1 AND (a = 0 OR i < a) THEN i ELSE a END, 0)"


_TERM_LISTS = "term_lists AS (SELECT query_id, list(class ORDER BY pos) AS list FROM terms GROUP BY query_id)"


def _words(condition: str) -> str:
    """Each query's search words, in order: query_id, list."""
    return rf"""word_places AS (
      SELECT query_id, regexp_replace(unnest(a), '^[.,;:!?{_Q}]+|[.,;:!?{_Q}]+$', '', 'g') AS word, generate_subscripts(a, 1) AS i
      FROM (SELECT item_id AS query_id, regexp_split_to_array(lower(text), '([,;]|{WS})+') AS a FROM benchmark WHERE {condition})), word_lists AS (
      SELECT query_id, list(word ORDER BY i) AS list FROM (SELECT query_id, word, min(i) AS i FROM word_places WHERE length(word) >= 2 GROUP BY ALL) GROUP BY query_id)"""


_REFRESHED = """e AS (SELECT 'user/' || user_id || '.tsx' AS file, event_type, value, ts, event_id, epoch_us(ts) // 1000 AS ms FROM events),
    cut AS (SELECT quantile_cont(ms, 0.98) AS cut_ms FROM e),
    o AS (SELECT file, ms AS old_ms FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, event_id DESC) AS k FROM e, cut WHERE ms <= cut_ms) WHERE k = 1 AND event_type <> 'error'),
    n AS (SELECT file, ms AS new_ms, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, event_id DESC) AS k FROM e) WHERE k = 1 AND event_type <> 'error'),
    states AS (SELECT *, CASE WHEN new_ms IS NULL THEN 'removed' WHEN old_ms >= new_ms THEN 'unchanged' ELSE 'extract' END AS status FROM o FULL OUTER JOIN n USING (file))"""
_DECLARED = "'min-width: ' || p_size || 'px; Color: ' || upper(p_name) || '; width: 5px ; bad;'"



def _limited(k: int) -> str:
    """The first k results of each query, with up to three places for text-only ones."""
    return f"""WITH {_MERGED}, t AS (SELECT *, sum(CASE WHEN rank <= {k} AND match_type = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS head,
      CASE WHEN rank > {k} AND match_type = 'text' AND NOT prose THEN row_number() OVER (PARTITION BY query_id, rank > {k} AND match_type = 'text' ORDER BY rank) END AS tp FROM ordered), s AS (
      SELECT *, coalesce(tp <= greatest(3 - head, 0), false) AS saved FROM t), n AS (SELECT *, sum(CASE WHEN saved THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS ns FROM s), kept AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS new_rank FROM n WHERE saved OR rank <= {k} - ns)"""


_FORM_ROWS = ", ".join(f"({k}, {i}, '{c}', {line})" for k, (_, found) in enumerate(FORMS) for i, (c, line) in enumerate(found))
_PLACES = f"""{_limited(25)}, {_TERM_LISTS}, {_words("item_id IN (SELECT query_id FROM rates WHERE prose)")}, text_places AS (
    SELECT query_id, file, line, text, place - 1 AS col, row_number() OVER (PARTITION BY query_id, file ORDER BY line, place) AS n FROM phrase_hits
    UNION ALL SELECT query_id, file, line, text, {_fold("list", "lower(text)")}, row_number() OVER (PARTITION BY query_id, file ORDER BY line)
    FROM (SELECT *, max(k) OVER (PARTITION BY query_id, file) AS best FROM tk ANTI JOIN phrase_files USING (query_id, file)) JOIN lines USING (file, line) JOIN word_lists USING (query_id) WHERE k = best), shown_text AS (
    SELECT t.* FROM text_places t SEMI JOIN (SELECT * FROM kept WHERE match_type <> 'class') USING (query_id, file) WHERE n <= 12), shown_class AS (
    SELECT query_id, file, line, text, {_fold("list", "text")} AS col, r AS n FROM refined JOIN lines USING (file, line) JOIN term_lists USING (query_id)
    SEMI JOIN (SELECT * FROM kept WHERE match_type <> 'text') USING (query_id, file) WHERE r <= 12), every AS (
    SELECT *, 0 AS part FROM shown_text UNION ALL SELECT *, 1 FROM shown_class ANTI JOIN (SELECT query_id, file, line FROM shown_text) USING (query_id, file, line)), places AS (
    SELECT query_id, file, line, text, col, row_number() OVER (PARTITION BY query_id, file ORDER BY part, n) - 1 AS number FROM every QUALIFY number < 12), once_lines AS (
    SELECT query_id, file, line, any_value(text) AS text, min(number) AS number FROM places GROUP BY query_id, file, line), line_rows AS (
    SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY number) - 1 AS k, count(*) OVER (PARTITION BY query_id, file) AS n FROM once_lines)"""


SQL: dict[str, str] = {
    "scan_corpus": "SELECT sum(length(text) + 1)::BIGINT AS n_chars, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS n_lines FROM documents",
    "index_snapshot": f"WITH {_LOCS} SELECT file, count(*) AS n_locations, count(DISTINCT class) AS n_classes, any_value(n_chars) AS mtime_ms FROM locs JOIN (SELECT 'doc/' || doc_id AS file, n_chars FROM documents) USING (file) GROUP BY file",
    "incremental_refresh": f"WITH {_REFRESHED} SELECT file, status FROM states",
    "refresh_locations": f"""WITH {_REFRESHED} SELECT file, status, CASE WHEN status <> 'removed' THEN unnest([event_type, 'w-[' || floor(value)::BIGINT || 'px]']) END AS class,
        CASE WHEN status <> 'removed' THEN 0 END::INTEGER AS line, new_ms AS mtime_ms FROM states WHERE status <> 'removed'
        UNION ALL SELECT file, status, NULL, NULL, NULL FROM states WHERE status = 'removed'""",
    "clean_token": f"SELECT token, {_clean('token')} AS cleaned FROM (SELECT DISTINCT unnest(regexp_split_to_array(html, '{WS}+')) AS token FROM pages)",
    "tokenize": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "looks_like_code": rf"SELECT page_id, regexp_matches(html, '\b{_HELP}{WS}*\(') OR regexp_matches(html, '(^|{WS})[?:]({WS}|$)|&&') AS is_code FROM pages",
    "extract_paste": rf"SELECT page_id, regexp_extract(html, '(?i)\bclass(Name)?{WS}*={WS}*\{{?{WS}*[\"'']([^\"'']*)[\"'']', 2) AS pasted FROM pages",
    "parse_class_list": f"WITH {_TERMS} SELECT query_id AS item_id, pos::INTEGER AS pos, class FROM terms",
    "normalize_style": "SELECT p_partkey, lower(regexp_replace('Border-' || lower(p_type) || '-Top', '-([a-z])', '\\1', 'g')) AS style_key, p_size::VARCHAR AS style_value FROM part",
    "is_style_input": rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?i)^style{WS}*=') THEN true WHEN regexp_matches(t, '[{_Q}?(){{}}]|&&') THEN false WHEN NOT contains(t, ':') THEN false
        WHEN regexp_matches(t, '[;,]') THEN true ELSE regexp_matches(split_part(t, ':', 1), '(?i)^({STYLE_PROPERTIES})') END AS is_style
        FROM (SELECT conv_id, turn, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS t FROM conversations)""",
    "parse_style_list": "SELECT p_partkey, unnest([0, 1, 2])::INTEGER AS pos, unnest(['style:minwidth:' || p_size, 'style:color:' || lower(p_name), 'style:width:5']) AS style FROM part",
    "route_query": f"""WITH {_TERMS} SELECT query_id, false AS is_style, any_value(n)::INTEGER AS n_terms, true AS has_text FROM terms GROUP BY query_id
        UNION ALL SELECT p_partkey + 1000000, true, 3, false FROM part""",
    "looks_like_class_input": "SELECT p_partkey, regexp_matches(p_name, '^[a-zA-Z0-9!:_./ -]+$') AND contains(p_name, ' ') AS name_is, false AS both_is FROM part",
    "arbitrary_base": "SELECT p_partkey, 'w-[]' AS base, CAST(NULL AS VARCHAR) AS no_base FROM part",
    "split_lines": f"WITH {_LINES} SELECT file, line, text FROM lines",
    "line_tokens": f"WITH {_LOCS}, kept AS (SELECT file, line, string_agg(class, '|' ORDER BY rp) AS tokens FROM firsts GROUP BY file, line) SELECT file, line, coalesce(tokens, '') AS tokens FROM lines LEFT JOIN kept USING (file, line)",
    "query_words": rf"""WITH w AS (SELECT conv_id, turn, unnest(a) AS raw, generate_subscripts(a, 1) AS i FROM (SELECT *, regexp_split_to_array(lower(text), '([,;]|{WS})+') AS a FROM conversations)),
        c AS (SELECT conv_id, turn, i, regexp_replace(raw, '^[.,;:!?{_Q}]+|[.,;:!?{_Q}]+$', '', 'g') AS word FROM w), o AS (SELECT conv_id, turn, word, min(i) AS i FROM c WHERE length(word) >= 2 GROUP BY ALL),
        k AS (SELECT conv_id, turn, string_agg(word, '|' ORDER BY i) AS words FROM o GROUP BY ALL) SELECT conv_id, turn, coalesce(words, '') AS words FROM conversations LEFT JOIN k USING (conv_id, turn)""",
    "context_snippet": f"WITH {_LINES} SELECT file, line, {_CONTEXT} AS context FROM lines",
    "extract_classes": f"""WITH {_PARTS} SELECT file, unnest(list_concat(string_split(p_name, ' '), ['w-[' || p_size || 'px]'])) AS class, 1::INTEGER AS line,
        substr(trim(string_split(head || p_name || tail, chr(10))[2]), 1, 140) AS context FROM parts""",
    "resolve_variables": "SELECT p_partkey::VARCHAR AS file, unnest(string_split(p_name, ' ')) AS class, 0::INTEGER AS line FROM part",
    "source_forms": f"""WITH forms(k, number, class, line) AS (VALUES {_FORM_ROWS})
        SELECT p_partkey::VARCHAR AS file, number::INTEGER AS number, replace(class, '{{n}}', p_size::VARCHAR) AS class, line::INTEGER AS line FROM part JOIN forms ON p_partkey % {len(FORMS)} = k""",
    "extract_styles": "SELECT 'part/' || p_partkey || '.tsx' AS file, 'style:fontsize:' || p_size AS class, 1::INTEGER AS line FROM part",
    "extract_errors": "SELECT p_partkey::VARCHAR AS file, true AS failed FROM part WHERE p_size > 25",
    "file_classes": f"WITH {_LOCS} SELECT file, class, first_seq FROM fc",
    "cap_locations": f"WITH {_LOCS} SELECT file, class, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM ranked WHERE loc_rank <= 8 GROUP BY file, class",
    "arbitrary_index": f"""WITH {_ORDERS}, ofc AS (SELECT file, class, min(emit_seq) AS s FROM oloc WHERE contains(class, '[') GROUP BY file, class)
        SELECT file, 'w-[]' AS base, arg_min(class, s) AS first_class, string_agg(class, '|' ORDER BY s) AS classes FROM ofc GROUP BY file""",
    "class_postings": f"""WITH {_LOCS}, placed AS (SELECT class, file, (row_number() OVER (PARTITION BY class ORDER BY file) - 1) // 1024 AS chunk FROM fc)
        SELECT class, chunk::BIGINT AS chunk, count(*)::INTEGER AS n_files, string_agg(file, '|' ORDER BY file) AS files FROM placed GROUP BY class, chunk""",
    "index_stats": f"WITH {_LOCS} SELECT count(DISTINCT file) AS n_files, count(DISTINCT class) AS n_classes, count(*) AS n_postings FROM fc",
    "exact_match": f"WITH {_TERMS} SELECT query_id, file, pos::INTEGER AS pos, class FROM hits",
    "near_match": f"""WITH {_ORDERS}, q AS (SELECT DISTINCT p_name, p_size + 100 AS size FROM part), first AS (
        SELECT file, arg_min(class, s) AS actual FROM (SELECT file, class, min(emit_seq) AS s FROM oloc WHERE contains(class, '[') GROUP BY file, class) GROUP BY file), sizes AS (
        SELECT size, count(*) AS k FROM q GROUP BY size)
        SELECT file, 'w-[' || size || 'px]' AS input, actual, k AS n_queries FROM first CROSS JOIN sizes""",
    "unmatched": f"""WITH {_SCORED}, rest AS (SELECT s.query_id, s.file, string_agg(t.class, '|' ORDER BY t.pos) AS unmatched, count(*) AS k
        FROM scored s JOIN terms t ON s.query_id = t.query_id LEFT JOIN fc ON fc.file = s.file AND fc.class = t.class WHERE fc.class IS NULL GROUP BY ALL)
        SELECT query_id, file, coalesce(k, 0)::INTEGER AS n_unmatched, coalesce(unmatched, '') AS unmatched FROM scored LEFT JOIN rest USING (query_id, file)""",
    "score_files": f"""WITH {_SCORED}, listed AS (SELECT query_id, file, string_agg(class, '|' ORDER BY pos) AS matched FROM hits GROUP BY query_id, file)
        SELECT query_id, file, round(score, 6) AS score, m::INTEGER AS matched_count, n::INTEGER AS total_input_count, matched FROM scored JOIN listed USING (query_id, file)""",
    "best_lines": f"""WITH {_BEST}, chosen AS (SELECT query_id, file, line, any_value(most) AS most, any_value(text) AS text, arg_min(class, pos) AS class
        FROM bestlines JOIN hits USING (query_id, file) JOIN ranked USING (file, class, line) WHERE r <= 12 AND loc_rank <= 8 GROUP BY query_id, file, line)
        SELECT query_id, file, any_value(most)::INTEGER AS max_line_matches, string_agg(line::VARCHAR, '|' ORDER BY line) AS lines,
        string_agg((instr(' ' || {_BLANKED} || ' ', ' ' || class || ' ') - 1)::VARCHAR, '|' ORDER BY line) AS columns, arg_min({_CONTEXT}, line) AS first_context FROM chosen GROUP BY query_id, file""",
    "refine_locations": f"""WITH {_REFINED}, {_TERM_LISTS} SELECT query_id, file, any_value(most)::INTEGER AS max_line_matches, string_agg(line::VARCHAR, '|' ORDER BY line) AS lines,
        string_agg({_fold("list", "text")}::VARCHAR, '|' ORDER BY line) AS columns, arg_min({_CONTEXT}, line) AS first_context
        FROM refined JOIN lines USING (file, line) JOIN term_lists USING (query_id) WHERE r <= 12 GROUP BY query_id, file""",
    "class_rate": f"WITH {_TERMS} SELECT query_id, round(avg(CASE WHEN class IN (SELECT class FROM fc) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS class_rate, avg(CASE WHEN class IN (SELECT class FROM fc) THEN 1.0::DOUBLE ELSE 0.0 END) < 0.6 AS is_prose FROM terms GROUP BY query_id",
    "phrase_search": rf"""WITH {_LINES}, bl AS (SELECT unnest(string_split(text, chr(10))) AS raw FROM benchmark), al AS (
        SELECT raw FROM bl UNION SELECT regexp_extract(raw, '^([^ \t\n\r\f]+ [^ \t\n\r\f]+)', 1) FROM bl), asked AS (
        SELECT raw AS query_id, regexp_replace(raw, '^{WS}+|{WS}+$', '', 'g') AS phrase FROM al), {_PHRASES}
        SELECT query_id AS raw, file, hits::INTEGER AS hits, head[1] AS first_line, (head[2] - 1)::INTEGER AS first_column FROM phrase_files""",
    "search": f"""{_limited(25)} SELECT query_id, file, new_rank AS rank, round(score, 6) AS score, matched_count::INTEGER AS matched_count, total_input_count::INTEGER AS total_input_count,
        max_line_matches::INTEGER AS max_line_matches, match_type FROM kept""",
    "term_search": rf"""WITH {_LINES}, asked AS (SELECT item_id AS query_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS phrase FROM benchmark), {_PHRASES}, {_words("true")}, words AS (
        SELECT query_id, unnest(list) AS word, len(list) AS n_words FROM word_lists), k AS (
        SELECT query_id, file, line, any_value(n_words) AS n_words, count(*) AS k FROM words JOIN lines ON contains(lower(text), word) GROUP BY query_id, file, line), b AS (
        SELECT *, max(k) OVER (PARTITION BY query_id, file) AS best FROM k ANTI JOIN phrase_files USING (query_id, file)), f AS (
        SELECT query_id, file, any_value(best)::INTEGER AS best, any_value(n_words)::INTEGER AS n_words, least(count(*), 12)::INTEGER AS n_locations, min(line) AS first_line FROM b WHERE k = best GROUP BY query_id, file)
        SELECT query_id, file, best, n_words, n_locations, first_line, {_fold("list", "lower(text)")}::INTEGER AS first_column, {_CONTEXT} AS first_context
        FROM f JOIN word_lists USING (query_id) JOIN (SELECT file, line AS first_line, text FROM lines) USING (file, first_line)""",
    "search_locations": f"{_PLACES} SELECT query_id, file, number::INTEGER AS number, line, col::INTEGER AS column, {_CONTEXT} AS context FROM places",
    "result_locations": f"""{_PLACES} SELECT query_id, file, k::INTEGER AS number, '    Line ' || (line + 1) AS label, '    ' || substr({_CONTEXT}, 1, 100) AS detail FROM line_rows WHERE n > 1""",
    "result_report": f"""{_PLACES}, lists AS (SELECT query_id, file, list(class ORDER BY pos) AS list FROM hits GROUP BY query_id, file), missing AS (
        SELECT query_id, file, list(class ORDER BY pos) AS list FROM (SELECT query_id, file, class, pos FROM kept JOIN terms USING (query_id) WHERE match_type <> 'text') t
        ANTI JOIN hits USING (query_id, file, class) GROUP BY query_id, file), texts_of AS (SELECT query_id, file, string_agg((line + 1)::VARCHAR, ',' ORDER BY k) AS lines FROM line_rows GROUP BY query_id, file)
        SELECT query_id, file, new_rank AS rank, regexp_extract(file, '([^/]*)$', 1) AS label, CASE WHEN match_type = 'text' THEN 'text match' ELSE
          floor(score * 100 + 0.5)::INTEGER || '% match  (' || matched_count || '/' || total_input_count || ')' || CASE WHEN match_type = 'both' THEN '  +text' ELSE '' END END AS description,
        regexp_replace(file, '^doc/', '') || '  —  ' || CASE WHEN match_type = 'text' THEN 'text match' ELSE array_to_string(l.list[1:8], ' ') || CASE WHEN len(l.list) > 8 THEN ' …' ELSE '' END END
          || CASE WHEN len(m.list) > 0 THEN '   |   missing: ' || array_to_string(m.list[1:4], ' ') || CASE WHEN len(m.list) > 4 THEN ' …' ELSE '' END ELSE '' END AS detail,
        floor(score * 100 + 0.5)::INTEGER AS percent, coalesce(lines, '') AS lines
        FROM kept LEFT JOIN lists l USING (query_id, file) LEFT JOIN missing m USING (query_id, file) LEFT JOIN texts_of USING (query_id, file)""",
    "merge_class_text": f"WITH {_MERGED} SELECT query_id, match_type, count(*) AS n_files, round(max(score), 6) AS top_score FROM merged GROUP BY query_id, match_type",
    "rank_results": f"WITH {_MERGED} SELECT query_id, file, rank::INTEGER AS rank, round(score, 6) AS score, max_line_matches::INTEGER AS max_line_matches, match_type FROM ordered",
    "limit_reserved": f"{_limited(5)} SELECT query_id, file, new_rank AS rank, match_type FROM kept",
    "line_class_sets": f"WITH {_SETS} SELECT file, line, context, array_to_string(classes, '|') AS classes FROM sets",
    "duplicate_groups": f"WITH {_GROUPS} SELECT array_to_string(classes, '|') AS classes, n_occurrences, n_files FROM dups",
    "duplicate_documents": f"""WITH {_LOCS}, sets AS (SELECT file, line, arg_min(text, emit_seq) AS text, list_sort(list(class)) AS classes FROM ranked WHERE loc_rank <= 8 GROUP BY file, line HAVING count(*) >= 3), dups AS (
        SELECT classes FROM sets GROUP BY classes HAVING count(DISTINCT file) >= 2) SELECT file, line, {_CONTEXT} AS context FROM sets SEMI JOIN dups USING (classes)""",
    "duplicate_summary": f"""WITH {_GROUPS}, f AS (SELECT classes, string_agg(file, ', ' ORDER BY file) AS files FROM (SELECT DISTINCT classes, file FROM sets) GROUP BY classes)
        SELECT n_files, n_occurrences, len(classes)::INTEGER AS n_classes, array_to_string(classes[1:6], ' ') || CASE WHEN len(classes) > 6 THEN ' …' ELSE '' END AS preview, md5(files) AS files_md5 FROM dups JOIN f USING (classes)""",
    "duplicate_report": f"""WITH {_GROUPS} SELECT n_occurrences, n_files, array_to_string(classes, '|') AS classes, regexp_extract(file, '([^/]*)$', 1) || ':' || (line + 1) AS label, file, line, context
        FROM sets JOIN dups USING (classes)""",
    "replace_in_string": """WITH w AS (SELECT p_partkey, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM (SELECT p_partkey, string_split(p_name || ' bolt', ' ') AS a FROM part)), m AS (
        SELECT *, lower(w) IN ('red', 'bolt') AS hit FROM w), n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, hit ORDER BY i) AS k FROM m)
        SELECT p_partkey, ' ' || string_agg(CASE WHEN NOT hit THEN w WHEN k = 1 THEN 'blue-1 blue-2' END, ' ' ORDER BY i) AS new_value, true AS changed FROM n GROUP BY p_partkey""",
    "candidate_files": f"WITH {_EDITED} SELECT file FROM edits",
    "compute_edits": f"WITH {_EDITED} SELECT file, 1::INTEGER AS line, (length(head) - 1)::INTEGER AS start_at, (length(head) + length(p_name) + 1)::INTEGER AS end_at, '\"' || p_name || '\"' AS before, '\"' || new || '\"' AS new_text FROM edits",
    "preview_replacements": f"""WITH {_EDITED} SELECT sha256(concat_ws(chr(1), (SELECT min(r_regionkey) FROM region)::VARCHAR, file, (length(head) - 1)::VARCHAR, '"' || p_name || '"')) AS key, file, 1::INTEGER AS line,
        '"' || p_name || '"' AS before, '"' || new || '"' AS after FROM edits""",
    "apply_selected": f"WITH {_EDITED} SELECT (SELECT count(*) FROM edits WHERE lower(p_name) LIKE 'red%') AS applied, (SELECT count(*) FROM region) AS skipped",
    "apply_edits": f"WITH {_EDITED} SELECT file, head || new || tail AS source FROM edits",
    "replace_summary": f"WITH {_EDITED} SELECT count(*) AS n_files, count(*) AS n_occurrences FROM edits",
    "index_stream": """WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error')
        SELECT 'user/' || user_id || '.tsx' AS file, unnest([event_type, 'w-[' || floor(value)::BIGINT || 'px]']) AS class, epoch_us(ts) // 1000 AS mtime_ms FROM last""",
}
