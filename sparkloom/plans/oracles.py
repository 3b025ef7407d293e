"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..functions.asking import CUES, ENDINGS

#: What the queries' word list has to be, stated again here; fixed values.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "this", "that", "be", "as", "at", "by", "from",
    "do", "does", "add", "now", "then", "your", "you", "we", "can", "class", "method", "function", "file", "code", "line",
]

V = {
    "v_trace": """SELECT user_id AS session_id, event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn_number, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'passthrough' WHEN 'click' THEN 'curator' WHEN 'purchase' THEN 'briefing' WHEN 'signup' THEN 'cold_start' ELSE 'agent_solo_compressed' END AS assembly_mode,
  CAST(FLOOR(value*100) AS BIGINT) AS input_tokens,
  CASE WHEN event_type IN ('click','purchase','error') THEN CAST(FLOOR(value*40) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS savings_tokens,
  value AS latency_ms, event_type = 'click' AS recall_used, event_type = 'error' AS failed FROM events""",
    "v_read": """SELECT session_id, turn_number AS idx, CASE WHEN assembly_mode='briefing' THEN 'write' WHEN assembly_mode='curator' THEN 'grep' WHEN assembly_mode='agent_solo_compressed' THEN 'bash' ELSE 'read' END AS tool,
  CONCAT('src/f', CAST(event_id % 17 AS VARCHAR), '.py') AS path, CONCAT('body ', CAST(event_id % 29 AS VARCHAR)) AS content FROM v_trace""",
    "v_msg": "SELECT conv_id AS session_id, turn AS idx, role, text AS content FROM conversations",
    "v_turn": "SELECT *, CAST(SUM(CASE WHEN role='user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx) AS BIGINT) AS turn FROM v_msg",
    "v_fact": """SELECT doc_id AS fact_id, doc_id // 40 AS session_id, doc_id % 40 + 1 AS source_turn, text AS content,
  CASE doc_id % 7 WHEN 0 THEN 'file_state' WHEN 1 THEN 'error' WHEN 2 THEN 'tool_result' WHEN 3 THEN 'decision' WHEN 4 THEN 'state' WHEN 5 THEN 'goal' ELSE 'observation' END AS fact_type,
  (n_chars % 101) / CAST(100 AS DOUBLE) AS confidence, doc_id % 5 = 0 AS invalidated FROM documents""",
    "v_again": "SELECT * FROM v_fact UNION ALL SELECT fact_id + 1000000000, session_id, source_turn, CASE WHEN fact_id % 3 = 0 THEN content ELSE content || ' once more' END, fact_type, confidence, invalidated FROM v_fact",
    "v_supersedes": "SELECT n.session_id, n.fact_id AS new_id, o.fact_id AS old_id FROM v_fact n JOIN v_fact o ON n.session_id = o.session_id AND n.source_turn = o.source_turn + 1 WHERE o.invalidated",
    "v_file": "SELECT page_id // 20 AS session_id, REGEXP_REPLACE(url, '^https?://', '') AS path, html AS content, page_id AS last_updated_turn FROM pages",
    "v_edge": "SELECT DISTINCT a.session_id, a.path AS src, b.path AS dst FROM v_file a JOIN v_file b ON a.session_id * 20 + (a.last_updated_turn % 20) // 2 = b.last_updated_turn WHERE a.path <> b.path",
    "v_score": """SELECT *, CASE fact_type WHEN 'error' THEN 5 WHEN 'goal' THEN 4 WHEN 'state' THEN 3 WHEN 'file_state' THEN 3 WHEN 'tool_result' THEN 2 WHEN 'decision' THEN 2 ELSE 1 END / CAST(5 AS DOUBLE) * 0.4e0
  + confidence * 0.3e0 + (1.0e0 / (1.0e0 + LN(1.0e0 + CAST(GREATEST(MAX(source_turn) OVER (PARTITION BY session_id) - source_turn, 0) AS DOUBLE)))) * 0.3e0 AS score,
  GREATEST(1, LENGTH('- [' || fact_type || '|t' || CAST(source_turn AS VARCHAR) || '] ' || content || chr(10)) // 4) AS tokens FROM v_fact""",
}
V["v_tooled"] = """SELECT session_id, idx * 10 AS idx, role, content, CASE WHEN role = 'assistant' AND idx % 4 < 3 THEN 'c' || idx % 3 END AS call, CAST(NULL AS VARCHAR) AS tool_call_id, CAST(NULL AS VARCHAR) AS name FROM v_msg
  UNION ALL SELECT session_id, idx * 10 + 5, 'tool', content || chr(10) || content, NULL, 'c' || idx % 3, CASE WHEN session_id % 2 = 0 THEN 'grep' ELSE 'read_file' END FROM v_msg WHERE role = 'assistant' AND idx % 4 < 3"""
_NEEDS = {"v_tooled": ["v_msg"], "v_again": ["v_fact"], "v_read": ["v_trace"], "v_turn": ["v_msg"], "v_supersedes": ["v_fact"], "v_score": ["v_fact"], "v_edge": ["v_file"]}


def norm(c: str) -> str:
    sp = r"[ \t\n\r\f\x0B]"
    c = f"regexp_replace(lower(coalesce({c}, '')), '^{sp}+|{sp}+$', '', 'g')"
    c = f"regexp_replace({c}, '^[\"''`]+|[\"''`]+$', '', 'g')"
    return f"regexp_replace(regexp_replace({c}, '{sp}+', ' ', 'g'), '[.!?;:]+$', '')"


def toks(c: str) -> str:
    return f"list_filter(list_distinct(string_split({norm(c)}, ' ')), lambda x: x <> '')"


def idents(c: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '[a-zA-Z_][a-zA-Z0-9_]+'), lambda x: lower(x))), lambda x: x NOT IN ({stop}))"


def est(c: str) -> str:
    return f"GREATEST(1, LENGTH(COALESCE({c}, '')) // 4)"


def _q(text: str, *views: str, recursive: bool = False) -> str:
    order: list[str] = []

    def add(v):
        for x in _NEEDS.get(v, []):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    head = ", ".join(f"{v} AS ({V[v]})" for v in order)
    start = "WITH RECURSIVE" if recursive else "WITH"
    return f"{start} {head} {text}" if not text.startswith(",") else f"{start} {head}{text}"


_REL = f"""SELECT session_id, path, CASE WHEN len({idents("'install the href link and table of content title'")}) = 0 OR len(t) = 0 THEN 0.0e0 ELSE len(list_intersect({idents("'install the href link and table of content title'")}, t)) / CAST(len({idents("'install the href link and table of content title'")}) AS DOUBLE) END AS relevance
  FROM (SELECT session_id, path, {idents("path || chr(10) || coalesce(content, '')")} AS t FROM v_file)"""
_REL_RANK = f"SELECT session_id, path, relevance, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY relevance DESC, path) AS rank FROM ({_REL})"
_DEG = "SELECT f.session_id, f.path, COALESCE(n, 0) AS in_degree FROM v_file f LEFT JOIN (SELECT session_id, dst, COUNT(*) AS n FROM v_edge GROUP BY 1, 2) e ON f.session_id = e.session_id AND f.path = e.dst"
_DEG_RANK = f"SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY in_degree DESC, path) AS rank FROM ({_DEG})"
_CLASS = f"""SELECT r.session_id, r.idx, CASE WHEN rn > 1 THEN 'exact_dup' WHEN COALESCE(w.m > r.idx, false) THEN 'superseded' ELSE 'live' END AS bucket, {est('r.content')} AS tokens
  FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, content ORDER BY idx) AS rn FROM v_read WHERE tool = 'read') r
  LEFT JOIN (SELECT session_id, path, MAX(idx) AS m FROM v_read WHERE tool = 'write' GROUP BY 1, 2) w ON r.session_id = w.session_id AND r.path = w.path"""
_TRUTH = f""", words AS (SELECT session_id * 10 + (source_turn - 1) // 4 AS turn, list_filter(list_distinct(string_split({norm('content')}, ' ')), lambda w: LENGTH(w) > 2) AS fw FROM v_fact WHERE NOT invalidated),
  truth AS (SELECT session_id * 10 + (source_turn - 1) // 4 AS turn, fact_id AS truth_id, list_filter(list_distinct(string_split({norm("'also ' || content")}, ' ')), lambda w: LENGTH(w) > 2) AS tw FROM v_fact),
  found AS (SELECT t.turn, truth_id, MAX(CASE WHEN len(tw) = 0 OR fw IS NULL THEN 0.0e0 ELSE len(list_intersect(tw, fw)) / CAST(len(tw) AS DOUBLE) END) AS overlap FROM truth t LEFT JOIN words w ON t.turn = w.turn GROUP BY 1, 2)"""

def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _held(line: str, words: list[str], more: str = "true") -> str:
    """Whether a padded line holds one of some words (w) for which more is true."""
    return f"len(list_filter({_list(words)}, lambda w: contains({line}, ' ' || w || ' ') AND {more})) > 0"


def _cued(kind: str) -> str:
    """Whether a line of `lines` holds a cue of a kind of question."""
    alone, pairs = next((a, p) for k, a, p in CUES if k == kind)
    rest = "substr(line, strpos(line, ' ' || w || ' ') + length(w) + 1)"
    later = lambda words: f"len(list_filter({_list(words)}, lambda x: contains({rest}, ' ' || x || ' '))) > 0"
    return f"len(list_filter(lines, lambda line: {' OR '.join([_held('line', alone), *(_held('line', first, later(words)) for first, words in pairs)])})) > 0"


def _lines(c: str) -> str:
    return rf"list_transform(string_split(regexp_replace(lower(COALESCE({c}, '')), '[^\p{{L}}\p{{N}}_\n]+', ' ', 'g'), chr(10)), lambda x: ' ' || trim(x) || ' ')"


#: The order in which kinds are tried, and what a message without cues is.
_QUESTION = "CASE " + " ".join(f"WHEN {_cued(k)} THEN '{k}'" for k in ("debug", "recall", "status", "exploration", "action")) + " ELSE 'followup' END"
#: Again stated here: words of domains, weights by kind of question, and types of facts; fixed values.
_DOMAINS = {
    "errors": ["error", "exception", "traceback", "fail", "crash", "bug", "issue", "broken", "TypeError", "ValueError", "KeyError", "ImportError", "SyntaxError", "RuntimeError"],
    "decisions": ["decide", "decision", "chose", "choice", "approach", "strategy", "tradeoff", "trade-off", "rationale", "why did we"],
    "architecture": ["architecture", "design", "pattern", "module", "component", "layer", "service", "pipeline", "flow", "data model", "schema"],
    "goals": ["goal", "objective", "task", "milestone", "requirement", "spec", "target"],
    "tools": ["tool", "command", "script", "npm", "pip", "cargo", "make", "docker", "git", "curl", "test"],
}
_shown = lambda d: f"CASE WHEN regexp_matches(content, '(?i)(?:^|[^a-z0-9_])(?:{'|'.join(_DOMAINS[d])})(?:[^a-z0-9_]|$)') THEN 0.3e0 ELSE 0.0e0 END"
_kind = lambda **w: "CASE question " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in w.items()) + " ELSE 0.0e0 END"
_SAID = """said AS (SELECT session_id, idx, content || [' why does parse_it( fail in `src/a.py`', ' explain the data model', ' what did we decide on the requirement', ' create a script', '', ' what did we decide about the error', ' let''s go ahead', chr(10) || 'actually, please' || chr(10) || 'add it'][CAST((session_id + idx) % 8 + 1 AS INT)] AS content FROM v_msg WHERE role = 'user')"""
_ASKED = fr""", {_SAID},
  cut AS (SELECT *, {_lines('content')} AS lines, list_transform(regexp_split_to_array(COALESCE(content, ''), '[\s`"'']+'), lambda w: string_split(regexp_extract(w, '^[A-Za-z_][\w./\-]*'), '.')) AS paths,
    list_transform(string_split(COALESCE(content, ''), '('), lambda x, i: regexp_split_to_array(CASE WHEN i > 1 THEN '(' ELSE '' END || regexp_replace(x, '\s+$', ''), '[\s`]')[-1]) AS before, string_split(COALESCE(content, ''), '`') AS ticks FROM said),
  named AS (SELECT *, list_transform(paths, lambda p: list_max(list_filter(range(2, len(p) + 1), lambda i: list_contains({_list(ENDINGS)}, regexp_extract(p[i], '^\w+'))))) AS ends FROM cut),
  kinds AS (SELECT session_id, idx, content, {_QUESTION} AS question, list_sort(list_distinct(list_concat(list_concat(
      list_transform(list_filter(range(1, len(paths) + 1), lambda i: ends[i] IS NOT NULL), lambda i: array_to_string(paths[i][1:ends[i] - 1], '.') || '.' || regexp_extract(paths[i][ends[i]], '^\w+')),
      list_filter(before[1:len(before) - 1], lambda n: regexp_matches(n, '^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*$'))),
      list_filter(ticks[2:len(ticks) - 1], lambda n: regexp_matches(n, '^[a-zA-Z_][\w.]*$'))))) AS refs FROM named),
  asked AS (SELECT *, GREATEST({_kind(debug=0.3, status=0.3, action=0.4)}, CASE WHEN len(refs) > 0 THEN 0.5e0 ELSE 0.0e0 END) AS w_files, GREATEST({_shown('errors')}, {_kind(debug=0.6)}) AS w_errors,
    GREATEST({_shown('decisions')}, {_kind(recall=0.5, status=0.4, action=0.2)}) AS w_decisions, GREATEST({_shown('architecture')}, {_kind(exploration=0.5)}) AS w_architecture,
    {_kind(debug=0.4, recall=0.3, status=0.3, exploration=0.3, action=0.3)} AS w_state, {_shown('tools')} AS w_tools, GREATEST({_shown('goals')}, {_kind(recall=0.4, status=0.5)}) AS w_goals FROM kinds)"""
_LAST_TURN = """f AS (SELECT v.*, e.embedding, q.embedding AS query, 1.0e0 / (1.0e0 + LN(1.0e0 + CAST(MAX(source_turn) OVER (PARTITION BY session_id) - source_turn AS DOUBLE))) AS recency,
    (CASE fact_type WHEN 'error' THEN 5 WHEN 'goal' THEN 4 WHEN 'state' THEN 3 WHEN 'file_state' THEN 3 WHEN 'tool_result' THEN 2 WHEN 'decision' THEN 2 ELSE 1 END / 5.0e0 * 0.5e0 + confidence * 0.5e0) AS worth,
    CASE WHEN e.embedding IS NOT NULL AND q.embedding IS NOT NULL THEN list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) ELSE 0.0e0 END AS similarity
    FROM v_score v LEFT JOIN embeddings e ON v.fact_id = e.vec_id LEFT JOIN embeddings q ON v.session_id = q.vec_id)"""
_NOISE = f""", own AS (SELECT session_id * 10 + (source_turn - 1) // 4 AS turn, fact_id AS id, invalidated, list_filter(list_distinct(string_split({norm('content')}, ' ')), lambda w: LENGTH(w) > 2) AS fw,
    list_filter(list_distinct(string_split({norm("'also ' || content")}, ' ')), lambda w: LENGTH(w) > 2) AS tw FROM v_fact),
  noisy AS (SELECT a.turn, a.id, NOT COALESCE(bool_or(len(list_intersect(a.fw, b.tw)) > 0 AND len(list_intersect(a.fw, b.tw)) >= 0.4e0 * len(b.tw)), false) AS noise FROM own a LEFT JOIN own b ON a.turn = b.turn AND NOT b.invalidated GROUP BY 1, 2)"""

#: Messages with calls: where a tail begins, what its messages refer to, where it may begin, and its merged rows.
_MERGED = r""", n AS (SELECT *, COUNT(*) OVER s AS n, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS spot FROM v_tooled WINDOW s AS (PARTITION BY session_id)),
  b AS (SELECT r.session_id, r.spot, MAX(c.spot) AS call_at FROM n r JOIN n c ON c.session_id = r.session_id AND c.call = r.tool_call_id AND c.spot < r.spot GROUP BY 1, 2),
  e AS (SELECT n.*, MIN(COALESCE(call_at, n.spot)) OVER (PARTITION BY n.session_id ORDER BY n.spot DESC) AS need FROM n LEFT JOIN b ON b.session_id = n.session_id AND b.spot = n.spot),
  f AS (SELECT *, MAX(CASE WHEN need >= spot AND spot <= GREATEST(n - 4, 0) THEN spot END) OVER (PARTITION BY session_id) AS start, MIN(CASE WHEN role = 'user' AND spot >= n - 12 THEN spot END) OVER (PARTITION BY session_id) AS user_at FROM e),
  k AS (SELECT * FROM f WHERE spot >= CASE WHEN n - start <= 12 THEN start ELSE COALESCE(user_at, n - 4) END),
  h AS (SELECT session_id, MIN(idx) AS head FROM k WHERE role = 'user' OR EXISTS (SELECT 1 FROM k r WHERE r.session_id = k.session_id AND r.tool_call_id = k.call AND r.idx > k.idx) GROUP BY 1),
  v AS (SELECT k.*, role NOT IN ('user', 'assistant') OR call IS NOT NULL OR content IS NULL AS alone FROM k JOIN h ON h.session_id = k.session_id AND k.idx >= head),
  g AS (SELECT *, SUM(fresh) OVER (PARTITION BY session_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN role = LAG(role) OVER o AND NOT alone AND NOT LAG(alone) OVER o THEN 0 ELSE 1 END AS fresh FROM v WINDOW o AS (PARTITION BY session_id ORDER BY idx)))
  SELECT session_id, MIN(idx) AS idx, MIN(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY idx) AS content, COUNT(*) AS merged FROM g GROUP BY session_id, run"""


def _cut_sql(n: int) -> str:
    head = f"c[1:{n}]"
    back = f"strpos(reverse({head}), chr(10))"
    cut = f"CASE WHEN {back} > 0 AND length({head}) - {back} > {n // 2} THEN c[1:length({head}) - {back}] ELSE {head} END"
    return f"CASE WHEN shown THEN '[content already in session context — ' || length(c) || ' chars: ' || (regexp_replace(split_part(c, chr(10), 1), '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g'))[1:100] || '...]' ELSE {cut} || chr(10) || '[...' || (length(c) - length({cut})) || ' chars truncated by context ceiling...]' END"


_CEILING = rf""", p AS (SELECT *, content AS c, idx > MAX(idx) OVER s - 20 AS tail, CASE WHEN role = 'system' THEN 1000.0e0 ELSE 0.4e0 * (ROW_NUMBER() OVER o - 1) / GREATEST(COUNT(*) OVER s - 1, 1) END AS priority,
    COALESCE(FIRST_VALUE(CASE WHEN role = 'system' THEN content END) OVER (PARTITION BY session_id ORDER BY CASE WHEN role = 'system' THEN idx END NULLS LAST), '') AS ctx FROM v_tooled WINDOW s AS (PARTITION BY session_id), o AS (PARTITION BY session_id ORDER BY idx)),
  t AS (SELECT *, CASE WHEN tail THEN NULL WHEN role = 'tool' AND name = 'grep' AND length(c) > 300 THEN 1 WHEN role = 'tool' AND length(c) > 900 THEN 2 WHEN role = 'assistant' AND length(c) > 300 THEN 3 END AS phase,
    list_transform(list_filter(string_split(c, chr(10)), lambda x: length(trim(x)) >= 20)[1:8], lambda x: trim(x)[1:60]) AS heads FROM p),
  w AS (SELECT *, length(ctx) >= 100 AND len(list_filter(heads, lambda x: contains(ctx, x))) >= 3 AND len(list_filter(heads, lambda x: contains(ctx, x))) * 2 >= len(heads) AS shown, regexp_replace(c[1:200], ' [^ ]*\z', '') AS h, regexp_replace(SUBSTRING(c, LENGTH(c) - 99), '\A[^ ]* ', '') AS e FROM t),
  x AS (SELECT *, CASE phase WHEN 1 THEN {_cut_sql(300)} WHEN 2 THEN {_cut_sql(900)} WHEN 3 THEN h || chr(10) || '[...' || (length(c) - length(h) - length(e)) || ' chars compressed...]' || chr(10) || e END AS short FROM w),
  y AS (SELECT *, CASE WHEN phase IS NULL THEN 0 ELSE CAST(trunc(({est('short')} - {est('c')}) * 1.1e0) AS BIGINT) END AS delta, GREATEST(CAST(FLOOR(SUM({est('c')}) OVER (PARTITION BY session_id) * 1.1e0) AS BIGINT), 100) AS start FROM x),
  z AS (SELECT *, start + COALESCE(SUM(delta) OVER (PARTITION BY session_id ORDER BY phase NULLS LAST, priority, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM y),
  a AS (SELECT *, phase IS NOT NULL AND MIN(held) OVER (PARTITION BY session_id ORDER BY phase NULLS LAST, priority, idx ROWS UNBOUNDED PRECEDING) > 1500 AS applied FROM z)
  SELECT session_id, idx, CASE WHEN applied THEN phase END AS phase, CASE WHEN applied THEN short ELSE content END AS content FROM a"""

_REFS = r""", e AS (SELECT session_id, src, dst, length(dst) % 5 AS k, regexp_replace(dst, '[?#].*$', '') AS plain FROM v_edge),
  t AS (SELECT *, CASE k WHEN 0 THEN './' || repeat('../', length(src) - length(replace(src, '/', ''))) || dst WHEN 1 THEN '@/' || regexp_replace(dst, '^[^/]*/', '') WHEN 2 THEN dst || '?raw' WHEN 3 THEN regexp_extract(plain, '([^/]*)/*$', 1) ELSE regexp_replace(plain, '\.html$', '') END AS target FROM e),
  b AS (SELECT *, CASE k WHEN 0 THEN regexp_replace(regexp_replace(plain, '/+', '/', 'g'), '/$', '') WHEN 1 THEN regexp_replace(regexp_replace(dst, '^[^/]*/', ''), '[?#].*$', '') WHEN 3 THEN '' ELSE CASE WHEN contains(plain, '/') THEN regexp_replace(plain, CASE WHEN k = 4 THEN '\.html$' ELSE '$^' END, '') ELSE '' END END AS base,
    CASE WHEN k IN (2, 3, 4) THEN regexp_extract(regexp_replace(target, '[?#].*$', ''), '([^/]*)/*$', 1) ELSE '' END AS own, NOT contains(regexp_replace(target, '[?#].*$', ''), '/') AND contains(regexp_replace(target, '[?#].*$', ''), '.') AS dotted FROM t WHERE trim(regexp_replace(target, '[?#].*$', '')) <> ''),
  f AS (SELECT DISTINCT session_id, path, regexp_extract(path, '([^/]*)/*$', 1) AS bn FROM v_file),
  a AS (SELECT b.*, key, how, rank FROM b, unnest(list_concat(CASE WHEN base = '' THEN [] ELSE list_concat(
      list_transform(range(1, 12), lambda i: {'how': 'path', 'rank': i, 'key': base || ['', '.ts', '.tsx', '.js', '.jsx', '.mjs', '.css', '.astro', '.vue', '.svelte', '.json'][i]}), list_transform(range(1, 6), lambda i: {'how': 'index', 'rank': i, 'key': base || '/index' || ['.ts', '.tsx', '.js', '.jsx', '.mjs'][i]})) END,
      list_filter([{'how': 'name', 'rank': 1, 'key': own}, {'how': 'name', 'rank': 2, 'key': regexp_replace(own, '\.[^.]*$', '')}, {'how': 'name', 'rank': 3, 'key': CASE WHEN dotted THEN split_part(regexp_replace(target, '[?#].*$', ''), '.', -1) ELSE '' END}], lambda x: x.key <> ''))) u(c), LATERAL (SELECT c.key AS key, c.how AS how, c.rank AS rank)),
  h AS (SELECT a.*, f.path, CASE WHEN how = 'name' THEN 'name' WHEN f.path = key THEN how WHEN how = 'path' THEN 'end' ELSE 'end_index' END AS way FROM a JOIN f ON f.session_id = a.session_id AND (CASE WHEN how = 'name' THEN key IN (f.path, bn, regexp_replace(bn, '\.[^.]*$', '')) ELSE f.path = key OR ends_with(f.path, '/' || key) END)),
  g AS (SELECT session_id, src, target, path, way FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, src, target ORDER BY list_position(['path', 'index', 'end', 'end_index', 'name'], way), rank, path) = 1)
  SELECT session_id, src, target, path AS dst, way FROM g WHERE src <> path"""

_CAPTURED = r""", n AS (SELECT session_id || ':' || idx AS response_id, content, length(content) AS size FROM v_msg WHERE role = 'assistant' AND length(content) > 0),
  c AS (SELECT response_id, size, seq, seq * 40 + 40 >= size AS done, translate(content[CAST(seq * 40 + 1 AS BIGINT):CAST(seq * 40 + 40 AS BIGINT)], '"\' || chr(10) || chr(9) || chr(13), '     ') AS safe FROM n, unnest(range(0, (size - 1) // 40 + 1)) t(seq)),
  p AS (SELECT *, '{"model":"m' || seq % 3 || '","choices":[{"delta":{"content":"' || safe || '"}' || CASE WHEN done THEN ',"finish_reason":"stop"}],"usage":{"total_tokens":' || size || '}}' ELSE '}]}' END AS payload FROM c),
  o AS (SELECT *, SUM(octet_length(encode(payload))) OVER (PARTITION BY response_id ORDER BY seq) > 1000 AS over FROM p)
  SELECT response_id, COALESCE(string_agg(safe, '' ORDER BY seq) FILTER (NOT over), '') AS content, arg_max('m' || seq % 3, seq) FILTER (NOT over) AS model, MAX(CASE WHEN done THEN 'stop' END) FILTER (NOT over) AS finish, MAX(CASE WHEN done THEN '{"total_tokens":' || size || '}' END) FILTER (NOT over) AS usage,
    COUNT(*) FILTER (NOT over) AS chunks, bool_or(over) AS truncated FROM o GROUP BY 1"""
_DEGREES = "SELECT f.session_id, f.path, COALESCE(n, 0) AS d FROM (SELECT DISTINCT session_id, path FROM v_file) f LEFT JOIN (SELECT session_id, dst, COUNT(*) AS n FROM v_edge GROUP BY 1, 2) e ON f.session_id = e.session_id AND f.path = e.dst"
_BASE = "SELECT session_id, string_agg(path || ' (<-' || d || ')', ', ' ORDER BY k) AS base FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY d DESC, path) AS k FROM deg WHERE d > 0) WHERE k <= {} GROUP BY 1"
_capped = lambda c, n: f"CASE WHEN length({c}) <= {n} THEN {c} ELSE CASE WHEN contains({c}[1:{n}], chr(10)) THEN {c}[1:{n}][1:{n} - strpos(reverse({c}[1:{n}]), chr(10))] ELSE {c}[1:{n}] END || chr(10) || '... [map truncated]' END"

_OUTLINE = r""", l AS (SELECT session_id, path, i AS line, string_split(content, chr(10))[i] AS x FROM v_file, unnest(range(1, len(string_split(content, chr(10))) + 1)) t(i)),
  n AS (SELECT *, regexp_extract(x, '^\s*(?:async\s+)?(?:def|function|fn|func)\s+(\w+)', 1) AS f, regexp_extract(x, '^\s*(?:class|struct|interface|enum)\s+(\w+)', 1) AS c, regexp_extract(x, '^\s*(?:const|let|var)\s+(\w+)', 1) AS v, regexp_extract(x, '<h[1-6][^>]*>([^<]+)<', 1) AS h FROM l),
  outline AS (SELECT session_id, path, line, CASE WHEN f <> '' THEN 'function' WHEN c <> '' THEN 'class' WHEN v <> '' THEN 'const' ELSE 'heading' END AS kind, CASE WHEN f <> '' THEN f WHEN c <> '' THEN c WHEN v <> '' THEN v ELSE h END AS name FROM n WHERE f || c || v || h <> '')"""
_ASKED_WORDS = idents("'install the href link and table of content title'")
_FOCUS = f""", o AS (SELECT *, LEAD(line) OVER (PARTITION BY session_id, path ORDER BY line) AS next, {idents('name')} AS t FROM outline),
  s AS (SELECT *, CASE WHEN len({_ASKED_WORDS}) = 0 OR len(t) = 0 THEN 0.0e0 ELSE len(list_intersect({_ASKED_WORDS}, t)) / CAST(len({_ASKED_WORDS}) AS DOUBLE) END AS score FROM o)
  SELECT session_id, path, name, line AS first_line, LEAST(COALESCE(next - 1, line + 79), line + 79) AS last_line, score FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, path ORDER BY score DESC, line) = 1"""
#: A fold over a session's open facts, anchors first.
_FILL = """, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY CASE WHEN fact_type IN ('goal', 'decision') THEN 0 ELSE 1 END, CASE WHEN fact_type IN ('goal', 'decision') THEN 0.0e0 ELSE -score END, fact_id) AS k, fact_type NOT IN ('goal', 'decision') AS other FROM v_score WHERE NOT invalidated),
  w(session_id, k, used, stop, taken, fact_id) AS (SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, false, CAST(NULL AS BIGINT) FROM k
    UNION ALL SELECT k.session_id, k.k, CASE WHEN NOT stop AND used + tokens <= 3000 THEN used + tokens ELSE used END, stop OR (other AND NOT (NOT stop AND used + tokens <= 3000)), NOT stop AND used + tokens <= 3000, k.fact_id FROM w JOIN k ON k.session_id = w.session_id AND k.k = w.k + 1),
  fill AS (SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY k) - 1 AS pos, fact_id FROM w WHERE taken)"""
_PREVIEW = "CASE WHEN length(c) <= 120 THEN c ELSE CASE WHEN b > 0 AND length(h) - b + 1 > 60 THEN h[1:length(h) - b] ELSE h END || chr(10) || '... [' || (length(c) - length(CASE WHEN b > 0 AND length(h) - b + 1 > 60 THEN h[1:length(h) - b] ELSE h END)) || ' chars omitted]' END"

_T, _B, _E = "<\uff5c\uff5cDSML\uff5c\uff5c", "<\uff5ctool\u2581calls\u2581begin\uff5c>", "<\uff5ctool\u2581calls\u2581end\uff5c>"
_LEAKING = f""", l AS (SELECT session_id, idx, content AS t, (session_id + idx) % 4 AS k, CASE (session_id + idx) % 4 WHEN 0 THEN content || '{_T}x>' WHEN 1 THEN '<tool_call>{{}}</tool_call>' || content || '{_B}a{_E} ' || chr(10) WHEN 2 THEN '<tool_call>' || content ELSE content END AS c FROM v_msg WHERE role = 'assistant')
  SELECT session_id, idx, regexp_replace(CASE WHEN k = 2 THEN c ELSE t END, '\\s+$', '') AS text, k < 2 AS leaks, CASE WHEN length(c) < 300 THEN 'low_tokens (' || length(c) || 't < 300t)' WHEN k < 3 THEN 'markup' END AS reason FROM l"""
_SOLO = r""", m AS (SELECT session_id, idx, role, CASE WHEN role = 'tool' AND session_id % 5 = 0 THEN 'same ' || repeat('x ', 60) ELSE content END AS c FROM v_tooled),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, role, c ORDER BY idx) > 1 AS again, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx DESC) <= 3 AS late, SUM(GREATEST(1, length(c) // 4)) OVER (PARTITION BY session_id) >= 1000 AS enough, '[same result as before: ' || length(c) || ' chars]' AS mark,
    c[1:400] AS h, strpos(reverse(c[1:400]), chr(10)) AS b, regexp_replace(c[1:133], ' [^ ]*\z', '') AS hh, regexp_replace(SUBSTRING(c, LENGTH(c) - 65), '\A[^ ]* ', '') AS tt FROM m),
  s AS (SELECT *, CASE WHEN NOT enough THEN NULL WHEN role = 'tool' AND again AND length(c) > length(mark) THEN 'dedup' WHEN role = 'tool' AND length(c) > 400 THEN 'shrink' WHEN role = 'assistant' AND NOT late AND length(c) > 200 THEN 'middle' END AS strategy,
    CASE WHEN b > 0 AND length(h) - b > 200 THEN c[1:length(h) - b] ELSE h END AS cut FROM r),
  t AS (SELECT *, CASE strategy WHEN 'dedup' THEN mark WHEN 'shrink' THEN cut || chr(10) || '[...' || (length(c) - length(cut)) || ' chars shrunk...]' WHEN 'middle' THEN hh || chr(10) || '[...' || (length(c) - length(hh) - length(tt)) || ' chars compressed...]' || chr(10) || tt ELSE c END AS x FROM s),
  g AS (SELECT session_id, COALESCE(string_agg(DISTINCT strategy, ',' ORDER BY strategy), '') AS strategies, COALESCE(SUM(length(c) - length(x)) FILTER (strategy = 'dedup'), 0) AS saved_dedup, COALESCE(SUM(length(c) - length(x)) FILTER (strategy = 'shrink'), 0) AS saved_shrink,
    COALESCE(SUM(length(c) - length(x)) FILTER (strategy = 'middle'), 0) AS saved_middle, SUM(length(c) - length(x)) AS saved, bool_or(enough) AS enough FROM t GROUP BY 1)
  SELECT session_id, strategies, CAST(saved_dedup AS BIGINT) AS saved_dedup, CAST(saved_shrink AS BIGINT) AS saved_shrink, CAST(saved_middle AS BIGINT) AS saved_middle, CAST(saved AS BIGINT) AS saved, CASE WHEN NOT enough THEN 'below_threshold_1000' WHEN strategies = '' THEN 'nothing_to_shorten' END AS skipped FROM g"""

ORACLES = {
    "turn_usage": _q("""SELECT session_id, CAST((turn_number - 1) // 4 AS BIGINT) AS turn, CAST(COALESCE(SUM(input_tokens) FILTER (NOT failed), 0) AS BIGINT) AS prompt_tokens, CAST(SUM(savings_tokens) AS BIGINT) AS completion_tokens, CAST(0 AS BIGINT) AS cached_tokens, COUNT(*) FILTER (recall_used) AS llm_calls,
  COALESCE(string_agg(DISTINCT assembly_mode, ',') FILTER (recall_used), '') AS steps FROM v_trace GROUP BY 1, 2""", "v_trace"),
    "arm_metrics": _q(""", a AS (SELECT *, CASE WHEN session_id % 2 = 0 THEN 'proxy' ELSE 'passthrough' END AS arm FROM v_trace), m AS (SELECT arm, string_agg(assembly_mode || '=' || n, ',' ORDER BY assembly_mode) AS modes FROM (SELECT arm, assembly_mode, COUNT(*) AS n FROM a GROUP BY 1, 2) GROUP BY 1),
  s AS (SELECT arm, COUNT(*) AS turns, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, CAST(SUM(CAST(FLOOR(latency_ms) AS BIGINT)) AS BIGINT) AS output_tokens, CAST(SUM(savings_tokens) AS BIGINT) AS savings_tokens FROM a GROUP BY 1)
  SELECT s.arm, turns, input_tokens, output_tokens, savings_tokens, round(savings_tokens / CAST(GREATEST(input_tokens, 1) AS DOUBLE), 4) AS savings_ratio, modes, round(input_tokens / CAST((SELECT input_tokens FROM s WHERE arm = 'passthrough') AS DOUBLE), 4) AS to_base FROM s JOIN m ON m.arm = s.arm""", "v_trace"),
    "turn_records": _q("""SELECT session_id, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx) AS turn, COALESCE((SELECT arg_max(u.content, u.idx) FROM v_msg u WHERE u.session_id = m.session_id AND u.idx < m.idx AND u.role = 'user'), '')[1:500] AS user_msg,
  content AS response, length(content) AS output_tokens, CASE WHEN idx % 2 = 1 OR idx = 0 THEN idx * 2.0e0 ELSE idx * 1.5e0 END AS latency_ms FROM v_msg m WHERE role = 'assistant'""", "v_msg"),
    "stripped_calls": _q(_LEAKING, "v_msg"),
    "solo_statistics": _q(_SOLO, "v_tooled"),
    "yaml_values": r"""SELECT page_id, CASE WHEN regexp_matches(v, '[:''"#\\]') THEN '"' || replace(replace(v, '\', '\\'), '"', '\"') || '"' ELSE v END AS value,
  COALESCE(CAST(NULLIF(regexp_extract(split_part(n, '.', 1), '^([0-9]*)', 1), '') AS BIGINT), 0) > 0 OR COALESCE(CAST(NULLIF(split_part(n, '.', 2), '') AS BIGINT), 0) > 0 OR COALESCE(CAST(NULLIF(split_part(n, '.', 3), '') AS BIGINT), 0) >= 5 AS newer
  FROM (SELECT page_id, regexp_extract(url, '[^/]*$', 0) AS v, regexp_replace(url, '[^0-9.]+', '', 'g') AS n FROM pages)""",
    "file_outline": _q(_OUTLINE + " SELECT session_id, path, line, kind, name FROM outline", "v_file"),
    "focus_range": _q(_OUTLINE + _FOCUS, "v_file"),
    "budget_fill": _q(_FILL + " SELECT session_id, pos, fact_id FROM fill", "v_score", recursive=True),
    "recall_answer": _q(_FILL + r""" SELECT f.session_id, string_agg('- [' || v.fact_type || '|t' || v.source_turn || '] ' || regexp_replace(v.content, '[ \t\n\r\f\x0B]+', ' ', 'g'), chr(10) ORDER BY pos) AS answer, COUNT(*) AS facts FROM fill f JOIN v_fact v ON v.fact_id = f.fact_id GROUP BY 1""", "v_score", recursive=True),
    "reserved_calls": _q(""", c AS (SELECT session_id, CAST(FLOOR((turn_number - 1) / 8) AS BIGINT) AS turn, turn_number AS pos, savings_tokens AS tokens, ROW_NUMBER() OVER (PARTITION BY session_id, (turn_number - 1) // 8 ORDER BY turn_number) AS k FROM v_trace),
  w(session_id, turn, k, n, used, kept) AS (SELECT DISTINCT session_id, turn, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM c
    UNION ALL SELECT c.session_id, c.turn, c.k, CASE WHEN n < 4 AND used + tokens <= 5000 THEN n + 1 ELSE n END, CASE WHEN n < 4 AND used + tokens <= 5000 THEN used + tokens ELSE used END, CASE WHEN n < 4 AND used + tokens <= 5000 THEN kept || CASE WHEN n > 0 THEN ',' ELSE '' END || pos ELSE kept END FROM w JOIN c ON c.session_id = w.session_id AND c.turn = w.turn AND c.k = w.k + 1)
  SELECT session_id, turn, n AS calls, used AS tokens, kept FROM w QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id, turn ORDER BY k DESC) = 1""", "v_trace", recursive=True),
    "recall_requests": _q(r"""SELECT session_id, idx, role = 'user' AND len(list_filter(['do you remember', 'as we discussed', 'what did we decide', 'earlier you said', 'remind me'], lambda p: contains(lower(COALESCE(content, '')), p))) > 0 AS recall,
    len(list_filter(regexp_split_to_array(lower(COALESCE(content, '')), '\s+'), lambda x: x <> '')) BETWEEN 1 AND 40 AND regexp_matches(lower(COALESCE(content, '')), '(^|\W)(it|that|this|they|them|those|same|again)(\W|$)') AS ambiguous FROM v_msg""", "v_msg"),
    "rewritten_context": _q(rf""", s AS (SELECT *, MAX(idx) OVER (PARTITION BY session_id) AS z FROM v_turn), k AS (SELECT * FROM s WHERE turn = 1 OR idx > z - 3 OR role = 'system'),
  r AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(COALESCE(content, ''), '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<reasoning>.*?</reasoning>', '', 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g') AS c, idx <= MAX(idx) OVER (PARTITION BY session_id) - 3 AS old FROM k),
  h AS (SELECT *, c[1:120] AS h, strpos(reverse(c[1:120]), chr(10)) AS b FROM r)
  SELECT session_id, idx, role, CASE WHEN old AND role <> 'system' THEN {_PREVIEW} ELSE c END AS content FROM h""", "v_turn"),
    "captured_answers": _q(_CAPTURED, "v_msg"),
    "bounded_messages": _q("""SELECT session_id, idx, CASE WHEN length(content) > 100 THEN content[1:100] || '... [' || length(content) || ' chars truncated]' ELSE content END AS content, CASE WHEN call IS NOT NULL THEN '{"path":"src/' || idx // 10 || '"}' END AS arguments FROM v_tooled""", "v_tooled"),
    "finished_requests": _q("SELECT event_id AS request_id, turn_number % 2 = 0 OR (NOT failed AND recall_used) AS boundary FROM v_trace", "v_trace"),
    "paired_runs": """WITH r AS (SELECT l_returnflag AS f, l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT a.l_suppkey, a.q AS a, b.q AS b, b.q - a.q AS change FROM r a JOIN r b ON a.l_suppkey = b.l_suppkey AND a.f = 'A' AND b.f = 'R' WHERE a.q % 5 <> 0 AND b.q % 5 <> 0""",
    "code_map_text": _q(f""", deg AS ({_DEGREES}), base AS ({_BASE.format(3)}), e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, src ORDER BY dst) AS k, COUNT(*) OVER (PARTITION BY session_id, src) AS n FROM v_edge),
  l AS (SELECT session_id, src, n, string_agg(dst, ', ' ORDER BY dst) AS onto FROM e WHERE k <= 2 GROUP BY 1, 2, 3),
  m AS (SELECT l.session_id, string_agg(src || ' -> ' || onto || CASE WHEN n > 2 THEN ', +' || (n - 2) || ' more' ELSE '' END, chr(10) ORDER BY d DESC, src) AS lines FROM l JOIN deg ON deg.session_id = l.session_id AND deg.path = src GROUP BY 1),
  t AS (SELECT m.session_id, concat_ws(chr(10), '=== CODE MAP ===', 'Load-bearing: ' || base, lines) AS c FROM m LEFT JOIN base ON base.session_id = m.session_id)
  SELECT session_id, {_capped('c', 400)} AS map FROM t""", "v_edge", "v_file"),
    "task_map_text": _q(f""", deg AS ({_DEGREES}), base AS ({_BASE.format(2)}), r AS ({_REL_RANK}),
  m AS (SELECT session_id, string_agg('  ' || path || CASE WHEN ends_with(path, '1') OR ends_with(path, '1/') THEN ' [exemplar]' ELSE '' END, chr(10) ORDER BY rank) AS lines FROM r WHERE rank <= 4 GROUP BY 1),
  t AS (SELECT m.session_id, concat_ws(chr(10), '=== CODE MAP (task-ranked) ===' || chr(10) || 'START HERE (most relevant to this task):', lines, 'Shared foundations: ' || base) AS c FROM m LEFT JOIN base ON base.session_id = m.session_id)
  SELECT session_id, {_capped('c', 300)} AS map FROM t""", "v_edge", "v_file"),
    "file_activity": _q("""SELECT session_id, path, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY score DESC, path) AS rank FROM (SELECT session_id, path,
    len(list_filter(['the', 'example', 'href'], lambda w: contains(lower(path), w))) * 2.0e0 + len(list_filter(['the', 'example', 'href'], lambda w: contains(lower(content[1:100]), w))) * 1.5e0 + CASE WHEN last_updated_turn % 20 > 10 THEN LEAST(3.0e0, (last_updated_turn % 20 - 10) * 0.5e0) ELSE 0.0e0 END AS score FROM v_file)) WHERE score > 0 OR rank <= 3""", "v_file"),
    "path_references": _q(_REFS, "v_edge"),
    "python_symbols": _q(r""", c AS (SELECT session_id, fact_id, len(string_split(content, chr(10))) AS n FROM v_fact)
  SELECT session_id, 'f' || fact_id || '.py' AS path, CAST(1 AS BIGINT) AS line, CAST(1 AS BIGINT) AS first, CAST(2 * n + 1 + CASE WHEN fact_id % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS last, CAST(0 AS INT) AS depth, 'class' AS kind, 'C' || fact_id AS name FROM c
  UNION ALL SELECT session_id, 'f' || fact_id || '.py', 2 * i + 2, 2 * i + 2, 2 * i + 3 + CASE WHEN fact_id % 7 = 0 AND i = n - 1 THEN 1 ELSE 0 END, 1, 'def', CASE WHEN fact_id % 7 = 0 THEN '' ELSE 'C' || fact_id || '.' END || 'm' || i FROM c, unnest(range(0, n)) t(i)""", "v_fact"),
    "outline_lookup": _q(r""", o AS (SELECT session_id, path, MIN(content[1:20]) AS outline FROM v_file GROUP BY 1, 2), q AS (SELECT DISTINCT session_id, CASE WHEN last_updated_turn % 2 = 0 THEN regexp_replace(path, '^[^/]*/', '') ELSE '/root/' || path END AS query FROM v_file)
  SELECT q.session_id, query, path, outline FROM q JOIN o ON o.session_id = q.session_id AND (path = query OR ends_with(path, '/' || query) OR ends_with(query, '/' || path))
  QUALIFY ROW_NUMBER() OVER (PARTITION BY q.session_id, query ORDER BY path <> query, LEAST(length(path), length(query)) DESC, path) = 1""", "v_file"),
    "briefing_ranges": _q("""SELECT session_id, CAST(fact_id AS VARCHAR) AS path, CAST(1 AS BIGINT) AS first, CAST(len(string_split(content, chr(10))) AS BIGINT) AS last, content FROM v_fact
  UNION ALL SELECT session_id, CAST(fact_id AS VARCHAR), len(string_split(content, chr(10))) + 5, len(string_split(content, chr(10))) + 5, split_part(content, chr(10), 1) FROM v_fact""", "v_fact"),
    "kept_briefings": _q("""SELECT CAST(2 AS INT) AS version, CAST(session_id AS VARCHAR) AS session_id, MAX(turn_number) AS source_turn, array_to_string(list_sort(list(DISTINCT turn_number)), ',') AS retained_turns, COALESCE(NULLIF(arg_max(assembly_mode, turn_number), 'curator'), 'two_pass') AS mode, 0.0e0 AS latency_ms, CAST(0 AS INT) AS files FROM v_trace GROUP BY session_id""", "v_trace"),
    "trace_fields": _q("""SELECT event_id AS turn_id, 'extractor_prompt_tokens' AS name, CAST(CASE WHEN failed AND savings_tokens <> 0 THEN savings_tokens ELSE input_tokens END AS VARCHAR) AS value FROM v_trace WHERE input_tokens <> 0 OR (failed AND savings_tokens <> 0)
  UNION ALL SELECT event_id, 'assembly_mode', assembly_mode FROM v_trace UNION ALL SELECT event_id, 'recall_used', CAST(recall_used AS VARCHAR) FROM v_trace UNION ALL SELECT event_id, 'recall_question', repeat(assembly_mode, 30)[1:200] FROM v_trace
  UNION ALL SELECT event_id, 'recall_trigger', CASE WHEN failed THEN 'phrase' ELSE 'model_invoked' END FROM v_trace WHERE failed OR recall_used""", "v_trace"),
    "merged_tail": _q(_MERGED, "v_tooled"),
    "ceiling_phases": _q(_CEILING, "v_tooled"),
    "answered_calls": _q("""SELECT r.session_id, r.idx, r.tool_call_id, arg_max(c.name, c.idx) AS name, arg_max('src/' || (c.idx // 10), c.idx) AS path, MAX(c.idx) AS call_idx, r.content FROM v_tooled r
  JOIN (SELECT session_id, idx, call, CASE WHEN session_id % 2 = 0 THEN 'grep' ELSE 'read_file' END AS name FROM v_tooled WHERE call IS NOT NULL) c ON c.session_id = r.session_id AND c.call = r.tool_call_id WHERE r.role = 'tool' AND trim(r.content) <> '' GROUP BY r.session_id, r.idx, r.tool_call_id, r.content""", "v_tooled"),
    "turn_eviction": _q(""", g AS (SELECT session_id, turn_number, created_at, SUM(CASE WHEN epoch_us(created_at) - epoch_us(before) > 21600000000 THEN 1 ELSE 0 END) OVER o AS stay FROM (SELECT *, LAG(created_at) OVER o AS before FROM v_trace WINDOW o AS (PARTITION BY session_id ORDER BY created_at, turn_number)) WINDOW o AS (PARTITION BY session_id ORDER BY created_at, turn_number)),
  r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, stay ORDER BY created_at DESC, turn_number DESC) AS k, MAX(stay) OVER (PARTITION BY session_id) AS last, MAX(created_at) OVER (PARTITION BY session_id, stay) AS until, MAX(created_at) OVER () AS now FROM g)
  SELECT CAST(session_id AS VARCHAR) AS session_id, turn_number, epoch_us(created_at) AS "at", CASE WHEN k > 3 THEN 'full' WHEN stay < last OR epoch_us(now) - epoch_us(until) > 21600000000 THEN 'idle' END AS why FROM r""", "v_trace"),
    "neighbourhood": _q(""", e AS (SELECT 'session:' || session_id AS src, 'file:' || session_id || ':' || arg_max(path, last_updated_turn) AS dst FROM v_file GROUP BY session_id UNION SELECT 'session:' || session_id, 'fact:' || session_id || ':' || MAX(fact_id) FROM v_fact GROUP BY session_id
    UNION SELECT 'file:' || session_id || ':' || src, 'file:' || session_id || ':' || dst FROM v_edge UNION SELECT 'fact:' || session_id || ':' || new_id, 'fact:' || session_id || ':' || old_id FROM v_supersedes),
  w(node, hops) AS (SELECT DISTINCT src, CAST(0 AS BIGINT) FROM e WHERE starts_with(src, 'session:') UNION SELECT e.dst, hops + 1 FROM w JOIN e ON e.src = w.node WHERE hops < 60)
  SELECT node, MIN(hops) AS hops FROM w GROUP BY 1""", "v_edge", "v_supersedes", recursive=True),
    "extracted_calls": _q(r""", c AS (SELECT session_id, last_updated_turn % 20 AS turn, last_updated_turn AS call_id, ['Read', 'Write', 'Glob', 'find_files', 'LS'][CAST(last_updated_turn % 5 + 1 AS INT)] AS tool, CASE WHEN last_updated_turn % 4 > 0 THEN path END AS p, COALESCE(content, '') AS r FROM v_file),
  l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(r, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS lines FROM c),
  g AS (SELECT *, list_filter(lines, lambda x: NOT starts_with(x, 'Found') AND (tool = 'Glob' OR length(x) > 1)) AS paths, len(list_filter(lines, lambda x: ends_with(x, '/'))) AS dirs, COALESCE(p, NULLIF(trim(split_part(r, chr(10), 1)), '')) AS named FROM l)
  SELECT session_id, turn, call_id, tool, CAST(0 AS BIGINT) AS pos, CASE tool
    WHEN 'Read' THEN '[Read] ' || COALESCE(named, 'unknown') || ' read at turn ' || turn || CASE WHEN trim(r) <> '' THEN ' (' || (length(r) - length(replace(r, chr(10), '')) + 1) || ' lines)' ELSE '' END
    WHEN 'Write' THEN '[Write] ' || COALESCE(p, 'unknown') || ' written at turn ' || turn
    WHEN 'Glob' THEN '[Glob] *.html → ' || len(paths) || ' files: ' || array_to_string(paths[1:8], ', ') || CASE WHEN len(paths) > 8 THEN ', ... (' || len(paths) || ' total)' ELSE '' END
    WHEN 'find_files' THEN '[find] found ' || len(paths) || ' paths matching query: ' || array_to_string(paths[1:8], ', ') || CASE WHEN len(paths) > 8 THEN ', ... (' || len(paths) || ' total)' ELSE '' END
    ELSE '[ls] ' || COALESCE(p, '') || ': ' || len(lines) || ' entries (' || (len(lines) - dirs) || ' files, ' || dirs || ' dirs) — ' || array_to_string(lines[1:6], ', ') || CASE WHEN len(lines) > 6 THEN ', ...' ELSE '' END END AS content,
    CASE WHEN tool IN ('Read', 'Write') THEN 'file_state' ELSE 'tool_result' END AS fact_type, 1.0e0 AS confidence, CASE tool WHEN 'Read' THEN NULLIF(named, 'unknown') WHEN 'Write' THEN p END AS touched FROM g""", "v_file"),
    "extracted_text": _q(r""", c AS (SELECT session_id, source_turn AS turn, fact_id AS call_id, fact_id % 3 AS k, CASE WHEN fact_id % 2 = 0 THEN 'src/a.py:7:x' || chr(10) || 'error: said' || chr(10) || chr(10) ELSE '' END || content AS r FROM v_fact),
  m AS (SELECT *, list_filter(list_transform(CASE WHEN contains(r, '---') THEN string_split(r, '---') ELSE string_split(r, chr(10) || chr(10)) END, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1:20] AS parts,
    list_transform(regexp_extract_all(r, '(?:error|Error|ERROR):?\s+([^\n]{0,120})', 1), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS errors FROM c),
  f AS (SELECT session_id, turn, call_id, k, CASE WHEN k = 2 THEN list_transform(parts, lambda x: '[memory_recall] ' || x) WHEN k = 1 AND len(errors) > 0 THEN list_transform(errors, lambda x: '[Bash] error: ' || x) WHEN k = 1 THEN ['[Bash] make all: ' || r[1:200]]
    WHEN call_id % 2 = 0 THEN ['[Grep] ''a'' matched 1 times in src/a.py (lines 7)'] ELSE ['[Grep] ''a'' — no structured matches; raw output: ' || r[1:300]] END AS said, len(errors) > 0 AS bad FROM m)
  SELECT session_id, turn, call_id, ['Grep', 'Bash', 'mcp__memory__recall_all'][CAST(k + 1 AS INT)] AS tool, CAST(i - 1 AS BIGINT) AS pos, said[i] AS content, CASE WHEN k = 2 THEN 'observation' WHEN k = 1 AND bad THEN 'error' ELSE 'tool_result' END AS fact_type,
    CASE WHEN k = 2 THEN 0.8e0 WHEN k = 1 THEN CASE WHEN bad THEN 0.9e0 ELSE 0.4e0 END WHEN call_id % 2 = 0 THEN 1.0e0 ELSE 0.6e0 END AS confidence, CASE WHEN k = 0 AND call_id % 2 = 0 THEN 'src/a.py' END AS touched FROM f, unnest(range(1, len(said) + 1)) t(i)""", "v_fact"),
    "changed_config": _q(""", m AS (SELECT assembly_mode, COUNT(*) AS n FROM v_trace GROUP BY 1), k AS (SELECT assembly_mode, 'turns' AS key, CAST(n AS VARCHAR) AS value FROM m UNION ALL SELECT assembly_mode, 'fixed', '1' FROM m UNION ALL SELECT assembly_mode, 'only_' || assembly_mode, 'x' FROM m)
  SELECT key, COUNT(DISTINCT value) AS "values", COUNT(DISTINCT assembly_mode) AS experiments FROM k GROUP BY 1 HAVING COUNT(DISTINCT value) > 1 OR COUNT(DISTINCT assembly_mode) < (SELECT COUNT(*) FROM m)""", "v_trace"),
    "compression_ratio": _q(""", h AS (SELECT session_id, COALESCE(content, '') AS c, SUBSTRING(COALESCE(content, ''), 1, 200) AS head FROM v_msg), p AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN LENGTH(head) - strpos(reverse(head), chr(10)) + 1 ELSE 0 END AS last FROM h),
  k AS (SELECT session_id, LENGTH(c) AS n, CASE WHEN last > 100 THEN last - 1 ELSE LENGTH(head) END AS cut FROM p), z AS (SELECT session_id, n, CASE WHEN n <= 200 THEN n ELSE cut + LENGTH(chr(10) || '... [' || (n - cut) || ' chars omitted]') END AS kept FROM k)
  SELECT session_id, CAST(SUM(n) AS BIGINT) AS chars, CAST(SUM(kept) AS BIGINT) AS kept_chars, round(SUM(n) / CAST(GREATEST(SUM(kept), 1) AS DOUBLE), 9) AS ratio FROM z GROUP BY 1""", "v_msg"),
    "intent_domains": _q(_ASKED + """ SELECT session_id, idx, question, array_to_string(refs, ',') AS refs, array_to_string(list_filter([CASE WHEN w_architecture > 0 THEN 'architecture' END, CASE WHEN w_decisions > 0 THEN 'decisions' END, CASE WHEN w_errors > 0 THEN 'errors' END,
  CASE WHEN w_files > 0 THEN 'files' END, CASE WHEN w_goals > 0 THEN 'goals' END, CASE WHEN w_state > 0 THEN 'state' END, CASE WHEN w_tools > 0 THEN 'tools' END], lambda x: x IS NOT NULL), ',') AS domains,
  round(w_files + w_errors + w_decisions + w_architecture + w_state + w_tools + w_goals, 6) AS weight FROM asked""", "v_msg"),
    "topic_shift": _q(f""", {_SAID}, w AS (SELECT session_id, idx, {_lines('content')} AS lines, list_distinct(regexp_extract_all(lower(COALESCE(content, '')), '[a-z0-9_]{{4,}}')) AS now FROM said), b AS (SELECT *, LAG(now) OVER (PARTITION BY session_id ORDER BY idx) AS before FROM w)
  SELECT session_id, idx, COALESCE((before IS NOT NULL AND len(list_filter(lines, lambda line: {_held('line', ['actually', 'instead', 'switching', 'different', 'new topic', 'moving on', 'let s talk about', 'forget about', 'never mind'])})) > 0)
    OR (len(now) > 0 AND len(before) > 0 AND len(list_intersect(now, before)) * 10 < len(now)), false) AS shift FROM b""", "v_msg"),
    "fact_scores_intent": _q(_ASKED + f""", last AS (SELECT * FROM asked QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx DESC) = 1), {_LAST_TURN},
  b AS (SELECT f.*, COALESCE(w_files + w_errors + w_decisions + w_architecture + w_state + w_tools + w_goals, 0.0e0) > 0 AS has, l.session_id IS NOT NULL AS asked,
    GREATEST(CASE fact_type WHEN 'file_state' THEN w_files WHEN 'error' THEN w_errors WHEN 'decision' THEN w_decisions WHEN 'state' THEN GREATEST(w_architecture, w_state) WHEN 'observation' THEN w_architecture WHEN 'tool_result' THEN w_tools WHEN 'goal' THEN GREATEST(w_state, w_goals) ELSE 0.0e0 END,
      CASE WHEN len(list_filter(refs, lambda r: contains(lower(f.content), lower(r)))) > 0 THEN 0.8e0 ELSE 0.0e0 END) AS boost FROM f LEFT JOIN last l ON f.session_id = l.session_id)
  SELECT session_id, fact_id, round(CASE WHEN has THEN boost * 0.3e0 + similarity * 0.25e0 + recency * 0.2e0 + worth * 0.25e0 WHEN asked AND embedding IS NOT NULL AND query IS NOT NULL THEN similarity * 0.4e0 + recency * 0.3e0 + worth * 0.3e0 ELSE score END, 9) AS score FROM b""", "v_msg", "v_score"),
    "fact_scores_embedding": _q(f", {_LAST_TURN} SELECT session_id, fact_id, round(CASE WHEN embedding IS NOT NULL AND query IS NOT NULL THEN similarity * 0.4e0 + recency * 0.3e0 + worth * 0.3e0 ELSE score END, 9) AS score FROM f", "v_score"),
    "read_arguments": _q("""SELECT session_id, idx, path, CAST(idx AS BIGINT) AS "offset", CASE WHEN tool = 'read' THEN NULL ELSE CAST(40 AS BIGINT) END AS "limit" FROM v_read""", "v_read"),
    "provenance_facts": _q("""SELECT session_id, idx AS turn, CASE tool WHEN 'read' THEN '[Read] ' || COALESCE(p, content) || ' read at turn ' || idx || ' (2 lines)' WHEN 'write' THEN '[Write] ' || COALESCE(p, 'unknown') || ' written at turn ' || idx ELSE '[Edit] ' || COALESCE(p, 'unknown') || ' edited at turn ' || idx END AS content,
  'file_state' AS fact_type, 1.0e0 AS confidence, CASE WHEN tool = 'read' THEN COALESCE(p, content) ELSE p END AS touched FROM (SELECT *, CASE WHEN idx % 4 > 0 THEN path END AS p FROM v_read)""", "v_read"),
    "full_writes": _q("""SELECT session_id, idx, 'c' || idx AS tool_call_id, 'src/' || session_id AS path, content FROM (SELECT * FROM v_msg WHERE role = 'assistant' QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx DESC) = 1) WHERE idx % 4 = 1 AND content <> ''""", "v_msg"),
    "written_paths": _q("""SELECT f.session_id, 'src/' || (f.session_id + f.last_updated_turn % 2) AS path FROM v_file f JOIN (SELECT * FROM v_msg WHERE role = 'assistant' QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx DESC) = 1) m ON f.session_id = m.session_id AND f.last_updated_turn % 2 = 0 WHERE idx % 4 = 1 AND m.content <> ''""", "v_file", "v_msg"),
    "resolved_sessions": _q("""SELECT request_id, session, rn = 1 AS created, CAST(SUM(CASE WHEN rn = 1 OR NOT recall_used THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY request_id) AS BIGINT) AS turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session ORDER BY request_id) AS rn FROM (
  SELECT event_id AS request_id, recall_used, CASE session_id % 3 WHEN 0 THEN 's' || session_id WHEN 1 THEN 'a' || session_id ELSE CASE WHEN failed THEN 'request-' || event_id ELSE 'f' || session_id END END AS session FROM v_trace))""", "v_trace"),
    "environment_fields": _q("""SELECT event_id, name, value FROM (SELECT event_id, unnest(['harness', 'working_directory', 'is_it_the_users', 'platform']) AS name, unnest(['Some Agent', '/work/' || session_id, CAST(failed AS VARCHAR), 'linux']) AS value FROM v_trace)""", "v_trace"),
    "imported_modules": r"""SELECT doc_id, m AS module, replace(m, '.', '/') || '.py,' || replace(m, '.', '/') || '/__init__.py' AS files FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all('import ' || source || '.x' || chr(10) || text || chr(10) || '  from ' || lang || ' import y', '(?m)^\s*(?:from|import)\s+([a-zA-Z_][\w.]*)', 1)) AS m FROM documents)""",
    "head_and_tail": r"""SELECT doc_id, CASE WHEN LENGTH(text) <= 300 THEN text ELSE h || chr(10) || '[...' || (LENGTH(text) - LENGTH(h) - LENGTH(t)) || ' chars compressed...]' || chr(10) || t END AS text
  FROM (SELECT doc_id, text, regexp_replace(SUBSTRING(text, 1, 200), ' [^ ]*\z', '') AS h, regexp_replace(SUBSTRING(text, LENGTH(text) - 99), '\A[^ ]* ', '') AS t FROM documents)""",
    "retrieval_ranking": _q(f", r AS ({_REL}), s AS (SELECT v_file.session_id, v_file.path, last_updated_turn, 1.0e0 + CASE WHEN last_updated_turn % 11 > 1 THEN (last_updated_turn % 11) / 10.0e0 ELSE CAST(last_updated_turn % 11 AS DOUBLE) END * 0.5e0 + relevance * 2 AS score FROM v_file JOIN (SELECT DISTINCT * FROM r) r ON v_file.session_id = r.session_id AND v_file.path = r.path)"
        " SELECT session_id, path, round(score, 9) AS score, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY score DESC, last_updated_turn) AS rank FROM s", "v_file"),
    "merged_files": _q("SELECT session_id, path, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY m) AS rank FROM (SELECT session_id, path, MIN(idx) AS m FROM v_read GROUP BY 1, 2)", "v_read"),
    "cache_costs": _q("SELECT CAST(SUM(savings_tokens) AS BIGINT) AS hits, CAST(SUM(input_tokens - savings_tokens) AS BIGINT) AS misses, round(SUM(savings_tokens) / CAST(SUM(input_tokens) AS DOUBLE), 9) AS hit_rate, round(SUM(savings_tokens) * 0.0028e0 / 1e6 + SUM(input_tokens - savings_tokens) * 0.14e0 / 1e6, 9) AS cost, round(SUM(input_tokens) * 0.14e0 / 1e6, 9) AS uncached_cost FROM v_trace", "v_trace"),
    "briefing_freshness": _q("SELECT session_id, turn_number, briefed, COALESCE(briefed >= turn_number - 1, false) AS fresh FROM (SELECT *, MAX(CASE WHEN assembly_mode = 'briefing' THEN turn_number END) OVER (PARTITION BY session_id ORDER BY turn_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS briefed FROM v_trace)", "v_trace"),
    "expired_cleanup": _q(", gone AS (SELECT session_id FROM v_trace GROUP BY 1 HAVING COUNT(*) FILTER (failed) > 10) SELECT session_id, 'traces' AS store, COUNT(*) AS rows FROM v_trace WHERE session_id IN (SELECT * FROM gone) GROUP BY 1 UNION ALL SELECT session_id, 'messages', COUNT(*) FROM v_msg WHERE session_id IN (SELECT * FROM gone) GROUP BY 1", "v_trace", "v_msg"),
    "noise_facts": _q(_NOISE + " SELECT * FROM noisy", "v_fact"),
    "audit_gates": _q(_TRUTH + _NOISE + """ SELECT round(parse_rate, 9) AS parse_rate, round(accuracy, 9) AS accuracy, round(noise_rate, 9) AS noise_rate, parse_rate >= 0.95 AND accuracy >= 0.8 AND noise_rate <= 0.1 AS passes
  FROM (SELECT AVG(CASE WHEN json_valid(props) THEN 1.0e0 ELSE 0.0e0 END) AS parse_rate FROM events), (SELECT AVG(CASE WHEN overlap >= 0.5 THEN 1.0e0 ELSE 0.0e0 END) AS accuracy FROM found), (SELECT AVG(CASE WHEN noise THEN 1.0e0 ELSE 0.0e0 END) AS noise_rate FROM noisy)""", "v_fact"),
    "session_summary": _q("""SELECT session_id, CAST(SUM(n) AS BIGINT) AS turns, CAST(SUM(i) AS BIGINT) AS input_tokens, CAST(SUM(s) AS BIGINT) AS savings_tokens, MIN(a) AS first_at, MAX(z) AS last_at, CAST(SUM(r) AS BIGINT) AS recalls, MAX(t) AS max_turn,
  string_agg(assembly_mode || ':' || n, ',' ORDER BY assembly_mode) AS modes, COALESCE(CAST(SUM(s) AS DOUBLE) / NULLIF(SUM(i), 0), 0) AS savings_ratio,
  COALESCE(CAST(SUM(s) FILTER (assembly_mode <> 'passthrough') AS DOUBLE) / NULLIF(SUM(i) FILTER (assembly_mode <> 'passthrough'), 0), 0) AS rewritten_ratio
  FROM (SELECT session_id, assembly_mode, COUNT(*) n, SUM(input_tokens) i, SUM(savings_tokens) s, MIN(created_at) a, MAX(created_at) z, COUNT(*) FILTER (recall_used) r, MAX(turn_number) t FROM v_trace GROUP BY 1, 2) GROUP BY 1""", "v_trace"),
    "global_metrics": _q("""SELECT COUNT(*) AS turns, COUNT(DISTINCT session_id) AS sessions, COUNT(*) FILTER (recall_used) / CAST(COUNT(*) AS DOUBLE) AS recall_rate, COUNT(*) FILTER (failed) / CAST(COUNT(*) AS DOUBLE) AS failure_rate,
  CAST(SUM(savings_tokens) AS DOUBLE) / SUM(input_tokens) AS savings_ratio, CAST(SUM(input_tokens) AS BIGINT) * 0.14e0 / 1e6 AS cost, CAST(SUM(savings_tokens) AS BIGINT) * 0.14e0 / 1e6 AS saved_cost, round(AVG(latency_ms) FILTER (assembly_mode = 'curator'), 6) AS curator_latency FROM v_trace""", "v_trace"),
    "mode_counts": _q("SELECT assembly_mode, COUNT(*) AS turns FROM v_trace WHERE assembly_mode IN ('curator','briefing','cold_start') GROUP BY 1", "v_trace"),
    "counters_and_gauges": _q("SELECT assembly_mode AS metric, CAST(SUM(input_tokens) AS BIGINT) AS counter, arg_max(input_tokens, event_id) AS gauge FROM v_trace GROUP BY 1", "v_trace"),
    "latency_nearest_rank": _q("""SELECT assembly_mode, COUNT(*) AS n, list_sort(list(latency_ms))[CAST(round_even((COUNT(*) - 1) * 0.5, 0) AS INT) + 1] AS p50, list_sort(list(latency_ms))[CAST(round_even((COUNT(*) - 1) * 0.95, 0) AS INT) + 1] AS p95,
  list_sort(list(latency_ms))[CAST(round_even((COUNT(*) - 1) * 0.99, 0) AS INT) + 1] AS p99 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY assembly_mode ORDER BY created_at DESC, event_id DESC) r FROM v_trace) WHERE r <= 1000 GROUP BY 1""", "v_trace"),
    "trace_cap": _q("SELECT session_id, turn_number, event_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY turn_number DESC) r FROM v_trace) WHERE r <= 50", "v_trace"),
    "lru_sessions": _q("SELECT session_id, MAX(created_at) AS last_active FROM v_trace GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1000", "v_trace"),
    "latency_deltas": _q("""SELECT session_id, turn_number, latency_ms, latency_ms - LAG(latency_ms) OVER w AS delta, CASE WHEN turn_number > 1 THEN round(AVG(latency_ms) OVER t, 6) END AS trailing_mean, CASE WHEN turn_number > 1 THEN round(latency_ms - AVG(latency_ms) OVER t, 6) END AS trailing_delta
  FROM v_trace WINDOW w AS (PARTITION BY session_id ORDER BY turn_number), t AS (PARTITION BY session_id ORDER BY turn_number ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", "v_trace"),
    "failure_streaks": _q("""SELECT session_id, MAX(run) AS longest, CAST(SUM(run) AS BIGINT) AS failures, MAX(run) >= 3 AS opened, SUM(run) >= 10 AS disabled FROM (SELECT session_id, g, COUNT(*) FILTER (failed) AS run
  FROM (SELECT *, SUM(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY turn_number) g FROM v_trace) GROUP BY 1, 2) GROUP BY 1""", "v_trace"),
    "output_collapse_runs": _q("""SELECT session_id, MIN(turn_number) AS from_turn, MAX(turn_number) AS to_turn, COUNT(*) AS run FROM (SELECT *, SUM(CASE WHEN latency_ms < 30 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY turn_number) g FROM v_trace)
  WHERE latency_ms < 30 GROUP BY session_id, g HAVING COUNT(*) >= 3""", "v_trace"),
    "folded_events": _q("""SELECT session_id, turn_number, assembly_mode, CAST(h - COALESCE(LAG(h) OVER (PARTITION BY session_id ORDER BY turn_number), 0) AS BIGINT) AS folded
  FROM (SELECT *, SUM(CASE WHEN assembly_mode IN ('passthrough','cold_start') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_number) h FROM v_trace) WHERE assembly_mode NOT IN ('passthrough','cold_start')""", "v_trace"),
    "session_ttl": _q("SELECT session_id, MAX(created_at) AS last_active FROM v_trace GROUP BY 1 HAVING TIMESTAMP '2024-02-01 00:00:00' - MAX(created_at) > INTERVAL 72 HOUR", "v_trace"),
    "running_token_budget": _q("""SELECT session_id, turn_number, CAST(SUM(input_tokens) OVER w AS BIGINT) AS running_tokens, SUM(input_tokens) OVER w > 100000 AS exceeded FROM v_trace WINDOW w AS (PARTITION BY session_id ORDER BY turn_number)""", "v_trace"),
    "recall_events": _q("SELECT session_id, turn_number, created_at, input_tokens FROM v_trace WHERE recall_used", "v_trace"),
    "session_page": _q("SELECT session_id, turn_number, event_id FROM v_trace WHERE session_id = 7 ORDER BY turn_number LIMIT 20 OFFSET 10", "v_trace"),
    "rewrite_gate": _q("""SELECT session_id, turn_number, CASE WHEN turn_number <= 2 THEN 'cold_start' WHEN input_tokens < 2000 THEN 'low_tokens' WHEN COALESCE(savings_tokens / CAST(NULLIF(input_tokens, 0) AS DOUBLE), 0) < 0.1 THEN 'low_savings' ELSE 'graph' END AS gate FROM v_trace""", "v_trace"),
    "turn_reconciliation": _q("""SELECT session_id, g AS graph_turn, t AS trace_turn, CASE WHEN g = 0 AND t > 0 THEN 'orphan' WHEN t > g + 1 THEN 'mismatch' ELSE 'ok' END AS state, GREATEST(g, t) AS turn FROM (SELECT COALESCE(a.session_id, b.session_id) AS session_id, COALESCE(g, 0) AS g, COALESCE(t, 0) AS t
  FROM (SELECT session_id, MAX(source_turn) g FROM v_fact GROUP BY 1) a FULL JOIN (SELECT session_id, MAX(turn_number) t FROM v_trace GROUP BY 1) b ON a.session_id = b.session_id)""", "v_fact", "v_trace"),
    "token_savings": _q("""SELECT session_id, turn_number, input_tokens - s AS sent_tokens, s AS saved_tokens, COALESCE(s / CAST(NULLIF(input_tokens, 0) AS DOUBLE), 0) AS ratio FROM (SELECT *, GREATEST(0, LEAST(savings_tokens, input_tokens)) AS s FROM v_trace)""", "v_trace"),
    "windowed_modes": _q("SELECT date_trunc('day', created_at) AS start, assembly_mode, COUNT(*) AS turns, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens, COUNT(*) FILTER (failed) AS failures FROM v_trace GROUP BY 1, 2", "v_trace"),
    "read_redundancy": _q(f"""SELECT session_id, COUNT(*) AS reads, CAST(SUM(tokens) AS BIGINT) AS tokens, {', '.join(f"COUNT(*) FILTER (bucket='{b}') AS {b}_reads, CAST(COALESCE(SUM(tokens) FILTER (bucket='{b}'), 0) AS BIGINT) AS {b}_tokens, COALESCE(SUM(tokens) FILTER (bucket='{b}'), 0) / CAST(SUM(tokens) AS DOUBLE) AS {b}_ratio" for b in ('exact_dup', 'superseded', 'live'))}
  FROM ({_CLASS}) GROUP BY 1""", "v_read"),
    "repeated_reads": _q("""SELECT session_id, content, times, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY times DESC, content) AS rank FROM (SELECT session_id, content, COUNT(*) AS times FROM
  (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx DESC) b FROM v_read) WHERE b <= 20 AND tool = 'read' GROUP BY 1, 2 HAVING COUNT(*) >= 2)) WHERE rank <= 3""", "v_read"),
    "repeat_flags": _q("SELECT session_id, idx, tool, path, ROW_NUMBER() OVER (PARTITION BY session_id, tool, path ORDER BY idx) > 1 AS repeat FROM v_read", "v_read"),
    "stuck_loops": _q("""SELECT session_id, idx, tool FROM (SELECT *, SUM(CASE WHEN CAST(SUBSTRING(content, 6, 9) AS INT) % 2 = 0 THEN 1 ELSE 0 END) OVER w AS bad, MIN(tool) OVER w AS lo, MAX(tool) OVER w AS hi FROM v_read
  WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)) WHERE bad = 2 AND lo = hi""", "v_read"),
    "tool_call_join": _q("""SELECT a.session_id, 'c' || a.idx AS call_id, a.tool, a.path, b.content FROM v_read a JOIN v_read b ON a.session_id = b.session_id AND a.idx = b.idx WHERE b.tool <> 'write'""", "v_read"),
    "tool_families": _q("SELECT tool, COUNT(*) AS calls, CASE tool WHEN 'read' THEN 'read' WHEN 'bash' THEN 'shell' ELSE 'default' END AS extractor FROM v_read GROUP BY 1", "v_read"),
    "turn_segmentation": _q("SELECT session_id, idx, role, turn FROM v_turn", "v_turn"),
    "turn_inventory": _q("""SELECT session_id, turn, SUBSTRING(arg_min(content, idx) FILTER (role='user'), 1, 80) AS user_preview, SUBSTRING(arg_min(content, idx) FILTER (role='assistant'), 1, 60) AS assistant_preview, COUNT(*) AS messages FROM v_turn WHERE turn > 0 GROUP BY 1, 2""", "v_turn"),
    "turn_boundaries": _q("SELECT session_id, idx, role='user' AS boundary, arg_max(role, idx) OVER (PARTITION BY session_id) = 'user' AS open FROM v_msg", "v_msg"),
    "coherence_tail": _q("SELECT session_id, idx, role, content FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY idx DESC) r FROM v_msg) WHERE r <= 3", "v_msg"),
    "last_exchanges": _q("""SELECT session_id, idx, role, content FROM (SELECT *, SUM(CASE WHEN role='user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY idx DESC) - CASE WHEN role='user' THEN 1 ELSE 0 END AS b FROM v_msg) WHERE b < 2""", "v_msg"),
    "merged_roles": _q(""", n AS (SELECT *, CASE WHEN role = LAG(role) OVER (PARTITION BY session_id ORDER BY idx) THEN 0 ELSE 1 END AS f FROM (SELECT session_id, idx, CASE WHEN idx % 3 = 1 THEN 'user' ELSE role END AS role, content FROM v_msg)), g AS (SELECT *, SUM(f) OVER (PARTITION BY session_id ORDER BY idx) AS i FROM n)
  SELECT session_id, MIN(idx) AS idx, MIN(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY idx) AS content, COUNT(*) AS merged FROM g GROUP BY session_id, i""", "v_msg"),
    "session_fingerprint": _q(r"""SELECT session_id, SUBSTRING(sha256(SUBSTRING(regexp_replace(regexp_replace(regexp_replace(regexp_replace(COALESCE(arg_min(content, idx) FILTER (role='system'), ''), '\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?Z?)?', '<date>', 'g'), '(?im)^(?:today|current date|current time|git status|recent commits).*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$', '', 'g'), 1, 4000) || chr(10) || COALESCE(arg_min(content, idx) FILTER (role='user'), '')), 1, 16) AS fingerprint FROM v_msg GROUP BY 1""", "v_msg"),
    "message_fingerprint": _q("SELECT session_id, idx, md5(role || ':' || SUBSTRING(COALESCE(content, ''), 1, 200)) AS fingerprint FROM v_msg", "v_msg"),
    "token_accounting": _q(f"""SELECT session_id, n AS messages, GREATEST(CAST(FLOOR(s * 1.1e0) AS BIGINT), 500) AS content_tokens, CAST(s + 6 * n AS BIGINT) AS structural_tokens
  FROM (SELECT session_id, SUM(GREATEST(CAST(FLOOR({est('content')} * 1.1e0) AS BIGINT), 1)) AS s, COUNT(*) AS n FROM v_msg GROUP BY 1)""", "v_msg"),
    "request_prefixes": _q("""SELECT session_id, idx, messages, chars, last_role FROM (SELECT session_id, idx, role, COUNT(*) OVER w AS messages, CAST(SUM(LENGTH(content)) OVER w AS BIGINT) AS chars, LAG(role) OVER (PARTITION BY session_id ORDER BY idx) AS last_role FROM v_msg
  WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role = 'assistant' AND last_role IN ('user', 'tool')""", "v_msg"),
    "selected_turns": _q("""SELECT session_id, idx, turn FROM (SELECT *, MAX(idx) OVER (PARTITION BY session_id) AS z FROM v_turn) WHERE session_id % 3 = 0 OR (session_id % 3 = 1 AND turn = 1) OR idx > z - 2 OR role = 'system'""", "v_turn"),
    "intent_class": _q(f""", u AS (SELECT session_id, idx, {_QUESTION} AS intent FROM (SELECT *, {_lines('content')} AS lines FROM v_msg WHERE role = 'user'))
  SELECT session_id, idx, intent, COALESCE(intent <> LAG(intent) OVER (PARTITION BY session_id ORDER BY idx), false) AS shift FROM u""", "v_msg"),
    "message_preview": _q("""SELECT session_id, idx, CASE WHEN LENGTH(content) <= 100 THEN content ELSE cut || chr(10) || '... [' || (LENGTH(content) - LENGTH(cut)) || ' chars omitted]' END AS preview FROM (SELECT *, CASE WHEN last > 50 THEN SUBSTRING(content, 1, last - 1) ELSE SUBSTRING(content, 1, 100) END AS cut
  FROM (SELECT *, CASE WHEN strpos(reverse(SUBSTRING(content, 1, 100)), chr(10)) > 0 THEN LENGTH(SUBSTRING(content, 1, 100)) - strpos(reverse(SUBSTRING(content, 1, 100)), chr(10)) + 1 ELSE 0 END AS last FROM v_msg))""", "v_msg"),
    "result_tail": _q("""SELECT session_id, idx, role, SUBSTRING(content, 1, CAST(600 - used AS BIGINT)) AS content FROM (SELECT *, COALESCE(SUM(LENGTH(COALESCE(content, ''))) OVER (PARTITION BY session_id ORDER BY idx DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM v_msg) WHERE used < 600""", "v_msg"),
    "active_facts": _q("SELECT session_id, fact_id, source_turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY source_turn DESC, fact_id DESC) r FROM v_fact WHERE NOT invalidated) WHERE r <= 5", "v_fact"),
    "facts_filtered": _q("SELECT session_id, fact_id, fact_type, confidence FROM v_fact WHERE fact_type IN ('error','decision') AND confidence >= 0.4e0 AND source_turn BETWEEN 2 AND 15 AND NOT invalidated", "v_fact"),
    "fact_counts": _q("SELECT session_id, COUNT(*) AS facts, COUNT(*) FILTER (NOT invalidated) AS active, COUNT(*) FILTER (invalidated) AS closed FROM v_fact GROUP BY 1", "v_fact"),
    "fact_types": _q("SELECT fact_type, COUNT(*) AS facts, round(AVG(confidence), 9) AS confidence FROM v_fact GROUP BY 1", "v_fact"),
    "keyword_search": _q("SELECT session_id, fact_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY source_turn DESC, fact_id DESC) r FROM v_fact WHERE NOT invalidated AND contains(lower(content), 'the')) WHERE r <= 3", "v_fact"),
    "supersession_chains": _q("""SELECT s.session_id, new_id, old_id, n.fact_type AS new_type, n.source_turn AS new_turn, o.fact_type AS old_type, o.source_turn AS old_turn FROM v_supersedes s JOIN v_fact n ON n.fact_id = new_id JOIN v_fact o ON o.fact_id = old_id""", "v_supersedes"),
    "exact_dedup": _q(f"SELECT session_id, SUBSTRING(sha256({norm('content')}), 1, 32) AS content_hash, MIN(fact_id) AS fact_id, COUNT(*) AS copies FROM v_fact GROUP BY 1, 2", "v_fact"),
    "known_content": _q(f""", h AS (SELECT *, {norm('content')} AS c FROM v_again) SELECT session_id, MIN(fact_id) AS fact_id FROM h WHERE fact_id >= 1000000000 AND NOT EXISTS (SELECT 1 FROM h o WHERE o.fact_id < 1000000000 AND o.source_turn <= 10 AND o.session_id = h.session_id AND o.c = h.c) GROUP BY session_id, c""", "v_again"),
    "best_match_invalidation": _q(f""", d AS (SELECT session_id, fact_id AS id, {toks("'The ' || content")} AS t FROM v_fact WHERE NOT invalidated UNION ALL SELECT item_id % 50, item_id + 1000000000, {toks('text')} FROM benchmark), f AS (SELECT session_id, fact_id, {toks('content')} AS t FROM v_fact WHERE NOT invalidated),
  p AS (SELECT d.session_id, d.id, f.fact_id, CASE WHEN len(d.t) = 0 OR len(f.t) = 0 THEN 0.0e0 ELSE len(list_intersect(d.t, f.t)) / CAST(len(list_distinct(list_concat(d.t, f.t))) AS DOUBLE) END AS similarity FROM d JOIN f ON d.session_id = f.session_id)
  SELECT session_id, id AS description_id, fact_id, similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, id ORDER BY similarity DESC, fact_id) r FROM p WHERE similarity >= 0.6e0) WHERE r = 1""", "v_fact"),
    "near_dup_pairs": _q(f""", f AS (SELECT session_id, fact_id, {toks('content')} AS t FROM v_again), w AS (SELECT session_id, fact_id, len(t) AS n, unnest(t) AS word FROM f), c AS (SELECT a.session_id, a.fact_id AS a, b.fact_id AS b, COUNT(*) AS k, ANY_VALUE(a.n) AS na, ANY_VALUE(b.n) AS nb FROM w a JOIN w b ON a.session_id = b.session_id AND a.word = b.word AND a.fact_id < b.fact_id GROUP BY 1, 2, 3)
  SELECT session_id, a, b, k / CAST(na + nb - k AS DOUBLE) AS similarity FROM c WHERE k / CAST(na + nb - k AS DOUBLE) > 0.85e0""", "v_again"),
    "context_window": _q("""SELECT session_id, fact_id, source_turn FROM v_fact f WHERE fact_type <> 'decision' AND EXISTS (SELECT 1 FROM v_fact s WHERE s.fact_type = 'decision' AND s.session_id = f.session_id AND ABS(s.source_turn - f.source_turn) <= 1)""", "v_fact"),
    "fact_scores": _q("SELECT session_id, fact_id, round(score, 9) AS score FROM v_score", "v_score"),
    "budget_prefix": _q("""SELECT session_id, fact_id, round(score, 9) AS score, CAST(used AS BIGINT) AS used FROM (SELECT *, SUM(tokens) OVER (PARTITION BY session_id ORDER BY score DESC, fact_id ROWS UNBOUNDED PRECEDING) AS used
  FROM v_score WHERE NOT invalidated) WHERE used <= 3000""", "v_score"),
    "promotable_facts": _q("""SELECT session_id, fact_id, SUBSTRING(sha256(session_id || ':' || fact_type || ':' || content), 1, 32) AS dedupe_key FROM v_fact WHERE fact_type IN ('decision','goal','error') AND confidence >= 0.9e0 AND NOT invalidated""", "v_fact"),
    "invalidated_facts": _q("SELECT session_id, fact_id, invalidated OR fact_type = 'error' AS invalidated FROM v_fact", "v_fact"),
    "latest_fact": _q("SELECT session_id, fact_type, fact_id, source_turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, fact_type ORDER BY source_turn DESC, fact_id DESC) r FROM v_fact) WHERE r = 1", "v_fact"),
    "file_lookup": _q(""", q AS (SELECT DISTINCT session_id, regexp_extract(path, '([^/]+)$', 1) AS query FROM v_file WHERE regexp_extract(path, '([^/]+)$', 1) <> '')
  SELECT session_id, query, path, candidates FROM (SELECT q.session_id, q.query, f.path, COUNT(*) OVER (PARTITION BY q.session_id, q.query) AS candidates, ROW_NUMBER() OVER (PARTITION BY q.session_id, q.query ORDER BY f.path <> q.query, LENGTH(f.path), f.path) r
  FROM q JOIN v_file f ON f.session_id = q.session_id AND (f.path = q.query OR ends_with(f.path, '/' || q.query))) WHERE r = 1""", "v_file"),
    "line_slice": _q("""SELECT session_id, path, len(l) AS line_count, GREATEST(0, LEAST(len(l), 5) - 1) AS lines, array_to_string(list_transform(range(2, LEAST(len(l), 5) + 1), lambda i: i || ': ' || l[i]), chr(10)) AS text FROM (SELECT *, string_split(COALESCE(content, ''), chr(10)) AS l FROM v_file)""", "v_file"),
    "file_eviction": _q("""SELECT session_id, path, last_updated_turn FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY last_updated_turn DESC, path) r FROM (SELECT *, MAX(last_updated_turn) OVER (PARTITION BY session_id) z FROM v_file) WHERE z - 100 <= 0 OR last_updated_turn >= z - 100) WHERE r <= 5""", "v_file"),
    "reference_extract": _q(r"""SELECT session_id, path, target FROM (SELECT DISTINCT session_id, path, regexp_replace(unnest(list_concat(list_concat(list_concat(regexp_extract_all(content, '(?:href|src)\s*=\s*["'']([^"'']+)["'']', 1), regexp_extract_all(content, '\bfrom\s+["'']([^"'']+)["'']', 1)), list_concat(regexp_extract_all(content, '\brequire\(\s*["'']([^"'']+)["'']', 1), regexp_extract_all(content, '\bimport\s+["'']([^"'']+)["'']', 1))),
  list_concat(regexp_extract_all(content, '@import\s+["'']([^"'']+)["'']', 1), regexp_extract_all(content, 'url\(\s*["'']?([^"'')]+)["'']?\s*\)', 1)))), '[?#].*$', '') AS target FROM v_file) WHERE target <> ''""", "v_file"),
    "in_degree": _q(_DEG_RANK, "v_edge"),
    "keyword_relevance": _q(_REL_RANK, "v_file"),
    "score_propagation": _q(f""", s AS ({_REL}) SELECT s.session_id, s.path, round(s.relevance + COALESCE(m, 0), 9) AS score FROM s LEFT JOIN (SELECT e.session_id, dst, SUM(relevance) AS m FROM v_edge e JOIN s ON s.session_id = e.session_id AND s.path = e.src GROUP BY 1, 2) x ON x.session_id = s.session_id AND x.dst = s.path""", "v_edge"),
    "combo_order": _q(f""", u AS (SELECT session_id, path, rank * 2 AS r FROM ({_REL_RANK}) UNION ALL SELECT session_id, path, rank * 2 + 1 FROM ({_DEG_RANK})) SELECT session_id, path, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY MIN(r), path) AS rank FROM u GROUP BY session_id, path""", "v_edge"),
    "recurring_patterns": _q(r""", p AS (SELECT session_id, path || CASE WHEN last_updated_turn % 2 = 0 THEN '.html' ELSE '.py' END AS path FROM v_file) SELECT session_id, pattern, COUNT(DISTINCT parent) AS parents, COUNT(*) AS files FROM (SELECT session_id, regexp_extract(path, '\.([A-Za-z0-9]+)$', 1) AS pattern, regexp_replace(path, '/[^/]*$', '') AS parent FROM p) GROUP BY 1, 2 HAVING COUNT(DISTINCT parent) >= 3""", "v_file"),
    "file_touches": _q(""", t AS (SELECT session_id, path, CASE tool WHEN 'write' THEN 'modified' WHEN 'read' THEN 'read' ELSE 'seen' END AS status, idx FROM v_read) SELECT session_id, path, arg_max(status, idx) AS status, MAX(idx) FILTER (status = 'read') AS last_read_turn, COALESCE(MAX(idx) FILTER (status = 'modified'), 0) AS last_modified_turn, COUNT(*) AS touches FROM t GROUP BY 1, 2""", "v_read"),
    "file_union": _q(""", s AS (SELECT session_id, path, last_updated_turn + 5 AS turn FROM v_file WHERE last_updated_turn % 3 = 0 UNION ALL SELECT session_id, path || '/new', last_updated_turn FROM v_file WHERE last_updated_turn % 3 = 1)
  SELECT COALESCE(f.session_id, s.session_id) AS session_id, COALESCE(f.path, s.path) AS path, GREATEST(f.last_updated_turn, s.turn) AS turn, f.path IS NOT NULL AS cached FROM v_file f FULL JOIN s ON f.session_id = s.session_id AND f.path = s.path""", "v_file"),
    "semantic_topk": """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT query_id, vec_id AS id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS similarity FROM embeddings, q)
  SELECT query_id, id, round(similarity, 9) AS similarity, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity > 0.05) WHERE rank <= 10""",
    "label_norms": "SELECT label, COUNT(*) AS vectors, round(AVG(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))), 9) AS mean_norm FROM embeddings GROUP BY 1",
    "probe_recall": "SELECT doc_id AS id, len(list_filter(['license','the','email','und'], lambda k: contains(lower(COALESCE(text, '')), k))) AS found, len(list_filter(['license','the','email','und'], lambda k: contains(lower(COALESCE(text, '')), k))) / 4.0e0 AS recall FROM documents",
    "edit_fidelity": "SELECT doc_id AS id, CASE WHEN contains(text, 'License') THEN 0.0e0 ELSE len(list_filter(['the','and'], lambda k: contains(text, k))) / 2.0e0 END AS fidelity FROM documents",
    "run_totals": _q("""SELECT assembly_mode AS arm, COUNT(*) AS turns, CAST(SUM(input_tokens) AS BIGINT) AS input, CAST(SUM(savings_tokens) AS BIGINT) AS saved, CAST(SUM(savings_tokens) AS DOUBLE) / SUM(input_tokens) AS savings_ratio, COUNT(*) FILTER (FLOOR(latency_ms) < 40) / CAST(COUNT(*) AS DOUBLE) AS collapse_rate FROM v_trace GROUP BY 1""", "v_trace"),
    "run_compare": """WITH a AS (SELECT l_suppkey, SUM(l_quantity) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey, SUM(l_quantity) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT COALESCE(a.l_suppkey, b.l_suppkey) AS l_suppkey, a, b, b - a AS change FROM a FULL JOIN b ON a.l_suppkey = b.l_suppkey""",
    "micro_averages": """SELECT 'file' AS level, SUM(l_quantity) / SUM(l_quantity + l_linenumber) AS coverage, SUM(l_quantity) / SUM(l_quantity + 1) AS precision FROM lineitem UNION ALL SELECT 'line', SUM(l_linenumber) / CAST(SUM(l_quantity) AS DOUBLE), SUM(l_linenumber) / CAST(SUM(l_linenumber + 2) AS DOUBLE) FROM lineitem""",
    "sweep_statistics": """SELECT o_orderpriority AS arm, COUNT(*) FILTER (o_orderstatus = 'F') AS complete, COUNT(*) FILTER (o_orderstatus <> 'F') AS failed, round(quantile_cont(o_totalprice, 0.5) FILTER (o_orderstatus = 'F'), 6) AS median, MAX(o_totalprice) FILTER (o_orderstatus = 'F') AS largest, round(AVG(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean FROM orders GROUP BY 1""",
    "truth_overlap": _q(_TRUTH + " SELECT turn, truth_id, overlap, overlap >= 0.5 AS matched FROM found", "v_fact"),
    "audit_gate": _q(_TRUTH + " SELECT COUNT(*) AS truths, COUNT(*) FILTER (overlap >= 0.5) AS matched, COUNT(*) FILTER (overlap >= 0.5) / CAST(COUNT(*) AS DOUBLE) AS accuracy, COUNT(*) FILTER (overlap >= 0.5) / CAST(COUNT(*) AS DOUBLE) >= 0.8 AS passes FROM found", "v_fact"),
    "calibration_gaps": _q("""SELECT category, COUNT(*) AS cases, round(AVG(gap) FILTER (gap <> 0), 6) AS mean_gap, CASE WHEN ABS(COALESCE(AVG(gap) FILTER (gap <> 0), 0)) <= 10 THEN 'keep' WHEN ABS(COALESCE(AVG(gap) FILTER (gap <> 0), 0)) <= 30 THEN 'adjust' ELSE 'recalibrate' END AS advice
  FROM (SELECT assembly_mode AS category, COALESCE(CAST(input_tokens - savings_tokens AS DOUBLE) * 100 / NULLIF(input_tokens, 0), 0) AS gap FROM v_trace) GROUP BY 1""", "v_trace"),
    "pii_redact": "SELECT doc_id, SUBSTRING(text, 1, 32) AS short, sha256(text) AS hash, CASE WHEN text IS NOT NULL THEN '[REDACTED]' END AS redacted FROM documents",
    "slugs": "SELECT page_id, regexp_replace(SUBSTRING(regexp_replace(regexp_replace(lower(COALESCE(url, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM pages",
    "event_json": "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS path FROM events",
    "sse_reassembly": "SELECT conv_id || ':' || turn AS response_id, text AS content, 'm1' AS model, 'stop' AS finish, CAST((LENGTH(text) - 1) // 40 + 1 AS BIGINT) AS chunks FROM conversations WHERE role = 'assistant' AND LENGTH(text) > 0",
}
ORACLES |= {
    "recent_sessions": "SELECT c_custkey AS session_id, c_acctbal AS updated, COALESCE(n, 0) AS messages FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey ORDER BY updated DESC, session_id LIMIT 50",
    "storage_summary": _q("SELECT session_id, 'facts' AS store, COUNT(*) AS rows FROM v_fact GROUP BY 1 UNION ALL SELECT session_id, 'files', COUNT(*) FROM v_file GROUP BY 1 UNION ALL SELECT session_id, 'messages', COUNT(*) FROM v_msg GROUP BY 1", "v_fact", "v_file", "v_msg"),
    "pruned_state": _q("SELECT session_id, turn_number FROM v_trace WHERE session_id IN (SELECT session_id FROM v_trace WHERE failed AND turn_number > 60)", "v_trace"),
    "find_or_create": _q(""", f AS (SELECT session_id, SUBSTRING(sha256(SUBSTRING(COALESCE(arg_min(content, idx) FILTER (role='system'), ''), 1, 4000) || chr(10) || COALESCE(arg_min(content, idx) FILTER (role='user'), '')), 1, 16) AS fingerprint FROM v_msg GROUP BY 1),
  k AS (SELECT fingerprint, CAST(MIN(session_id) AS VARCHAR) AS session_id FROM f WHERE session_id % 2 = 0 GROUP BY 1)
  SELECT fingerprint, session_id, false AS created FROM k UNION ALL SELECT DISTINCT fingerprint, SUBSTRING(sha256(fingerprint), 1, 16), true FROM f WHERE fingerprint NOT IN (SELECT fingerprint FROM k)""", "v_msg"),
    "plugin_metrics": _q("SELECT assembly_mode AS plugin, 'a.b' AS name, CAST(SUM(input_tokens) AS BIGINT) AS value FROM v_trace WHERE failed GROUP BY 1", "v_trace"),
    "embedding_cache": "SELECT o_orderkey AS key, o_totalprice AS at FROM orders WHERE 300000.0 - o_totalprice <= 100000.0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 128",
    "compressed_context": _q(f""", m AS (SELECT *, {est('content')} AS f, CASE WHEN role = 'system' THEN 0 ELSE {est('content')} - {est('SUBSTRING(content, 1, 40)')} END AS s FROM v_msg),
  c AS (SELECT *, SUM(f) OVER (PARTITION BY session_id) - 300 AS o, COALESCE(SUM(s) OVER (PARTITION BY session_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m)
  SELECT session_id, idx, b < o AND s > 0 AS cut, CASE WHEN b < o AND s > 0 THEN SUBSTRING(content, 1, 40) ELSE content END AS content FROM c""", "v_msg"),
    "promotion_stats": _q("""SELECT CASE WHEN k IS NULL THEN 'refused' WHEN r = 1 THEN 'promoted' ELSE 'duplicate' END AS outcome, COUNT(*) AS facts FROM (SELECT f.fact_id, k, r FROM v_fact f LEFT JOIN (SELECT fact_id, session_id || ':' || fact_type || ':' || content AS k,
  ROW_NUMBER() OVER (PARTITION BY session_id, fact_type, content ORDER BY fact_id) AS r FROM v_fact WHERE fact_type IN ('decision','goal','error') AND confidence >= 0.9e0 AND NOT invalidated) p ON p.fact_id = f.fact_id) GROUP BY 1""", "v_fact"),
    "extraction_dry_run": _q(f""", h AS (SELECT *, {norm('content')} AS c FROM v_again), a AS (SELECT session_id, COUNT(*) AS offered FROM h WHERE source_turn > 10 GROUP BY 1),
  b AS (SELECT session_id, COUNT(DISTINCT c) AS stored FROM h WHERE source_turn > 10 AND NOT EXISTS (SELECT 1 FROM h o WHERE o.fact_id < 1000000000 AND o.source_turn <= 10 AND o.session_id = h.session_id AND o.c = h.c) GROUP BY 1) SELECT a.session_id, offered, COALESCE(stored, 0) AS stored FROM a LEFT JOIN b ON a.session_id = b.session_id""", "v_again"),
    "file_checks": _q("""SELECT session_id, path, array_to_string(list_filter([CASE WHEN COALESCE(content, '') = '' THEN 'not_empty' END, CASE WHEN NOT contains(COALESCE(content, ''), '<h1') THEN 'contains' END, CASE WHEN len(string_split(COALESCE(content, ''), chr(10))) < 5 THEN 'min_lines' END], lambda x: x IS NOT NULL), ',') AS failed,
  COALESCE(content, '') <> '' AND contains(COALESCE(content, ''), '<h1') AND len(string_split(COALESCE(content, ''), chr(10))) >= 5 AS passes FROM v_file""", "v_file"),
    "work_summary": _q("""SELECT session_id, fact_type, fact_id, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, fact_type ORDER BY source_turn DESC, fact_id DESC) AS rank FROM v_fact WHERE NOT invalidated) WHERE rank <= CASE fact_type WHEN 'error' THEN 2 WHEN 'decision' THEN 1 WHEN 'state' THEN 1 WHEN 'goal' THEN 3 END""", "v_fact"),
    "consent_state": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'granted' WHEN 'O' THEN 'denied' ELSE 'unset' END AS consent, o_orderstatus = 'F' AS allowed FROM orders",
    "token_hints": "SELECT o_orderkey AS id, CASE WHEN FLOOR(o_totalprice / 1000) BETWEEN 100 AND 5000000 THEN CAST(FLOOR(o_totalprice / 1000) AS BIGINT) WHEN o_orderkey BETWEEN 100 AND 5000000 THEN o_orderkey END AS tokens FROM orders",
    "compression_priority": _q("""SELECT session_id, idx, role, CASE role WHEN 'system' THEN 1000.0e0 ELSE (2.0e0 - CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END) / 2.0e0 + 0.4e0 * COALESCE((ROW_NUMBER() OVER w - 1) / CAST(NULLIF(COUNT(*) OVER (PARTITION BY session_id) - 1, 0) AS DOUBLE), 0) END AS priority
  FROM v_msg WINDOW w AS (PARTITION BY session_id ORDER BY idx)""", "v_msg"),
    "session_windows": _q("""SELECT session_id, MIN(created_at) AS start, MAX(created_at) + INTERVAL 6 HOUR AS end, COUNT(*) AS events FROM (SELECT *, SUM(n) OVER (PARTITION BY session_id ORDER BY created_at, event_id) AS g FROM (SELECT *, CASE WHEN created_at - LAG(created_at) OVER (PARTITION BY session_id ORDER BY created_at, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM v_trace)) GROUP BY session_id, g""", "v_trace"),
    "first_seen_trail": _q("SELECT session_id, MIN(created_at) AS first_seen FROM v_trace GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 20", "v_trace"),
    "fact_supersession_edges": _q("SELECT n.session_id, n.fact_id AS new_id, o.fact_id AS old_id FROM v_fact n JOIN v_fact o ON n.session_id = o.session_id AND (n.source_turn - 1) // 10 = (o.source_turn - 1) // 10 WHERE NOT n.invalidated AND o.invalidated", "v_fact"),
    "resolved_references": _q(r"""SELECT DISTINCT session_id, src, dst FROM (SELECT e.session_id, e.src, f.path AS dst, ROW_NUMBER() OVER (PARTITION BY e.session_id, e.src, e.dst ORDER BY f.path <> e.dst, f.path) r
  FROM v_edge e JOIN v_file f ON f.session_id = e.session_id AND f.path <> e.src AND (f.path = e.dst OR regexp_extract(f.path, '([^/]+?)/?$', 1) = regexp_extract(e.dst, '([^/]+?)/?$', 1))) WHERE r = 1""", "v_edge"),
    "code_map": _q(f""", d AS ({_DEG_RANK}) SELECT b.session_id, foundations, COALESCE(n, 0) AS edges FROM (SELECT session_id, string_agg(path || ' (' || in_degree || ')', '; ' ORDER BY rank) AS foundations FROM d WHERE rank <= 8 GROUP BY 1) b
  LEFT JOIN (SELECT session_id, COUNT(*) AS n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, src ORDER BY dst) r FROM v_edge) WHERE r <= 6 GROUP BY 1) e ON b.session_id = e.session_id""", "v_edge"),
}
ORACLES |= {
    "code_fill": _q("""SELECT session_id, path, rank, cost > l AS cut, CASE WHEN cost > l THEN SUBSTRING(block, 1, CAST(l AS BIGINT)) ELSE block END AS block FROM (SELECT *, 20000 - COALESCE(SUM(cost) OVER (PARTITION BY session_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l
  FROM (SELECT session_id, path, last_updated_turn AS rank, '## ' || path || chr(10) || COALESCE(content, '') AS block, LENGTH('## ' || path || chr(10) || COALESCE(content, '')) + 1 AS cost FROM v_file)) WHERE cost <= l OR l > 200""", "v_file"),
    "current_turn": _q(""", b AS (SELECT session_id, MAX(idx) AS e, MAX(idx) FILTER (role = 'user') AS u FROM v_msg GROUP BY 1), p AS (SELECT b.session_id, e, u, MAX(idx) FILTER (role = 'user' AND idx < u) AS q FROM b JOIN v_msg m ON m.session_id = b.session_id GROUP BY 1, 2, 3)
  SELECT m.session_id, idx FROM v_msg m JOIN p ON p.session_id = m.session_id WHERE CASE WHEN u = e THEN idx > COALESCE(q, -1) AND idx < u ELSE idx > COALESCE(u, -1) END""", "v_msg"),
    "strongest_status": _q("SELECT session_id, path, arg_max(tool, CASE tool WHEN 'grep' THEN 1 WHEN 'bash' THEN 2 WHEN 'read' THEN 3 ELSE 4 END) AS status FROM v_read GROUP BY 1, 2", "v_read"),
    "resolved_issues": _q("""SELECT i.session_id, i.summary, i.turn, r.resolved_turn, r.resolved_turn IS NULL AS open FROM (SELECT session_id, content AS summary, source_turn AS turn FROM v_fact WHERE fact_type = 'error') i
  LEFT JOIN (SELECT session_id, content AS summary, MIN(source_turn) AS resolved_turn FROM v_again WHERE fact_type = 'error' GROUP BY 1, 2) r ON r.session_id = i.session_id AND r.summary = i.summary""", "v_again"),
    "prefix_splice": _q("SELECT session_id, CAST(2 AS BIGINT) AS count, session_id % 2 = 0 AS hit FROM v_msg WHERE idx = 1", "v_msg"),
    "search_hits": _q("""SELECT session_id, path, hits, array_to_string(list_transform(a[1:3], lambda x: CAST(x AS VARCHAR)), ',') AS lines FROM (SELECT *, len(a) AS hits, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY path) r
  FROM (SELECT session_id, path, list_filter(range(1, len(string_split(content, chr(10))) + 1), lambda i: contains(string_split(content, chr(10))[i], '<p')) AS a FROM v_file) WHERE len(a) > 0) WHERE r <= 6""", "v_file"),
    "cached_view": _q("""SELECT session_id, path, array_to_string(list_transform(range(1, CASE WHEN len(l) <= 8 THEN len(l) ELSE 2 END + 1), lambda i: i || ': ' || l[i]), chr(10)) || CASE WHEN len(l) <= 8 THEN '' ELSE chr(10) || '... ' || len(l) || ' lines' END AS view FROM (SELECT *, string_split(COALESCE(content, ''), chr(10)) AS l FROM v_file)""", "v_file"),
    "command_names": _q("SELECT event_id, CASE WHEN failed THEN 'cd' ELSE assembly_mode END AS command FROM v_trace", "v_trace").replace("THEN 'cd' ELSE", "THEN 'builtin' ELSE"),
    "tool_outcomes": _q("SELECT session_id, idx, tool IN ('read', 'grep', 'bash') AS compressible, CASE WHEN idx % 5 = 0 THEN 'error' WHEN idx % 7 = 0 THEN 'soft_error' ELSE 'ok' END AS outcome FROM v_read", "v_read"),
    "file_patterns": r"""SELECT page_id, '*' || upper(d[-1][1]) || d[-1][2:] || e AS pattern FROM (SELECT page_id, regexp_extract_all(regexp_replace(url, '^https?://|/.*$|[.]', ' ', 'g'), '[a-z]+') AS d, regexp_extract(url, '[.][a-z]+$', 0) AS e FROM pages)""",
}
ORACLES |= {
    "context_blocks": _q("""SELECT session_id, string_agg('=== ' || upper(fact_type) || ' ===' || chr(10) || content, chr(10) || chr(10) ORDER BY fact_id) AS block, COUNT(*) AS sections FROM v_fact WHERE NOT invalidated AND trim(content) <> '' GROUP BY 1""", "v_fact"),
    "task_map": _q(f""", k AS (SELECT *, MIN(CASE WHEN ends_with(path, '1') THEN rank END) OVER (PARTITION BY session_id) AS f FROM ({_REL_RANK}) WHERE rank <= 6)
  SELECT session_id, string_agg(rank || '. ' || path || CASE WHEN ends_with(path, '1') AND rank = f THEN ' [example]' ELSE '' END, chr(10) ORDER BY rank) AS map FROM k GROUP BY 1""", "v_file"),
    "session_overview": _q(""", a AS (SELECT session_id, string_agg(path, chr(10) ORDER BY path) AS files FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY path) r FROM v_file) WHERE r <= 5 GROUP BY 1),
  b AS (SELECT session_id, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY r) AS decisions FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY source_turn DESC, fact_id DESC) r FROM v_fact WHERE fact_type = 'decision') WHERE r <= 3 GROUP BY 1)
  SELECT COALESCE(a.session_id, b.session_id) AS session_id, COALESCE(files, '') AS files, COALESCE(decisions, '') AS decisions FROM a FULL JOIN b ON a.session_id = b.session_id""", "v_file", "v_fact"),
    "event_lines": _q("""SELECT session_id, turn_number, strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' #' || turn_number || ' ' || CASE WHEN failed THEN 'failed' WHEN recall_used THEN 'recalled' ELSE assembly_mode END || ' ' || input_tokens || ' tokens' AS line FROM v_trace""", "v_trace"),
    "front_matter": _q("""SELECT fact_id, '---' || chr(10) || 'type: ' || fact_type || chr(10) || 'session: "' || session_id || '"' || chr(10) || 'turn: ' || source_turn || chr(10) || '---' || chr(10) || content || chr(10) AS document FROM v_fact""", "v_fact"),
    "cut_blocks": """SELECT doc_id, CASE WHEN LENGTH(b) <= 60 THEN b WHEN (len(string_split(SUBSTRING(b, 1, 60), '```')) - 1) % 2 = 1 THEN SUBSTRING(b, 1, 60) || chr(10) || '```' ELSE SUBSTRING(b, 1, 60) END AS block FROM (SELECT doc_id, '```' || chr(10) || text || chr(10) || '```' AS b FROM documents)""",
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
