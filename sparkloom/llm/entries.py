"""Queries and SQL of the corpus operators, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable

from . import chat_format, embedding_dedup, jaccard_join, langid, license_scan, line_dedup, merkle, mixing, nearest, packing, quality, spelling, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_packing": packing.op2_packing,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_warc": warc.op4_warc,
        "op5_nearest": nearest.op5_nearest,
        "op6_mixing": mixing.op6_mixing,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
        "op9_langid": langid.op9_langid,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_quality_rules": quality.op11_quality_rules,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


OP4_SQL = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages),
f AS (SELECT *, MIN(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS hex FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS BIGINT) // [32768, 1024, 32, 1][i % 4 + 1]) % 32 + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM f
"""


def _escaped(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for x in chat_format.CONTROL:
        c = f"replace({c}, '{x}', '{x[0]}\\{x[1:]}')"
    return c


OP7_SQL = f"""
WITH m AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(SUM(LENGTH(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(SUM(LENGTH({_escaped("role")}) + LENGTH({_escaped("text")}) + CASE WHEN role = 'assistant' THEN 8 ELSE 23 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

#: All pairs: for the small tables that SQL is run on.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT vec_id, COALESCE(n, 0) AS n_links, LEAST(vec_id, COALESCE(m, vec_id)) AS component_id, vec_id <= COALESCE(m, vec_id) AS kept
FROM embeddings LEFT JOIN (SELECT a, COUNT(*) AS n FROM l GROUP BY 1) USING (vec_id) LEFT JOIN (SELECT a, MIN(b) AS m FROM r GROUP BY 1) q ON q.a = vec_id
""".replace("USING (vec_id)", "d ON d.a = vec_id")

OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, COUNT(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS k FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, LEAST(d.doc_id, COALESCE(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, MIN(b) AS m FROM r GROUP BY 1) q ON q.a = d.doc_id
"""


#: The table of crc32 by its rule, as crc.t.
CRC_SQL = """crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """crc32 of a text's UTF-8, with the table crc at hand."""
    bytes_ = f"list_transform(range(0, octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: xor(c >> 8, crc.t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS BIGINT))"


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
o AS (SELECT doc_id, run, COUNT(*) AS n FROM r WHERE length(run) >= {spelling.LETTERS} GROUP BY 1, 2),
h AS (SELECT run, n, {_crc("COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM o, crc),
w AS (SELECT CASE WHEN h % {spelling.LOSS} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM w WHERE length(word) >= {spelling.LETTERS} GROUP BY 1 HAVING SUM(n) >= {spelling.OCCURRENCES}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) t(i)),
p AS (
  SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
b AS (SELECT word, COUNT(*) AS n_near, MAX(m) AS m FROM p GROUP BY 1),
s AS (SELECT p.word, MIN(p.near) AS near FROM p JOIN b ON p.word = b.word AND p.m = b.m GROUP BY 1),
f AS (SELECT v.word, v.n, COALESCE(b.n_near, 0) AS n_near, CASE WHEN b.m >= {spelling.TIMES} * v.n THEN s.near END AS form, CASE WHEN b.m >= {spelling.TIMES} * v.n THEN b.m END AS form_n
  FROM v LEFT JOIN b ON b.word = v.word LEFT JOIN s ON s.word = v.word),
g AS (SELECT word, word AS at, form AS onto FROM f UNION ALL SELECT g.word, f.word, f.form FROM g JOIN f ON g.onto = f.word)
SELECT f.word, f.form, g.at AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word AND g.onto IS NULL
"""


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c})) || ':' || {c} END"


_REST = " || ".join(_field(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang"))
_LEVEL = "SELECT {tree}, lv + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {level} WHERE n > 1 GROUP BY {tree}, lv, idx // 2, n"
OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
a AS (SELECT doc_id, lang, sha256({_REST} || {_field("CAST(n_chars AS VARCHAR)")} || {_field("text")}) AS leaf,
  CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % {merkle.SEVENTH} = 0 THEN sha256({_REST} || {_field("CAST(n_chars + 1 AS VARCHAR)")} || {_field("text")}) END AS tampered FROM documents, crc),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, COUNT(*) OVER (PARTITION BY lang) AS n FROM a),
t(lang, lv, idx, n, h) AS (SELECT lang, 0, idx, n, leaf FROM l UNION ALL {_LEVEL.format(tree="lang", level="t")}),
q AS (SELECT lang, lv AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, COUNT(*) OVER () AS n FROM t WHERE n = 1),
u(lv, idx, n, h) AS (SELECT 0, idx, n, subroot FROM q UNION ALL {_LEVEL.format(tree="", level="u").replace("SELECT ,", "SELECT").replace("GROUP BY ,", "GROUP BY")}),
lp AS (SELECT l.lang, l.idx, list(CASE WHEN s.h IS NULL THEN '' WHEN (l.idx >> k.lv) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY k.lv) AS path
  FROM l JOIN q ON q.lang IS NOT DISTINCT FROM l.lang JOIN (SELECT DISTINCT lang, lv FROM t) k ON k.lang IS NOT DISTINCT FROM l.lang AND k.lv < q.height
  LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM l.lang AND s.lv = k.lv AND s.idx = xor(l.idx >> k.lv, 1) GROUP BY 1, 2),
qp AS (SELECT q.idx, list(CASE WHEN s.h IS NULL THEN '' WHEN (q.idx >> k.lv) & 1 = 1 THEN 'L' || s.h ELSE 'R' || s.h END ORDER BY k.lv) AS path
  FROM q JOIN (SELECT DISTINCT lv FROM u WHERE n > 1) k ON true LEFT JOIN u s ON s.lv = k.lv AND s.idx = xor(q.idx >> k.lv, 1) GROUP BY 1),
w AS (SELECT l.doc_id, l.leaf, q.subroot, (SELECT h FROM u WHERE n = 1) AS root, COALESCE(l.tampered, l.leaf) AS start, list_concat(COALESCE(lp.path, []), COALESCE(qp.path, [])) AS path
  FROM l JOIN q ON q.lang IS NOT DISTINCT FROM l.lang LEFT JOIN lp ON lp.lang IS NOT DISTINCT FROM l.lang AND lp.idx = l.idx LEFT JOIN qp ON qp.idx = q.idx),
f AS (SELECT *, list_reduce(list_prepend(start, path), lambda x, y: CASE WHEN y = '' THEN sha256(x) WHEN y[1] = 'L' THEN sha256(substr(y, 2) || x) ELSE sha256(x || substr(y, 2)) END) AS folded_root FROM w)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda y: substr(y, 2)), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op7_chat_format": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op10_jaccard_join": OP10_SQL, "op12_spelling_variants": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
