"""SQL with the same results, for the queries that it can express; it runs on DuckDB over the same tables."""

from __future__ import annotations

from specloom.llm import rules

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_RUN = r"[^\x{0}-\x60\x7B-\x7F]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def divergence_rules_sql() -> str:
    languages = ", ".join(f"('{lang}', [{', '.join(f"'{w}'" for w in words)}])" for lang, words in rules.COMMON_WORDS.items())
    found = lambda pattern: f"length(text) - length(regexp_replace(text, '{pattern}', '', 'g'))"
    classes = {name: found(pattern.replace("\\x00", "\\x{0}").replace("'", "''")) for name, pattern in rules.CLASSES.items()}
    listed = ", ".join(classes.values())
    return f"""
        WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, regexp_extract_all({_LOWER.format('text')}, '{_RUN}') AS runs, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
        runs AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w) u),
        again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs),
        repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY doc_id),
        lists AS (SELECT * FROM (VALUES {languages}) AS v(lang, listed)),
        counted AS (
            SELECT w.*, [{listed}] AS classes, list_transform(listed, lambda y: len(list_filter(runs, lambda x: x = y))) AS common
            FROM w LEFT JOIN lists ON w.lang = lists.lang),
        whole AS (
            SELECT doc_id, lang, 'c' AS kind, list_append(classes, length(text) - list_sum(classes)) AS ns FROM counted WHERE common IS NOT NULL
            UNION ALL SELECT doc_id, lang, 'w' AS kind, list_append(common, len(runs) - list_sum(common)) AS ns FROM counted WHERE common IS NOT NULL),
        bins AS (SELECT doc_id, lang, kind, unnest(ns) AS n, unnest(range(len(ns))) AS bin FROM whole),
        shares AS (
            SELECT doc_id, kind, n / sum(n) OVER (PARTITION BY doc_id, kind) AS x, sum(n) OVER (PARTITION BY doc_id, kind) AS total,
                sum(n) OVER (PARTITION BY lang, kind, bin) / sum(n) OVER (PARTITION BY lang, kind) AS y FROM bins),
        told AS (
            SELECT doc_id, kind, round(sqrt(round(greatest(0e0, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2), 12)), 6) AS v
            FROM shares WHERE total > 0 GROUP BY doc_id, kind),
        base AS (
            SELECT c.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
                CAST({found(rules.CLASSES['symbol'])} AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(text) AS n_chars, a.v AS char_distance, b.v AS word_distance
            FROM counted c LEFT JOIN repeated r ON c.doc_id = r.doc_id
            LEFT JOIN told a ON c.doc_id = a.doc_id AND a.kind = 'c' LEFT JOIN told b ON c.doc_id = b.doc_id AND b.kind = 'w'),
        failed AS (SELECT *, n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > {rules.MAX_REPEAT} * n_words AS base_failed FROM base)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND NOT coalesce(n_chars >= {rules.LEAST_CHARS} AND char_distance > {rules.MAX_CHARS}, false)
                AND NOT coalesce(n_words >= {rules.LEAST_WORDS} AND word_distance * word_distance > {rules.MAX_WORDS**2!r} + {rules.WORDS_SLACK} / greatest(n_words, 1), false) AS kept,
            char_distance, word_distance FROM failed"""


JACCARD_JOIN_SQL = rf"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0) u),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id
    FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) m ON w.doc_id = m.a"""

TOOL_CALLS_SQL = """
        WITH RECURSIVE c AS (
            SELECT conv_id, turn, role, text, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
                role = 'user' AND contains(text, chr(10)) AS waits FROM conversations),
        results AS (SELECT conv_id, turn - 1 AS id FROM c WHERE kind = 'result'), calls AS (SELECT conv_id, turn AS id FROM c WHERE kind = 'call'),
        ways AS (
            SELECT conv_id, turn AS id, turn AS last, 0 AS links FROM c WHERE kind = 'call'
            UNION ALL SELECT w.conv_id, w.id, w.last + 2, w.links + 1 FROM ways w
            JOIN c ON w.conv_id = c.conv_id AND w.last = c.turn AND c.waits JOIN results r ON w.conv_id = r.conv_id AND w.last + 2 = r.id),
        longest AS (SELECT conv_id, id, max(last) AS last, max(links) AS links FROM ways GROUP BY conv_id, id),
        linked AS (
            SELECT c.*, r.id IS NOT NULL AS answered, k.id IS NOT NULL AS called, b.id IS NOT NULL AS ready, coalesce(l.links, 0) AS links, l.last
            FROM c LEFT JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.id
            LEFT JOIN calls k ON c.conv_id = k.conv_id AND c.turn - 1 = k.id LEFT JOIN results b ON c.conv_id = b.conv_id AND c.turn + 2 = b.id
            LEFT JOIN longest l ON c.conv_id = l.conv_id AND l.id = CASE c.kind WHEN 'call' THEN c.turn WHEN 'result' THEN c.turn - 1 END)
        SELECT conv_id, turn, kind, CAST(CASE kind WHEN 'call' THEN turn WHEN 'result' THEN turn - 1 END AS VARCHAR) AS call_id,
            CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'call' THEN CASE WHEN answered THEN 'linked' ELSE 'no_result' END
                WHEN called THEN 'linked' ELSE 'no_call' END AS status,
            CASE WHEN kind = 'call' THEN concat_ws(',', CASE WHEN length(text) > 400 THEN 'content: maxLength' END, CASE WHEN text = '' THEN 'content: minLength' END,
                CASE WHEN text IS NULL THEN 'content: required' END, CASE WHEN turn > 5 THEN 'turn: maximum' END,
                CASE WHEN waits AND NOT ready THEN 'after: ' || (turn + 2) END) ELSE '' END AS errors,
            CAST(CASE WHEN links > 0 THEN last + 1 ELSE turn END AS BIGINT) AS ready_turn,
            CAST(CASE WHEN links = 0 THEN 0 WHEN kind = 'call' THEN 2 * links - 1 ELSE 2 * links END AS BIGINT) AS depth,
            CASE kind WHEN 'call' THEN '{"arguments":{"content":' || to_json(text) || ',"turn":' || turn || '},"id":"' || turn || '","kind":"call","name":"reply","role":"user"}'
                WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":"' || (turn - 1) || '","kind":"result","role":"assistant"}'
                ELSE '{"content":' || to_json(text) || ',"kind":"message","role":"' || role || '"}' END AS json
        FROM linked"""
