"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from satchel.llm import credentials

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def line_dedup() -> str:
    key = _LOWER.format(f"trim(line, {_SPACE})")
    return f"""
    WITH l AS (
      SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS ord
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
    k AS (SELECT *, {key} AS key FROM l),
    often AS (
      SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    d AS (SELECT k.*, often.key IS NOT NULL AND k.doc_id <> often.last AS gone FROM k LEFT JOIN often ON k.key = often.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM d GROUP BY doc_id"""


def near_dedup() -> str:
    return f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    s AS (
      SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
      FROM w WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
    FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id, n.n"""


def _escaped(text: str, role: bool = False) -> str:
    for old, new in (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"), ("</also>", "\\a"), *([(":", "\\c")] if role else [])):
        text = f"replace({text}, '{old}', '{new}')"
    return text


def chat_format() -> str:
    hard = "\\### Assistant: </turn> ok"
    return f"""
    WITH c AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{hard}'), (-7, 1, 'assistant', '{hard}'))),
    o AS (
      SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before FROM c
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      (8 + sum(length({_escaped("text")}) + CASE WHEN rn > 1 AND before = role THEN 7
        ELSE CASE WHEN rn > 1 THEN 8 ELSE 0 END + 6 + length({_escaped("role", True)}) END))::BIGINT AS formatted_chars
    FROM o GROUP BY conv_id"""


def _found(kind: int, pattern: str, group: int, good: str) -> str:
    rx = "'" + pattern.replace("'", "''") + "'"
    return f"""
    SELECT row, doc_id, source, {kind} AS rank, list_sum(list_transform(g[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, m[i] AS m, v[i] AS value
    FROM (
      SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT row, doc_id, source, regexp_extract_all(text, {rx}) AS m, regexp_extract_all(text, {rx}, {group}) AS v,
          string_split_regex(text, {rx}) AS g FROM d))
    WHERE {good}"""


def secret_scan() -> str:
    words = " AND ".join(f"regexp_matches(m[i], '{x}')" for x in credentials.WORD_NEEDS)
    kinds = "['" + "', '".join(credentials.KINDS) + "']"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
    base AS (
      {_found(0, credentials.ASSIGN, 2, "length(v[i]) >= 6")} UNION ALL
      {_found(1, credentials.ACCESS, 0, "length(m[i]) >= 20")} UNION ALL
      {_found(2, credentials.HEX, 0, "true")}),
    cand AS (
      SELECT DISTINCT row, doc_id, source, s, s + length(m) AS e, value FROM (
        SELECT * FROM base UNION ALL {_found(3, credentials.WORD, 0, words)})),
    owned AS (
      SELECT value, CASE WHEN regexp_matches(value, '{credentials.PLACEHOLDER}') OR count(DISTINCT coalesce(source, '')) >= {credentials.MANY_OWNERS} THEN 4
        WHEN count(DISTINCT coalesce(source, '')) = 1 THEN 3 ELSE 5 END AS rank
      FROM cand GROUP BY value),
    every AS (
      SELECT row, rank, s, s + length(m) AS e FROM base
      UNION ALL SELECT row, rank, s, e FROM cand JOIN owned USING (value)),
    listed AS (SELECT *, {kinds}[rank + 1] || ':' || s::BIGINT || ':' || e::BIGINT AS item FROM every)
    SELECT d.doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
      count(*) FILTER (WHERE rank = 2) AS n_hex,
      sha256(coalesce(string_agg(item, ',' ORDER BY s, rank, e) FILTER (WHERE rank < 3), '')) AS base_sha256,
      coalesce(string_agg(item, ',' ORDER BY s, rank, e), '') AS spans, count(*) FILTER (WHERE rank = 3) AS n_live,
      count(*) FILTER (WHERE rank = 4) AS n_example, count(*) FILTER (WHERE rank = 5) AS n_shared
    FROM d LEFT JOIN listed USING (row) GROUP BY d.row, d.doc_id"""


def warc() -> str:
    digit = ("substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha, (i // 4) * 5 + 1, 5))::BIGINT"
             " >> (15 - 5 * (i % 4))) & 31)::INT, 1)")
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    q AS (SELECT page_id, html, sha1(html) AS sha, max(page_id) OVER (PARTITION BY html) AS last FROM p)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
      CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> last THEN last END AS refers_to
    FROM q"""


def prefix_trie() -> str:
    # crc32 of a conversation's decimal id, bit by bit.
    step = "(CASE WHEN i % 8 = 0 THEN xor(a, ascii(substr(c, (i // 8 + 1)::INT, 1))::BIGINT) ELSE a END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * length(c))), lambda a, i: xor({step} // 2, ({step} % 2) * 3988292384)), 4294967295::BIGINT)"
    return f"""
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {crc} % 9 AS h FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS c FROM t)),
    r AS (
      SELECT c.conv_id, 0 AS part, t.pos, md5(length(t.role) || ':' || t.role || t.text) AS id, strlen(t.text) AS size
      FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
      UNION ALL
      SELECT c.conv_id, 1, t.pos, md5(length(t.role) || ':' || t.role || t.text), strlen(t.text)
      FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
    p AS (
      SELECT conv_id, string_agg(id, '') OVER w AS path, count(*) OVER w AS depth, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
      UNION ALL SELECT conv_id, '', 0, 0 FROM c),
    n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved FROM p GROUP BY path, depth),
    kids AS (SELECT path[:32 * (depth - 1)] AS path, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
    below AS (
      SELECT path[:32 * d] AS path, count(*) FILTER (WHERE k IS NULL) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT n.path, n.saved, kids.n AS k, unnest(range(n.depth + 1)) AS d FROM n LEFT JOIN kids USING (path)) GROUP BY 1),
    ends AS (
      SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
      FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, below.n_leaves,
      below.saved_tokens::BIGINT AS saved_tokens, coalesce(ends.ends_sha256, sha256('')) AS ends_sha256
    FROM n JOIN below USING (path) LEFT JOIN kids USING (path) LEFT JOIN ends USING (path)
      LEFT JOIN n up ON n.depth > 0 AND up.path = n.path[:32 * (n.depth - 1)]"""


def source_divergence() -> str:
    return """
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (
      SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
      FROM d),
    kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
    l AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON w.lang = kept.lang AND w.term = kept.term GROUP BY ALL),
    t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
    p AS (
      SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (kept.n_lang + 2)) // (l.total_lang + 2 * l.v)::HUGEINT AS q
      FROM g JOIN l ON l.lang = g.lang JOIN kept ON kept.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    sums AS (
      SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (
      SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    found AS (
      SELECT lang, source, 'pair' AS part, item, value FROM pairs
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""


def statements() -> dict[str, str]:
    return {
        "op4_near_dedup": near_dedup(),
        "op5_line_dedup": line_dedup(),
        "op7_chat_format": chat_format(),
        "op9_secret_scan": secret_scan(),
        "op10_warc": warc(),
        "op11_prefix_trie": prefix_trie(),
        "op13_source_divergence": source_divergence(),
    }
