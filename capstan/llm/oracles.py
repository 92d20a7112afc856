"""SQL for the operators of this subpackage that SQL can express, for DuckDB over whole tables."""

from __future__ import annotations

from .conversations import DELETE, INSERT, REROLE, TRUNCATED
from .decontaminate import AGREE, LEAST_WORDS, WINDOW
from .jaccard import GRAM, PERCENT
from .resampling import SCALE
from .urls import DAMPING, MARGIN, PLACES, ROUNDS, RULES

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_AZ[0]}', '{_AZ[1]}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT doc_id, CASE WHEN len(ws) >= {GRAM} THEN list_distinct(list_transform(range(1, len(ws) - {GRAM - 2}), lambda i: array_to_string(ws[i:i + {GRAM - 1}], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, unnest(g) AS g FROM l),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN l a ON a.doc_id = x JOIN l b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (len(a.g) + len(b.g) - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM l UNION SELECT r.a, u.y FROM r JOIN u ON u.x = r.b)
SELECT doc_id, len(g) AS n_shingles, component_id FROM l JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) ON a = doc_id
"""

_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
dw AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d), iw AS (SELECT item_id, len(ws) AS m, unnest(ws) AS w, unnest(range(len(ws))) AS q FROM i WHERE len(ws) >= {LEAST_WORDS}),
h AS (SELECT doc_id, item_id, n, m, p - q AS g, q FROM dw JOIN iw USING (w)),
k AS (SELECT doc_id, item_id, g, any_value(n) AS n, any_value(m) AS m, list(q) AS qs FROM h GROUP BY doc_id, item_id, g HAVING count(*) >= {AGREE} * least(any_value(m), {WINDOW})),
t AS (SELECT doc_id, item_id, least(m, {WINDOW}) AS "window", qs, unnest(range(greatest(0, -g), least(m, n - g) - least(m, {WINDOW}) + 1)) AS s FROM k),
a AS (SELECT doc_id, item_id, "window", len(list_filter(qs, lambda q: q >= s AND q < s + "window")) AS agreeing FROM t)
SELECT doc_id, item_id, max(agreeing) AS agreeing, max("window") AS "window" FROM a WHERE agreeing >= {AGREE} * "window" - 1e-9 GROUP BY doc_id, item_id
"""


def _url_rules() -> str:
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        out = f"CASE WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}') THEN '{rule}' ELSE {out} END"
    return out


def _url_filters() -> str:
    verdict = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
    lower = f"'{_AZ[0]}', '{_AZ[1]}'"
    steps, last = [], "s"
    for k in range(1, ROUNDS + 1):
        steps.append(
            f"r{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT p.kind, p.dst AS host, x.score * p.share * {DAMPING} AS score FROM {last} x JOIN p ON p.kind = x.kind AND p.src = x.host "
            f"UNION ALL SELECT kind, host, score * {1 - DAMPING} FROM s) GROUP BY kind, host)"
        )
        last = f"r{k}"
    return rf"""
WITH u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {lower}) AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
v AS (SELECT *, {_url_rules()} AS rule FROM u), j AS (SELECT *, {verdict} AS verdict FROM v),
links AS (SELECT host AS src, translate(regexp_extract(l, '//([^/?#]*)', 1), {lower}) AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href[\x20\x09-\x0D]*=[\x20\x09-\x0D]*["'']?((?:https?:)?//[^"''\x20\x09-\x0D>]+)', 1)) AS l FROM u WHERE host <> '')),
e AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS links FROM links WHERE dst <> '' AND src <> dst GROUP BY src, dst),
b AS (SELECT 'trust' AS kind, src, dst, links FROM e UNION ALL SELECT 'distrust', dst, src, links FROM e),
p AS (SELECT kind, src, dst, links / sum(links) OVER (PARTITION BY kind, src) AS share FROM b),
s AS (SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) / sum(count(*)) OVER (PARTITION BY verdict) AS score FROM j WHERE verdict IS NOT NULL GROUP BY verdict, host),
{", ".join(steps)},
n AS (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM {last}),
f AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM n GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * (1 + {MARGIN}) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), {PLACES}) AS trust, round(coalesce(distrust, 0), {PLACES}) AS distrust
FROM j LEFT JOIN f ON j.host = f.host
"""


URL_FILTERS = _url_filters()


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, four bits at a time, the low ones of each byte first."""
    steps = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        steps.append(k)
    nibbles = f"list_transform(range(2 * octet_length(encode({text}))), lambda i: CAST(strpos('0123456789ABCDEF', substr(hex(encode({text})), CAST(xor(i, 1) AS BIGINT) + 1, 1)) - 1 AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {nibbles}), lambda c, n: xor(c >> 4, list_extract({steps}::BIGINT[], CAST(xor(c, n) & 15 AS BIGINT) + 1))), 4294967295::BIGINT)"


def _conversation_repair() -> str:
    plus = lambda state, cost, letter: f"printf('%08d', CAST(left({state}, 8) AS INTEGER) + {cost}) || substr({state}, 9) || {letter}"
    insert = lambda state: plus(state, INSERT, "'I'")

    def said(state: str, kind: str) -> str:
        return f"CASE WHEN fault NOT IN ('b', 'd') THEN {plus(state, f'CASE WHEN i = {kind!r} THEN extra ELSE extra + {REROLE} END', f'CASE WHEN i = {kind!r} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"

    def gone(state: str) -> str:
        return f"least({plus(state, DELETE, repr('D'))}, CASE WHEN fault NOT IN ('b', 'd') AND i = '' THEN {plus(state, 'extra', repr('K'))} END)"

    closed = lambda source: f"SELECT conv_id, pos, st, sy, us, least(an, {insert('us')}) AS an FROM (SELECT conv_id, pos, st, sy, least(us, {insert('st')}, {insert('sy')}, {insert('an')}) AS us, an FROM ({source}))"
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return rf"""
WITH RECURSIVE r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS damage FROM conversations),
t AS (SELECT conv_id, turn, CASE damage WHEN 4 THEN 'user' ELSE role END AS role, CASE damage WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE damage WHEN 3 THEN 2 ELSE 1 END)) AS k FROM r WHERE damage <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, k) AS nth, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM t),
g AS (SELECT conv_id, turn, role, text, left(role, 1) AS i, lag(left(role, 1)) OVER w AS before, row_number() OVER w AS pos, CASE WHEN last = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  CASE WHEN last <> '' AND nth = 1 AND last NOT IN ('.', '!', '?') THEN {TRUNCATED} ELSE 0 END AS extra FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth)),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS size FROM g GROUP BY conv_id),
v AS ({closed("SELECT conv_id, CAST(0 AS BIGINT) AS pos, '00000000' AS st, CAST(NULL AS VARCHAR) AS sy, CAST(NULL AS VARCHAR) AS us, CAST(NULL AS VARCHAR) AS an FROM c")} UNION ALL
{closed(f"SELECT g.conv_id, g.pos, {gone('st')} AS st, least({gone('sy')}, CASE WHEN fault NOT IN ('b', 'd') AND i = 's' THEN {plus('st', 'extra', repr('K'))} END) AS sy, least({gone('us')}, {said('least(st, sy, an)', 'u')}) AS us, least({gone('an')}, {said('us', 'a')}) AS an FROM v JOIN g ON g.conv_id IS NOT DISTINCT FROM v.conv_id AND g.pos = v.pos + 1")}),
b AS (SELECT c.*, least(st, an) AS best, substr(least(st, an), 9) AS audit FROM c JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.pos = c.size),
p AS (SELECT conv_id, unnest(list_concat(regexp_extract_all(audit, 'I*[DKR]'), [regexp_extract(audit, 'I*$')])) AS piece, unnest(range(1, size + 2)) AS pos FROM b),
q AS (SELECT p.conv_id, p.pos, g.role, g.text, len(replace(replace(replace(piece, 'D', ''), 'K', ''), 'R', '')) AS inserted, replace(piece, 'I', '') AS letter, coalesce(g.i, '') AS i FROM p LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.pos = p.pos),
o AS (SELECT *, coalesce(sum(inserted + CASE WHEN letter = 'R' OR letter = 'K' AND i IN ('u', 'a') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS said FROM q),
x AS (SELECT conv_id, pos, list_concat(list_transform(range(inserted), lambda k: CASE WHEN (said + k) % 2 = 0 THEN 'user:' ELSE 'assistant:' END), CASE letter WHEN 'K' THEN [role || ':' || text] WHEN 'R' THEN [CASE WHEN (said + inserted) % 2 = 0 THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END) AS lines FROM o),
y AS (SELECT conv_id, sha256(string_agg(array_to_string(lines, chr(10)), chr(10) ORDER BY pos)) AS sha FROM x WHERE len(lines) > 0 GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(CAST(left(best, 8) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN y ON y.conv_id IS NOT DISTINCT FROM e.conv_id
"""


def _importance_resampling(seed: int = 7, buckets: int = 10_000) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_AZ[0]}', '{_AZ[1]}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    features = lambda source: f"SELECT k, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM {source}"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, {words} AS ws FROM documents), b AS (SELECT item_id AS k, {words} AS ws FROM benchmark),
df AS ({features("d")}), bf AS ({features("b")}),
h AS (SELECT f, {_crc32("f")} % {buckets} AS bucket FROM (SELECT f FROM df UNION SELECT f FROM bf)),
s AS (SELECT bucket, count(*) AS s FROM df JOIN h USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
a AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM bf) AS t_all),
g AS (SELECT bucket, floor({SCALE} * ln(CAST((coalesce(t, 0) + 1) * (s_all + {buckets}) AS DOUBLE) / CAST((s + 1) * (t_all + {buckets}) AS DOUBLE))) AS gain FROM s LEFT JOIN t USING (bucket), a),
w AS (SELECT k, count(*) AS n_features, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM df JOIN h USING (f) JOIN g USING (bucket) GROUP BY k),
u AS (SELECT doc_id, d.k, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-{SCALE} * ln(-ln((CAST('0x' || left(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w ON w.k = d.k),
o AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM u WHERE able)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 25 * count(*) // 100 FROM o) THEN rank END AS rank FROM u LEFT JOIN o ON o.k = u.k
"""


CONVERSATION_REPAIR = _conversation_repair()
IMPORTANCE_RESAMPLING = _importance_resampling()

_SPACES = r"\x20\x09-\x0D"

QUALITY_BASE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{_SPACES}]+') AS ws FROM documents),
g AS (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS times FROM (SELECT k, unnest(range(1, len(ws) - 1)) AS p, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM d)),
r AS (SELECT k, count(DISTINCT q) AS n FROM (SELECT k, unnest([p, p + 1, p + 2]) AS q FROM g WHERE times > 1) GROUP BY k),
l AS (SELECT k, sum(n - 1) AS n FROM (SELECT k, line, count(*) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^{_SPACES}]') GROUP BY k, line) GROUP BY k)
SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(l.n, 0) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed FROM d LEFT JOIN r USING (k) LEFT JOIN l USING (k)
"""


def _spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    """k, rank, kind, start, end of the matches of ``pattern`` that ``keep``, an expression of hit and grp (its first group)."""
    p = "'" + pattern.replace("'", "''") + "'"
    upto = lambda n: f"coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:{n}], lambda h: length(h))), 0)"
    return f"""SELECT k, {rank} AS rank, '{kind}' AS kind, a AS start, a + length(hit) AS stop FROM (SELECT k, unnest(hits) AS hit, unnest(grps) AS grp, unnest(list_transform(range(1, len(hits) + 1), lambda i: CAST({upto("i - 1")} AS BIGINT))) AS a
    FROM (SELECT k, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, 1) AS grps, string_split_regex(t, {p}) AS gaps FROM d)) WHERE {keep}"""


def _base_spans(kinds: dict[str, tuple[str, str]], order: str) -> str:
    every = " UNION ALL ".join(_spans(k, i, p, keep) for i, (k, (p, keep)) in enumerate(kinds.items()))
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t FROM documents), s AS ({every})
    SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY {order}), '')) AS base_sha256 FROM d LEFT JOIN s USING (k) GROUP BY d.k, doc_id"""


SECRET_BASE = _base_spans(
    {"assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(grp) >= 6"), "access": ("(AKIA[A-Z0-9]+)", "length(hit) >= 20"), "hex": ("([0-9a-f]{24,})", "true")}, "start, rank"
)
_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS BIGINT) ELSE (CAST(reverse({_DIGITS})[i] AS BIGINT) * 2) // 10 + (CAST(reverse({_DIGITS})[i] AS BIGINT) * 2) % 10 END)) % 10 = 0"
PERSONAL_BASE = _base_spans(
    {
        "email": (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", "true"),
        "ip": (r"([0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+))", "len(list_filter(string_split(hit, '.'), lambda x: coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0"),
        "card": (r"([0-9](?:[\x20-]?[0-9])+)", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
        "phone": (r"(\+[0-9][\x20().0-9-]+[0-9])", f"length({_DIGITS}) BETWEEN 8 AND 15"),
    },
    "rank, start",
)
