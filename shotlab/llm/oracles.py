"""DuckDB SQL for the queries that SQL can express, written apart from the Spark code."""

from __future__ import annotations

import math
import re

from shotlab.llm.quality import CLASSES, COMMON, Limits
from shotlab.llm.secrets import ACCESS, HEX, WINDOW, Entropy

_HOST = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

URL_FILTER = f"""
WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') END AS canon FROM p),
l AS (SELECT DISTINCT canon FROM c WHERE canon IS NOT NULL AND regexp_matches(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '(^|&)ref=')),
r(rh, rp, rv) AS (VALUES {", ".join(str(x) for x in _RULES)}),
best AS (SELECT page_id, c.host, c.path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS rv
         FROM (SELECT DISTINCT page_id, host, path FROM c) c JOIN r ON (c.host = rh OR ends_with(c.host, '.' || rh)) AND starts_with(c.path, rp) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.rv, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canon IS NOT NULL AS listed
FROM c LEFT JOIN l ON c.canon = l.canon LEFT JOIN best b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.host = b.host AND c.path = b.path
"""

_SPACE = r"[\x20\x09-\x0D]+"


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _quality() -> str:
    lim = Limits()
    counts = [f"length(regexp_replace(t, {_sql(c.replace(chr(92) + 'p', chr(92) + 'P') + '+' if c.startswith(chr(92) + 'p') else '[^' + c + ']+')}, '', 'g'))" for c in CLASSES.values()]
    words = " ".join(f"WHEN '{k}' THEN [{', '.join(_sql(w) for w in v)}]" for k, v in COMMON.items())
    js = lambda a, b: f"sqrt(greatest(0, round(list_sum([CASE WHEN u.x > 0 THEN u.x * log2(u.x / ((u.x + u.y) / 2)) ELSE 0 END + CASE WHEN u.y > 0 THEN u.y * log2(u.y / ((u.x + u.y) / 2)) ELSE 0 END FOR u IN [{{'x': {a}[i] / list_sum({a}), 'y': {b}[i] / list_sum({b})}} FOR i IN range(1, len({a}) + 1)]]) / 2, 12)))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({', '.join(_sql(k) for k in COMMON)}) THEN lang ELSE '*' END AS lang FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT rid, i, ws[i:i + 4] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
hit AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g) WHERE n >= 2),
rep AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM hit GROUP BY rid),
f AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
        [x::DOUBLE FOR x IN [{', '.join(counts)}]] AS c0, CASE lang {words} END AS cw FROM w),
bare AS (SELECT rid, list(regexp_replace(regexp_replace(lower(x), '^[\\p{{P}}\\p{{S}}]+', ''), '[\\p{{P}}\\p{{S}}]+$', '')) AS bs FROM (SELECT rid, unnest(ws) AS x FROM w) GROUP BY rid),
h AS (SELECT f.*, list_append(c0, length(t) - list_sum(c0)) AS hc, CASE WHEN cw IS NOT NULL THEN [len(list_filter(coalesce(bs, []), lambda y: y = x))::DOUBLE FOR x IN cw] END AS k0 FROM f LEFT JOIN bare USING (rid)),
h2 AS (SELECT *, CASE WHEN k0 IS NOT NULL THEN list_append(k0, len(ws) - list_sum(k0)) END AS hk FROM h),
rc AS (SELECT lang, list(v ORDER BY i) AS rc FROM (SELECT lang, i, sum(hc[i]) AS v FROM h2, range(1, {len(CLASSES) + 2}) r(i) GROUP BY lang, i) GROUP BY lang),
rk AS (SELECT lang, list(v ORDER BY i) AS rk FROM (SELECT lang, i, sum(hk[i]) AS v FROM h2, range(1, {len(COMMON['en']) + 2}) r(i) GROUP BY lang, i) GROUP BY lang),
a AS (SELECT h2.*, coalesce(rep.n, 0) AS nrep,
        CASE WHEN length(t) >= {lim.min_chars} THEN {js('hc', 'rc')} END AS cd,
        CASE WHEN len(ws) >= {lim.min_words} AND hk IS NOT NULL THEN {js('hk', 'rk')} END AS kd, least({lim.word_distance}, {lim.none_share} * nullif({js('nn', 'rk')}, 0)) AS kl
      FROM (SELECT *, list_append([0.0::DOUBLE FOR i IN range({len(COMMON['en'])})], 1.0::DOUBLE) AS nn FROM h2) h2 LEFT JOIN rep USING (rid) JOIN rc USING (lang) JOIN rk USING (lang)),
b AS (SELECT *, len(ws) < 10 OR 100 * nrep > 20 * len(ws) AS bad FROM a)
SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  nrep::BIGINT AS n_repeat_words, bad AS base_failed, NOT bad AND coalesce(cd, 0) <= {lim.char_distance} AND coalesce(kd, 0) <= coalesce(kl, {lim.word_distance}) AS kept
FROM b
"""


QUALITY = _quality()


def _secrets() -> str:
    e = Entropy()
    assign = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    allowed = " OR ".join(f"regexp_full_match(hit, {_sql(p)})" for p in e.allowed)
    known = _sql("|".join(re.escape(k) for k in e.known) or "[^\\x00-\\x{10FFFF}]")

    def kind(rank, name, pattern, group):
        p = _sql(pattern)
        return f"""SELECT rid, {rank} AS rank, '{name}' AS kind, unnest(regexp_extract_all(t, {p}, 0)) AS hit, unnest(regexp_extract_all(t, {p}, {group})) AS val,
            unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i, regexp_split_to_array(t, {p}) AS gaps, [length(x) FOR x IN regexp_extract_all(t, {p}, 0)] AS lens FROM d"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kind(0, 'assign', assign, 1)} UNION ALL {kind(1, 'access', ACCESS, 0)} UNION ALL {kind(2, 'hex', HEX, 0)} UNION ALL {kind(3, 'entropy', '[A-Za-z0-9+/_=-]{' + str(WINDOW) + ',}', 0)}),
s AS (SELECT rid, rank, kind, hit, val, CAST(list_sum([length(x) FOR x IN gaps[1:i]]) + coalesce(list_sum(lens[1:i - 1]), 0) AS BIGINT) AS b, length(hit) AS n FROM m),
base AS (SELECT rid, rank, kind, b, b + n AS e FROM s WHERE rank IN (1, 2) OR rank = 0 AND length(val) >= 6),
run AS (SELECT row_number() OVER () AS cid, rid, rank, kind, hit, b, b + n AS e FROM s WHERE rank = 3),
lit AS (SELECT cid, b, unnest(regexp_extract_all(hit, {known}, 0)) AS x, unnest(range(1, len(regexp_extract_all(hit, {known}, 0)) + 1)) AS i,
  regexp_split_to_array(hit, {known}) AS gaps, [length(y) FOR y IN regexp_extract_all(hit, {known}, 0)] AS lens FROM run),
cut AS (SELECT r.cid, x.b AS s, x.e AS t FROM run r JOIN base x ON x.rid = r.rid AND x.b < r.e AND r.b < x.e
  UNION ALL SELECT cid, p AS s, p + length(x) AS t FROM (SELECT *, CAST(b + list_sum([length(y) FOR y IN gaps[1:i]]) + coalesce(list_sum(lens[1:i - 1]), 0) AS BIGINT) AS p FROM lit)
  UNION ALL SELECT cid, e, e FROM run),
gap AS (SELECT cid, s, max(t) OVER (PARTITION BY cid ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM cut),
piece AS (SELECT r.rid, r.rank, r.kind, substring(r.hit, greatest(r.b, coalesce(f, r.b)) - r.b + 1, s - greatest(r.b, coalesce(f, r.b))) AS hit,
  greatest(r.b, coalesce(f, r.b)) AS b, s AS e FROM gap JOIN run r USING (cid) WHERE s - greatest(r.b, coalesce(f, r.b)) >= {WINDOW}),
cand AS (SELECT * FROM piece WHERE NOT ({allowed})),
win AS (SELECT rid, rank, kind, hit, b, e, unnest(range(1, length(hit) - {WINDOW - 2})) AS i FROM cand),
cnt AS (SELECT rid, rank, kind, hit, b, e, i, ch, count(*) AS n FROM (SELECT *, unnest(string_split(substring(hit, i, {WINDOW}), '')) AS ch FROM win) GROUP BY ALL),
ent AS (SELECT rid, rank, kind, hit, b, e, round(max(h), 9) AS h FROM (SELECT rid, rank, kind, hit, b, e, i, {math.log2(WINDOW)!r} - sum(n * log2(n)) / {WINDOW} AS h FROM cnt GROUP BY ALL) GROUP BY ALL),
more AS (SELECT rid, rank, kind, b, e FROM ent WHERE h >= CASE WHEN regexp_full_match(hit, '([0-9a-f]+|[0-9A-F]+)') THEN {e.hex} WHEN regexp_full_match(hit, '[A-Za-z0-9]+') THEN {e.alnum} ELSE {e.base64} END),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
agg AS (SELECT rid, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, count(*) FILTER (rank = 3) AS n3,
  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS bs, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS sp FROM every GROUP BY rid)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(sp, '') AS spans, coalesce(n3, 0) AS n_entropy
FROM d LEFT JOIN agg USING (rid)
"""


SECRETS = _secrets()


def _codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    def assign(book, name):
        return f"""{name}_d AS (SELECT v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS far FROM v JOIN {book} b ON b.part = v.part AND b.pos = v.pos GROUP BY ALL),
{name} AS (SELECT rid, part, arg_min(entry, (far, entry)) AS entry, min(far) AS far FROM {name}_d GROUP BY rid, part)"""

    steps = []
    for r in range(rounds):
        steps.append(assign(f"b{r}", f"a{r}"))
        steps.append(f"""m{r} AS (SELECT a.part, a.entry, v.pos, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid, part) GROUP BY ALL),
b{r + 1} AS (SELECT b.part, b.entry, b.pos, CASE WHEN m.n IS NULL THEN b.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x FROM b{r} b LEFT JOIN m{r} m USING (part, entry, pos))""")
    steps.append(assign(f"b{rounds}", "z"))
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding AS e, len(embedding) // {parts} AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT rid, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor(256 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT rid, e, w, unnest(range(1, len(e) + 1)) AS i FROM k)),
b0 AS (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= {entries}),
{("," + chr(10)).join(steps)},
c AS (SELECT rid, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM z GROUP BY rid),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN c USING (rid) CROSS JOIN h
"""


CODES = _codes()


DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 3),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT s.lang, s.source, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = s.lang AND t.source = s.source),
p AS (SELECT g.lang, g.source, k.term, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS BIGINT) AS p, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS BIGINT) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
    LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
