"""DuckDB SQL for those corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from . import licences, quality, secrets

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def quality_sql(cfg: quality.QualityConfig = quality.QualityConfig()) -> str:
    boiler, closed = (_quoted(p).replace("\\b", "\\b") for p in (quality.BOILERPLATE, quality.CLOSED))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS ws FROM d),
ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
lw AS (SELECT id, k, line, {_WORDS.format('line')} AS ws FROM ln),
lr AS (SELECT id, k, line, len(ws) AS n,
    100 * len(list_filter(ws, lambda x: x IN ('|', '»', '«', '•', '·', '>', '<', '-', '–', '/', '::'))) > {cfg.max_separator_percent} * len(ws)
    OR 100 * (length(line) - length(translate(line, '#*$%&|<>', ''))) > {cfg.max_symbol_percent} * length(line)
    OR 100 * len(list_filter(ws, lambda x: regexp_matches(x, '[!?]{{2,}}$'))) > {cfg.max_shout_percent} * len(ws)
    OR (len(ws) <= {cfg.short_line_words} AND NOT regexp_matches(line, '{closed}'))
    OR (len(ws) <= 30 AND regexp_matches(line, '{boiler}')) AS bad
  FROM lw WHERE len(ws) > 0),
la AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (WHERE bad) AS n_lines_removed, coalesce(sum(n) FILTER (WHERE bad), 0) AS lost FROM lr GROUP BY id),
cl AS (SELECT id, string_agg(lw.line, chr(10) ORDER BY k) AS cleaned FROM lw LEFT JOIN lr USING (id, k) WHERE NOT coalesce(bad, FALSE) GROUP BY id),
p AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT id, i, word, lead(word, 1) OVER q AS b, lead(word, 2) OVER q AS c FROM p WINDOW q AS (PARTITION BY id ORDER BY i)),
g AS (SELECT id, i, count(*) OVER (PARTITION BY id, word, b, c) AS n FROM t WHERE c IS NOT NULL),
r AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM g, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY id),
a AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(la.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
    coalesce(la.n_lines, 0) AS n_lines, coalesce(la.n_lines_removed, 0) AS n_lines_removed, CAST(len(ws) - coalesce(la.lost, 0) AS BIGINT) AS kept_words, sha256(coalesce(cl.cleaned, '')) AS cleaned_sha256
  FROM w LEFT JOIN la USING (id) LEFT JOIN r USING (id) LEFT JOIN cl USING (id))
SELECT *, n_words < {cfg.min_words} OR 100 * n_repeat_words > {cfg.max_repeat_percent} * n_words AS base_failed,
  NOT (n_words < {cfg.min_words} OR 100 * n_repeat_words > {cfg.max_repeat_percent} * n_words) AND 100 * kept_words >= {cfg.min_kept_percent} * n_words AS kept FROM a"""


def _canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{licences.COPYRIGHT}', ' ', 'g')"
    for a, b in licences.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def licence_sql() -> str:
    texts = ", ".join(f"('{k}', '{terms}', '{_quoted(t)}')" for k, terms, t in licences.published())
    lines = ", ".join(f"('{k}', '{terms}', '{_quoted(t)}')" for k, (terms, ts) in licences.NOTICES.items() for t in ts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
kt(licence, terms, t) AS (VALUES {texts}), kl(licence, terms, t) AS (VALUES {lines}),
ct AS (SELECT DISTINCT licence, terms, {_canonical('t')} AS form FROM kt), cl AS (SELECT DISTINCT licence, terms, {_canonical('t')} AS form FROM kl),
wh AS (SELECT id, {_canonical('text')} AS form FROM d), ln AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d), lf AS (SELECT id, {_canonical('line')} AS form FROM ln),
w AS (SELECT id, licence, terms FROM wh JOIN ct USING (form)),
n AS (SELECT id, licence, terms FROM lf JOIN cl USING (form)),
a AS (SELECT id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n_notices FROM n GROUP BY id),
t AS (SELECT id, string_agg(DISTINCT terms, ',' ORDER BY terms) AS terms FROM (SELECT id, terms FROM w UNION ALL SELECT id, terms FROM n WHERE terms <> 'reserved' OR id NOT IN (SELECT id FROM w)) GROUP BY id)
SELECT doc_id, coalesce(w.licence, '') AS licence, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices, coalesce(t.terms, '') AS terms
FROM d LEFT JOIN w USING (id) LEFT JOIN a USING (id) LEFT JOIN t USING (id)"""


def jaccard_sql(k: int = 4, percent: int = 85) -> str:
    gram = " || chr(31) || ".join(f"ws[i + {j}]" for j in range(k))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(low)} AS ws FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, {gram} AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {k - 2})) AS i FROM w WHERE len(ws) >= {k})
  UNION ALL SELECT DISTINCT doc_id, len(ws) || chr(30) || array_to_string(ws, chr(31)) FROM w WHERE len(ws) BETWEEN 1 AND {k - 1}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(u) FROM r WHERE v = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)"""


def secrets_sql(cfg: secrets.SecretConfig = secrets.SecretConfig()) -> str:
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
    value = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(.*)$"""
    base = [("assign", 0, assign, f"length(regexp_extract(m, '^{_quoted(value)}', 1)) >= 12"), ("access", 1, "AKIA[A-Z0-9]{14,}", "TRUE"), ("hex", 2, "[0-9a-f]{16,}", "TRUE")]
    more = [(k, 3 + i, p.replace("\\b", "\\b"), "TRUE") for i, (k, p) in enumerate(secrets.MORE.items())]

    def found(kind: str, rank: int, pattern: str, ok: str) -> str:
        p = _quoted(pattern)
        return rf"""SELECT id, owner, repo, '{kind}' AS kind, {rank} AS rank, m, s, s + length(m) AS e FROM (
  SELECT id, owner, repo, m, CAST(sum(length(g)) OVER q + coalesce(sum(length(m)) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM (
    SELECT id, owner, repo, unnest(regexp_extract_all(text, '{p}')) AS m, unnest(list_slice(string_split_regex(text, '{p}'), 1, len(regexp_extract_all(text, '{p}')))) AS g,
      unnest(range(len(regexp_extract_all(text, '{p}')))) AS k FROM d WHERE regexp_matches(text, '{p}')) WINDOW q AS (PARTITION BY id ORDER BY k)) WHERE {ok}"""

    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, coalesce(source, '') || chr(31) || coalesce(lang, '') AS repo FROM documents),
b AS ({' UNION ALL '.join(found(*x) for x in base)}),
x AS ({' UNION ALL '.join(found(*x) for x in more)}),
c AS (SELECT *, TRUE AS base FROM b UNION ALL SELECT *, FALSE FROM x WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = x.id AND b.s <= x.s AND x.e <= b.e)),
v AS (SELECT *, CASE WHEN kind = 'assign' THEN regexp_extract(m, '^{_quoted(value)}', 1) ELSE m END AS val FROM c),
o AS (SELECT val, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM v GROUP BY val),
j AS (SELECT v.*, CASE WHEN owners > {cfg.max_owners} OR repos > {cfg.max_repositories} THEN 'example' WHEN len(list_distinct(string_split(val, ''))) >= {cfg.min_distinct} THEN 'live' ELSE 'weak' END AS verdict FROM v JOIN o USING (val)),
a AS (SELECT id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE base OR verdict = 'live'), '') AS spans,
  count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example, count(*) FILTER (WHERE verdict = 'weak') AS n_weak FROM j GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(n_weak, 0) AS n_weak FROM d LEFT JOIN a USING (id)"""


INFILL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j FROM e),
p AS (SELECT *, array_to_string(u[1:i], '') AS a, array_to_string(u[i + 1:j], '') AS m, array_to_string(u[j + 1:], '') AS z FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END AS output FROM p),
r AS (SELECT *, regexp_split_to_array(output, '<[PSM]>') AS x FROM o)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(a) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256 FROM r"""


def windows_sql(k: int) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT id, doc_id, unnest(generate_series(1, len(ws) - {k - 1})) AS i, ws FROM d WHERE len(ws) >= {k}),
g AS (SELECT id, doc_id, i, sha256(array_to_string(ws[i:i + {k - 1}], ' ')) AS h FROM w),
m AS (SELECT h, min(doc_id) AS least FROM g GROUP BY h),
c AS (SELECT DISTINCT id, i + s AS i FROM g JOIN m USING (h), (SELECT unnest(generate_series(0, {k - 1})) AS s) WHERE least < doc_id),
x AS (SELECT id, count(*) AS n FROM c GROUP BY id),
p AS (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
t AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS kept FROM p ANTI JOIN c USING (id, i) GROUP BY id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN x USING (id) LEFT JOIN t USING (id)"""
