"""DuckDB SQL for the operators that SQL can express."""

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT rid, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT rid, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o AS g FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g WHERE g IS NOT NULL) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS q FROM twice) GROUP BY rid),
f AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 10000 * n_symbols // greatest(word_chars, 1) AS symbols,
  10000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines, 10000 * n_repeat_words // greatest(n_words, 1) AS repeats, 100 * word_chars // greatest(n_words, 1) AS word_len FROM f),
v AS (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_len']) AS metric, unnest([symbols, dup_lines, repeats, word_len]) AS v FROM m WHERE NOT base_failed),
b AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bin, count(*) AS n FROM v GROUP BY ALL),
q2 AS (SELECT lang, source, metric, max(a) AS n, min(bin) FILTER (WHERE upto * 4 >= a) AS lo, min(bin) FILTER (WHERE upto * 4 >= 3 * a) AS hi FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS a FROM b) GROUP BY ALL),
q1 AS (SELECT lang, metric, max(a) AS n, min(bin) FILTER (WHERE upto * 4 >= a) AS lo, min(bin) FILTER (WHERE upto * 4 >= 3 * a) AS hi FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, metric) AS a FROM (SELECT lang, metric, bin, sum(n) AS n FROM b GROUP BY ALL)) GROUP BY ALL),
q0 AS (SELECT metric, max(a) AS n, min(bin) FILTER (WHERE upto * 4 >= a) AS lo, min(bin) FILTER (WHERE upto * 4 >= 3 * a) AS hi FROM
  (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY metric) AS a FROM (SELECT metric, bin, sum(n) AS n FROM b GROUP BY ALL)) GROUP BY ALL),
l AS (SELECT q2.lang, q2.source, q2.metric, CASE WHEN q2.n >= 100 THEN q2.lo WHEN q1.n >= 100 THEN q1.lo ELSE q0.lo END AS lo, CASE WHEN q2.n >= 100 THEN q2.hi WHEN q1.n >= 100 THEN q1.hi ELSE q0.hi END AS hi,
  CASE q2.metric WHEN 'symbols' THEN 400 WHEN 'dup_lines' THEN 4000 WHEN 'repeats' THEN 3000 ELSE 300 END AS slack
  FROM q2 JOIN q1 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.metric = q2.metric JOIN q0 ON q0.metric = q2.metric),
fence AS (SELECT lang, source, max(hi + far) FILTER (WHERE metric = 'symbols') AS ms, max(hi + far) FILTER (WHERE metric = 'dup_lines') AS md, max(hi + far) FILTER (WHERE metric = 'repeats') AS mr,
  max(hi + far) FILTER (WHERE metric = 'word_len') AS mw, max(lo - far) FILTER (WHERE metric = 'word_len') AS lw FROM (SELECT *, greatest(3 * (hi - lo), slack) AS far FROM l) GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(symbols <= ms AND dup_lines <= md AND repeats <= mr AND word_len <= mw AND word_len >= lw, true) AS kept
FROM m LEFT JOIN fence ON m.lang IS NOT DISTINCT FROM fence.lang AND m.source IS NOT DISTINCT FROM fence.source
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ())::HUGEINT - coalesce(sum(cap) OVER before, 0)::HUGEINT AS rest, (sum(w) OVER ())::HUGEINT - coalesce(sum(w) OVER before, 0)::HUGEINT AS shares
  FROM r WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT source, source_size, w, cap, w * rest > cap * shares AS clamped FROM o),
k AS (SELECT (sum(source_size) - coalesce(sum(cap) FILTER (WHERE clamped), 0))::DOUBLE AS rest, (sum(w) FILTER (WHERE NOT clamped))::DOUBLE AS shares FROM c),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE w::DOUBLE * rest / shares END AS target FROM c, k),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
z AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS quota FROM q),
u AS (SELECT d.*, z.source_size, z.target, z.whole, z.quota, sum(size) OVER (PARTITION BY d.source ORDER BY h) - sum(size) OVER (PARTITION BY d.source, h) AS before, sum(size) OVER (PARTITION BY d.source, h) AS n
  FROM d JOIN z ON d.source IS NOT DISTINCT FROM z.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN quota > 0 AND 2 * before + n <= 2 * quota THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""


def _urls() -> str:
    rule = "NULL"
    for verdict, host, path in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        rule = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{host}{path}' ELSE {rule} END"
    blocks = ", ".join(f"'{h}{p}'" for v, h, p in RULES if v == "block")
    out = rf"""
WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(regexp_replace(coalesce(rest, ''), '^[^/?#]*', ''), '^[^?#]*') AS path FROM a),
c AS (SELECT *, {rule} AS rule, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+([._-](?s:.*))?\z')
  OR (regexp_matches(s, '[0-9]') AND (regexp_matches(s, '^[0-9a-fA-F-]{{8,}}\z') OR length(s) >= 24)) THEN '*' ELSE s END) AS segs FROM b),
e AS (SELECT *, segs AS shape, CASE WHEN rule IS NULL THEN NULL WHEN rule IN ({blocks}) THEN 1 ELSE 0 END AS rb FROM c),
k AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
f AS (SELECT e.*, coalesce(rb, k.bad) AS bad FROM e LEFT JOIN k USING (page_id)),
t0 AS (SELECT host, shape, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, '' AS template FROM f GROUP BY host, shape)"""
    for d in range(1, 9):  # paths that are of unlike labels down to their eighth segment are told apart no further here
        out += f""",
c{d} AS (SELECT host, template, shape[{d}] AS seg, sum(labelled) AS cl, sum(bad) AS cb FROM t{d - 1} WHERE shape[{d}] IS NOT NULL GROUP BY ALL),
p{d} AS (SELECT host, template, sum(cl) AS pl, sum(cb)::DOUBLE / sum(cl) AS share FROM c{d} GROUP BY ALL),
n{d} AS (SELECT host, template, seg, CASE WHEN seg = '*' THEN '*' WHEN cl > 0 AND abs(cb::DOUBLE / cl - share) > 1.96 * sqrt(share * (1 - share) / cl) THEN seg ELSE '*' END AS name FROM c{d} JOIN p{d} USING (host, template)),
t{d} AS (SELECT t.host, t.shape, t.labelled, t.bad, CASE WHEN n.name IS NULL THEN t.template ELSE t.template || '/' || n.name END AS template FROM t{d - 1} t LEFT JOIN n{d} n ON t.host = n.host AND t.template = n.template AND t.shape[{d}] = n.seg)"""
    out += """,
t9 AS (SELECT host, shape, labelled, bad, template || repeat('/*', greatest(len(shape) - 8, 0)) AS template FROM t8),
g AS (SELECT sum(bad)::DOUBLE / nullif(sum(labelled), 0) AS base FROM t9),
h AS (SELECT host, (sum(bad) + 4 * coalesce(any_value(base), 0)) / (sum(labelled) + 4) AS hp FROM t9, g GROUP BY host),
j AS (SELECT host, template, (sum(bad) + 4 * any_value(hp)) / (sum(labelled) + 4) AS purity FROM t9 JOIN h USING (host) GROUP BY host, template)
SELECT f.page_id, f.host, f.path, f.rule, CASE WHEN rb = 1 THEN 'block' WHEN rb = 0 THEN 'allow' WHEN j.purity >= 0.8 THEN 'block' ELSE 'allow' END AS verdict, t9.template, round(j.purity, 6) AS purity
FROM f JOIN t9 ON f.host = t9.host AND f.shape = t9.shape JOIN j ON j.host = t9.host AND j.template = t9.template"""
    return out


ORACLES: dict[str, str] = {"op1_quality": QUALITY, "op7_mixing": MIXING, "op8_urls": _urls()}
