"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: As the operator's: a host's suffix and its registered domain.
TWO = "('ac.uk','co.in','co.jp','co.kr','co.nz','co.uk','co.za','com.ar','com.au','com.br','com.cn','com.mx','com.tr','com.tw','gov.uk','ne.jp','or.jp','org.au','org.uk')"


def _level(name: str, groups: str, mean: str) -> str:
    """Common table expressions of one pooling level: `groups` has n, good and `mean`."""
    return f"""
{name}_fit AS (SELECT LEAST(0.5, GREATEST(0.002, COALESCE(CASE WHEN SUM((n-1)*n*{mean}*(1-{mean}))>0 THEN SUM((good-n*{mean})*(good-n*{mean})-n*{mean}*(1-{mean}))/SUM((n-1)*n*{mean}*(1-{mean})) END, 0.002))) AS r FROM {groups}),
{name} AS (SELECT g.* EXCLUDE (m), (1.0/r-1) AS strength, (good+(1.0/r-1)*m)/(n+(1.0/r-1)) AS mean FROM (SELECT *, {mean} AS m FROM {groups}) g CROSS JOIN {name}_fit)"""


OP1 = rf"""
WITH u AS (SELECT page_id, url, translate(COALESCE(regexp_extract(url, '^(?:.*?)://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  COALESCE(regexp_extract(url, '^(?:.*?)://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
  TRY_CAST(regexp_extract(url, '://[^/?#]*/[^/?#]*/(\d+)', 1) AS BIGINT) AS doc FROM pages),
l AS (SELECT doc_id, MIN(CASE WHEN quality=1 AND toxic=0 THEN 1 ELSE 0 END) AS good FROM labels GROUP BY doc_id),
h0 AS (SELECT host, COUNT(good)::DOUBLE AS n, COALESCE(SUM(good),0)::DOUBLE AS good FROM u LEFT JOIN l ON u.doc=l.doc_id GROUP BY host),
h1 AS (SELECT *, string_split(host,'.') AS parts FROM h0),
h2 AS (SELECT *, array_to_string(parts[-2:],'.') AS last2, array_to_string(parts[-3:],'.') AS last3 FROM h1),
h AS (SELECT host, n, good, CASE WHEN last2 IN {TWO} THEN last3 ELSE last2 END AS domain, CASE WHEN last2 IN {TWO} THEN last2 ELSE parts[-1] END AS suffix FROM h2),
d AS (SELECT domain, suffix, SUM(n) AS n, SUM(good) AS good FROM h GROUP BY ALL),
x AS (SELECT suffix, SUM(n) AS n, SUM(good) AS good FROM d GROUP BY ALL),
w AS (SELECT (SUM(good)+1)/(SUM(n)+2) AS wm FROM x),
xw AS (SELECT * FROM x CROSS JOIN w), {_level('xs', 'xw', 'wm')},
dx AS (SELECT d.*, xs.mean AS wm FROM d JOIN xs USING (suffix)), {_level('ds', 'dx', 'wm')},
hd AS (SELECT h.*, ds.mean AS wm FROM h JOIN ds USING (domain)), {_level('hs', 'hd', 'wm')},
b AS (SELECT host, mean-1.645*sqrt(mean*(1-mean)/(n+strength+1)) AS bound FROM hs),
rules AS (SELECT * FROM (VALUES ('org','/','org/','allow'),('example.org','/es/','example.org/es/','block'),('example.org','/en/1','example.org/en/1','block'),('com','/fr/','com/fr/','allow'),('com','/de/','com/de/','block')) t(rh,rp,rule,verdict)),
hit AS (SELECT page_id, url, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN rules ON (host=rh OR ends_with(host,'.'||rh)) AND starts_with(path,rp) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, hit.rule, COALESCE(hit.verdict, CASE WHEN bound>=0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM u JOIN b USING (host) LEFT JOIN hit ON u.page_id IS NOT DISTINCT FROM hit.page_id AND u.url IS NOT DISTINCT FROM hit.url
"""


#: Kinds, patterns, group and least length as the operator has them; letters of either case are spelt out.
_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_RULES = [("assign", _ASSIGN, 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]{32,}", 0, 32), ("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), ("github", "gh[pousr]_[A-Za-z0-9]{20,}", 0, 1), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1), ("google", "AIza[0-9A-Za-z_-]{35}", 0, 1), ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1)]
_FOUND = " UNION ALL ".join(f"SELECT blob, {i} AS kind, '{k}' AS name, {n} AS least, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS gs, regexp_extract_all(text, '{p}', {g}) AS vs FROM blobs WHERE regexp_matches(text, '{p}')" for i, (k, p, g, n) in enumerate(_RULES))

OP2 = rf"""
WITH docs AS (SELECT doc_id, sha256(COALESCE(text,'')) AS blob, COALESCE(text,'') AS text FROM documents),
blobs AS (SELECT DISTINCT blob, text FROM docs),
found AS ({_FOUND}),
one AS (SELECT blob, kind, name, least, unnest(range(1, len(ms)+1)) AS i, ms, gs, vs FROM found),
len AS (SELECT blob, kind, name, least, i, length(ms[i]) AS n, length(gs[i]) AS gap, length(vs[i]) AS v FROM one),
pos AS (SELECT *, SUM(gap+n) OVER (PARTITION BY blob, kind ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM len),
span AS (SELECT blob, kind, name, (e-n)::BIGINT AS s, e::BIGINT AS e FROM pos WHERE v>=least),
per AS (SELECT blob, COUNT(*) FILTER (kind=0) AS a, COUNT(*) FILTER (kind=1) AS k, COUNT(*) FILTER (kind=2) AS x,
  COALESCE(string_agg(name||':'||s||':'||e, ',' ORDER BY s, kind) FILTER (kind<3), '') AS base, string_agg(name||':'||s||':'||e, ',' ORDER BY s, kind) AS spans FROM span GROUP BY blob)
SELECT doc_id, COALESCE(a,0) AS n_assign, COALESCE(k,0) AS n_access, COALESCE(x,0) AS n_hex, sha256(COALESCE(base,'')) AS base_sha256, COALESCE(spans,'') AS spans FROM docs LEFT JOIN per USING (blob)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x'||substr(md5('42:'||COALESCE(doc_id::VARCHAR,'null')),1,12))::BIGINT AS u FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, [5.0::DOUBLE,2.0,1.0][((ROW_NUMBER() OVER (ORDER BY source NULLS LAST)-1)%3+1)::INT] AS w, 2.0::DOUBLE*ss AS cap FROM s),
o AS (SELECT *, ROW_NUMBER() OVER (ORDER BY cap/w) AS j, COALESCE(SUM(cap) OVER (ORDER BY cap/w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS caps, SUM(w) OVER (ORDER BY cap/w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, (SELECT 1.5*SUM(ss)::DOUBLE FROM s) AS t FROM w),
lv AS (SELECT COALESCE((SELECT (t-caps)/ws FROM o WHERE (t-caps)/ws*w < cap ORDER BY j LIMIT 1), 1e300) AS level),
tg AS (SELECT source, ss, LEAST(level*w, cap) AS target FROM w CROSS JOIN lv),
p AS (SELECT *, CASE WHEN ss>0 THEN floor(target/ss) ELSE 0 END::BIGINT AS whole FROM tg),
q AS (SELECT *, round(target)::BIGINT-whole*ss AS need FROM p),
c AS (SELECT doc_id, source, size, COALESCE(SUM(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS below FROM d)
SELECT doc_id, size, ss AS source_size, target, (size*whole+LEAST(size, GREATEST(need-below,0)))::BIGINT AS taken FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
"""

ORACLES = {"op1_url_filters": OP1, "op2_secret_scans": OP2, "op10_source_mix": OP10}
