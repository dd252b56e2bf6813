"""Queries over package names made from part names: twins, affixes, edits, manifests and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import quoted
from ..functions.frames import plain, run
from ..operators import packages as pk

POPULAR = "SELECT ecosystem, name, CAST(row_number() OVER (PARTITION BY ecosystem ORDER BY k, name) AS INT) AS rank FROM (SELECT 'npm' AS ecosystem, replace(p_name, ' ', '-') AS name, min(p_partkey) AS k FROM {part} GROUP BY p_name UNION ALL SELECT 'pypi', replace(p_name, ' ', '-'), min(p_partkey) FROM {part} WHERE p_partkey % 3 <> 0 GROUP BY p_name UNION ALL SELECT 'npm', '@' || substr(p_name, 1, 3) || '/' || replace(p_name, ' ', '-'), min(p_partkey) + 500 FROM {part} WHERE p_partkey % 5 = 0 GROUP BY p_name)"
_N = "replace(p_name, ' ', '-')"
EDITS = [
    _N, "replace(p_name, ' ', '')", "replace(p_name, ' ', '_')", f"{_N} || '-js'", f"'node-' || {_N}", f"substr({_N}, 1, 3) || substr({_N}, 5)", f"replace({_N}, 'l', '1')", f"replace({_N}, 'o', '0')", f"{_N} || 'xy'", f"'é' || {_N}",
    f"substr({_N}, 1, 4)", f"'@' || substr(p_name, 1, 3) || '/x' || {_N}", f"'@zzz/' || {_N}", f"upper({_N})", f"{_N} || '.js'", f"reverse({_N})", f"substr({_N}, 2)", f"{_N} || 'python'",
]
NAMES = "SELECT p_partkey AS id, CASE p_partkey % 18 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(EDITS)) + " END AS name, CASE WHEN p_partkey % 4 = 0 THEN 'pypi' ELSE 'npm' END AS ecosystem FROM {part}"


def _names(spark, sf):
    return run(spark, sf, NAMES)


def _popular(spark, sf):
    return run(spark, sf, POPULAR)


def _open(spark, sf):
    p = _popular(spark, sf)
    return pk.gated(_names(spark, sf), p).where("gate is null"), p


def pep503(spark, sf):
    return _names(spark, sf).select("id", pk.canonical(F.col("name"), F.col("ecosystem")).alias("canon"), pk.collapse(F.col("name")).alias("collapsed"), pk.valid(F.col("name")).alias("valid"))


def ecosystem_alias(spark, sf):
    return run(spark, sf, "SELECT x FROM (VALUES ('NPM'), ('pip'), ('cargo'), ('gem'), ('golang'), ('nuget'), ('perl'), (CAST(NULL AS STRING))) AS t(x)").select(F.coalesce("x", F.lit("-")).alias("given"), pk.ecosystem(F.col("x")).alias("ecosystem"))


def pkg_gate(spark, sf):
    return pk.gated(_names(spark, sf), _popular(spark, sf)).select("id", "gate")


def pkg_nonascii(spark, sf):
    return _names(spark, sf).where(F.rlike("name", F.lit(r"[^\x00-\x7F]"))).select("id", "name")


def pkg_collapse_join(spark, sf):
    return pk.separator_twins(*_open(spark, sf))


def pkg_affix(spark, sf):
    return pk.affixed(*_open(spark, sf))


def pkg_near(spark, sf):
    return pk.nearest(*_open(spark, sf)).select("id", "target", "distance")


def pkg_confusable(spark, sf):
    return pk.nearest(*_open(spark, sf)).where("lookalike").select("id", "target")


def pkg_verdict(spark, sf):
    out = pk.inspect(_names(spark, sf), _popular(spark, sf), spark.sql(CACHE))
    return out.select("id", "verdict", F.array_join(F.transform("findings", lambda f: f["id"]), ",").alias("rules"))


def pkg_verdict_no_list(spark, sf):
    return pk.inspect(_names(spark, sf), None).groupBy("verdict").agg(F.count("*").alias("n"))


CACHE = "SELECT ecosystem, name, verdict FROM (VALUES ('npm', 'red-plate', 'danger'), ('npm', 'hot-gizmo', 'caution'), ('npm', 'old-rod', 'safe')) AS t(ecosystem, name, verdict)"


def typosquat_variants(spark, sf):
    names = run(spark, sf, f"SELECT DISTINCT name FROM ({POPULAR}) WHERE ecosystem = 'npm'")
    return names.select("name", F.posexplode(pk.typosquats(F.col("name"))).alias("pos", "variant"))


def typosquat_registered(spark, sf):
    """Variants that someone has registered: a semi-join with the registry's names."""
    found = typosquat_variants(spark, sf).where("pos < 20")
    known = run(spark, sf, f"SELECT DISTINCT name AS variant FROM ({NAMES})")
    return found.join(known, "variant", "left_semi").groupBy("name").agg(F.count("*").alias("registered"))


def did_you_mean(spark, sf):
    return pk.did_you_mean(_names(spark, sf), _popular(spark, sf).where("name not like '@%'"))


LISTED = f"SELECT ecosystem, name, rank % 2 = 0 AS whole FROM ({POPULAR}) WHERE rank % 5 = 0"
VERSIONED = f"SELECT id, name, ecosystem, '1.' || CAST(id % 4 AS STRING) || '.0' AS version FROM ({NAMES})"


def _listed(spark, sf):
    return run(spark, sf, LISTED).select("ecosystem", "name", F.when(~F.col("whole"), F.array(F.lit("1.0.0"), F.lit("1.2.0"))).alias("versions"))


def malicious_check(spark, sf):
    return pk.malicious(run(spark, sf, VERSIONED), _listed(spark, sf)).select("id", "list_verdict")


REGISTRY = f"SELECT ecosystem, name, id % 11 <> 0 AS exists, CASE WHEN id % 3 = 0 THEN id % 200 END AS age_days, CASE WHEN id % 2 = 0 THEN id % 120 END AS weekly_downloads, id % 13 = 0 AS deprecated, CASE WHEN id % 6 = 0 THEN 'x' END AS confusable FROM (SELECT ecosystem, name, min(id) AS id FROM ({NAMES}) WHERE id % 17 <> 3 GROUP BY ecosystem, name)"
OSV = f"SELECT ecosystem, name, CASE WHEN rank % 10 = 0 THEN 'MAL-2024-1' ELSE 'GHSA-x' END AS id, CAST(NULL AS STRING) AS introduced, CASE WHEN rank % 3 = 0 THEN '1.2' END AS fixed FROM ({POPULAR}) WHERE rank % 4 = 0 UNION ALL SELECT ecosystem, name, 'OSV-2', '1.1.0', CASE WHEN rank % 16 = 0 THEN '1.10' END FROM ({POPULAR}) WHERE rank % 8 = 0"
WANTED = f"SELECT id, name, CASE WHEN id % 9 = 0 THEN 'crates' ELSE ecosystem END AS ecosystem, CASE WHEN id % 5 > 0 THEN version END AS version FROM ({VERSIONED})"
FACTS = f"SELECT CASE WHEN k = 1 THEN 'crates' ELSE ecosystem END AS ecosystem, name, min(exists) AS exists, min(age_days) AS age_days, min(weekly_downloads) AS weekly_downloads, max(deprecated) AS deprecated, max(confusable) AS confusable FROM ({REGISTRY}) CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) GROUP BY 1, 2"


def _report(spark, sf, osv=True):
    return pk.verify(_names(spark, sf), run(spark, sf, REGISTRY), run(spark, sf, OSV) if osv else None)


def verify_package(spark, sf):
    """Versions, advisories that apply to them, the list of malicious packages, and ecosystems without a registry."""
    out = pk.verify(run(spark, sf, WANTED), run(spark, sf, FACTS), run(spark, sf, OSV), _listed(spark, sf))
    return out.select("id", "exists", "vulns", "malicious", "list_verdict", "limited", "verdict")


def check_vulns(spark, sf):
    out = pk.vulnerabilities(run(spark, sf, WANTED), run(spark, sf, OSV))
    return out.select("id", "count", "malicious", F.array_join(F.transform("advisories", lambda a: F.concat_ws("<", a["id"], a["fixed"])), ",").alias("advisories"))


GIVEN = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '{"dependencies": {"a": "^1.2.3", "shared": "1.0"}, "devDependencies": {"a": "2", "d' || CAST(p_partkey AS STRING) || '": ">=3"}}' WHEN 1 THEN '{"name": "x"}' WHEN 2 THEN '{broken' END AS manifest,
 CASE WHEN p_partkey % 3 > 0 THEN 'shared==9.' || CAST(p_partkey AS STRING) || chr(10) || '# no' || chr(10) || 'flask' END AS lines FROM {part}"""


def parse_deps(spark, sf):
    d = run(spark, sf, GIVEN).withColumn("given", F.create_map(F.lit("shared"), F.lit("0"), F.lit("given"), F.lit("7"))).withColumn("packages", F.when(F.col("id") % 5 > 0, F.array(F.lit(" flask "), F.lit(""), F.concat(F.lit("p"), F.col("id").cast("string")))))
    out = pk.merged_dependencies(d, "given", "manifest", "lines", "packages")
    return out.select("id", F.size("input_errors").alias("errors"), F.explode("dependencies").alias("x")).select("id", "errors", "x.name", "x.version")


def package_info(spark, sf):
    return pk.info(_names(spark, sf), run(spark, sf, REGISTRY)).select("id", "exists", "age_days", "weekly_downloads")


def slopsquat(spark, sf):
    return _report(spark, sf).groupBy("slopsquat").agg(F.count("*").alias("n"))


def audit_deps_report(spark, sf):
    """Without advisories: nothing is safe."""
    return _report(spark, sf, osv=False).select("id", "vulns", "verdict")


def audit_deps_summary(spark, sf):
    return pk.summary(_report(spark, sf))


VERSIONS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '^4.17.' || CAST(p_partkey AS STRING) WHEN 1 THEN '>=1.2 <2' WHEN 2 THEN 'latest' WHEN 3 THEN '~=0.10' WHEN 4 THEN '' ELSE 'v1.2.3.4' END AS version FROM {part}"


def clean_version(spark, sf):
    return run(spark, sf, VERSIONS).select("id", pk.clean_version(F.col("version")).alias("clean"))


def requirements_parse(spark, sf):
    lines = ["# comment", "requests==2.31.0", "  flask >= 2.0,<3", "-r other.txt", "numpy", "", "pkg[extra]==1.0", "a_b.c~=1.4.rc1"]
    text = F.concat_ws("\n", *(F.lit(x) for x in lines), F.concat(F.lit("part"), F.col("p_partkey").cast("string"), F.lit("==1."), (F.col("p_partkey") % 9).cast("string")))
    out = run(spark, sf, "SELECT p_partkey FROM {part}").select(F.col("p_partkey").alias("id"), F.explode(pk.requirements(text)).alias("r"))
    return out.select("id", "r.name", "r.version")


TOKENS = "SELECT p_partkey AS id, CASE p_partkey % 16 WHEN 0 THEN 'express@4.' || CAST(p_partkey AS STRING) WHEN 1 THEN '@babel/core@7' WHEN 2 THEN '@babel/core' WHEN 3 THEN 'requests[socks]==2.31.0' WHEN 4 THEN 'flask>=2,<3' WHEN 5 THEN './local' WHEN 6 THEN 'git+https://x/y' WHEN 7 THEN 'owner/repo' WHEN 8 THEN '*' WHEN 9 THEN '-g' WHEN 10 THEN 'C:/x' WHEN 11 THEN '..' WHEN 12 THEN 'left-pad' WHEN 13 THEN 'x@' WHEN 14 THEN '~/p' ELSE 'npm:a@1' END AS token FROM {part}"


def npm_spec(spark, sf):
    return run(spark, sf, TOKENS).select("id", pk.npm_spec(F.col("token")).alias("s")).select("id", "s.name", "s.version")


def pip_spec(spark, sf):
    return run(spark, sf, TOKENS).select("id", pk.pip_spec(F.col("token")).alias("s")).select("id", "s.name", "s.version")


def not_package_reason(spark, sf):
    return run(spark, sf, TOKENS).select("id", "token", pk.not_package(F.col("token")).alias("reason"))


_s = lambda sql: plain(sql).replace("AS STRING", "AS VARCHAR").replace("min(exists)", "bool_and(exists)").replace("max(deprecated)", "bool_or(deprecated)")
_canon = "CASE WHEN ecosystem = 'pypi' THEN lower(regexp_replace(name, '[-_.]+', '-', 'g')) ELSE name END"
_scope = lambda c: f"nullif(lower(regexp_extract({c}, '^(@[^/]+)/', 1)), '')"
_collapse = lambda c: f"CASE WHEN regexp_matches({c}, '^@[^/]+/.') THEN regexp_replace(split_part(lower({c}), '/', 1), '[-_.]', '', 'g') || '/' || regexp_replace(substr(lower({c}), strpos({c}, '/') + 1), '[-_.]', '', 'g') ELSE regexp_replace(lower({c}), '[-_.]', '', 'g') END"
_with = f"""p AS MATERIALIZED ({_s(POPULAR)}), n AS MATERIALIZED (SELECT *, {_canon} AS canon FROM ({_s(NAMES)})),
g AS MATERIALIZED (SELECT n.*, CASE WHEN length(name) < 5 THEN 'short' WHEN EXISTS (SELECT 1 FROM p WHERE p.ecosystem = n.ecosystem AND p.name = canon) THEN 'popular' WHEN n.ecosystem = 'npm' AND {_scope('canon')} IN (SELECT {_scope('name')} FROM p WHERE ecosystem = 'npm' AND name LIKE '@%/%') THEN 'scope' END AS gate FROM n),
o AS MATERIALIZED (SELECT * FROM g WHERE gate IS NULL)"""
_twins = f"SELECT id, twin FROM o JOIN (SELECT ecosystem, {_collapse('name')} AS c, arg_min(name, rank) AS twin FROM p GROUP BY ALL) q ON q.ecosystem = o.ecosystem AND c = {_collapse('canon')} WHERE twin <> canon"
_cuts = " UNION ALL ".join(
    [f"SELECT id, ecosystem, {i} AS k, {quoted(s)} AS affix, regexp_replace(left(canon, length(canon) - {len(s)}), '[-_.]$', '') AS base FROM o WHERE ends_with(canon, {quoted(s)}) AND length(canon) > {len(s)}" for i, s in enumerate(pk.SUFFIXES)]
    + [f"SELECT id, ecosystem, {50 + i}, {quoted(p)}, substr(canon, {len(p) + 1}) FROM o WHERE starts_with(canon, {quoted(p)}) AND length(canon) > {len(p)}" for i, p in enumerate(pk.PREFIXES)]
)
_affix = f"SELECT id, arg_min(base, k) AS base, arg_min(affix, k) AS affix FROM ({_cuts}) c JOIN p ON p.ecosystem = c.ecosystem AND p.name = base WHERE length(base) >= 5 GROUP BY id"
_dist = f"SELECT id, canon, p.name AS target, rank, levenshtein(translate(canon, 'é', '~'), p.name) AS distance FROM o JOIN p ON o.ecosystem = p.ecosystem AND abs(length(canon) - length(p.name)) <= 2 AND length(p.name) >= 5 AND ({_scope('canon')} IS NULL) = ({_scope('p.name')} IS NULL) AND p.name <> canon"
_near = f"SELECT id, canon, target, distance::INT AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, length(target), rank) AS k FROM ({_dist}) WHERE distance BETWEEN 1 AND 2) WHERE k = 1"
_pairs = "(" + ", ".join(quoted(x) for a, b in pk.LOOKALIKE for x in (a + b, b + a)) + ")"
_look = f"distance = 1 AND length(canon) = length(target) AND (SELECT min(lower(substr(canon, i::INT, 1) || substr(target, i::INT, 1))) FROM range(1, 60) AS r(i) WHERE i <= length(canon) AND substr(canon, i::INT, 1) <> substr(target, i::INT, 1)) IN {_pairs}"
_rep = f"""SELECT n.id, exists, CASE WHEN {{osv}} THEN coalesce(v.vulns, 0) END AS vulns, CASE WHEN {{osv}} THEN coalesce(v.malicious, FALSE) END AS malicious, deprecated, confusable,
 CASE WHEN age_days < 90 THEN 1 ELSE 0 END + CASE WHEN weekly_downloads < 50 THEN 1 ELSE 0 END AS sig FROM ({_s(NAMES)}) n LEFT JOIN ({_s(REGISTRY)}) r ON n.ecosystem = r.ecosystem AND n.name = r.name
 LEFT JOIN (SELECT ecosystem, name, count(*) AS vulns, bool_or(starts_with(id, 'MAL-')) AS malicious FROM ({_s(OSV)}) GROUP BY ALL) v ON n.ecosystem = v.ecosystem AND n.name = v.name"""
_slop = "CASE WHEN sig >= 1 AND confusable IS NOT NULL THEN 'high' WHEN sig >= 1 THEN 'medium' ELSE 'low' END"
_ver = f"CASE WHEN exists IS NULL THEN 'unknown' WHEN NOT exists THEN 'danger' WHEN coalesce(malicious, FALSE) OR {_slop} = 'high' THEN 'danger' WHEN vulns IS NULL OR vulns > 0 OR coalesce(deprecated, FALSE) OR {_slop} = 'medium' THEN 'caution' ELSE 'safe' END"
_vs = f"""WITH b AS (SELECT name, regexp_replace(name, '^@[^/]+/', '') AS b FROM (SELECT DISTINCT name FROM ({_s(POPULAR)}) WHERE ecosystem = 'npm')),
v AS (SELECT name, b, list_concat(list_transform(range(1, length(b) + 1), lambda i: substr(b, 1, (i - 1)::INT) || substr(b, (i + 1)::INT)), list_transform(range(1, length(b)), lambda i: substr(b, 1, (i - 1)::INT) || substr(b, (i + 1)::INT, 1) || substr(b, i::INT, 1) || substr(b, (i + 2)::INT)),
 list_transform(range(1, length(b) + 1), lambda i: substr(b, 1, (i - 1)::INT) || substr(b, i::INT, 1) || substr(b, i::INT, 1) || substr(b, i::INT)), [{', '.join(f"replace(b, {quoted(x)}, {quoted(y)})" for x, y in pk.SWAPS)}, replace(b, '-', ''), replace(b, '_', '')]) AS xs FROM b),
w AS (SELECT name, list_filter(xs, lambda x, i: x <> b AND length(x) >= 2 AND list_position(xs, x) = i AND regexp_matches(x, '^[A-Za-z0-9._-]+$'))[1:30] AS xs FROM v),
t AS (SELECT name, unnest(range(len(xs)))::INT AS pos, unnest(xs) AS variant FROM w)"""
_vp = lambda c: f"list_resize(list_transform(string_split({c}, '.'), lambda p: p::INT), 4, 0)"
_adv = f"""w AS MATERIALIZED ({_s(WANTED)}), g AS (SELECT w.id, count(*) AS n, bool_or(starts_with(o.id, 'MAL-')) AS mal, string_agg(concat_ws('<', o.id, fixed), ',' ORDER BY o.id) AS ids FROM w JOIN ({_s(OSV)}) o ON o.ecosystem = w.ecosystem AND o.name = w.name
 WHERE (w.version IS NULL OR introduced IS NULL OR {_vp('w.version')} >= {_vp('introduced')}) AND (w.version IS NULL OR fixed IS NULL OR {_vp('w.version')} < {_vp('fixed')}) GROUP BY w.id)"""
_tok = f"({_s(TOKENS)})"
QUERIES = {f.__name__: f for f in (pep503, ecosystem_alias, pkg_gate, pkg_nonascii, pkg_collapse_join, pkg_affix, pkg_near, pkg_confusable, pkg_verdict, pkg_verdict_no_list, typosquat_variants, typosquat_registered, did_you_mean, malicious_check, verify_package, check_vulns, parse_deps, package_info, slopsquat, audit_deps_report, audit_deps_summary, clean_version, requirements_parse, npm_spec, pip_spec, not_package_reason)}
SQL = {
    "pep503": f"SELECT id, {_canon} AS canon, {_collapse('name')} AS collapsed, length(name) BETWEEN 1 AND 214 AND regexp_matches(name, '^[@a-zA-Z0-9._/-]+$') AS valid FROM ({_s(NAMES)})",
    "ecosystem_alias": "SELECT * FROM (VALUES ('NPM', 'npm'), ('pip', 'pypi'), ('cargo', 'crates'), ('gem', 'rubygems'), ('golang', 'go'), ('nuget', 'nuget'), ('perl', NULL), ('-', 'npm')) AS t(given, ecosystem)",
    "pkg_gate": f"WITH {_with} SELECT id, gate FROM g",
    "pkg_nonascii": f"SELECT id, name FROM ({_s(NAMES)}) WHERE strlen(name) > length(name)",
    "pkg_collapse_join": f"WITH {_with} {_twins}",
    "pkg_affix": f"WITH {_with} {_affix}",
    "pkg_near": f"WITH {_with} SELECT id, target, distance FROM ({_near})",
    "pkg_confusable": f"WITH {_with} SELECT id, target FROM ({_near}) WHERE {_look}",
    "pkg_verdict": f"""WITH {_with}, tw AS ({_twins}), af AS ({_affix}), ne AS (SELECT *, {_look} AS look FROM ({_near})),
x AS (SELECT g.id, strlen(name) > length(name) AS na, twin, base, target, distance, look, g.canon, (SELECT max(verdict) FROM ({CACHE}) c WHERE c.ecosystem = g.ecosystem AND c.name = g.canon) AS cached FROM g LEFT JOIN tw USING (id) LEFT JOIN af USING (id) LEFT JOIN ne USING (id)),
y AS (SELECT id, na, twin IS NOT NULL AS t, base IS NOT NULL AS a, target IS NOT NULL AND target IS DISTINCT FROM base AND target IS DISTINCT FROM twin AS own, coalesce(look, FALSE) AS look, distance <= CASE WHEN length(canon) >= 8 THEN 2 ELSE 1 END AS close, cached FROM x)
SELECT id, CASE WHEN na OR t OR (own AND look) OR cached = 'danger' THEN 'danger' WHEN a OR (own AND NOT look AND close) OR cached = 'caution' THEN 'caution' ELSE 'safe' END AS verdict,
 concat_ws(',', CASE WHEN na THEN 'pkg-name-nonascii' END, CASE WHEN t THEN 'pkg-name-separator' END, CASE WHEN a THEN 'pkg-name-affix' END, CASE WHEN own AND look THEN 'pkg-name-confusable' END, CASE WHEN own AND NOT look AND close THEN 'pkg-name-near' END, CASE WHEN cached IN ('danger', 'caution') THEN 'pkg-cached-verdict' END) AS rules FROM y""",
    "pkg_verdict_no_list": f"SELECT CASE WHEN strlen(name) > length(name) THEN 'danger' ELSE 'unknown' END AS verdict, count(*) AS n FROM ({_s(NAMES)}) GROUP BY ALL",
    "typosquat_variants": f"{_vs} SELECT * FROM t",
    "typosquat_registered": f"{_vs} SELECT name, count(*) AS registered FROM t WHERE pos < 20 AND variant IN (SELECT name FROM ({_s(NAMES)})) GROUP BY name",
    "did_you_mean": f"WITH {_with} SELECT id, rank::INT AS rank, suggestion, distance::INT AS distance FROM (SELECT n.id, p.name AS suggestion, levenshtein(translate(n.name, 'é', '~'), p.name) AS distance, row_number() OVER (PARTITION BY n.id ORDER BY levenshtein(translate(n.name, 'é', '~'), p.name), p.name) AS rank FROM n JOIN p ON n.ecosystem = p.ecosystem AND n.name <> p.name AND p.name NOT LIKE '@%') WHERE rank <= 5",
    "malicious_check": f"SELECT id, CASE WHEN whole IS NULL THEN 'clear' WHEN whole OR version IN ('1.0.0', '1.2.0') THEN 'malicious' ELSE 'caution' END AS list_verdict FROM ({_s(VERSIONED)}) v LEFT JOIN ({_s(LISTED)}) l ON v.ecosystem = l.ecosystem AND v.name = l.name",
    "verify_package": f"""WITH {_adv}, m AS (SELECT w.id, w.ecosystem, exists, deprecated, confusable, coalesce(n, 0) AS vulns, coalesce(mal, FALSE) AS malicious, CASE WHEN l.name IS NULL THEN 'clear' WHEN whole OR w.version IN ('1.0.0', '1.2.0') THEN 'malicious' ELSE 'caution' END AS list_verdict,
 CASE WHEN age_days < 90 THEN 1 ELSE 0 END + CASE WHEN weekly_downloads < 50 THEN 1 ELSE 0 END AS sig, w.ecosystem NOT IN ('npm', 'pypi') AS limited FROM w LEFT JOIN g USING (id) LEFT JOIN ({_s(FACTS)}) f ON f.ecosystem = w.ecosystem AND f.name = w.name LEFT JOIN ({_s(LISTED)}) l ON l.ecosystem = w.ecosystem AND l.name = w.name)
SELECT id, exists, vulns, malicious, list_verdict, limited, CASE WHEN list_verdict = 'malicious' THEN 'danger' WHEN exists AND (malicious OR {_slop} = 'high') THEN 'danger' WHEN exists AND (limited OR list_verdict = 'caution') THEN 'caution' ELSE {_ver} END AS verdict FROM m""",
    "check_vulns": f"WITH {_adv} SELECT w.id, coalesce(n, 0) AS count, coalesce(mal, FALSE) AS malicious, coalesce(ids, '') AS advisories FROM w LEFT JOIN g USING (id)",
    "parse_deps": f"""WITH d AS ({_s(GIVEN)}), x AS (SELECT id, 0 AS k, 'shared' AS name, '0' AS version FROM d UNION ALL SELECT id, 0, 'given', '7' FROM d UNION ALL SELECT id, 1, 'a', '^1.2.3' FROM d WHERE id % 4 = 0 UNION ALL SELECT id, 1, 'shared', '1.0' FROM d WHERE id % 4 = 0
 UNION ALL SELECT id, 2, 'a', '2' FROM d WHERE id % 4 = 0 UNION ALL SELECT id, 2, 'd' || id, '>=3' FROM d WHERE id % 4 = 0 UNION ALL SELECT id, 3, 'shared', '9.' || id FROM d WHERE id % 3 > 0 UNION ALL SELECT id, 3, 'flask', '' FROM d WHERE id % 3 > 0),
y AS (SELECT id, name, arg_max(version, k) AS version FROM x GROUP BY ALL), z AS (SELECT id, 'flask' AS name FROM d WHERE id % 5 > 0 UNION ALL SELECT id, 'p' || id FROM d WHERE id % 5 > 0)
SELECT id, CASE WHEN id % 4 = 2 THEN 1 ELSE 0 END AS errors, name, version FROM (SELECT * FROM y UNION ALL SELECT id, name, '' FROM z WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.id = z.id AND y.name = z.name))""",
    "package_info": f"SELECT n.id, exists, age_days, weekly_downloads FROM ({_s(NAMES)}) n LEFT JOIN ({_s(REGISTRY)}) r ON n.ecosystem = r.ecosystem AND n.name = r.name",
    "slopsquat": f"SELECT {_slop} AS slopsquat, count(*) AS n FROM ({_rep.format(osv='TRUE')}) GROUP BY ALL",
    "audit_deps_report": f"SELECT id, vulns, {_ver} AS verdict FROM ({_rep.format(osv='FALSE')})",
    "audit_deps_summary": f"SELECT count(*) AS total, count(*) FILTER (v = 'danger') AS danger, count(*) FILTER (v = 'caution') AS caution, count(*) FILTER (v = 'safe') AS safe, count(*) FILTER (v = 'unknown') AS unknown, count(*) FILTER (NOT exists) AS missing, count(*) FILTER (malicious) AS malicious, count(*) FILTER (vulns > 0) AS vulnerable, count(*) FILTER (deprecated) AS deprecated, count(*) FILTER (vulns IS NULL) AS unchecked FROM (SELECT *, {_ver} AS v FROM ({_rep.format(osv='TRUE')}))",
    "clean_version": f"SELECT id, nullif(regexp_extract(version, '[0-9]+\\.[0-9]+(?:\\.[0-9]+)?'), '') AS clean FROM ({_s(VERSIONS)})",
    "requirements_parse": "SELECT p_partkey AS id, name, version FROM part, (VALUES ('requests', '2.31.0'), ('flask', '2.0'), ('-r', ''), ('numpy', ''), ('pkg', ''), ('a_b.c', '1.4.rc1')) AS t(name, version) UNION ALL SELECT p_partkey, 'part' || p_partkey, '1.' || p_partkey % 9 FROM part",
    "npm_spec": f"SELECT id, CASE WHEN strpos(substr(token, 2), '@') > 0 THEN left(token, strpos(substr(token, 2), '@')) ELSE token END AS name, CASE WHEN strpos(substr(token, 2), '@') > 0 THEN nullif(substr(token, strpos(substr(token, 2), '@') + 2), '') END AS version FROM {_tok}",
    "pip_spec": f"SELECT id, coalesce(nullif(regexp_extract(token, '^([A-Za-z0-9._-]+)', 1), ''), token) AS name, nullif(regexp_extract(token, '^[A-Za-z0-9._-]+(?:\\[[^\\]]*\\])?[ \\t]*(?:===|==|>=|<=|~=|!=|>|<)[ \\t]*([^ \\t,;]+)', 1), '') AS version FROM {_tok}",
    "not_package_reason": f"SELECT id, token, CASE WHEN starts_with(token, '-') THEN NULL WHEN token[1] IN ('.', '~', '/') OR regexp_matches(token, '^[A-Za-z]:[\\\\/]') THEN 'local path' WHEN regexp_matches(token, {quoted(pk.NOT_NAMES)}) THEN 'url' WHEN regexp_matches(token, '^[^@/]+/[^@/]+$') THEN 'owner/repo' WHEN regexp_matches(token, '[$`*?]') THEN 'expansion' END AS reason FROM {_tok}",
}
