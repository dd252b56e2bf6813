"""Queries over a ledger made from events, and over rule bundles and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import verdicts
from ..functions.dialect import quoted
from ..functions.frames import plain, run
from ..operators import ledger as lg
from . import payments

LEDGER = "SELECT event_id AS id, ts, CASE user_id % 4 WHEN 0 THEN 'pre-bash' WHEN 1 THEN 'post-edit' WHEN 2 THEN 'scan' ELSE 'fetch' END AS event, CASE event_id % 7 WHEN 0 THEN 'danger' WHEN 1 THEN 'block' WHEN 2 THEN 'caution' WHEN 3 THEN 'unknown' ELSE 'safe' END AS verdict, CASE WHEN event_id % 7 < 2 AND event_id % 3 = 0 THEN 'blocked' WHEN event_id % 5 = 0 THEN NULL ELSE 'reported' END AS action, event_id % 11 AS r1, event_id % 4 AS r2, event_id % 6 AS sk, CAST(user_id AS STRING) || chr(10) || event_type AS subject FROM {events}"


def _ledger(spark, sf):
    d = run(spark, sf, LEDGER)
    rules = F.filter(F.array(F.concat(F.lit("rule-"), F.col("r1").cast("string")), F.when(F.col("r2") == 0, F.concat(F.lit("rule-x"), F.col("r1").cast("string")))), lambda x: x.isNotNull())
    return d.withColumn("rules", rules).withColumn("skipped", F.when(F.col("sk") == 0, F.array(F.lit("osv"))).otherwise(F.array().cast("array<string>")))


def ledger_stats(spark, sf):
    return lg.stats(_ledger(spark, sf))


def ledger_by_rule(spark, sf):
    return lg.by_rule(_ledger(spark, sf))


def ledger_by_verdict(spark, sf):
    return _ledger(spark, sf).groupBy("verdict", "event").agg(F.count("*").alias("n"))


def ledger_caught_topk(spark, sf):
    return lg.latest_caught(_ledger(spark, sf)).select("id", "verdict", "event")


def ledger_window(spark, sf):
    return lg.windows(_ledger(spark, sf), "1 day")


def ledger_window_sliding(spark, sf):
    return lg.windows(_ledger(spark, sf), "7 days", "1 day")


def ledger_sanitized(spark, sf):
    return _ledger(spark, sf).select("id", lg.sanitize(F.col("subject"), 8).alias("subject"))


CHECKS = "SELECT event_id AS id, 'npm:' || CAST(user_id AS STRING) AS key, CASE event_id % 3 WHEN 0 THEN 'safe' WHEN 1 THEN 'danger' ELSE 'caution' END AS verdict, ts AS at FROM {events}"


def cache_latest(spark, sf):
    return lg.cache_latest(run(spark, sf, CHECKS)).select("key", "verdict")


def cache_evict(spark, sf):
    return lg.cache_evict(lg.cache_latest(run(spark, sf, CHECKS)), 40).select("key")


def worst_verdict(spark, sf):
    names = list(verdicts.WORST)
    d = run(spark, sf, "SELECT p_partkey AS id FROM {part}")
    pick = lambda k: F.element_at(F.array(*map(F.lit, names)), (F.col("id") / k).cast("int") % len(names) + 1)
    return d.withColumn("a", pick(1)).withColumn("b", pick(3)).select("id", verdicts.worst(F.col("a"), F.col("b")).alias("worst"))


GATES = (("danger", "verdict = 'caution'"), ("warn", "verdict = 'caution'"), ("danger", "verdict = 'block'"), ("low", "verdict = 'safe'"), ("warn", "id % 7 > 2"), ("danger", "action = 'blocked'"))


def fail_on_gate(spark, sf):
    led = _ledger(spark, sf)
    each = [lg.gate(led.where(c), level).withColumn("gate", F.lit(f"{level} {c}")) for level, c in GATES]
    out = each[0]
    for e in each[1:]:
        out = out.union(e)
    return out


CASES = "SELECT CASE c_custkey % 5 WHEN 0 THEN 'injection' WHEN 1 THEN 'secrets' WHEN 2 THEN 'shell' WHEN 3 THEN 'names' ELSE 'email' END AS category, CASE WHEN c_custkey % 7 = 0 THEN 'quiet' WHEN c_custkey % 7 = 1 THEN 'miss' ELSE 'catch' END AS expect, c_custkey % 3 <> 0 AS detected FROM {customer}"


def corpus_report(spark, sf):
    return lg.corpus_report(run(spark, sf, CASES))


_dated = lambda k, m: f"CAST(2020 + {k} % 3 AS STRING) || '.0' || CAST({k} % {m} + 1 AS STRING) || '.' || CAST({k} % 5 + 8 AS STRING) || CASE WHEN {k} % 4 = 0 THEN '.' || CAST({k} % 13 AS STRING) ELSE '' END"
VERSIONS = f"SELECT DISTINCT {_dated('l_suppkey', 4)} AS a, {_dated('l_linenumber', 6)} AS b FROM {{lineitem}}"


def version_compare(spark, sf):
    return run(spark, sf, VERSIONS).select("a", "b", lg.compare_versions(F.col("a"), F.col("b")).alias("order"))


SOURCES = "SELECT id, ok, fetched FROM (VALUES ('ofac', true, TIMESTAMP '2024-01-20 00:00:00'), ('scam', false, TIMESTAMP '2024-01-31 00:00:00'), ('osv', true, TIMESTAMP '2024-01-25 00:00:01'), ('never', true, CAST(NULL AS TIMESTAMP))) AS t(id, ok, fetched)"


def stale_sources(spark, sf):
    return lg.stale(spark.sql(SOURCES), "2024-02-01 00:00:00").select("id", "age_days", "stale")


ADVISORIES = "SELECT 'npm' AS ecosystem, replace(p_name, ' ', '-') AS name, CASE WHEN p_partkey % 5 <> 0 THEN '1.' || CAST(p_partkey % 9 AS STRING) END AS version, CASE WHEN p_partkey % 4 = 0 THEN 'GHSA-' ELSE 'MAL-' END || CAST(p_partkey AS STRING) AS id, p_partkey % 6 = 0 AS withdrawn FROM {part} WHERE p_partkey % 10 < 4"


def malicious_build(spark, sf):
    return lg.build_malicious(run(spark, sf, ADVISORIES)).select("ecosystem", "name", F.array_join("versions", ",").alias("versions"), "advisory")


def list_carry_forward(spark, sf):
    old = payments._r(spark, sf, payments.LISTS).withColumn("address", F.trim("address"))
    return lg.carry_forward(old, old.where("list <> 'ETH' and address < '0x8'"), ["ETH", "BSC"]).groupBy("list").agg(F.count("*").alias("n"))


def list_fingerprint(spark, sf):
    return lg.fingerprint(payments._r(spark, sf, payments.LISTS), "list", "address")


def popular_list_build(spark, sf):
    ranked = run(spark, sf, "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '-') END AS name, p_partkey AS rank FROM {part}")
    return lg.popular_names(ranked, 50).select("ecosystem", "name", F.col("rank").cast("int").alias("rank"))


def bundle_validate(spark, sf):
    """Errors of some bundles, good and bad; the check itself runs on the driver, as bundles are control data."""
    rule = {"id": "a-rule", "pattern": "x(y)", "weight": 5, "value_group": 1}
    cases = {
        "good": {"schema": 1, "version": "2026.08.22", "rulesets": {"injection": [rule]}}, "schema": {"schema": 2, "version": "2026.08.22", "rulesets": {"injection": [rule]}}, "twice": {"schema": 1, "version": "2026.08.22.1", "rulesets": {"injection": [rule, rule]}},
        "slow": {"schema": 1, "version": "2026.08.22", "rulesets": {"injection": [{"id": "a", "pattern": "(a+)+b"}]}}, "group": {"schema": 1, "version": "x", "rulesets": {"pii": [{**rule, "value_group": 2}]}}, "empty": {"schema": 1, "version": "2026.08.22", "rulesets": {"code": []}},
    }
    return spark.createDataFrame([(k, ";".join(lg.validate_bundle(v))) for k, v in cases.items()], "bundle string, errors string")


_s = lambda sql: plain(sql).replace("AS STRING", "AS VARCHAR").replace(" AS at ", ' AS "at" ')
_L = f"({_s(LEDGER)})"
_CAUGHT = "verdict IN ('danger', 'block', 'caution', 'review', 'warn')"
_W = "{" + ", ".join(f"'{k}': {v}" for k, v in verdicts.WORST.items()) + "}"
_names = "[" + ", ".join(map(quoted, verdicts.WORST)) + "]"
_rank = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in verdicts.WORST.items()) + " END"
_parts = lambda c: f"list_resize(list_transform(string_split({c}, '.'), lambda p: p::INT), 4, 0)"
_rep = "count(*) FILTER (expect <> 'quiet') AS attacks, count(*) FILTER (expect <> 'quiet' AND detected) AS caught, count(*) FILTER (expect = 'quiet') AS quiet, count(*) FILTER (expect = 'quiet' AND detected) AS false_positives, floor(count(*) FILTER (expect <> 'quiet' AND detected) * 100 / nullif(count(*) FILTER (expect <> 'quiet'), 0) + 0.5)::INT AS rate"
QUERIES = {f.__name__: f for f in (ledger_stats, ledger_by_rule, ledger_by_verdict, ledger_caught_topk, ledger_window, ledger_window_sliding, ledger_sanitized, cache_latest, cache_evict, worst_verdict, fail_on_gate, corpus_report, version_compare, stale_sources, malicious_build, list_carry_forward, list_fingerprint, popular_list_build, bundle_validate)}
SQL = {
    "ledger_stats": f"SELECT count(*) AS checks, count(*) FILTER ({_CAUGHT}) AS caught, count(*) FILTER ({_CAUGHT} AND action = 'blocked') AS blocked, count(*) FILTER ({_CAUGHT} AND action IS DISTINCT FROM 'blocked') AS reported, count(*) FILTER (sk = 0) AS incomplete, min(ts) AS first, max(ts) AS last FROM {_L}",
    "ledger_by_rule": f"SELECT rule, count(*) AS n FROM (SELECT unnest(list_filter(['rule-' || r1, CASE WHEN r2 = 0 THEN 'rule-x' || r1 END], lambda x: x IS NOT NULL)) AS rule FROM {_L} WHERE {_CAUGHT}) GROUP BY rule ORDER BY n DESC, rule LIMIT 10",
    "ledger_by_verdict": f"SELECT verdict, event, count(*) AS n FROM {_L} GROUP BY ALL",
    "ledger_caught_topk": f"SELECT id, verdict, event FROM {_L} WHERE {_CAUGHT} ORDER BY ts DESC, id DESC LIMIT 15",
    "ledger_window": f"SELECT date_trunc('day', ts)::TIMESTAMP AS start, event, count(*) AS checks, count(*) FILTER ({_CAUGHT}) AS caught FROM {_L} GROUP BY ALL",
    "ledger_window_sliding": f"SELECT (date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP AS start, event, count(*) AS checks, count(*) FILTER ({_CAUGHT}) AS caught FROM {_L}, range(7) AS r(k) GROUP BY ALL",
    "ledger_sanitized": f"SELECT id, substr(replace(subject, chr(10), ' '), 1, 8) AS subject FROM {_L}",
    "cache_latest": f"SELECT key, arg_max(verdict, (\"at\", id)) AS verdict FROM ({_s(CHECKS)}) GROUP BY key",
    "cache_evict": f"SELECT key FROM (SELECT key, max(\"at\") AS a FROM ({_s(CHECKS)}) GROUP BY key) ORDER BY a DESC, key LIMIT 40",
    "worst_verdict": f"SELECT id, CASE WHEN {_rank('b')} > {_rank('a')} THEN b ELSE a END AS worst FROM (SELECT p_partkey AS id, {_names}[p_partkey % 10 + 1] AS a, {_names}[(p_partkey // 3) % 10 + 1] AS b FROM part)",
    "fail_on_gate": " UNION ALL ".join(f"SELECT {quoted(f'{level} {c}')} AS gate, max(CASE WHEN [{', '.join(str(v) for v in verdicts.LEVEL.values())}][list_position([{', '.join(map(quoted, verdicts.LEVEL))}], verdict)] >= {verdicts.LEVEL[level]} THEN 1 ELSE 0 END)::INT AS exit_code FROM {_L} WHERE {c}" for level, c in GATES),
    "corpus_report": f"SELECT category, {_rep} FROM ({plain(CASES)}) GROUP BY category UNION ALL SELECT 'all', {_rep} FROM ({plain(CASES)})",
    "bundle_validate": "SELECT * FROM (VALUES ('good', ''), ('schema', 'schema is not 1'), ('twice', 'injection/a-rule: twice'), ('slow', 'injection/a: could run for ever'), ('group', 'bad version;pii/a-rule: no such group'), ('empty', 'code: empty')) AS t(bundle, errors)",
    "version_compare": f"SELECT a, b, CASE WHEN x > y THEN 1 WHEN x < y THEN -1 ELSE 0 END AS \"order\" FROM (SELECT *, {_parts('a')} AS x, {_parts('b')} AS y FROM ({_s(VERSIONS)}))",
    "stale_sources": f"SELECT id, floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(fetched)) / 86400000000)::BIGINT AS age_days, NOT ok OR coalesce(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(fetched)) / 86400000000) > 7, TRUE) AS stale FROM ({SOURCES})",
    "malicious_build": f"SELECT ecosystem, name, CASE WHEN NOT bool_or(version IS NULL) THEN array_to_string(list_sort(list_distinct(list(version))), ',') END AS versions, min(id) AS advisory FROM ({_s(ADVISORIES)}) WHERE starts_with(id, 'MAL-') AND NOT withdrawn GROUP BY ALL",
    "list_carry_forward": f"SELECT list, count(*) AS n FROM ({payments._s(payments.LISTS)}) WHERE list IN ('ETH', 'BSC') OR trim(address) < '0x8' GROUP BY list",
    "list_fingerprint": f"SELECT count(*) AS n, sha256(concat_ws(':', count(*), {', '.join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT)" for k in range(8))})) AS fingerprint FROM (SELECT sha256(list || chr(31) || address) AS h FROM ({payments._s(payments.LISTS)}))",
    "popular_list_build": "SELECT ecosystem, name, rank::INT AS rank FROM (SELECT ecosystem, name, row_number() OVER (PARTITION BY ecosystem ORDER BY r, name) AS rank FROM (SELECT ecosystem, CASE WHEN ecosystem = 'pypi' THEN regexp_replace(name, '[-_.]+', '-', 'g') ELSE name END AS name, min(k) AS r FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '-') END AS name, p_partkey AS k FROM part) GROUP BY 1, 2)) WHERE rank <= 50",
}
