"""Queries of the secret and PII scan, over documents with values planted by id (made from parts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import quoted, re2
from ..functions.frames import plain, run
from ..operators import secrets as s

_HEX, _WORD = "repeat('0a1b2c3d', {n})", "repeat('Ab3', {n})"
PLANTS = [
    f"'AKIA' || repeat('AB12', 4)", f"'gh' || 'p_' || {_WORD.format(n=12)}", f"'sk-' || 'ant-' || {_WORD.format(n=8)}", f"'sk-' || {_WORD.format(n=8)}", f"'AI' || 'za' || {_WORD.format(n=11)} || 'xy'", f"'xox' || 'b-' || {_WORD.format(n=5)}",
    f"'sk_' || 'live_' || {_WORD.format(n=6)}", f"'SK' || {_HEX.format(n=4)}", f"'npm' || '_' || {_WORD.format(n=12)}", f"'ey' || 'J' || {_WORD.format(n=4)} || '.ey' || 'J' || {_WORD.format(n=4)} || '.' || {_WORD.format(n=4)}",
    "'-----BEGIN RSA ' || 'PRIVATE KEY-----abc' || '-----END RSA ' || 'PRIVATE KEY-----'", "'postgres://user:' || 'hunter22' || '@db.host/x'", "'AccountKey=' || repeat('Ab', 43) || '=='", "'https://x.y/z?sig=' || repeat('Ab3', 15) || ' '",
    f"'SG' || '.' || {_WORD.format(n=6)} || '.' || {_WORD.format(n=6)}", f"'gl' || 'pat-' || {_WORD.format(n=7)}", f"'hf' || '_' || {_WORD.format(n=11)}", "'api_key = \"' || 'abcd' || 'efgh1' || '\"'", "'Server=x;Password=' || 'pass' || 'word1' || ';'",
    "'mail bob.smith@corp.io and a@b.example.com'", "'ssn 123-45-6789'", "'card 4111 1111 1111 1111 or 4111-1111-1111-1112'",
]
SALTED = "SELECT doc_id, CASE doc_id % 29 " + " ".join(f"WHEN {i} THEN {p} || ' ' || text" for i, p in enumerate(PLANTS)) + " ELSE text END AS text FROM {documents}"
_T = f"({plain(SALTED)})"
_p = lambda r: quoted(re2(s.pattern(r), r.flags))
_n = lambda r: f"len(regexp_extract_all(text, {_p(r)}))"
_mails = f"len(list_filter(regexp_extract_all(text, {quoted(re2(s.EMAIL))}), lambda e: NOT regexp_matches(e, {quoted(re2(s.RESERVED, 'i'))})))"
_luhn = "(list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 0 THEN substr(d, i::INT, 1)::INT ELSE (substr(d, i::INT, 1)::INT * 2) % 10 + (substr(d, i::INT, 1)::INT * 2) // 10 END)) % 10 = 0)"
_cards = f"(SELECT count(*) FROM (SELECT regexp_replace(c, '[ -]', '', 'g') AS d FROM (SELECT unnest(regexp_extract_all(text, {quoted(re2(s.CARD))})) AS c)) WHERE {_luhn})"
_ssn = f"len(regexp_extract_all(text, {quoted(re2(s.SSN))}))"


def _redacted() -> str:
    out = "text"
    for r in s.RULES:
        out = f"regexp_replace({out}, {_p(r)}, {quoted(chr(92) + '1[REDACTED:' + r.type + ']' + chr(92) + '3')}, 'g')"
    return out


def _scan(spark, sf):
    return s.scan(run(spark, sf, SALTED))


def secrets_generic(spark, sf):
    generic = s.RULES[-1]
    return run(spark, sf, "SELECT doc_id, text FROM {documents}").select("doc_id", s.count(F.col("text"), generic).cast("long").alias("n")).where("n > 0")


def pii_email(spark, sf):
    return run(spark, sf, SALTED).select("doc_id", F.size(s.emails(F.col("text"))).cast("long").alias("n")).where("n > 0")


def pii_card_luhn(spark, sf):
    return run(spark, sf, SALTED).select("doc_id", F.size(s.cards(F.col("text"))).cast("long").alias("n")).where("n > 0")


def pii_ssn(spark, sf):
    return run(spark, sf, SALTED).select("doc_id", F.size(s.ssns(F.col("text"))).cast("long").alias("n")).where("n > 0")


def secrets_formats(spark, sf):
    found = _scan(spark, sf).select("doc_id", F.explode("findings").alias("f"))
    return found.groupBy(F.col("f.id").alias("rule_id")).agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("n"))


def secrets_findings(spark, sf):
    found = _scan(spark, sf).select("doc_id", F.explode("findings").alias("f"))
    return found.select("doc_id", F.col("f.id").alias("rule_id"), "f.kind", "f.severity", "f.index", "f.preview")


def redact_values(spark, sf):
    return run(spark, sf, SALTED).select("doc_id", F.md5(s.redact(F.col("text"))).alias("redacted_md5"))


def secret_verdict(spark, sf):
    return _scan(spark, sf).select("doc_id", "secrets", "pii", "found", "verdict")


def scan_secrets_spans(spark, sf):
    out = run(spark, sf, SALTED).select("doc_id", s.redact_spans("text").alias("r"))
    return out.select("doc_id", F.col("r.n").alias("n"), F.col("r.redacted").alias("redacted"))


def found_sql(rows: str, key: str, text: str) -> str:
    """(key, rule_id, kind, type, severity, index, preview) of every match in rows, places by sums over what lies between matches."""
    sides = [(r.id, "secret", r.type, r.severity, re2(s.pattern(r), r.flags), 1, 2, "TRUE") for r in s.RULES]
    sides += [("email", "pii", "Email Address", "low", re2(s.EMAIL), None, 0, f"NOT regexp_matches(value, {quoted(re2(s.RESERVED, 'i'))})"), ("ssn", "pii", "Social Security Number", "high", re2(s.SSN), None, 0, "TRUE")]
    sides += [("card", "pii", "Card Number", "high", re2(s.CARD), None, 0, f"(SELECT {_luhn} FROM (SELECT regexp_replace(value, '[ -]', '', 'g') AS d))")]
    out = []
    for i, kind, name, severity, p, label, value, cond in sides:
        every = lambda g, p=p: f"regexp_extract_all({text}, {quoted(p)}, {g})"
        labels = every(label) if label else f"list_transform({every(0)}, lambda x: '')"
        cut = f"SELECT {key}, string_split_regex({text}, {quoted(p)}) AS pieces, {every(0)} AS wholes, {every(value)} AS vs, {labels} AS labels FROM {rows} WHERE regexp_matches({text}, {quoted(p)})"
        at = "list_sum(list_transform(pieces[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(wholes[1:k - 1], lambda x: length(x))), 0) + length(labels[k])"
        out.append(f"SELECT {key}, {quoted(i)} AS rule_id, '{kind}' AS kind, {quoted(name)} AS type, '{severity}' AS severity, place::INT AS index, length(value)::INT AS size, value FROM (SELECT {key}, {at} AS place, vs[k] AS value FROM (SELECT *, unnest(range(1, len(wholes) + 1)) AS k FROM ({cut}))) WHERE {cond}")
    return f"SELECT * EXCLUDE (value), CASE WHEN length(value) >= 12 THEN substr(value, 1, 4) || '****' || right(value, 2) ELSE '****' END AS preview FROM ({' UNION ALL '.join(out)})"


_sum = lambda cond: " + ".join(_n(r) for r in s.RULES if cond(r)) or "0"
_kinds = " UNION ALL ".join([f"SELECT doc_id, '{r.id}' AS rule_id, {_n(r)} AS n FROM t" for r in s.RULES] + [f"SELECT doc_id, '{k}', {v} FROM t" for k, v in (("email", _mails), ("ssn", _ssn), ("card", _cards))])
QUERIES = {f.__name__: f for f in (secrets_generic, pii_email, pii_card_luhn, pii_ssn, secrets_formats, secrets_findings, redact_values, secret_verdict, scan_secrets_spans)}
SQL = {
    "secrets_generic": f"SELECT doc_id, {_n(s.RULES[-1])} AS n FROM documents WHERE {_n(s.RULES[-1])} > 0",
    "pii_email": f"SELECT doc_id, {_mails} AS n FROM {_T} WHERE {_mails} > 0",
    "pii_card_luhn": f"SELECT * FROM (SELECT doc_id, {_cards} AS n FROM {_T}) WHERE n > 0",
    "pii_ssn": f"SELECT doc_id, {_ssn} AS n FROM {_T} WHERE {_ssn} > 0",
    "secrets_formats": f"WITH t AS MATERIALIZED {_T} SELECT rule_id, count(*) AS docs, sum(n)::BIGINT AS n FROM ({_kinds}) WHERE n > 0 GROUP BY rule_id",
    "scan_secrets_spans": f"""WITH t AS MATERIALIZED {_T}, f AS (SELECT doc_id, index AS a, index + size AS b, type FROM ({found_sql('t', 'doc_id', 'text')}) WHERE kind = 'secret'),
g AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f),
h AS (SELECT *, sum(CASE WHEN m IS NULL OR a >= m THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b, type ROWS UNBOUNDED PRECEDING) AS k FROM g),
i AS (SELECT doc_id, k, min(a) AS a, max(b) AS b, first(type ORDER BY a, b, type) AS type FROM h GROUP BY ALL), j AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS p FROM i),
l AS (SELECT doc_id, count(*)::INT AS n, string_agg(substr(text, (p + 1)::INT, (a - p)::INT) || '[REDACTED:' || type || ']', '' ORDER BY k) AS s, max(b) AS e FROM j JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n, CASE WHEN n IS NULL THEN text ELSE s || substr(text, (e + 1)::INT) END AS redacted FROM t LEFT JOIN l USING (doc_id)""",
    "secrets_findings": f"WITH t AS MATERIALIZED {_T} SELECT doc_id, rule_id, kind, severity, index, preview FROM ({found_sql('t', 'doc_id', 'text')})",
    "redact_values": f"SELECT doc_id, md5({_redacted()}) AS redacted_md5 FROM {_T}",
    "secret_verdict": f"""SELECT doc_id, secrets::INT AS secrets, pii::INT AS pii, secrets + pii > 0 AS found, CASE WHEN crit > 0 THEN 'block' WHEN secrets + pii > 0 THEN 'review' ELSE 'allow' END AS verdict
FROM (SELECT doc_id, {_sum(lambda r: True)} AS secrets, {_sum(lambda r: r.severity == 'critical')} AS crit, {_mails} + {_ssn} + {_cards} AS pii FROM {_T})""",
}
