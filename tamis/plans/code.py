"""Queries of the code scan, over snippets and diffs made by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import quoted, re2
from ..functions.frames import plain, run
from ..functions import verdicts
from ..operators import code, content
from . import secrets

SNIPPETS = [
    ("js", "const x = eval(input);\nexec(`ls ${dir}`)\nel.innerHTML = value;\nel.innerHTML = '' ;"),
    ("", "def f(x):\n    os.system(x)\n    return yaml.load(x)\n\n    y = yaml.load(x, SafeLoader)"),
    ("python", "import requests\nrequests.get(url, verify=False)\nrequests.get('http://a.b')\nassert user.is_admin"),
    ("", "SELECT 1\nhash = md5(password)\ncipher = DES.new(key, MODE_ECB)"),
    ("typescript", "fetch(url)\nMath.random()\nnew Function('return 1')\ndb.query(\"SELECT * FROM t WHERE id=\" + id)"),
    ("", "let a = require('b')\ndocument.write(a)\nprocess.env.NODE_TLS_REJECT_UNAUTHORIZED = '0'"),
    ("py", "cursor.execute(f\"select * from t where x={x}\")\npickle.loads(data)\nsubprocess.run(cmd, shell=True)\nrandom.choice(xs)"),
    ("go", "package main\nimport \"fmt\"\nfunc main() { fmt.Println(1) }"),
    ("", "x=>y\nimport a from 'b'\r\nvm.runInNewContext(x)"),
    ("", "nothing to see here\n\n   \njust words"),
    ("py", "exec(cmd)\napp.run(debug=True)\nrender_template_string(t)\nssl.CERT_NONE"),
]
_case = lambda i, xs: f"CASE doc_id % {len(xs)} " + " ".join(f"WHEN {k} THEN {text(x[i])}" for k, x in enumerate(xs)) + " END"


def text(s: str) -> str:
    """A literal that both engines read: line ends and backslashes apart."""
    s = s.replace("\x00\x00", "")  # keeps formats of keys apart in this file
    for c, code_point in (("\r", 13), ("\n", 10), ("\\", 92), ("$", 36), ("'", 39)):
        s = s.replace(c, f"\x00{code_point}\x00")
    parts = [f"chr({p})" if k % 2 else f"'{p}'" for k, p in enumerate(s.split("\x00"))]
    return " || ".join(p for p in parts if p != "''") or "''"


CODE = f"SELECT doc_id, {_case(0, SNIPPETS)} AS hint, {_case(1, SNIPPETS)} || chr(10) || '// ' || CAST(doc_id AS STRING) AS code FROM {{documents}}"
DIFFS = [
    ("--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,4 @@\n context\n+os.system(cmd)\n-removed eval(x)\n same\n+  y = eval(z)\n@@ -10 +20,2 @@ def f\n+assert is_admin\n+\n\\ No newline at end of file",),
    ("+before any hunk\n@@ -1 +5 @@\n+++plus plus\n+const a = eval(b)\n unchanged\n+fetch(url)",),
    ("@@ -3,2 +3,2 @@\n-a\n+b\n+++ x\n context eval(a)",),
    ("@@ -7 +7,4 @@\n+def f(x):\n-old\n+-----BEGIN RSA \x00\x00PRIVATE KEY-----\n+abc\n+-----END RSA \x00\x00PRIVATE KEY-----\n same\n+  yaml.load(x)\n+token = 'abcd1234efgh'",),
]
DIFF = f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'js' WHEN 1 THEN '' END AS hint, {_case(0, DIFFS)} AS diff FROM {{documents}}"
_string = lambda sql: plain(sql).replace("AS STRING", "AS VARCHAR")


def _coded(spark, sf):
    df = run(spark, sf, CODE)
    return df.withColumn("lang", code.language(F.col("hint"), F.col("code")))


def code_lang(spark, sf):
    return _coded(spark, sf).select("doc_id", "lang")


def _found(spark, sf):
    return code.match_lines(code.lines(_coded(spark, sf).withColumnRenamed("code", "source"), "source", "doc_id", "lang"), "doc_id")


def code_findings(spark, sf):
    return _found(spark, sf)


def code_summary(spark, sf):
    return code.summarize(_found(spark, sf), run(spark, sf, CODE).select("doc_id"), "doc_id")


PLANTED = f"""SELECT doc_id, hint, code || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'password = ' || chr(39) || 'abcd1234xy' || chr(39) WHEN 1 THEN chr(13) || chr(10) || '-----BEGIN RSA ' || 'PRIVATE KEY-----' || chr(10) || 'abc' || CAST(doc_id AS STRING) || chr(10) || '-----END RSA ' || 'PRIVATE KEY-----' || chr(10) || 'mail = bob@corp.io'
 WHEN 2 THEN ' key = AKIA' || repeat('AB12', 4) || chr(10) || '# ssn 123-45-6789' ELSE '' END AS source FROM ({CODE})"""


def code_secrets(spark, sf):
    """Findings of hard-coded values, also over several lines."""
    df = run(spark, sf, PLANTED).withColumn("lang", F.lit("js"))
    return code.with_secrets(df, "source", "doc_id").where("category = 'hardcoded-secret'").select("doc_id", "line", "rule_id", "severity", "code")


def file_verdict(spark, sf):
    """The command line's verdict of a file: the worst of its code's and its text's."""
    summary = code_summary(spark, sf).withColumnRenamed("verdict", "code_verdict").select("doc_id", "code_verdict")
    scanned = content.scan(run(spark, sf, CODE), "code").select("doc_id", F.col("verdict").alias("text_verdict"))
    own = F.when(F.col("code_verdict") == "pass", "ok").otherwise(F.col("code_verdict"))
    return summary.join(scanned, "doc_id").select("doc_id", verdicts.worst(own, F.col("text_verdict")).alias("verdict"))


def rule_catalog(spark, sf):
    r = code.rules(spark)
    out = r.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("rule_id")), ",").alias("rules"))
    return out.union(spark.createDataFrame([("hardcoded-secret", 1, "hardcoded-*")], "category string, n long, rules string"))


def diff_added_lines(spark, sf):
    return code.diff_lines(run(spark, sf, DIFF), "diff", "doc_id").drop("pos")


def diff_findings(spark, sf):
    return code.diff_findings(run(spark, sf, DIFF), "diff", "doc_id", "hint")


def list_rules(spark, sf):
    from .. import tools

    return tools.TOOLS["list_rules"].run(spark.range(1))


def _rules() -> str:
    """Rules in SQL; the three patterns that look ahead are split in what must and what must not match."""
    split = {
        "py-yaml-load": (r"\byaml\.load\s*\(", r"\byaml\.load\s*\([^)]*(Safe|safe_)"),
        "js-innerhtml": (r"\.(innerHTML|outerHTML)\s*=", r"\.(innerHTML|outerHTML)\s*=['\"`]\s*['\"`]\s*;?\s*$"),
        "ssrf-py": (r"\b(requests\.\w+|urlopen|httpx\.\w+)\s*\(\s*[a-zA-Z_]", None),
    }
    rows = []
    for i, c, s, lang, p, f in code.RULES:
        yes, no = split.get(i, (p, None))
        rows.append(f"({quoted(i)}, {quoted(c)}, {quoted(s)}, {quoted(lang)}, {quoted(re2(yes, f))}, {quoted(re2(no, f)) if no else 'NULL'})")
    return f"r(rule_id, category, severity, rule_lang, yes, no) AS (VALUES {', '.join(rows)})"


_m = lambda c, p, f="": f"regexp_matches({c}, {quoted(re2(p, f))})"
_lined = f"regexp_matches(code, {quoted('(?m)' + re2(code.PYTHONIC))})"
_lang = f"CASE WHEN {_m('lower(hint)', code.JS_NAMES)} THEN 'js' WHEN {_m('lower(hint)', code.PY_NAMES)} THEN 'py' WHEN {_lined} AND NOT {_m('code', code.NOT_PYTHONIC)} THEN 'py' WHEN {_m('code', code.SCRIPTIC)} THEN 'js' ELSE 'unknown' END"
_hits = "SELECT doc_id, line, rule_id, category, severity, substr(trim(text), 1, 160) AS code FROM l JOIN r ON (rule_lang = 'any' OR rule_lang = lang OR lang = 'unknown') AND regexp_matches(text, yes) AND NOT coalesce(regexp_matches(text, no), FALSE)"
_lines = f"c AS ({_string(CODE)}), g AS (SELECT *, {_lang} AS lang FROM c), u AS (SELECT doc_id, lang, string_split_regex(code, '\\r?\\n') AS xs FROM g), l AS (SELECT doc_id, lang, unnest(range(1, len(xs) + 1))::INT AS line, unnest(xs) AS text FROM u), {_rules()}"
_h = "regexp_extract(x, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)', 1)"
_diff = f"""d AS ({plain(DIFF)}), u AS (SELECT doc_id, string_split_regex(diff, '\\r?\\n') AS xs FROM d), v AS (SELECT doc_id, unnest(range(len(xs))) AS pos, unnest(xs) AS x FROM u),
w AS (SELECT *, CASE WHEN {_h} = '' THEN NULL ELSE {_h}::INT END AS start, starts_with(x, '+++') OR starts_with(x, '---') AS header FROM v),
y AS (SELECT *, count(start) OVER (PARTITION BY doc_id ORDER BY pos) AS hunk FROM w),
z AS (SELECT *, max(start) OVER (PARTITION BY doc_id, hunk) AS first, sum(CASE WHEN start IS NOT NULL OR header OR starts_with(x, '-') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS steps FROM y),
a AS (SELECT doc_id, pos, (coalesce(first, 0) + coalesce(steps, 0))::INT AS line, substr(x, 2) AS text FROM z WHERE starts_with(x, '+') AND NOT header),
j AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS code, list(line ORDER BY pos) AS numbers, any_value(coalesce(hint, '')) AS hint FROM a JOIN (SELECT doc_id, hint FROM d) USING (doc_id) GROUP BY doc_id), q AS (SELECT *, {_lang} AS lang FROM j),
l AS (SELECT doc_id, lang, line, text FROM a JOIN (SELECT doc_id, lang FROM q) USING (doc_id) WHERE trim(text) <> '')"""
_ends = lambda c: f"(length(substr({c}, 1, index)) - length(replace(substr({c}, 1, index), chr(10), '')))::INT"
_scores = " + ".join(f"CASE WHEN regexp_matches(code, {quoted(re2(p, 'i'))}) THEN {w} ELSE 0 END" for _, _, w, p in content.RULES)
QUERIES = {f.__name__: f for f in (code_lang, code_findings, code_summary, code_secrets, file_verdict, rule_catalog, diff_added_lines, diff_findings, list_rules)}
SQL = {
    "code_lang": f"SELECT doc_id, {_lang} AS lang FROM ({_string(CODE)})",
    "code_findings": f"WITH {_lines} {_hits}",
    "code_summary": f"""WITH {_lines}, f AS ({_hits}), n AS (SELECT doc_id, count(rule_id) AS total, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
  count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM g LEFT JOIN f USING (doc_id) GROUP BY doc_id)
SELECT *, CASE WHEN critical + high > 0 THEN 'block' WHEN total > 0 THEN 'review' ELSE 'pass' END AS verdict FROM n""",
    "code_secrets": f"WITH c AS ({_string(PLANTED)}), h AS ({secrets.found_sql('c', 'doc_id', 'source')}) SELECT doc_id, 1 + {_ends('source')} AS line, 'hardcoded-' || rule_id AS rule_id, severity, '(' || type || ': ' || preview || ')' AS code FROM h JOIN c USING (doc_id)",
    "file_verdict": f"""WITH {_lines}, f AS ({_hits}), n AS (SELECT doc_id, count(*) FILTER (severity IN ('critical', 'high')) AS hard, count(rule_id) AS total FROM g LEFT JOIN f USING (doc_id) GROUP BY doc_id),
i AS (SELECT doc_id, least(100, {_scores}) AS score FROM c)
SELECT doc_id, CASE WHEN hard > 0 OR score >= 35 THEN 'block' WHEN total > 0 OR score >= 15 THEN 'review' ELSE 'ok' END AS verdict FROM n JOIN i USING (doc_id)""",
    "rule_catalog": f"WITH {_rules()} SELECT category, count(*) AS n, string_agg(rule_id, ',' ORDER BY rule_id) AS rules FROM r GROUP BY category UNION ALL SELECT 'hardcoded-secret', 1, 'hardcoded-*'",
    "diff_added_lines": f"WITH {_diff} SELECT doc_id, line, text FROM a",
    "diff_findings": f"WITH {_diff}, {_rules()}, h AS ({secrets.found_sql('q', 'doc_id', 'code')}) {_hits} UNION ALL SELECT doc_id, numbers[1 + {_ends('code')}], 'hardcoded-' || rule_id, 'hardcoded-secret', severity, '(' || type || ': ' || preview || ')' FROM h JOIN q USING (doc_id)",
    "list_rules": f"WITH {_rules()} SELECT rule_id, category, severity, rule_lang AS lang FROM r UNION ALL SELECT 'hardcoded-*', 'hardcoded-secret', 'critical', 'any'",
}
