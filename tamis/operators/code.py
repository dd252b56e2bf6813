"""Source code and diffs, line by line: language, findings, severities.

Lines are exploded once and tested by all rules of their language in one wide expression; a finding is one
(line, rule). What the secret scan finds in a whole source, also over several lines, is a finding of the line where
it begins, as hardcoded-<id>, shown by its masked preview only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dialect import java
from . import secrets

# Rule id, category, severity, language, pattern, flags.
RULES = [
    ("js-eval", "code-injection", "high", "js", r"\beval\s*\(", ""),
    ("js-new-function", "code-injection", "high", "js", r"\bnew\s+Function\s*\(", ""),
    ("js-cmd-concat", "command-injection", "critical", "js", r"\b(exec|execSync)\s*\(\s*(?:[`'\"][^`'\"]*\$\{|[^)]*\+)", ""),
    ("js-vm", "code-injection", "high", "js", r"\bvm\.(runIn\w+|compileFunction)\s*\(", ""),
    ("py-eval-exec", "code-injection", "high", "py", r"\b(eval|exec)\s*\(", ""),
    ("py-os-system", "command-injection", "critical", "py", r"\bos\.(system|popen)\s*\(", ""),
    ("py-subprocess-shell", "command-injection", "critical", "py", r"\bsubprocess\.\w+\s*\([^)]*shell\s*=\s*True", ""),
    ("sql-concat", "sql-injection", "high", "any", r"\b(execute|query)\s*\(\s*[`'\"][^`'\"]*\b(SELECT|INSERT|UPDATE|DELETE|DROP|UNION)\b[^`'\"]*(?:[`'\"]\s*[+%]|\$\{)", "i"),
    ("py-sql-fstring", "sql-injection", "high", "py", r"\.execute\s*\(\s*f[\"'][^\"']*\b(SELECT|INSERT|UPDATE|DELETE)\b", "i"),
    ("py-pickle", "insecure-deserialization", "critical", "py", r"\b(pickle|cPickle|_pickle|marshal)\.(loads?|load)\s*\(", ""),
    ("py-yaml-load", "insecure-deserialization", "high", "py", r"\byaml\.load\s*\((?![^)]*(Safe|safe_))", ""),
    ("node-deserialize", "insecure-deserialization", "high", "js", r"\bnode-serialize|\bunserialize\s*\(", ""),
    ("weak-hash", "weak-crypto", "medium", "any", r"\b(md5|sha1)\s*\(|['\"]md5['\"]|['\"]sha1['\"]|createHash\s*\(\s*['\"](md5|sha1)", "i"),
    ("js-math-random", "weak-crypto", "low", "js", r"\bMath\.random\s*\(\)", ""),
    ("py-random", "weak-crypto", "low", "py", r"\brandom\.(random|randint|choice|randrange|getrandbits)\s*\(", ""),
    ("crypto-ecb", "weak-crypto", "high", "any", r"\bECB\b|MODE_ECB", ""),
    ("weak-cipher", "weak-crypto", "high", "any", r"\b(DES|3DES|RC4|MD4)\b", ""),
    ("py-verify-false", "tls", "high", "py", r"\bverify\s*=\s*False\b", ""),
    ("js-reject-unauth", "tls", "high", "js", r"rejectUnauthorized\s*:\s*false", ""),
    ("node-tls-env", "tls", "high", "any", r"NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*['\"]?0", ""),
    ("py-unverified-ssl", "tls", "high", "py", r"_create_unverified_context|ssl\.CERT_NONE", ""),
    ("js-innerhtml", "xss", "medium", "js", r"\.(innerHTML|outerHTML)\s*=\s*(?!['\"`]\s*['\"`]\s*;?\s*$)", ""),
    ("js-dangerously", "xss", "medium", "js", r"dangerouslySetInnerHTML", ""),
    ("js-doc-write", "xss", "medium", "js", r"document\.write\s*\(", ""),
    ("py-ssti", "ssti", "high", "py", r"render_template_string\s*\(", ""),
    ("py-mark-safe", "xss", "medium", "py", r"\b(mark_safe|Markup)\s*\(", ""),
    ("ssrf-js", "ssrf", "medium", "js", r"\b(fetch|axios|request|got)\s*\(\s*(?:`[^`]*\$\{|req\.|request\.|[a-zA-Z_$][\w$]*\s*[,)])", ""),
    ("ssrf-py", "ssrf", "medium", "py", r"\b(requests\.\w+|urlopen|httpx\.\w+)\s*\(\s*(?![\"'])[a-zA-Z_]", ""),
    ("flask-debug", "misconfiguration", "medium", "py", r"\.run\s*\([^)]*debug\s*=\s*True", ""),
    ("jwt-noverify", "auth", "high", "any", r"verify_signature\s*:\s*false|algorithms\s*=\s*\[\s*['\"]none['\"]|['\"]alg['\"]\s*:\s*['\"]none['\"]", "i"),
    ("py-assert-auth", "logic", "low", "py", r"\bassert\b[^\n=]*\b(auth|admin|permission|is_authenticated|is_admin|token|password)\b", "i"),
]
# Names of languages, and what gives a language away.
JS_NAMES = r"\b(js|javascript|jsx|ts|typescript|tsx|node)\b"
PY_NAMES = r"\b(py|python)\b"
PYTHONIC = r"\bdef\s+\w+\s*\(|^\s*import\s+\w|:\s*$"  # ^ and $ of lines
NOT_PYTHONIC = r"\b(function|const|let|=>)\b"
SCRIPTIC = r"\b(function|const|let|=>|require\(|import [^\n]* from)\b"
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def rules(spark) -> DataFrame:
    return spark.createDataFrame([(i, a, b, c, d, java(p, f)) for i, (a, b, c, d, p, f) in enumerate(RULES)], "ordinal int, rule_id string, category string, severity string, rule_lang string, pattern string")


def language(hint: Column, source: Column) -> Column:
    """js, py or unknown: by the hint, else by the text."""
    h = F.lower(F.coalesce(hint, F.lit("")))
    has = lambda c, p: F.rlike(c, F.lit(java(p, exact=True)))
    lined = java(PYTHONIC.replace("^", r"(?<![^\n])").replace("$", r"(?![^\n])"), exact=True)
    py, js = F.rlike(source, F.lit(lined)) & ~has(source, NOT_PYTHONIC), has(source, SCRIPTIC)
    return F.when(has(h, JS_NAMES), "js").when(has(h, PY_NAMES), "py").when(py, "py").when(js, "js").otherwise("unknown")


def lines(df: DataFrame, source: str, *keys: str) -> DataFrame:
    """(keys, line, text) of lines that aren't blank, from 1."""
    return df.select(*keys, F.posexplode(F.split(source, "\r?\n", -1)).alias("pos", "text")).where(F.trim("text") != "").select(*keys, (F.col("pos") + 1).alias("line"), "text")


def match_lines(at: DataFrame, *keys: str) -> DataFrame:
    """Findings of at(keys, lang, line, text): each rule's pattern is a literal, compiled once."""
    lang, text = F.col("lang"), F.col("text")
    one = lambda i, c, s: F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"))
    asked = lambda of: F.lit(True) if of == "any" else lang.isin(of, "unknown")
    every = F.array(*(F.when(asked(of) & F.rlike(text, F.lit(java(p, f))), one(i, c, s)) for i, c, s, of, p, f in RULES))
    hit = at.withColumn("_found", F.explode(F.filter(every, lambda x: x.isNotNull())))
    return hit.select(*keys, "line", "_found.*", F.substring(F.trim("text"), 1, 160).alias("code"))


def hardcoded(df: DataFrame, source: str, line, *keys: str) -> DataFrame:
    """Findings of the secret scan over whole sources; line(n) gives the line with n line ends before it."""
    found = df.withColumn("_f", F.explode(secrets.findings(F.coalesce(F.col(source), F.lit("")))))
    before = F.regexp_count(F.expr(f"substring(`{source}`, 1, _f.index)"), F.lit("\n"))
    return found.select(*keys, line(before).alias("line"), F.concat(F.lit("hardcoded-"), F.col("_f.id")).alias("rule_id"), F.lit("hardcoded-secret").alias("category"), "_f.severity", F.concat(F.lit("("), F.col("_f.type"), F.lit(": "), F.col("_f.preview"), F.lit(")")).alias("code"))


def with_secrets(df: DataFrame, source: str, key: str) -> DataFrame:
    """match_lines() of df(key, lang, source), and a hardcoded-<id> finding for each secret or piece of personal data in a source."""
    return match_lines(lines(df, source, key, "lang"), key).union(hardcoded(df, source, lambda n: n + 1, key))


def diff_findings(df: DataFrame, diff: str, key: str, hint: str | None = None) -> DataFrame:
    """Findings in what diffs add: language by hint or by the added text, secrets over all added lines together."""
    added = diff_lines(df, diff, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "line", "text"))).alias("_added"))
    if hint:
        added = added.join(df.groupBy(key).agg(F.first(hint).alias("_hint")), key)
    added = added.withColumn("source", F.array_join(F.transform("_added", lambda x: x["text"]), "\n"))
    added = added.withColumn("lang", language(F.col("_hint") if hint else F.lit(None).cast("string"), F.col("source")))
    own = match_lines(added.select(key, "lang", F.inline("_added")).where(F.trim("text") != ""), key)
    return own.union(hardcoded(added, "source", lambda n: F.get(F.transform("_added", lambda x: x["line"]), n), key))


def summarize(found: DataFrame, all_keys: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity and a verdict for each key, also for those without findings."""
    n = found.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY), F.count("*").alias("total"))
    out = all_keys.join(n, list(keys), "left").fillna(0, [*SEVERITY, "total"])
    verdict = F.when(F.col("critical") + F.col("high") > 0, "block").when(F.col("total") > 0, "review").otherwise("pass")
    return out.select(*keys, "total", *SEVERITY, verdict.alias("verdict"))


def diff_lines(df: DataFrame, diff: str, *keys: str) -> DataFrame:
    """(keys, pos, line, text) of lines that unified diffs add, with their places in the diff and numbers in the new file.

    A hunk header sets the number; added and context lines advance it, removed ones don't.
    """
    d = df.select(*keys, F.posexplode(F.split(diff, "\r?\n", -1)).alias("pos", "raw"))
    w = Window.partitionBy(*keys).orderBy("pos")
    start = F.nullif(F.regexp_extract("raw", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1), F.lit("")).cast("int")
    header = F.col("raw").startswith("+++") | F.col("raw").startswith("---")
    d = d.withColumn("start", start).withColumn("hunk", F.count("start").over(w))
    steps = F.when(F.col("start").isNotNull() | header | F.col("raw").startswith("-"), 0).otherwise(1)
    inside = Window.partitionBy(*keys, "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("line", (F.coalesce(F.max("start").over(Window.partitionBy(*keys, "hunk")), F.lit(0)) + F.coalesce(F.sum(steps).over(inside), F.lit(0))).cast("int"))
    return d.where(F.col("raw").startswith("+") & ~header).select(*keys, "pos", "line", F.expr("substring(raw, 2)").alias("text"))
