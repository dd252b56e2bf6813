"""Sources, sinks and streams as queries: tables are written in the formats and read back by the engine's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as sql_functions
from ..functions.dialect import quoted
from ..functions.frames import plain, run
from ..functions.staging import new_folder
from ..operators import content, email, packages
from ..operators import ledger as lg
from ..sources import archives, files
from ..streaming import ledger as stream
from . import ledger as ledgers
from . import packages as package_plans
from . import payments, secrets


def _written(spark, sf, label):
    """The ledger made from events, as JSON lines."""
    path = new_folder(spark, label)
    files.write_ledger(ledgers._ledger(spark, sf).withColumn("source", F.col("id").cast("string")), path)
    return path


def source_ledger(spark, sf):
    """JSON lines, sink and source: lengths are bounded by the sink."""
    d = files.ledger(spark, _written(spark, sf, "ledger"), "2024-01-10").where("_corrupt is null")
    return d.select(F.col("source").cast("long").alias("id"), "ts", "event", "verdict", "action", "subject", F.array_join("rules", ",").alias("rules"), F.size("skipped").alias("skipped"))


def source_malicious_tsv(spark, sf):
    path = new_folder(spark, "tsv")
    files.write_malicious_tsv(lg.build_malicious(run(spark, sf, ledgers.ADVISORIES)), path)
    return files.malicious_tsv(spark, path).select("ecosystem", "name", F.array_join("versions", ",").alias("versions"), "advisory")


LINES = "SELECT CASE c_custkey % 4 WHEN 0 THEN '# list' WHEN 1 THEN ' 0x' || lpad(CAST(c_custkey AS STRING), 40, 'A') || ' ' WHEN 2 THEN '0x12' ELSE '0x' || lpad(CAST(c_custkey AS STRING), 40, 'b') END AS value FROM {customer}"


def source_address_list(spark, sf):
    path = new_folder(spark, "addresses")
    run(spark, sf, LINES).write.text(path)
    return files.address_list(spark, path, "ETH")


def source_scam_list(spark, sf):
    """JSON arrays of objects and strings, one array a file."""
    path = new_folder(spark, "scams")
    item = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(F.col("url").alias("address")))).when(F.col("id") % 3 == 1, F.to_json(F.struct(F.col("url").alias("address"), F.lit("c").alias("comment")))).otherwise(F.concat(F.lit('"'), F.col("url"), F.lit('"')))
    d = run(spark, sf, "SELECT s_suppkey AS id, '0xAb' || CAST(s_suppkey AS STRING) AS url FROM {supplier}").groupBy((F.col("id") % 8).alias("b")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("value"))
    d.repartition("b").write.partitionBy("b").text(path)
    return files.scam_list(spark, path + "/*", "dark", 2)


def source_manifest(spark, sf):
    return files.dependencies(run(spark, sf, package_plans.GIVEN), "manifest", "id")


def source_bundle(spark, sf):
    """A bundle of the compiled-in phrase rules, written as its bytes."""
    path = new_folder(spark, "bundle")
    bundle = {"schema": 1, "version": "2026.08.22", "rulesets": {"injection": [{"id": i, "category": c, "pattern": p, "flags": "i", "weight": w} for i, c, w, p in content.RULES]}}
    spark.createDataFrame([(archives.bundle_bytes(bundle).decode().strip(),)], "value string").write.text(path)
    return files.bundle_rules(spark, path).select("version", "ruleset", "ordinal", "id", "category", "weight", "pattern")


def _advisory_files(spark, sf):
    path = new_folder(spark, "osv")
    d = run(spark, sf, ledgers.ADVISORIES).withColumn("b", F.abs(F.hash("name")) % 16)
    package = F.struct(F.struct("ecosystem", "name").alias("package"), F.when(F.col("version").isNotNull(), F.array("version")).alias("versions"))
    one = F.to_json(F.struct("id", F.when(F.col("withdrawn"), F.lit("2024-01-01")).alias("withdrawn"), F.array(package).alias("affected")))
    d.groupBy("b").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value")).repartition("b").write.partitionBy("b").text(path)
    return path


def source_osv(spark, sf):
    """Advisory files to the list of malicious packages."""
    built = lg.build_malicious(files.osv_advisories(spark, _advisory_files(spark, sf)))
    return built.select("ecosystem", "name", F.array_join("versions", ",").alias("versions"), "advisory")


def source_file_tree(spark, sf):
    """A folder of text files: each one's content, by the folder it lies in."""
    path = new_folder(spark, "tree")
    d = run(spark, sf, "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'node_modules' WHEN doc_id % 7 = 1 THEN 'build' ELSE 'src' || CAST(doc_id % 16 AS STRING) END AS folder, 'x = ' || CAST(doc_id AS STRING) AS value FROM {documents}")
    for folder in ("node_modules", "build"):
        d.where(F.col("folder") == folder).select("value").write.text(f"{path}/{folder}")
    d.where("folder like 'src%'").repartition("folder").sortWithinPartitions("folder", "doc_id").select("value", "folder").write.mode("append").partitionBy("folder").text(path)
    t = files.tree(spark, path, None)
    return t.select(F.regexp_extract("path", "folder=([a-z0-9]+)/", 1).alias("folder"), F.col("length").cast("long").alias("length"), F.md5("content").alias("content_md5"))


DIFFS = "SELECT doc_id, 'From x' || chr(10) || 'diff --git a/a' || CAST(doc_id AS STRING) || '.py b/a.py' || chr(10) || '--- a/a.py' || chr(10) || '+++ b/a' || CAST(doc_id AS STRING) || '.py' || chr(10) || '@@ -1 +1 @@' || chr(10) || '+x' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'diff --git a/b b/b' || chr(10) || '+++ b/b' || chr(10) || '+y' || chr(10) ELSE '' END AS diff FROM {documents}"


def source_diff(spark, sf):
    return files.diff_files(run(spark, sf, DIFFS), "diff", "doc_id").select("doc_id", "file", F.length("diff").alias("chars"))


def cache_upserts(spark, sf):
    """Three updates of the verdict cache, each a new version; the oldest entries beyond 30 go."""
    path, version = new_folder(spark, "cache"), None
    for k in range(3):
        version = archives.upsert_cache(run(spark, sf, ledgers.CHECKS).where(F.col("id") % 3 == k).groupBy("key", "at").agg(F.max("verdict").alias("verdict")), path, version, 30)
    return archives.read_cache(spark, path, version).select("key", "at")


def stream_ledger_windows(spark, sf):
    """The ledger read as a stream, counted by event time; the last batch's complete result."""
    path, out = _written(spark, sf, "ledger"), new_folder(spark, "counts")
    write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/result")
    q = stream.counts(stream.read(spark, path, 3)).writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result")


def stream_verdict_cache(spark, sf):
    """Keyed state over the stream: each subject's latest verdict time, whatever the order of files."""
    path, out = _written(spark, sf, "ledger"), new_folder(spark, "latest")
    write = lambda df, n: df.write.mode("append").parquet(f"{out}/result")
    q = stream.cache_updates(stream.read(spark, path, 3)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/result").groupBy("key").agg(F.max("at").alias("at"))


def stream_scan(spark, sf):
    """Texts scanned batch by batch with rules that are read for each."""
    path, out = new_folder(spark, "texts"), new_folder(spark, "scanned")
    run(spark, sf, "SELECT doc_id, text FROM {documents}").write.json(path)
    rules = lambda s: s.createDataFrame([(0, "a", "x", 20, "(?i)the"), (1, "b", "y", 30, "(?i)and the")], "ordinal int, id string, category string, weight int, pattern string")
    texts = spark.readStream.schema("doc_id long, text string").json(path)
    q = stream.scan_stream(texts, rules, lambda df, n: df.select("doc_id", "score", "verdict").write.mode("append").parquet(f"{out}/result"))
    q.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/result")


def sql_registered(spark, sf):
    """The parsers called from SQL text."""
    sql_functions.register(spark)
    run(spark, sf, secrets.SALTED).createOrReplaceTempView("tamis_salted")
    return spark.sql("SELECT doc_id, redact_spans(text).n AS n, is_private_ip('10.0.0.' || CAST(doc_id % 256 AS STRING)) AS private FROM tamis_salted")


def content_catalog(spark, sf):
    return content.catalog(spark)


WORDS = "SELECT c_custkey AS id, c_name FROM {customer}"


def header_words(spark, sf):
    """Encoded words of headers: Base64, quoted and plain, also in a row."""
    raw = F.concat(F.lit("Subject: =?utf-8?B?"), F.base64(F.encode("c_name", "UTF-8")), F.lit("?= =?UTF-8?q?_caf=C3=A9_?= plain"), F.when(F.col("id") % 2 == 0, F.lit("\n =?x?q?=41?=")).otherwise(F.lit("")), F.lit("\n\nbody"))
    return run(spark, sf, WORDS).withColumn("m", email.parse_raw(raw)).select("id", "m.subject")


def npm_names_known(spark, sf):
    """A newline list as a source, and which names are on it."""
    path = new_folder(spark, "names")
    run(spark, sf, package_plans.POPULAR).where("ecosystem = 'npm'").select(F.concat("name", F.lit(" ")).alias("value")).write.text(path)
    listed = spark.read.text(path).select(F.lit("npm").alias("ecosystem"), F.trim("value").alias("name"), F.lit(None).cast("array<string>").alias("versions"))
    names = run(spark, sf, package_plans.VERSIONED)
    return packages.malicious(names, listed).select("id", "list_verdict")

_s = ledgers._s
_L = f"({_s(ledgers.LEDGER)})"
_rules = "list_filter(['rule-' || r1, CASE WHEN r2 = 0 THEN 'rule-x' || r1 END], lambda x: x IS NOT NULL)"
_clean = lambda c, n: f"substr(regexp_replace({c}, '[\\x00-\\x1F\\x7F]', ' ', 'g'), 1, {n})"
_b, _c = f"({plain(package_plans.GIVEN).replace('AS STRING', 'AS VARCHAR')})", content.RULES
_phrases = ", ".join(f"({k}, {quoted(i)}, {quoted(c)}, {w}, {quoted(p)})" for k, (i, c, w, p) in enumerate(_c))
_signals = "('zero-width-chars', 30), ('bidi-override', 30), ('unicode-tag-smuggling', 35), ('hidden-html', 20), ('html-comment-instruction', 20)"
_tree = "SELECT 'src' || doc_id % 16 AS folder, doc_id FROM documents WHERE doc_id % 7 > 1"
_newest = f"SELECT key, max(\"at\") AS \"at\" FROM ({_s(ledgers.CHECKS)}) GROUP BY key"
QUERIES = {f.__name__: f for f in (source_ledger, source_malicious_tsv, source_address_list, source_scam_list, source_manifest, source_bundle, source_osv, source_file_tree, source_diff, cache_upserts, stream_ledger_windows, stream_verdict_cache, stream_scan, sql_registered, content_catalog, header_words, npm_names_known)}
SQL = {
    "source_ledger": f"SELECT id, ts, {_clean('event', 40)} AS event, verdict, action, {_clean('subject', 120)} AS subject, array_to_string({_rules}, ',') AS rules, CASE WHEN sk = 0 THEN 1 ELSE 0 END AS skipped FROM {_L} WHERE ts >= TIMESTAMP '2024-01-10'",
    "source_malicious_tsv": ledgers.SQL["malicious_build"],
    "source_address_list": f"SELECT 'ETH' AS list, lower(trim(value)) AS address FROM ({_s(LINES)}) WHERE regexp_matches(trim(value), '^0x[0-9a-fA-F]{{40}}$')",
    "source_scam_list": "SELECT 2 AS \"order\", 'dark' AS list, '0xab' || s_suppkey AS address, CASE WHEN s_suppkey % 3 = 1 THEN 'c' ELSE '' END AS reason FROM supplier",
    "source_manifest": f"SELECT id, 'a' AS name, '2' AS version FROM {_b} WHERE id % 4 = 0 UNION ALL SELECT id, 'shared', '1.0' FROM {_b} WHERE id % 4 = 0 UNION ALL SELECT id, 'd' || id, '>=3' FROM {_b} WHERE id % 4 = 0",
    "source_bundle": f"SELECT '2026.08.22' AS version, 'injection' AS ruleset, ordinal, id, category, weight, pattern FROM (VALUES {_phrases}) AS t(ordinal, id, category, weight, pattern)",
    "source_osv": ledgers.SQL["malicious_build"],
    "source_file_tree": f"SELECT folder, sum(length('x = ' || doc_id) + 1)::BIGINT AS length, md5(string_agg('x = ' || doc_id || chr(10), '' ORDER BY doc_id)) AS content_md5 FROM ({_tree}) GROUP BY folder",
    "source_diff": f"SELECT doc_id, file, length(d)::INT AS chars FROM (SELECT doc_id, 'a' || doc_id || '.py' AS file, regexp_extract(diff, '(?s)(diff --git a/a.*?\\n\\+x\\n)', 1) AS d FROM ({_s(DIFFS)}) UNION ALL SELECT doc_id, 'b', regexp_extract(diff, '(?s)(diff --git a/b .*)', 1) FROM ({_s(DIFFS)}) WHERE doc_id % 2 = 0)",
    "cache_upserts": f"SELECT key, \"at\" FROM ({_newest}) ORDER BY \"at\" DESC, key LIMIT 30",
    "stream_ledger_windows": ledgers.SQL["ledger_window"],
    "stream_verdict_cache": f"SELECT {_clean('subject', 120)} AS key, max(ts) AS \"at\" FROM {_L} GROUP BY 1",
    "stream_scan": "SELECT doc_id, score, CASE WHEN score >= 35 THEN 'block' WHEN score >= 15 THEN 'review' ELSE 'allow' END AS verdict FROM (SELECT doc_id, (CASE WHEN regexp_matches(text, '(?i)the') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)and the') THEN 30 ELSE 0 END)::INT AS score FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
    "sql_registered": f"SELECT doc_id, n, TRUE AS private FROM ({secrets.SQL['scan_secrets_spans']})",
    "content_catalog": f"SELECT id AS rule_id, category, weight, 'phrase' AS kind FROM (VALUES {_phrases}) AS t(ordinal, id, category, weight, pattern) UNION ALL SELECT *, 'signal' FROM (SELECT id, 'obfuscation', w FROM (VALUES {_signals}) AS u(id, w))",
    "header_words": "SELECT c_custkey AS id, c_name || ' caf' || chr(233) || '  plain' || CASE WHEN c_custkey % 2 = 0 THEN ' A' ELSE '' END AS subject FROM customer",
    "npm_names_known": f"SELECT id, CASE WHEN ecosystem = 'npm' AND name IN (SELECT name FROM ({_s(package_plans.POPULAR)}) WHERE ecosystem = 'npm') THEN 'malicious' ELSE 'clear' END AS list_verdict FROM ({_s(package_plans.VERSIONED)})",
}
