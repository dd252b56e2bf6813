"""python -m tamis scan DIR | diff FILE | stats LEDGER  [--fail-on any|warn|danger]: JSON, and exit code 1 at that level."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import verdicts
from .operators import code, content, ledger
from .session import local_session
from .sources import files


def scan_files(found: DataFrame) -> DataFrame:
    """(path, verdict, code, text): the worst of both scans of files(path, content)."""
    d = found.withColumn("lang", code.language(F.element_at(F.split("path", r"\."), -1), F.col("content")))
    own = code.summarize(code.with_secrets(d, "content", "path"), d.select("path"), "path").select("path", F.when(F.col("verdict") == "pass", "ok").otherwise(F.col("verdict")).alias("code"))
    texts = content.scan(d, "content").select("path", F.col("verdict").alias("text"))
    return own.join(texts, "path").select("path", verdicts.worst(F.col("code"), F.col("text")).alias("verdict"), "code", "text").orderBy("path")


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="tamis", description=__doc__)
    p.add_argument("command", choices=["scan", "diff", "stats"])
    p.add_argument("path")
    p.add_argument("--fail-on", choices=["any", "warn", "danger"], default="danger")
    p.add_argument("--since")
    a = p.parse_args(args)
    spark = local_session()
    if a.command == "stats":
        print(json.dumps(ledger.stats(files.ledger(spark, a.path, a.since).where("_corrupt is null")).first().asDict(), default=str))
        return 0
    if a.command == "scan":
        out = scan_files(files.tree(spark, a.path))
    else:
        diffs = files.diff_files(spark.read.text(a.path, wholetext=True), "value").withColumnRenamed("file", "path")
        out = code.summarize(code.diff_findings(diffs, "diff", "path"), diffs.select("path"), "path").orderBy("path")
    out = out.cache()
    for line in out.toJSON().toLocalIterator():
        print(line)
    return ledger.gate(out, a.fail_on).first().exit_code or 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
