"""The event ledger, verdict cache, reports and rule bundles."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import verdicts


def sanitize(text: Column, most: int = 120) -> Column:
    """Control characters become spaces; the rest is cut."""
    return F.substring(F.regexp_replace(text, r"[\x00-\x1F\x7F]", " "), 1, most)


def record(events: DataFrame) -> DataFrame:
    """Only the ledger's fields, with their lengths bounded: rules and skipped to 12 entries. Engine, source, findings and ms may be there."""
    more = [sanitize(F.col(c), 40).alias(c) for c in ("engine", "source") if c in events.columns] + [F.col(c) for c in ("findings", "ms") if c in events.columns]
    return events.select("ts", sanitize(F.col("event"), 40).alias("event"), sanitize(F.col("verdict"), 20).alias("verdict"), sanitize(F.col("action"), 20).alias("action"), sanitize(F.col("subject")).alias("subject"), F.slice("rules", 1, 12).alias("rules"), F.slice("skipped", 1, 12).alias("skipped"), *more)


def caught() -> Column:
    return verdicts.rank(F.col("verdict"), verdicts.LEDGER) >= 2


def stats(ledger: DataFrame) -> DataFrame:
    """One row: checks, caught, blocked, reported, incomplete, first, last."""
    return ledger.agg(
        F.count("*").alias("checks"), F.count_if(caught()).alias("caught"), F.count_if(caught() & F.col("action").eqNullSafe("blocked")).alias("blocked"),
        F.count_if(caught() & ~F.col("action").eqNullSafe("blocked")).alias("reported"), F.count_if(F.size("skipped") > 0).alias("incomplete"), F.min("ts").alias("first"), F.max("ts").alias("last"),
    )


def by_rule(ledger: DataFrame, most: int = 10) -> DataFrame:
    """(rule, n): the rules named most often, ties by name."""
    return ledger.where(caught()).select(F.explode("rules").alias("rule")).groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(most)


def latest_caught(ledger: DataFrame, most: int = 15) -> DataFrame:
    return ledger.where(caught()).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def windows(ledger: DataFrame, size: str = "1 day", step: str | None = None) -> DataFrame:
    """Checks and catches by window; sliding with a step."""
    w = F.window("ts", size, step) if step else F.window("ts", size)
    return ledger.groupBy(w.alias("w"), "event").agg(F.count("*").alias("checks"), F.count_if(caught()).alias("caught")).select(F.col("w.start").alias("start"), "event", "checks", "caught")


def cache_latest(checks: DataFrame) -> DataFrame:
    """(key, verdict, at): each key's last verdict."""
    return checks.groupBy("key").agg(F.max(F.struct("at", "id", "verdict")).alias("x")).select("key", "x.verdict", "x.at")


def cache_evict(cache: DataFrame, most: int) -> DataFrame:
    """The newest `most` entries; older ones go first, ties by key. A top-k, not a full sort."""
    return cache.orderBy(F.desc("at"), "key").limit(most)


def age_days(at: Column, as_of: str) -> Column:
    return F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000)


def corpus_report(cases: DataFrame) -> DataFrame:
    """Rows by category and for all: attacks, caught, missed, rate, quiet, false_positives; cases(category, expect, detected)."""
    attack = F.col("expect") != "quiet"
    out = cases.rollup("category").agg(F.count_if(attack).alias("attacks"), F.count_if(attack & F.col("detected")).alias("caught"), F.count_if(~attack).alias("quiet"), F.count_if(~attack & F.col("detected")).alias("false_positives"))
    return out.withColumn("category", F.coalesce("category", F.lit("all"))).withColumn("rate", F.when(F.col("attacks") > 0, F.floor(F.col("caught") * 100 / F.col("attacks") + 0.5).cast("int")))


def gate(results: DataFrame, fail_on: str = "danger") -> DataFrame:
    """(exit_code): 1 where some verdict reaches the level that fails."""
    least = verdicts.LEVEL[fail_on]
    return results.agg(F.max((verdicts.rank(F.col("verdict"), verdicts.LEVEL) >= least).cast("int")).alias("exit_code"))


# --- rule bundles


def version_parts(version: Column) -> Column:
    """array of four numbers: missing parts are 0."""
    parts = F.transform(F.split(version, r"\."), lambda x: x.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.coalesce(F.get(parts, i), F.lit(0)))


def compare_versions(a: Column, b: Column) -> Column:
    x, y = version_parts(a), version_parts(b)
    return F.when(x > y, 1).when(x < y, -1).otherwise(0)


def build_malicious(advisories: DataFrame) -> DataFrame:
    """(ecosystem, name, versions, advisory) of advisories(ecosystem, name, version, id, withdrawn): null versions mean all."""
    own = advisories.where(F.col("id").startswith("MAL-") & ~F.coalesce("withdrawn", F.lit(False)))
    out = own.groupBy("ecosystem", "name").agg(F.sort_array(F.collect_set("version")).alias("versions"), F.max(F.col("version").isNull()).alias("whole"), F.min("id").alias("advisory"))
    return out.select("ecosystem", "name", F.when(~F.col("whole"), F.col("versions")).alias("versions"), "advisory")


def carry_forward(old: DataFrame, new: DataFrame, failed: list[str]) -> DataFrame:
    """(list, address): new rows, and the old ones of lists that could not be fetched."""
    return new.where(~F.col("list").isin(failed)).union(old.where(F.col("list").isin(failed)))


def stale(sources: DataFrame, as_of: str, most: int = 7) -> DataFrame:
    """sources(id, ok, fetched) with age_days and stale."""
    age = age_days(F.col("fetched"), as_of)
    return sources.withColumn("age_days", age).withColumn("stale", ~F.col("ok") | F.coalesce(age > most, F.lit(True)))


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, fingerprint): a digest of contents that doesn't depend on their order: of the sums of eight parts of rows' hashes.

    Sums are made before the shuffle and nothing is collected. For up to 2**31 rows.
    """
    d = rows.select(F.sha2(F.concat_ws("\x1f", *columns), 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")), F.lit(0)).alias(f"s{k}") for k in range(8)]
    return d.agg(F.count("*").alias("n"), *parts).select("n", F.sha2(F.concat_ws(":", "n", *(f"s{k}" for k in range(8))), 256).alias("fingerprint"))


def popular_names(ranked: DataFrame, most: int = 3000) -> DataFrame:
    """(ecosystem, rank, name): the first names in order; PyPI's are normalised and kept once."""
    canon = F.when(F.col("ecosystem") == "pypi", F.lower(F.regexp_replace("name", "[-_.]+", "-"))).otherwise(F.col("name"))
    once = ranked.select("ecosystem", canon.alias("name"), "rank").groupBy("ecosystem", "name").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("ecosystem").orderBy("rank", "name"))
    return once.withColumn("rank", place).where(F.col("rank") <= most)


# Bounds of a bundle.
LARGEST, MOST_RULES, LONGEST_PATTERN = 12 * 1024 * 1024, 500, 2000
VERSION = r"^\d{4}\.\d{2}\.\d{2}(\.\d+)?$"


def nested_quantifier(pattern: str) -> bool:
    """Whether an unbounded repetition stands around another: such a rule could take for ever."""
    depth: list[bool] = []
    pattern = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "x", pattern)
    for i, c in enumerate(pattern):
        if c == "(":
            depth.append(False)
        elif c == ")" and depth:
            inner = depth.pop()
            after = pattern[i + 1 : i + 2]
            loops = after in ("*", "+") or after == "{" and bool(re.match(r"\{\d+,\}", pattern[i + 1 :]))
            if loops and inner:
                return True
            if depth and (inner or loops):
                depth[-1] = True
        elif (c in "*+" or c == "{" and re.match(r"\{\d+,\}", pattern[i:])) and depth and (not i or pattern[i - 1] != ")"):
            depth[-1] = True
    return False


def validate_bundle(bundle: object) -> list[str]:
    """What is wrong with a bundle {schema, version, rulesets: {name: [rules]}, lists}; empty: nothing."""
    if not isinstance(bundle, dict):
        return ["not an object"]
    errors = []
    if len(json.dumps(bundle)) > LARGEST:
        errors.append("too large")
    if bundle.get("schema") != 1:
        errors.append("schema is not 1")
    if not re.match(VERSION, str(bundle.get("version", ""))):
        errors.append("bad version")
    sets = bundle.get("rulesets")
    if not isinstance(sets, dict):
        return [*errors, "no rulesets"]
    for name, rules in sets.items():
        if name in ("__proto__", "constructor", "prototype"):
            errors.append(f"forbidden name {name}")
            continue
        if not isinstance(rules, list) or not rules:
            errors.append(f"{name}: empty")
            continue
        if len(rules) > MOST_RULES:
            errors.append(f"{name}: more than {MOST_RULES} rules")
            continue
        seen = set()
        for r in rules:
            i = r.get("id") if isinstance(r, dict) else None
            if not isinstance(i, str) or not re.fullmatch(r"[a-z0-9-]{1,64}", i):
                errors.append(f"{name}: bad id")
                continue
            if i in seen:
                errors.append(f"{name}/{i}: twice")
            seen.add(i)
            if "weight" in r and not (isinstance(r["weight"], int) and 0 <= r["weight"] <= 100):
                errors.append(f"{name}/{i}: bad weight")
            if "severity" in r and r["severity"] not in ("critical", "high", "medium", "low"):
                errors.append(f"{name}/{i}: bad severity")
            if not re.fullmatch("[gimsuy]*", str(r.get("flags", ""))):
                errors.append(f"{name}/{i}: bad flags")
            if len(str(r.get("pattern"))) > LONGEST_PATTERN:
                errors.append(f"{name}/{i}: pattern too long")
                continue
            try:
                groups = re.compile(r.get("pattern") or "(").groups
            except (re.error, TypeError):
                errors.append(f"{name}/{i}: bad pattern")
                continue
            if nested_quantifier(r["pattern"]):
                errors.append(f"{name}/{i}: could run for ever")
            if not 0 <= r.get("value_group", 0) <= groups:
                errors.append(f"{name}/{i}: no such group")
    return errors
