"""The 31 tools by name, each over a whole DataFrame: run(name, df, ...) stamps the rules' version on every row.

Local tools need the table alone. Those that ask for facts (ages, lists, registries, responses) take them as
tables; what isn't given is not checked, and says so in its columns.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.dialect import java
from .operators import code, content, email, feed, packages, payments, secrets, urls, web


class Tool(NamedTuple):
    area: str
    kind: str  #: L local, M local with facts from outside, R facts from outside only
    run: Callable[..., DataFrame]


def _code(df: DataFrame, source: str = "code", hint: str = "hint", key: str = "id") -> DataFrame:
    d = df.withColumn("lang", code.language(F.col(hint), F.col(source)))
    found = code.with_secrets(d, source, key)
    return code.summarize(found, df.select(key), key).join(found.groupBy(key).agg(F.collect_list(F.struct("line", "rule_id", "category", "severity", "code")).alias("findings")), key, "left")


def _diff(df: DataFrame, diff: str = "diff", key: str = "id", hint: str | None = None) -> DataFrame:
    return code.summarize(code.diff_findings(df, diff, key, hint), df.select(key), key)


def _catalog(df: DataFrame) -> DataFrame:
    own = code.rules(df.sparkSession).select("rule_id", "category", "severity", F.col("rule_lang").alias("lang"))
    return own.union(df.sparkSession.createDataFrame([("hardcoded-*", "hardcoded-secret", "critical", "any")], own.schema))


def _url(df: DataFrame, url: str = "url", rdap: DataFrame | None = None, as_of: str = "1970-01-01") -> DataFrame:
    return urls.verdict(urls.with_age(urls.analyze(df, url), rdap, as_of))


def _payment(df: DataFrame, url: str = "url", final_url: str | None = None, rdap: DataFrame | None = None, as_of: str = "1970-01-01") -> DataFrame:
    return urls.payment_verdict(urls.with_age(urls.analyze(df, url), rdap, as_of), final_url)


def _squat(df: DataFrame, registered: DataFrame, name: str = "name", most: int = 20) -> DataFrame:
    v = df.select(name, F.explode(F.slice(packages.typosquats(F.col(name)), 1, most)).alias("variant"))
    return v.join(registered.select(F.col("name").alias("variant")).distinct(), "variant", "left_semi").groupBy(name).agg(F.sort_array(F.collect_set("variant")).alias("matches"))


TOOLS: dict[str, Tool] = {
    "scan_content": Tool("text", "L", content.scan), "scan_secrets": Tool("text", "L", secrets.scan), "check_url": Tool("text", "M", _url), "check_ip": Tool("text", "R", urls.reputation), "check_password": Tool("text", "R", urls.pwned),
    "scan_code": Tool("code", "L", _code), "scan_diff": Tool("code", "L", _diff), "list_rules": Tool("code", "L", _catalog),
    "verify_package": Tool("packages", "R", packages.verify), "check_vulns": Tool("packages", "R", packages.vulnerabilities), "package_info": Tool("packages", "R", packages.info), "audit_deps": Tool("packages", "R", packages.audit), "typosquat_scan": Tool("packages", "R", _squat),
    "screen_address": Tool("payments", "R", payments.screen_address), "screen_payment": Tool("payments", "M", _payment), "check_sanctioned": Tool("payments", "R", payments.check_sanctioned), "resolve_name": Tool("payments", "R", payments.resolve_name), "screen_token": Tool("payments", "R", payments.screen_token),
    "scan_inbound": Tool("email", "M", email.inbound), "scan_outbound": Tool("email", "M", email.outbound), "check_domain_auth": Tool("email", "R", email.domain_posture),
    "read_url": Tool("web", "R", lambda df, html="html": df.withColumn("page", web.read_page(html))), "unfurl_url": Tool("web", "R", web.metadata), "validate_email": Tool("web", "R", email.validate), "extract_web": Tool("web", "R", web.css_extract), "get_feed": Tool("web", "R", web.feed_items),
    "dns_lookup": Tool("web", "R", web.dns_pivot), "domain_info": Tool("web", "R", web.rdap_facts), "ssl_check": Tool("web", "R", web.certificate_facts), "http_inspect": Tool("web", "R", web.redirect_chain), "structured_data": Tool("web", "R", web.structured),
}


def fed_rules(spark, bundle: dict, ruleset: str = "injection") -> DataFrame:
    """A bundle's rules as content.scan_with() takes them."""
    rows = [(k, r["id"], r.get("category", ruleset), r.get("weight", 0), java(r["pattern"], r.get("flags", ""), exact=True)) for k, r in enumerate(bundle["rulesets"][ruleset])]
    return spark.createDataFrame(rows, "ordinal int, id string, category string, weight int, pattern string")


def status(bundle: dict | None = None) -> dict:
    """Which rules are in use: version, provenance, counts by ruleset, and sources that could not be read when they were built."""
    own = {"injection": len(content.RULES), "code": len(code.RULES), "secrets": len(secrets.RULES)}
    counts = own | ({k: len(v) for k, v in bundle["rulesets"].items()} if bundle else {})
    stale = [s["id"] for s in (bundle or {}).get("sources", []) if not s.get("ok")]
    return {"version": bundle["version"] if bundle else feed.RULES_VERSION, "provenance": feed.Outcome("", bundle=bundle).provenance, "rules": counts, "stale_sources": stale}


def run(name: str, df: DataFrame, *args, bundle: dict | None = None, **options) -> DataFrame:
    """The tool's result with rules_version and rules_provenance; unknown names raise KeyError.

    bundle: a rules bundle that was applied. Its phrase rules take the place of the compiled-in ones in scan_content; the
    other tools have no fed rules here and keep theirs.
    """
    if bundle and name == "scan_content" and bundle["rulesets"].get("injection"):
        out = content.scan_with(df, fed_rules(df.sparkSession, bundle), *args, **options)
        version = bundle["version"]
    else:
        out, version, bundle = TOOLS[name].run(df, *args, **options), feed.RULES_VERSION, None
    return out.withColumn("rules_version", F.lit(version)).withColumn("rules_provenance", F.lit(feed.Outcome("", bundle=bundle).provenance))
