"""URLs, hosts and IP addresses: parts, flags and scores; reputation joins.

One pattern takes a URL apart, so that batches stay in the JVM. Addresses are numbers, and ranges are a table
of fixed size. Facts from outside (ages, exit lists, block lists) are tables; without one the fact is null,
the check is listed as skipped, and the verdict can only become more careful.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import verdicts
from ..functions.frames import small

# Domains that are abused often, shorteners, imitated brands.
SUSPICIOUS_TLDS = "zip mov top xyz gq tk ml cf work click link country kim review loan date racing stream win bid rest cam quest".split()
SHORTENERS = "bit.ly tinyurl.com t.co goo.gl ow.ly is.gd buff.ly rebrand.ly cutt.ly shorturl.at rb.gy t.ly tiny.cc bl.ink".split()
BRANDS = "paypal apple microsoft google amazon netflix facebook instagram coinbase binance metamask wellsfargo chase bankofamerica".split()
DATACENTER = r"(?i)amazon|aws|google|gcp|microsoft|azure|digitalocean|linode|ovh|hetzner|vultr|cloudflare|oracle|alibaba|tencent|hosting|server|data ?cent"
# IPv4 ranges that are not public.
PRIVATE = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.168.0.0/16 192.0.0.0/24 192.0.2.0/24 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 100.64.0.0/10 224.0.0.0/3".split()

URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:@\s]+)(?::([0-9]*))?([/?#][^\s]*)?\z"
IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\z"


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with valid, scheme, userinfo, host, port, labels and tld."""
    part = lambda i: F.regexp_extract(F.coalesce(F.col(url), F.lit("")), URL, i)
    df = df.withColumn("valid", F.coalesce(F.rlike(F.col(url), F.lit(URL)), F.lit(False)))
    df = df.withColumns({"scheme": F.lower(part(1)), "userinfo": part(2), "host": F.lower(part(3)), "port": part(4)})
    df = df.withColumn("labels", F.size(F.split("host", r"\.")))
    return df.withColumn("tld", F.element_at(F.split("host", r"\."), -1))


def analyze(df: DataFrame, url: str = "url") -> DataFrame:
    """parts() with flags and score; invalid URLs have the flag invalid-url and score 40."""
    df = parts(df, url)
    sld = F.when(F.col("labels") >= 2, F.element_at(F.split("host", r"\."), -2)).otherwise("")
    host = F.col("host")
    brand = F.lit(None).cast("string")
    for b in reversed(BRANDS):
        brand = F.when(host.contains(b) & (sld != b), b).otherwise(brand)
    df = df.withColumn("brand", F.when(F.col("valid"), brand))
    ids, score = verdicts.flags(
        ("no-https", F.col("scheme") != "https", 12),
        ("ip-as-host", F.rlike(host, F.lit(IPV4)), 25),
        ("punycode", host.contains("xn--"), 25),
        ("userinfo-in-url", F.col("userinfo") != "", 25),
        ("suspicious-tld", F.col("tld").isin(SUSPICIOUS_TLDS), 18),
        ("url-shortener", host.isin(SHORTENERS), 10),
        ("excessive-subdomains", F.col("labels") > 5, 15),
        ("long-host", F.length(host) > 50, 8),
        ("nonstandard-port", ~F.col("port").isin("", "80", "443"), 8),
        ("brand-lookalike", F.col("brand").isNotNull(), 28),
        ("non-ascii-host", F.rlike(host, F.lit(r"[^\x00-\x7F]")), 15),
    )
    df = df.withColumn("flags", F.when(F.col("valid"), ids).otherwise(F.array(F.lit("invalid-url"))))
    return df.withColumn("score", F.when(F.col("valid"), score).otherwise(40).cast("int"))


def with_age(df: DataFrame, rdap: DataFrame | None, as_of: str) -> DataFrame:
    """df with domain_age_days: whole 24 hours from rdap(domain, registered_at) to as_of; null without the table or a row."""
    if rdap is None:
        return df.withColumn("domain_age_days", F.lit(None).cast("long"))
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("registered_at").cast("timestamp"))) / 86_400_000_000)
    rdap = rdap.select(F.col("domain").alias("_domain"), age.alias("domain_age_days"))
    return df.withColumn("_site", F.substring_index("host", ".", -2)).join(small(rdap), F.col("_site") == F.col("_domain"), "left").drop("_domain", "_site")


def verdict(df: DataFrame) -> DataFrame:
    """check_url: new domains add 25; from 50 malicious, from 25 suspicious. Invalid ones are malicious."""
    new = F.coalesce(F.col("domain_age_days") < 30, F.lit(False)) & F.col("valid")
    df = df.withColumn("score", F.least(F.lit(100), F.col("score") + F.when(new, 25).otherwise(0)))
    df = df.withColumn("flags", F.when(new, F.concat("flags", F.array(F.lit("new-domain")))).otherwise(F.col("flags")))
    out = F.when(~F.col("valid"), "malicious").otherwise(verdicts.by_score(F.col("score"), (50, "malicious"), (25, "suspicious"), default="safe"))
    return df.withColumn("verdict", out).withColumn("checks_skipped", verdicts.skipped(domain_age=F.col("domain_age_days")))


def payment_verdict(df: DataFrame, final_url: str | None = None) -> DataFrame:
    """screen_payment: young domains add 25 or 12; a redirect to another host adds that URL's score and flags."""
    age = F.col("domain_age_days")
    total = F.col("score") + F.when(age < 30, 25).when(age < 180, 12).otherwise(0)
    none = F.array().cast("array<string>")
    young = F.when(age < 30, F.array(F.lit("very-new-domain"))).when(age < 180, F.array(F.lit("new-domain"))).otherwise(none)
    df = df.withColumn("flags", F.when(F.col("valid"), F.concat("flags", young)).otherwise(F.col("flags")))
    if final_url:
        own = df.columns
        target = analyze(df.select(*[F.col(c).alias(f"_{c}") for c in own]), f"_{final_url}")
        df = target.select(*[F.col(f"_{c}").alias(c) for c in own], F.col("valid").alias("_reads"), F.col("host").alias("final_host"), F.col("score").alias("final_score"), F.col("flags").alias("_further"))
        moved = F.col("valid") & F.col("_reads") & (F.col("final_host") != F.col("host"))
        total = total + F.when(moved, F.col("final_score")).otherwise(0)
        df = df.withColumn("flags", F.when(moved, F.concat("flags", F.transform("_further", lambda f: F.concat(f, F.lit(" (after redirect)"))))).otherwise(F.col("flags")))
    df = df.withColumn("score", F.when(F.col("valid"), F.least(F.lit(100), total)).otherwise(100).cast("int"))
    df = df.drop("_reads", "_further")
    return df.withColumn("verdict", F.when(~F.col("valid"), "block").otherwise(verdicts.by_score(F.col("score"), (50, "block"), (25, "caution"), default="safe")))


def number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    octets = F.transform(F.split(ip, r"\."), lambda x: x.cast("long"))
    return F.when(F.rlike(ip, F.lit(IPV4)), octets[0] * 16777216 + octets[1] * 65536 + octets[2] * 256 + octets[3])


def ranges(spark, cidrs=PRIVATE) -> DataFrame:
    nets = [ipaddress.ip_network(c) for c in cidrs]
    return spark.createDataFrame([(str(n), int(n[0]), int(n[-1])) for n in nets], "cidr string, low long, high long")


def is_private(ip: Column) -> Column:
    """For IPv4; what isn't an address counts as private, so that nothing is fetched from it."""

    def judged(n: Column) -> Column:  # n is worked out once
        inside = F.lit(False)
        for c in map(ipaddress.ip_network, PRIVATE):
            inside = inside | n.between(int(c[0]), int(c[-1]))
        return F.when(n.isNull(), True).otherwise(inside)

    return F.transform(F.array(number(ip)), judged)[0]


@F.pandas_udf(T.BooleanType())
def is_private_any(ips: pd.Series) -> pd.Series:
    """IPv4 and IPv6, with mapped and translated addresses judged by the IPv4 address within."""
    nets = [ipaddress.ip_network(c) for c in PRIVATE]
    six = [ipaddress.ip_network(c) for c in ("fc00::/7", "fe80::/10", "ff00::/8")]

    def private(text: str | None) -> bool:
        try:
            a = ipaddress.ip_address((text or "").strip("[]").split("%")[0])
        except ValueError:
            return True
        if a.version == 6:
            n = int(a)
            if n < 2 or any(a in net for net in six):
                return True
            if n >> 32 in (0, 0xFFFF) or n >> 32 == 0x64FF9B << 64:
                a = ipaddress.IPv4Address(n & 0xFFFFFFFF)
            else:
                return False
        return any(a in net for net in nets)

    return ips.map(private)


def reputation(df: DataFrame, ip: str, tor: DataFrame | None, blocked: DataFrame | None, asn: DataFrame | None, ptr: DataFrame | None = None) -> DataFrame:
    """check_ip: each list may be missing, which leaves its fact null and lists the check as skipped.

    blocked(ip and perhaps code): codes 127.255.255.x say that the block list refused to answer, which is unknown, not
    listed. ptr(ip, name) are reverse names; they are told and don't count.
    """

    def fact(df: DataFrame, rows: DataFrame | None, name: str) -> DataFrame:
        if rows is None:
            return df.withColumn(name, F.lit(None).cast("boolean"))
        rows = small(rows.select(F.col("ip").alias("_ip"), F.lit(True).alias("_hit")).distinct())
        return df.join(rows, F.col(ip) == F.col("_ip"), "left").withColumn(name, F.coalesce("_hit", F.lit(False))).drop("_ip", "_hit")

    df = fact(df.withColumn("private", is_private(F.col(ip))), tor, "tor_exit")
    if blocked is None or "code" not in blocked.columns:
        df = fact(df, blocked, "blocklisted").withColumn("codes", F.lit(None).cast("array<string>"))
    else:
        codes = blocked.groupBy(F.col("ip").alias("_ip")).agg(F.sort_array(F.collect_set("code")).alias("codes"))  # some per address
        df = df.join(small(codes), F.col(ip) == F.col("_ip"), "left")
        refused = F.exists("codes", lambda c: c.startswith("127.255.255."))
        df = df.withColumn("blocklisted", F.when(F.col("_ip").isNull(), False).when(refused, None).otherwise(True)).drop("_ip")
    if ptr is None:
        df = df.withColumn("ptr", F.lit(None).cast("string"))
    else:
        names = ptr.groupBy(F.col("ip").alias("_ip")).agg(F.min("name").alias("ptr"))
        df = df.join(small(names), F.col(ip) == F.col("_ip"), "left").drop("_ip")
    if asn is None:
        df = df.withColumn("org", F.lit(None).cast("string"))
    else:
        df = df.join(small(asn.select(F.col("ip").alias("_ip"), "org")), F.col(ip) == F.col("_ip"), "left").drop("_ip")
    df = df.withColumn("datacenter", F.rlike("org", F.lit(DATACENTER)))
    add = lambda c, w: F.when(F.col(c), w).otherwise(0)
    df = df.withColumn("score", F.when(F.col("private"), 0).otherwise(add("tor_exit", 35) + add("blocklisted", 40) + add("datacenter", 10)).cast("int"))
    return df.withColumn("verdict", verdicts.by_score(F.col("score"), (40, "high-risk"), (15, "caution"), default="low-risk")).withColumn(
        "checks_skipped", F.when(F.col("private"), F.array().cast("array<string>")).otherwise(verdicts.skipped(tor=F.col("tor_exit"), blocklist=F.col("blocklisted"), asn=F.col("org")))
    )


def pwned(df: DataFrame, password: str, ranges_: DataFrame) -> DataFrame:
    """check_password: only the first five characters of the SHA-1 meet the ranges(prefix, suffix, count)."""
    digest = F.upper(F.sha1(F.col(password)))
    df = df.withColumn("_prefix", F.substring(digest, 1, 5)).withColumn("_suffix", F.substring(digest, 6, 35))
    r = small(ranges_.select(F.col("prefix").alias("_prefix"), F.col("suffix").alias("_suffix"), "count"))
    out = df.join(r, ["_prefix", "_suffix"], "left").withColumn("count", F.coalesce("count", F.lit(0))).drop("_prefix", "_suffix")
    return out.withColumn("verdict", F.when(F.col("count") > 1000, "severely-compromised").when(F.col("count") > 0, "compromised").otherwise("safe"))


def reversed_ip(ip: Column) -> Column:
    """1.2.3.4 as 4.3.2.1, the form of block list lookups."""
    return F.array_join(F.reverse(F.split(ip, r"\.")), ".")


def host_argument(given: Column) -> Column:
    """The host of a URL, host:port or bare host; null for private addresses and what is no host."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.trim(given), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", ""), r"[:/?#].*\z", ""))
    number_like = F.rlike(bare, F.lit(IPV4))
    ok = F.rlike(bare, F.lit(r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+\z")) & (bare != "localhost")
    return F.when(ok & ~(number_like & is_private(bare)), bare)


def links(html: Column, most: int = 25) -> Column:
    """http(s) links: href values, then bare ones, each once."""
    href = F.regexp_extract_all(html, F.lit(r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1))
    bare = F.regexp_extract_all(html, F.lit(r"(?i)https?://[^\s\"'<>)\]]+"), F.lit(0))
    return F.slice(F.filter(F.array_distinct(F.concat(href, bare)), lambda u: F.rlike(u, F.lit("(?i)^https?://"))), 1, most)
