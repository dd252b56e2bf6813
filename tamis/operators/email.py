"""E-mail: addresses, authentication results, sender risk, deliverability, and the two combined scores.

Header texts are taken apart by expressions. Whole messages with nested parts and encodings go through one
Arrow UDF (parse_raw) that returns a struct; everything after it is relational.
"""

from __future__ import annotations

import base64
import binascii
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import verdicts
from ..functions.dialect import java
from ..functions.frames import small
from . import content, secrets, urls

# Imitated brands, phrases of spam, throwaway domains, role accounts, free providers.
BRANDS = "paypal apple microsoft office365 google gmail amazon netflix facebook instagram coinbase binance metamask wellsfargo chase bankofamerica docusign dropbox linkedin usps fedex dhl irs stripe".split()
SPAM = r"\b(act now|limited time|urgent|guarantee[d]?|risk[- ]?free|no obligation|congratulations|winner|click here|buy now|order now|earn \$|make money fast|work from home|double your|wire transfer|lottery|claim your prize|100% free|free access|cash bonus|investment opportunity|miracle|viagra|weight loss)\b"
DISPOSABLE = (
    "mailinator.com guerrillamail.com 10minutemail.com tempmail.com temp-mail.org throwawaymail.com yopmail.com getnada.com trashmail.com sharklasers.com grr.la guerrillamail.info maildrop.cc dispostable.com fakeinbox.com mintemail.com mohmal.com emailondeck.com spamgourmet.com "
    "tempinbox.com 33mail.com mailnesia.com tempr.email discard.email mailcatch.com tempmailo.com 1secmail.com moakt.com burnermail.io spambog.com minuteinbox.com email-temp.com mail7.io fakemail.net tmpmail.org getairmail.com inboxkitten.com"
).split()
ROLES = (
    "admin administrator info support sales contact billing help helpdesk postmaster webmaster hostmaster abuse noreply no-reply donotreply do-not-reply marketing team office hello enquiries inquiries careers jobs hr press media security privacy legal "
    "accounts accounting finance service services newsletter notifications notification root"
).split()
FREE = "gmail.com googlemail.com yahoo.com ymail.com hotmail.com outlook.com live.com msn.com aol.com icloud.com me.com mac.com proton.me protonmail.com pm.me gmx.com gmx.net zoho.com yandex.com mail.com mail.ru fastmail.com hey.com tutanota.com tuta.io".split()
SYNTAX = r'^[^\s@"]+(\.[^\s@"]+)*@[^\s@.]+(\.[^\s@.]+)+\z'
BULK = r"(?i)\b(unsubscribe|newsletter|mailing list)\b"
RESULTS = "(pass|fail|softfail|hardfail|neutral|none|temperror|permerror|bestguesspass)"


def address(header: Column) -> Column:
    """struct<display, email, domain> of an address header; the e-mail is empty without an @."""
    h = F.trim(F.coalesce(header, F.lit("")))
    inner = F.regexp_extract(h, "<([^>]+)>", 1)
    mail = F.regexp_replace(F.lower(F.trim(F.when(inner != "", inner).otherwise(h))), "^mailto:", "")
    shown = F.when(inner != "", F.trim(F.regexp_replace(F.trim(F.regexp_extract(h, "^([^<]*)<", 1)), '^"|"\\z', ""))).otherwise("")
    domain = F.regexp_replace(F.coalesce(F.get(F.split(mail, "@"), 1), F.lit("")), r"[>,;\s].*\z", "")
    return F.struct(shown.alias("display"), F.when(mail.contains("@"), mail).otherwise("").alias("email"), domain.alias("domain"))


def auth_results(header: Column) -> Column:
    """struct<spf, dkim, dmarc> as a receiving server wrote them; null where the header has none of them."""
    one = lambda k: F.nullif(F.lower(F.regexp_extract(header, java(rf"\b{k}\s*=\s*{RESULTS}", "i"), 1)), F.lit(""))
    found = F.coalesce(one("spf"), one("dkim"), one("dmarc"))
    return F.when(found.isNotNull(), F.struct(one("spf").alias("spf"), one("dkim").alias("dkim"), one("dmarc").alias("dmarc")))


def sender_risk(df: DataFrame) -> DataFrame:
    """df(from_addr, reply_addr, return_addr as address structs) with sender_flags and sender_score."""
    domain = F.col("from_addr.domain")
    other = lambda c: (F.col(f"{c}.domain") != "") & (domain != "") & (F.col(f"{c}.domain") != domain)
    shown = F.lower(F.regexp_extract(F.col("from_addr.display"), r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]{2,}", 0))
    low = F.lower("from_addr.display")
    brand = F.lit(None).cast("string")
    for b in reversed(BRANDS):
        brand = F.when(low.contains(b) & (domain != "") & ~domain.contains(b), b).otherwise(brand)
    ids, score = verdicts.flags(("replyto-mismatch", other("reply_addr"), 18), ("returnpath-mismatch", other("return_addr"), 14), ("display-name-spoof", (shown != "") & (shown != F.col("from_addr.email")), 26), ("brand-impersonation", brand.isNotNull(), 28))
    return df.withColumn("sender_flags", ids).withColumn("sender_score", score)


def deliverability(df: DataFrame) -> DataFrame:
    """df(subject, body, html, list_unsubscribe) with links, spam_words, deliver_flags and deliver_score. Empty texts stand for missing parts."""
    text = F.array_join(F.filter(F.array("subject", "body", "html"), lambda x: x != ""), "\n")
    df = df.withColumn("_text", text).withColumn("links", urls.links(F.col("_text")))
    df = df.withColumn("spam_words", F.array_distinct(F.transform(F.regexp_extract_all("_text", F.lit(java(SPAM, "i")), F.lit(0)), lambda x: F.lower(x))))
    words = F.size(F.filter(F.split(F.regexp_replace(F.when(F.col("body") != "", F.col("body")).otherwise(F.col("html")), "<[^>]+>", " "), r"\s+"), lambda x: x != ""))
    bulk = F.rlike("_text", F.lit(java(BULK[4:], "i"))) | (F.size("links") > 4)
    parts = (
        ("all-caps-subject", (F.col("subject") == F.upper("subject")) & F.rlike("subject", F.lit("[A-Z]{4,}")), 10), ("excessive-exclamation", F.regexp_count("subject", F.lit("!")) >= 2, 8), ("many-links", F.size("links") > 8, 10),
        ("no-plaintext", (F.col("html") != "") & (F.col("body") == ""), 8), ("image-heavy", F.rlike("html", F.lit("(?i)<img")) & (words < 20), 15), ("missing-unsubscribe", bulk & (F.col("list_unsubscribe") == ""), 14),
    )
    ids, score = verdicts.flags(*parts)
    n = F.size("spam_words")
    df = df.withColumn("deliver_flags", F.when(n > 0, F.concat(F.array(F.lit("spam-trigger-words")), ids)).otherwise(ids))
    return df.withColumn("deliver_score", F.least(F.lit(100), score + F.least(F.lit(30), n * 6)).cast("int")).drop("_text")


def link_score(df: DataFrame, key: str, links: str = "links") -> DataFrame:
    """(key, max_link): the highest URL score of the first ten links; 0 without links."""
    each = urls.analyze(df.select(key, F.explode_outer(F.slice(links, 1, 10)).alias("_link")), "_link")
    return each.groupBy(key).agg(F.max(F.when(F.col("_link").isNotNull(), F.col("score")).otherwise(0)).alias("max_link"))


def disposable_domains(spark, feed: DataFrame | None = None) -> DataFrame:
    """The built-in domains, and those of a feed."""
    own = spark.createDataFrame([(d,) for d in DISPOSABLE], "domain string")
    return own if feed is None else own.union(feed.select(F.lower(F.trim("domain")).alias("domain")).where("domain <> '' and domain not like '#%'")).distinct()


def _risk(score: Column) -> Column:
    return verdicts.by_score(score, (60, "critical"), (35, "high"), (15, "medium"), (1, "low"), default="none")


def _half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def with_posture(df: DataFrame, domain: Column, posture: DataFrame | None) -> DataFrame:
    """df with _no_mx and _blank (nothing in DNS at all) of a domain by domain_posture(); both null where it wasn't asked."""
    if posture is None:
        return df.withColumn("_no_mx", F.lit(None).cast("boolean")).withColumn("_blank", F.lit(None).cast("boolean"))
    none = F.size("mx") == 0
    p = posture.select(F.col("domain").alias("_d"), none.alias("_no_mx"), (none & ~F.col("spf") & F.col("dmarc_policy").isNull()).alias("_blank"))
    return df.join(small(p), domain == F.col("_d"), "left").drop("_d")


def inbound(df: DataFrame, key: str, disposable: DataFrame, ages: DataFrame | None = None, posture: DataFrame | None = None) -> DataFrame:
    """scan_inbound: df(from_addr, reply_addr, return_addr, auth_header, subject, body, html) with score, risk and verdict.

    ages(domain, domain_age_days) and posture (of domain_posture); what isn't given or not in them is unknown, which is
    listed and never counts as good. Where a message has no authentication results, a sender domain without SPF, DMARC
    and MX counts, and is listed too, as a failed lookup looks the same.
    """
    df = sender_risk(df.withColumn("auth", auth_results(F.col("auth_header"))))
    text = F.array_join(F.filter(F.array("subject", "body", "html"), lambda x: x != ""), "\n")
    df = content.scan(df.withColumn("combined", text), "combined").withColumnRenamed("score", "injection_score").drop("risk", "verdict", "matched", "findings")
    df = df.withColumn("links", urls.links(F.col("combined")))
    df = df.join(link_score(df, key), key)
    d = small(disposable.select(F.col("domain").alias("_d"), F.lit(True).alias("disposable")).distinct())
    df = df.join(d, F.col("from_addr.domain") == F.col("_d"), "left").drop("_d").withColumn("disposable", F.coalesce("disposable", F.lit(False)))
    if ages is None:
        df = df.withColumn("domain_age_days", F.lit(None).cast("long"))
    else:
        df = df.join(small(ages.select(F.col("domain").alias("_d"), "domain_age_days")), F.col("from_addr.domain") == F.col("_d"), "left").drop("_d")
    add = lambda c, w: F.when(c, w).otherwise(0)
    auth = add(F.col("auth.dmarc") == "fail", 30) + add(F.col("auth.spf").isin("fail", "hardfail", "softfail"), 18) + add(F.col("auth.dkim") == "fail", 14)
    df = with_posture(df, F.col("from_addr.domain"), posture)
    asked = F.col("auth.spf").isNull() & F.col("auth.dkim").isNull() & F.col("auth.dmarc").isNull()
    total = F.col("injection_score") + auth + add(asked & F.col("_blank"), 12) + F.least(F.lit(40), _half_up(F.col("sender_score") * 0.6)) + add(F.col("disposable"), 15) + add(F.col("domain_age_days") < 30, 15) + F.least(F.lit(25), _half_up(F.col("max_link") * 0.3))
    df = df.withColumn("score", F.least(F.lit(100), total).cast("int"))
    return df.withColumn("risk", _risk(F.col("score"))).withColumn("verdict", verdicts.by_score(F.col("score"), (50, "block"), (25, "review"), default="allow")).withColumn("checks_skipped", F.concat(verdicts.skipped(domain_age=F.col("domain_age_days")), F.when(asked & F.coalesce("_blank", F.lit(True)), F.array(F.lit("sender-domain-dns"))).otherwise(F.array().cast("array<string>")))).drop("_no_mx", "_blank")


def outbound(df: DataFrame, key: str, disposable: DataFrame, posture: DataFrame | None = None) -> DataFrame:
    """scan_outbound: df(to_addr, subject, body, html, list_unsubscribe) with leak, recipient_flags, score, risk, verdict and redacted.

    posture (of domain_posture) tells whether the recipient's domain takes mail; where it wasn't asked, that is skipped.
    """
    df = deliverability(df)
    text = F.array_join(F.filter(F.array("subject", "body", "html"), lambda x: x != ""), "\n")
    df = secrets.scan(df.withColumn("combined", text), "combined").withColumnRenamed("verdict", "leak")
    df = df.join(link_score(df, key), key)
    d = small(disposable.select(F.col("domain").alias("_d"), F.lit(True).alias("disposable")).distinct())
    df = df.join(d, F.col("to_addr.domain") == F.col("_d"), "left").drop("_d").withColumn("disposable", F.coalesce("disposable", F.lit(False)))
    df = with_posture(df, F.col("to_addr.domain"), posture)
    no_mx = F.coalesce("_no_mx", F.lit(False))
    df = df.withColumn("recipient_flags", F.filter(F.array(F.when(no_mx, "recipient-no-mx"), F.when(F.col("disposable"), "recipient-disposable")), lambda x: x.isNotNull()))
    df = df.withColumn("checks_skipped", F.when((F.col("to_addr.domain") != "") & F.col("_no_mx").isNull(), F.array(F.lit("recipient-mx"))).otherwise(F.array().cast("array<string>")))
    recipient = F.when(no_mx, 25).otherwise(0) + F.when(F.col("disposable"), 12).otherwise(0)
    total = F.when(F.col("leak") == "block", 60).when(F.col("leak") == "review", 25).otherwise(0) + F.least(F.lit(40), F.col("deliver_score")) + recipient + F.least(F.lit(20), _half_up(F.col("max_link") * 0.25))
    df = df.withColumn("score", F.least(F.lit(100), total).cast("int")).withColumn("risk", _risk(F.col("score")))
    return df.withColumn("verdict", F.when(F.col("leak") == "block", "block").otherwise(verdicts.by_score(F.col("score"), (50, "block"), (25, "review"), default="allow"))).withColumn("redacted", F.substring("redacted", 1, 2000)).drop("_no_mx", "_blank")


def domain_posture(domains: DataFrame, dns: DataFrame) -> DataFrame:
    """(domain, spf, spf_qualifier, dmarc_policy, mx, posture, notes) from dns(domain, type, value, priority)."""
    dns = dns.withColumn("_place", F.row_number().over(Window.partitionBy("domain", "type").orderBy("priority", "value")))
    flat = dns.groupBy("domain").agg(
        F.min(F.when((F.col("type") == "TXT") & F.rlike("value", F.lit("(?i)^v=spf1")), F.col("value"))).alias("spf_record"),
        F.min(F.when((F.col("type") == "DMARC") & F.rlike("value", F.lit("(?i)v=DMARC1")), F.col("value"))).alias("dmarc_record"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("type") == "MX") & (F.col("_place") <= 5), F.struct("priority", "value")))), lambda x: x["value"]).alias("mx"),
    )
    d = domains.join(flat, "domain", "left").withColumn("mx", F.coalesce("mx", F.array().cast("array<string>")))
    policy = F.when(F.col("dmarc_record").isNotNull(), F.coalesce(F.nullif(F.lower(F.regexp_extract("dmarc_record", java(r"\bp\s*=\s*(none|quarantine|reject)", "i"), 1)), F.lit("")), F.lit("none")))
    d = d.withColumn("spf", F.col("spf_record").isNotNull()).withColumn("spf_qualifier", F.nullif(F.regexp_extract("spf_record", "([-~?+])all", 1), F.lit(""))).withColumn("dmarc_policy", policy)
    weak = ~F.col("spf") | F.col("dmarc_policy").isNull() | (F.col("dmarc_policy") == "none")
    notes = F.filter(F.array(F.when(~F.col("spf"), "no SPF"), F.when(F.col("dmarc_policy").isNull(), "no DMARC").when(F.col("dmarc_policy") == "none", "DMARC not enforced"), F.when(F.size("mx") == 0, "no MX")), lambda x: x.isNotNull())
    blank = ~F.col("spf") & F.col("dmarc_policy").isNull() & (F.size("mx") == 0)  # nothing at all: the lookup may have failed
    d = d.withColumn("checks_skipped", F.when(blank, F.array(F.lit("domain-dns"))).otherwise(F.array().cast("array<string>")))
    return d.withColumn("posture", F.when(weak, "weak").otherwise("enforced")).withColumn("notes", notes)


def validate(df: DataFrame, email: str, mx: DataFrame, disposable: DataFrame) -> DataFrame:
    """df with valid_syntax, domain, accepts_mail, disposable, role, free, deliverable and a score from 0 to 1. mx(domain): domains that take mail."""
    e = F.coalesce(F.col(email), F.lit(""))
    ok = (F.length(e) <= 254) & F.rlike(e, F.lit(SYNTAX))
    df = df.withColumn("valid_syntax", ok).withColumn("domain", F.when(e.contains("@"), F.lower(F.substring_index(e, "@", -1))).otherwise(""))
    df = df.join(small(mx.select("domain", F.lit(True).alias("accepts_mail")).distinct()), "domain", "left").join(small(disposable.select("domain", F.lit(True).alias("disposable")).distinct()), "domain", "left")
    df = df.fillna(False, ["accepts_mail", "disposable"]).withColumn("accepts_mail", F.col("accepts_mail") & F.col("valid_syntax"))
    local = F.lower(F.expr(f"substring(coalesce({email}, ''), 1, length(coalesce({email}, '')) - length(substring_index(coalesce({email}, ''), '@', -1)) - 1)"))
    df = df.withColumn("role", local.isin(ROLES)).withColumn("free", F.col("domain").isin(FREE)).withColumn("deliverable", F.col("valid_syntax") & F.col("accepts_mail") & ~F.col("disposable"))
    score = F.when(~F.col("valid_syntax"), 0.0).when(~F.col("accepts_mail"), 0.2).when(F.col("disposable"), 0.25).when(F.col("role"), 0.7).when(F.col("free"), 0.85).otherwise(0.95)
    return df.withColumn("score", score)


# --- whole messages


def decode_transfer(text: str, encoding: str) -> str:
    """A body by its transfer encoding; what can't be decoded stays as it is."""
    if encoding == "base64":
        kept = re.sub(r"[^A-Za-z0-9+/=]", "", text)
        try:
            return base64.b64decode(kept + "=" * (-len(kept) % 4)).decode("utf-8", "replace")
        except (ValueError, binascii.Error):
            return text
    if encoding == "quoted-printable":
        joined = re.sub(r"=\r?\n", "", text)
        return re.sub(r"=([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), joined)
    return text


def decode_words(text: str) -> str:
    """Encoded words of a header, read as UTF-8."""

    def one(m: re.Match) -> str:
        if m[1].upper() == "B":
            return decode_transfer(m[2], "base64")
        raw = re.sub(rb"=([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), m[2].replace("_", " ").encode())
        return raw.decode("utf-8", "replace")

    return re.sub(r"=\?[^?]+\?([BbQq])\?([^?]*)\?=", one, re.sub(r"(\?=)\s+(?==\?)", r"\1", text))


def split_headers(raw: str) -> tuple[dict[str, str], str]:
    head, _, body = raw.replace("\r\n", "\n").partition("\n\n")
    out: dict[str, str] = {}
    for line in re.sub(r"\n[ \t]+", " ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon and re.fullmatch(r"[A-Za-z0-9-]+", name):
            key = name.lower()
            out[key] = f"{out[key]} {value.strip()}" if key in out else value.strip()
    return out, body


def parse_message(raw: str | None, depth: int = 6) -> dict:
    """Headers, subject, text and HTML of a message; parts within parts up to a depth of six."""
    headers, body = split_headers(raw or "")
    found: dict[str, list[str]] = {"text": [], "html": []}

    def walk(h: dict[str, str], text: str, left: int) -> None:
        kind = h.get("content-type", "text/plain")
        edge = re.search(r'boundary="?([^";\s]+)"?', kind, re.I)
        if edge and left:
            for part in re.split(rf"(?m)^--{re.escape(edge[1])}(?:--)?[ \t]*$\n?", text)[1:]:
                if part.strip():
                    walk(*split_headers(part.lstrip("\n") if not part.startswith("\n") else part), left - 1)
            return
        found["html" if "html" in kind.lower() else "text"].append(decode_transfer(text, h.get("content-transfer-encoding", "").strip().lower()).strip())

    walk(headers, body, depth)
    return {"headers": headers, "subject": decode_words(headers.get("subject", "")), "body": "\n".join(found["text"]), "html": "\n".join(found["html"])}


MESSAGE = T.StructType([T.StructField("headers", T.MapType(T.StringType(), T.StringType())), *(T.StructField(n, T.StringType()) for n in ("subject", "body", "html"))])


@F.pandas_udf(MESSAGE)
def parse_raw(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_message(r) for r in raw], columns=["headers", "subject", "body", "html"])
