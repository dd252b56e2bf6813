"""Web documents: metadata, structured data, readable text, selections, and facts about hosts."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _find(html: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, pattern, group), r"\s+", " ")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    """Content of a meta element by property or name, whichever attribute comes first."""
    n = re.escape(name)
    a = _find(html, rf"(?is)<meta[^>]+(?:property|name)=[\"']{n}[\"'][^>]*?content=[\"']([^\"']*)[\"']")
    b = _find(html, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*?(?:property|name)=[\"']{n}[\"']")
    return F.coalesce(a, b)


def metadata(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df with title, description, image, site_name, canonical, favicon and lang; the first that isn't empty counts."""
    h = F.coalesce(F.col(html), F.lit(""))
    title = F.coalesce(meta(h, "og:title"), meta(h, "twitter:title"), _find(h, "(?is)<title[^>]*>(.*?)</title>"))
    origin = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    icon = F.coalesce(_find(h, r"(?is)<link[^>]+rel=[\"'](?:shortcut )?icon[\"'][^>]*?href=[\"']([^\"']*)[\"']"), F.lit("/favicon.ico"))
    return df.withColumns({
        "title": title, "description": F.coalesce(meta(h, "og:description"), meta(h, "twitter:description"), meta(h, "description")), "image": F.coalesce(meta(h, "og:image"), meta(h, "twitter:image")), "site_name": meta(h, "og:site_name"),
        "canonical": _find(h, r"(?is)<link[^>]+rel=[\"']canonical[\"'][^>]*?href=[\"']([^\"']*)[\"']"), "favicon": F.when(icon.startswith("/"), F.concat(origin, icon)).otherwise(icon), "lang": _find(h, r"(?is)<html[^>]+lang=[\"']([^\"']*)[\"']"),
    })


def json_ld(html: Column) -> Column:
    """Texts of the JSON-LD blocks."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))


def structured(df: DataFrame, html: str = "html") -> DataFrame:
    """df with jsonld (parsable blocks), unparsable, schema_types, opengraph and twitter (first value of each name)."""
    h = F.coalesce(F.col(html), F.lit(""))
    df = df.withColumn("_blocks", json_ld(h)).withColumn("jsonld", F.filter("_blocks", lambda b: F.try_parse_json(b).isNotNull()))
    types = F.flatten(F.transform("jsonld", lambda b: F.regexp_extract_all(b, F.lit(r'"@type"\s*:\s*"([^"]+)"'), F.lit(1))))

    def pairs(prefix: str) -> Column:
        names = F.regexp_extract_all(h, F.lit(rf"(?is)<meta[^>]+(?:property|name)=[\"']{prefix}:([^\"']+)[\"'][^>]*?content=[\"'][^\"']*[\"']"), F.lit(1))
        values = F.regexp_extract_all(h, F.lit(rf"(?is)<meta[^>]+(?:property|name)=[\"']{prefix}:[^\"']+[\"'][^>]*?content=[\"']([^\"']*)[\"']"), F.lit(1))
        return F.map_from_arrays(F.array_distinct(names), F.transform(F.array_distinct(names), lambda n: F.element_at(values, F.array_position(names, n).cast("int"))))

    return df.withColumns({"unparsable": F.size("_blocks") - F.size("jsonld"), "schema_types": F.array_distinct(types), "opengraph": pairs("og"), "twitter": pairs("twitter")}).drop("_blocks")


class _Markdown(HTMLParser):
    """Readable text of an article, or of the whole body without one, as Markdown."""

    SKIP = frozenset("script style noscript template nav footer aside form button svg iframe head".split())
    BLOCK = frozenset("p div section article main header blockquote pre ul ol table tr h1 h2 h3 h4 h5 h6 li figure br hr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.links: list[str | None] = []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in self.SKIP:
            if tag in self.SKIP:
                self.skip.append(tag)
            return
        if tag in self.BLOCK:
            self.out.append("\n" if tag in ("br", "tr") else "\n\n" if tag != "li" else "\n- ")
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a":
            self.links.append(dict(attrs).get("href"))
            self.out.append("[")

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass
            return
        if self.skip:
            return
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("_")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop() or ''})")
        elif tag in self.BLOCK and tag != "li":
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def markdown(page: str | None) -> str:
    page = page or ""
    article = re.search(r"<article\b[^>]*>(.*?)</article>", page, re.S | re.I)
    parser = _Markdown()
    parser.feed(article[1] if article else page)
    parser.close()
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(parser.out))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


_READ = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("words", T.IntegerType()), T.StructField("chars", T.IntegerType())])


@F.pandas_udf(_READ)
def read_page(pages: pd.Series) -> pd.DataFrame:
    texts = [markdown(p) for p in pages]
    return pd.DataFrame({"markdown": texts, "words": [len(t.split()) for t in texts], "chars": [len(t) for t in texts]})


class _Tree(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.nodes.append({"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "up": self.open[-1] if self.open else None, "text": []})
        if tag not in self.VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[k]]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        for k in self.open:
            self.nodes[k]["text"].append(data)


def _step(simple: str) -> re.Match:
    m = re.fullmatch(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[^\]]+\])*)", simple)
    if not m or not simple:
        raise ValueError(simple)
    return m


def _matches(node: dict, simple: str) -> bool:
    m = _step(simple)
    if m[1] and m[1] != "*" and node["tag"] != m[1].lower():
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]+\]", m[2]):
        if part[0] == "." and part[1:] not in node["attrs"].get("class", "").split() or part[0] == "#" and node["attrs"].get("id") != part[1:]:
            return False
        if part[0] == "[":
            name, eq, value = part[1:-1].partition("=")
            if name not in node["attrs"] or eq and node["attrs"][name] != value.strip("\"'"):
                return False
    return True


def select(page: str, selector: str, base: str = "") -> list[str]:
    """Texts, or an attribute with @name, of all elements of `a b.c > d`-like selectors (descendants only)."""
    css, _, attribute = selector.removesuffix("[]").partition("@")
    steps = css.split()
    for step in steps:  # a bad one is bad on every page, whatever elements there are
        _step(step)
    tree = _Tree()
    tree.feed(page)
    out = []
    for n in tree.nodes:
        if not _matches(n, steps[-1]):
            continue
        up, left = n["up"], list(steps[:-1])
        while left and up is not None:
            if _matches(tree.nodes[up], left[-1]):
                left.pop()
            up = tree.nodes[up]["up"]
        if left:
            continue
        value = n["attrs"].get(attribute) if attribute else re.sub(r"\s+", " ", "".join(n["text"])).strip()
        if value is not None:
            out.append(urljoin(base, value) if attribute in ("href", "src", "data-src", "poster") else value)
    return out


def css_extract(df: DataFrame, selectors: dict[str, str], html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """(key, data map<string, array<string>>): up to 50 selections of each page; a bad selector gives null."""
    if not 1 <= len(selectors) <= 50:
        raise ValueError("1 to 50 selectors")

    @F.pandas_udf(T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    def run(pages: pd.Series, urls: pd.Series) -> pd.Series:
        def one(page, base):
            out = {}
            for name, s in selectors.items():
                try:
                    found = select(page or "", s, base or "")
                    out[name] = found if s.endswith("[]") else found[:1]
                except (ValueError, IndexError):
                    out[name] = None
            return out

        return pd.Series([one(p, u) for p, u in zip(pages, urls, strict=True)])

    return df.select(key, run(html, url).alias("data"))


def feed_items(df: DataFrame, xml: str, key: str, limit: int = 25) -> DataFrame:
    """(key, pos, title, link, snippet) of the first items of RSS or Atom texts; the limit is kept in 1..100."""
    limit = max(1, min(100, limit))
    items = F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    d = df.select(key, F.posexplode(F.slice(items, 1, limit)).alias("pos", "item"))
    plain = lambda tag: _find(F.col("item"), rf"(?is)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>")
    link = F.coalesce(plain("link"), _find(F.col("item"), r"(?is)<link[^>]+href=[\"']([^\"']*)[\"']"))
    text = F.regexp_replace(F.coalesce(plain("description"), plain("summary")), "<[^>]*>", "")
    return d.select(key, "pos", plain("title").alias("title"), link.alias("link"), F.substring(text, 1, 500).alias("snippet"))


def dns_pivot(dns: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row a domain: records of each type, SPF and DMARC records, and types whose lookup failed."""
    types = ["A", "AAAA", "CNAME", "MX", "NS", "TXT"]
    wide = dns.groupBy("domain").pivot("type", types).agg(F.array_join(F.sort_array(F.collect_list("value")), " "))
    wide = wide.select("domain", *(F.nullif(t, F.lit("")).alias(t) for t in types))
    first = lambda p: F.min(F.when((F.col("type") == "TXT") & F.lower("value").startswith(p), F.col("value")))
    mail = dns.groupBy("domain").agg(first("v=spf1").alias("spf"), first("v=dmarc1").alias("dmarc"))
    out = wide.join(mail, "domain")
    if failed is None:
        return out.withColumn("skipped", F.lit(""))
    bad = failed.groupBy("domain").agg(F.array_join(F.sort_array(F.collect_set("type")), ",").alias("skipped"))
    return out.join(bad, "domain", "left").withColumn("skipped", F.coalesce("skipped", F.lit("")))


RDAP = "struct<events:array<struct<eventAction:string,eventDate:string>>,nameservers:array<struct<ldhName:string>>,entities:array<struct<roles:array<string>,handle:string>>>"


def rdap_facts(df: DataFrame, json: str, as_of: str) -> DataFrame:
    """df with registered, expires, age_days, days_left, registrar and nameservers from RDAP documents."""
    df = df.withColumn("_r", F.from_json(json, RDAP))
    when = lambda action: F.try_to_timestamp(F.element_at(F.filter("_r.events", lambda e: e["eventAction"] == action), 1)["eventDate"])
    now = F.lit(as_of).cast("timestamp")
    days = lambda a, b: F.floor((F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000)
    df = df.withColumn("registered", F.when(F.exists("_r.events", lambda e: e["eventAction"] == "registration"), when("registration"))).withColumn("expires", F.when(F.exists("_r.events", lambda e: e["eventAction"] == "expiration"), when("expiration")))
    registrar = F.get(F.filter("_r.entities", lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["handle"]
    return df.withColumns({"age_days": days(now, F.col("registered")), "days_left": days(F.col("expires"), now), "registrar": registrar, "nameservers": F.array_join(F.sort_array(F.transform("_r.nameservers", lambda n: F.lower(n["ldhName"]))), ",")}).drop("_r")


def certificate_facts(df: DataFrame, as_of: str) -> DataFrame:
    """df(valid_to, subject_alt_names) with days_remaining, expired and sans."""
    left = F.floor((F.unix_micros(F.col("valid_to").cast("timestamp")) - F.unix_micros(F.lit(as_of).cast("timestamp"))) / 86_400_000_000)
    sans = F.transform(F.split("subject_alt_names", r",\s*"), lambda x: F.regexp_replace(x, "^DNS:", ""))
    return df.withColumn("days_remaining", left).withColumn("expired", left < 0).withColumn("sans", sans)


SECURITY_HEADERS = ["strict-transport-security", "content-security-policy", "x-frame-options", "x-content-type-options", "referrer-policy", "permissions-policy"]


def redirect_chain(hops: DataFrame) -> DataFrame:
    """hops(id, hop, url, status) with next_url: where each hop leads."""
    return hops.withColumn("next_url", F.lead("url").over(Window.partitionBy("id").orderBy("hop")))


def security_headers(responses: DataFrame) -> DataFrame:
    """(id, present, missing) of responses(id, headers map)."""
    low = F.transform_keys("headers", lambda k, v: F.lower(k))
    names = F.array(*map(F.lit, SECURITY_HEADERS))
    r = responses.withColumn("_h", low)
    has = F.filter(names, lambda n: F.array_contains(F.map_keys("_h"), n))
    return r.select("id", has.alias("present"), F.array_except(names, has).alias("missing"))
