"""Package names, manifests and verdicts about packages.

Names are compared with a list of popular names: by a key without punctuation (equi-join), by affixes (the
bases of a name are exploded and joined), and by edit distance within bands of length. The list has a few
thousand names for each ecosystem, so it is the broadcast side. Registry, advisory and download facts are
tables; where one is missing the check is skipped and a name can't come out as safe because of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ledger import compare_versions

from ..functions import verdicts
from ..functions.frames import small

# Affixes in the order they are tried, pairs of letters that look alike, ecosystems' names.
SUFFIXES = ["js", "-js", ".js", "_js", "py", "-py", "_py", "python", "-python", "-node", "node", "-lib", ".io"]
PREFIXES = ["node-", "nodejs-", "python-", "py-", "js-"]
LOOKALIKE = [("l", "1"), ("l", "i"), ("i", "1"), ("o", "0"), ("s", "5"), ("g", "q"), ("b", "6"), ("z", "2"), ("a", "4"), ("e", "3"), ("t", "7")]
SWAPS = [("l", "1"), ("1", "l"), ("o", "0"), ("0", "o"), ("rn", "m"), ("m", "rn"), ("-", "_"), ("_", "-"), (".", "-"), ("i", "l"), ("s", "z")]
ECOSYSTEMS = {"npm": "npm", "pypi": "pypi", "python": "pypi", "pip": "pypi", "go": "go", "golang": "go", "crates": "crates", "rust": "crates", "cargo": "crates", "rubygems": "rubygems", "ruby": "rubygems", "gem": "rubygems", "maven": "maven", "nuget": "nuget"}
LEAST = 5  #: shorter names are not compared


def ecosystem(name: Column) -> Column:
    """The ecosystem that a name stands for; null is npm, unknown names are null."""
    out = F.lit(None).cast("string")
    n = F.lower(F.coalesce(name, F.lit("npm")))
    for k, v in reversed(ECOSYSTEMS.items()):
        out = F.when(n == k, v).otherwise(out)
    return out


def canonical(name: Column, eco: Column) -> Column:
    return F.when(eco == "pypi", F.lower(F.regexp_replace(name, "[-_.]+", "-"))).otherwise(name)


def scope(name: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(name, r"^(@[^/]+)/", 1)), F.lit(""))


def collapse(name: Column) -> Column:
    """Lower case without - _ and . (a scope stays apart)."""
    low = F.lower(name)
    at, rest = F.regexp_extract(low, r"^(@[^/]+)/(.+)$", 1), F.regexp_extract(low, r"^(@[^/]+)/(.+)$", 2)
    bare = lambda c: F.regexp_replace(c, "[-_.]", "")
    return F.when(at != "", F.concat(bare(at), F.lit("/"), bare(rest))).otherwise(bare(low))


def valid(name: Column) -> Column:
    return F.coalesce(F.length(name).between(1, 214) & F.rlike(name, F.lit(r"^[@a-zA-Z0-9._/-]+\z")), F.lit(False))


def gated(names: DataFrame, popular: DataFrame) -> DataFrame:
    """names(id, name, ecosystem) with canon and gate: short, popular, scope or null (to be compared)."""
    p = small(popular.select("ecosystem", F.col("name").alias("canon"), F.lit(True).alias("_listed")).distinct())
    s = small(popular.where("ecosystem = 'npm'").select("ecosystem", scope(F.col("name")).alias("_scope")).where("_scope is not null").distinct().withColumn("_known", F.lit(True)))
    n = names.withColumn("canon", canonical(F.col("name"), F.col("ecosystem"))).withColumn("_scope", scope(F.col("canon")))
    n = n.join(p, ["ecosystem", "canon"], "left").join(s, ["ecosystem", "_scope"], "left")
    gate = F.when(F.length("name") < LEAST, "short").when(F.col("_listed"), "popular").when(F.col("_known"), "scope")
    return n.withColumn("gate", gate).drop("_scope", "_listed", "_known")


def separator_twins(open_: DataFrame, popular: DataFrame) -> DataFrame:
    """(id, twin): the first popular name, by rank, that differs in punctuation only."""
    p = popular.withColumn("collapsed", collapse(F.col("name"))).groupBy("ecosystem", "collapsed").agg(F.min_by("name", "rank").alias("twin"))
    return open_.withColumn("collapsed", collapse(F.col("canon"))).join(small(p), ["ecosystem", "collapsed"]).where("twin <> canon").select("id", "twin")


def affixed(open_: DataFrame, popular: DataFrame) -> DataFrame:
    """(id, base, affix): the first affix, suffixes before prefixes, that leaves a popular name."""
    c = F.col("canon")
    cut = [F.when(c.endswith(s) & (F.length(c) > len(s)), F.struct(F.lit(i).alias("o"), F.lit(s).alias("affix"), F.regexp_replace(F.expr(f"left(canon, length(canon) - {len(s)})"), r"[-_.]\z", "").alias("base"))) for i, s in enumerate(SUFFIXES)]
    cut += [F.when(c.startswith(p) & (F.length(c) > len(p)), F.struct(F.lit(50 + i).alias("o"), F.lit(p).alias("affix"), F.expr(f"substring(canon, {len(p) + 1})").alias("base"))) for i, p in enumerate(PREFIXES)]
    tries = open_.select("id", "ecosystem", F.explode(F.filter(F.array(*cut), lambda x: x.isNotNull())).alias("x")).select("id", "ecosystem", "x.*").where(F.length("base") >= LEAST)
    hit = tries.join(small(popular.select("ecosystem", F.col("name").alias("base")).distinct()), ["ecosystem", "base"])
    return hit.groupBy("id").agg(F.min(F.struct("o", "base", "affix")).alias("x")).select("id", "x.base", "x.affix")


def nearest(open_: DataFrame, popular: DataFrame, most: int = 2) -> DataFrame:
    """(id, target, distance, lookalike): the popular name with the fewest edits; then the shorter, then the better ranked.

    Bands of length are join keys, so no name meets the whole list.
    """
    p = popular.where(F.length("name") >= LEAST).select("ecosystem", F.col("name").alias("target"), "rank", F.length("name").alias("size"), scope(F.col("name")).isNotNull().alias("scoped"))
    n = open_.withColumn("scoped", scope(F.col("canon")).isNotNull()).withColumn("size", F.explode(F.sequence(F.length("canon") - most, F.length("canon") + most)))
    d = n.join(small(p), ["ecosystem", "scoped", "size"]).where("target <> canon").withColumn("distance", F.levenshtein("canon", "target", most)).where("distance > 0")
    best = d.groupBy("id", "canon").agg(F.min(F.struct("distance", "size", "rank", "target")).alias("x")).select("id", "canon", "x.target", "x.distance")
    other = F.filter(F.zip_with(F.split("canon", ""), F.split("target", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: ~x["a"].eqNullSafe(x["b"]))
    pairs = [p for a, b in LOOKALIKE for p in (a + b, b + a)]
    swap = F.lower(F.concat(other[0]["a"], other[0]["b"]))
    look = (F.col("distance") == 1) & (F.length("canon") == F.length("target")) & swap.isin(pairs)
    return best.select("id", "target", "distance", F.coalesce(look, F.lit(False)).alias("lookalike"))


def inspect(names: DataFrame, popular: DataFrame | None, cache: DataFrame | None = None) -> DataFrame:
    """(id, name, ecosystem, findings array<struct<id, severity, resembles>>, verdict) of names(id, name, ecosystem)."""
    ascii_ = F.rlike("name", F.lit(r"[^\x00-\x7F]"))
    item = lambda cond, i, s, r: F.when(cond, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), r.cast("string").alias("resembles")))
    none = F.lit(None)
    n = names
    if popular is None:
        n = n.withColumns({"canon": F.col("name"), "twin": none, "base": none, "target": none, "distance": none, "lookalike": F.lit(False)})
    else:
        n = gated(n, popular)
        open_ = n.where("gate is null")
        for part in (separator_twins(open_, popular), affixed(open_, popular), nearest(open_, popular)):
            n = n.join(part, "id", "left")
    own = F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("base")) & ~F.col("target").eqNullSafe(F.col("twin"))
    near = own & ~F.col("lookalike") & (F.col("distance") <= F.when(F.length("canon") >= 8, 2).otherwise(1))
    found = [
        item(ascii_, "pkg-name-nonascii", "critical", none), item(F.col("twin").isNotNull(), "pkg-name-separator", "critical", F.col("twin")), item(F.col("base").isNotNull(), "pkg-name-affix", "medium", F.col("base")),
        item(own & F.col("lookalike"), "pkg-name-confusable", "critical", F.col("target")), item(near, "pkg-name-near", "medium", F.col("target")),
    ]
    if cache is not None:
        n = n.join(cache.select("ecosystem", F.col("name").alias("canon"), F.col("verdict").alias("_cached")), ["ecosystem", "canon"], "left")
        found.append(F.when(F.col("_cached").isin("danger", "caution"), F.struct(F.lit("pkg-cached-verdict").alias("id"), F.when(F.col("_cached") == "danger", "critical").otherwise("medium").alias("severity"), F.lit(None).cast("string").alias("resembles"))))
    n = n.withColumn("findings", F.filter(F.array(*found), lambda x: x.isNotNull()))
    v = F.when(F.exists("findings", lambda f: f["severity"] == "critical"), "danger").when(F.size("findings") > 0, "caution").otherwise("unknown" if popular is None else "safe")
    return n.select("id", "name", "ecosystem", "findings", v.alias("verdict"))


def typosquats(name: Column, most: int = 30) -> Column:
    """Variants of a name in a fixed order, the first `most`: dropped, swapped and inserted letters, look-alikes, separators dropped.

    The third kind puts two copies before each letter, so a letter comes out three times, as in the original.
    """
    base = F.regexp_replace(name, "^@[^/]+/", "")

    def build(b: Column) -> Column:
        at = lambda last: F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        n = F.length(b)
        part = lambda s, i, k: F.substring(s, i, k)
        drop = F.transform(at(n), lambda i: F.concat(part(b, F.lit(1), i - 1), part(b, i + 1, n)))
        swap = F.transform(at(n - 1), lambda i: F.concat(part(b, F.lit(1), i - 1), part(b, i + 1, F.lit(1)), part(b, i, F.lit(1)), part(b, i + 2, n)))
        more = F.transform(at(n), lambda i: F.concat(part(b, F.lit(1), i - 1), part(b, i, F.lit(1)), part(b, i, F.lit(1)), part(b, i, n)))
        look = F.array(*(F.replace(b, F.lit(x), F.lit(y)) for x, y in SWAPS), F.replace(b, F.lit("-"), F.lit("")), F.replace(b, F.lit("_"), F.lit("")))
        every = F.array_distinct(F.concat(drop, swap, more, look))
        return F.slice(F.filter(every, lambda x: (x != b) & (F.length(x) >= 2) & F.rlike(x, F.lit(r"^[A-Za-z0-9._-]+\z"))), 1, most)

    return F.element_at(F.transform(F.array(base), build), 1)


def malicious(df: DataFrame, listed: DataFrame | None) -> DataFrame:
    """df(ecosystem, name, version) with list_verdict: null without a list, else clear, malicious or caution."""
    if listed is None:
        return df.withColumn("list_verdict", F.lit(None).cast("string"))
    p = listed.select("ecosystem", "name", F.lit(True).alias("_known"), F.col("versions").alias("_versions"))
    df = df.join(p, ["ecosystem", "name"], "left")
    v = F.when(F.col("_known").isNull(), "clear").when(F.col("_versions").isNull(), "malicious").when(F.array_contains("_versions", F.col("version")), "malicious").otherwise("caution")
    return df.withColumn("list_verdict", v).drop("_known", "_versions")


def advised(df: DataFrame, osv: DataFrame | None, most: int = 5) -> DataFrame:
    """df(ecosystem, name and perhaps version) with vulns, malicious and advisories (id and first fixed version, `most` of them).

    osv(ecosystem, name, id) and perhaps introduced and fixed: where df has a version, only advisories that apply to it
    count. None means not checked: all three are null.
    """
    if osv is None:
        return df.withColumns({"vulns": F.lit(None).cast("long"), "malicious": F.lit(None).cast("boolean"), "advisories": F.lit(None).cast("array<struct<id:string,fixed:string>>")})
    of = [F.col(c).alias(f"_{c}") if c in df.columns else F.lit(None).cast("string").alias(f"_{c}") for c in ("ecosystem", "name", "version")]
    wanted = df.select(*of).distinct()
    text = lambda c: (F.col(c) if c in osv.columns else F.lit(None)).cast("string")
    o = osv.select(F.col("ecosystem").alias("_ecosystem"), F.col("name").alias("_name"), F.col("id").alias("_id"), text("introduced").alias("_from"), text("fixed").alias("_fixed"))
    apply = lambda c, least, cond: F.col("_version").isNull() | F.col(c).isNull() | cond(compare_versions(F.col("_version"), F.col(c)))
    hit = wanted.join(o, ["_ecosystem", "_name"]).where(apply("_from", 0, lambda x: x >= 0) & apply("_fixed", 0, lambda x: x < 0))
    place = F.row_number().over(Window.partitionBy("_ecosystem", "_name", "_version").orderBy("_id", "_fixed"))
    bad = F.col("_id").startswith("MAL-") | F.upper("_id").contains("MALWARE")
    few = F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct(F.col("_id").alias("id"), F.col("_fixed").alias("fixed")))))
    v = hit.withColumn("_n", place).groupBy("_ecosystem", "_name", "_version").agg(F.count("*").alias("vulns"), F.max(bad).alias("malicious"), few.alias("advisories"))
    at = F.col("ecosystem").eqNullSafe(F.col("_ecosystem")) & F.col("name").eqNullSafe(F.col("_name")) & (F.col("version") if "version" in df.columns else F.lit(None).cast("string")).eqNullSafe(F.col("_version"))
    out = df.join(v, at, "left").drop("_ecosystem", "_name", "_version")
    return out.withColumns({"vulns": F.coalesce("vulns", F.lit(0).cast("long")), "malicious": F.coalesce("malicious", F.lit(False)), "advisories": F.coalesce("advisories", F.array().cast("array<struct<id:string,fixed:string>>"))})


def verify(df: DataFrame, registry: DataFrame, osv: DataFrame | None, listed: DataFrame | None = None) -> DataFrame:
    """df(ecosystem, name and perhaps version) with exists, slopsquat, vulns, malicious, limited and verdict.

    registry(ecosystem, name, exists, age_days, weekly_downloads, deprecated, confusable); a package without a
    row was not looked up, and its verdict is unknown. osv as in advised(); None means not checked. listed: the list of
    malicious packages (malicious()), whose verdict counts where it is given. Ecosystems that have no registry of their
    own here are limited, and never more than caution: what a registry says is about another package of that name.
    """
    df = advised(df.join(registry, ["ecosystem", "name"], "left"), osv)
    df = malicious(df if "version" in df.columns else df.withColumn("version", F.lit(None).cast("string")), listed)
    signals = F.when(F.col("age_days") < 90, 1).otherwise(0) + F.when(F.col("weekly_downloads") < 50, 1).otherwise(0)
    signals = signals + F.when(F.col("confusable").isNotNull() & (signals > 0), 1).otherwise(0)
    df = df.withColumn("slopsquat", F.when((signals >= 2) & F.col("confusable").isNotNull(), "high").when(signals >= 1, "medium").otherwise("low"))
    df = df.withColumn("limited", ~F.col("ecosystem").isin("npm", "pypi"))
    care = (F.coalesce(F.col("vulns") > 0, F.lit(True))) | F.coalesce("deprecated", F.lit(False)) | (F.col("slopsquat") == "medium") | F.col("limited") | F.coalesce(F.col("list_verdict") == "caution", F.lit(False))
    bad = F.coalesce("malicious", F.lit(False)) | F.coalesce(F.col("list_verdict") == "malicious", F.lit(False)) | (F.col("slopsquat") == "high")
    v = F.when(F.coalesce(F.col("list_verdict") == "malicious", F.lit(False)), "danger").when(F.col("exists").isNull(), "unknown").when(~F.col("exists"), "danger").when(bad, "danger").when(care, "caution").otherwise("safe")
    return df.withColumn("verdict", v)


def vulnerabilities(df: DataFrame, osv: DataFrame | None) -> DataFrame:
    """df(ecosystem, name and perhaps version) with count, malicious, advisories and ids (five at most); all null where there is no osv table."""
    out = advised(df, osv).withColumnRenamed("vulns", "count")
    return out.withColumn("ids", F.transform("advisories", lambda a: a["id"]))


def info(df: DataFrame, registry: DataFrame) -> DataFrame:
    """df(ecosystem, name) with the registry's facts; exists is null where it was not asked."""
    return df.join(registry, ["ecosystem", "name"], "left")


def merged_dependencies(df: DataFrame, given: str | None = None, manifest: str | None = None, requirement_lines: str | None = None, packages: str | None = None) -> DataFrame:
    """df with dependencies (array<struct<name, version>>) and input_errors, from columns of four kinds that may be null.

    given (map), then package.json's dependencies and devDependencies, then requirement lines: later ones win. packages
    (array) adds names that aren't there yet, without a version. A manifest that isn't JSON is an error, not an empty one.
    """
    pair = "array<struct<name:string,version:string>>"
    none = F.array().cast(pair)
    pairs = lambda m: F.coalesce(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), F.coalesce(e["value"], F.lit("")).alias("version"))), none)
    text = F.nullif(F.trim(F.coalesce(F.col(manifest), F.lit(""))), F.lit("")) if manifest else F.lit(None).cast("string")
    read = F.from_json(text, "struct<dependencies:map<string,string>,devDependencies:map<string,string>>")
    df = df.withColumn("_read", read)
    parts = [pairs(F.col(given))] * bool(given) + [pairs(F.col("_read.dependencies")), pairs(F.col("_read.devDependencies"))]
    parts += [F.coalesce(requirements(F.col(requirement_lines)), none)] * bool(requirement_lines)
    df = df.withColumn("_all", F.concat(*parts))
    names = F.array_distinct(F.transform("_all", lambda x: x["name"]))
    own = F.transform(names, lambda n: F.struct(n.alias("name"), F.element_at(F.filter("_all", lambda x: x["name"] == n), -1)["version"].alias("version")))
    if packages:
        listed = F.array_distinct(F.filter(F.transform(F.coalesce(F.col(packages), F.array().cast("array<string>")), lambda n: F.trim(n)), lambda n: n != ""))
        own = F.concat(own, F.transform(F.array_except(listed, names), lambda n: F.struct(n.alias("name"), F.lit("").alias("version"))))
    wrong = text.isNotNull() & F.try_parse_json(text).isNull()
    errors = F.when(wrong, F.array(F.lit("manifest is not JSON"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("dependencies", own.cast(pair)).withColumn("input_errors", errors).drop("_read", "_all")


def audit(df: DataFrame, registry: DataFrame, osv: DataFrame | None, most: int | None = 40, key: str = "project") -> DataFrame:
    """verify() for the first `most` dependencies of each project(key, position); None takes all."""
    if most is not None:
        place = F.row_number().over(Window.partitionBy(key).orderBy("position"))
        df = df.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")
    return verify(df, registry, osv)


def summary(report: DataFrame) -> DataFrame:
    """Counts of an audit's verdicts and reasons."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    return report.agg(
        F.count("*").alias("total"), *(n(F.col("verdict") == v, v) for v in ("danger", "caution", "safe", "unknown")), n(F.col("exists").eqNullSafe(False), "missing"),
        n(F.coalesce("malicious", F.lit(False)), "malicious"), n(F.coalesce(F.col("vulns") > 0, F.lit(False)), "vulnerable"), n(F.coalesce("deprecated", F.lit(False)), "deprecated"), n(F.col("vulns").isNull(), "unchecked"),
    )


def clean_version(version: Column) -> Column:
    return F.nullif(F.regexp_extract(version, r"[0-9]+\.[0-9]+(?:\.[0-9]+)?", 0), F.lit(""))


def requirements(text: Column) -> Column:
    """array<struct<name, version>> of requirement lines; comments are left out. Option lines come out as names, as in the original."""
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.trim(x))
    p = r"^([A-Za-z0-9._-]+)[ \t]*(?:[=<>!~]+[ \t]*([0-9][A-Za-z0-9_.]*))?"
    return F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(p)) & ~x.startswith("#")), lambda x: F.struct(F.regexp_extract(x, p, 1).alias("name"), F.regexp_extract(x, p, 2).alias("version")))


def npm_spec(token: Column) -> Column:
    p = r"^(@?[^@]+)(?:@(.*))?\z"
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(token, p, 1), F.lit("")), token).alias("name"), F.nullif(F.regexp_extract(token, p, 2), F.lit("")).alias("version"))


def pip_spec(token: Column) -> Column:
    p = r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?[ \t]*(?:(?:===|==|>=|<=|~=|!=|>|<)[ \t]*([^ \t,;]+))?"
    return F.struct(F.coalesce(F.nullif(F.regexp_extract(token, p, 1), F.lit("")), token).alias("name"), F.nullif(F.regexp_extract(token, p, 2), F.lit("")).alias("version"))


# Prefixes of what isn't installed by a registry name.
NOT_NAMES = r"(?i)^(git\+|https?:|ssh:|file:|github:|gitlab:|bitbucket:|npm:|link:|workspace:|portal:)"


def not_package(token: Column) -> Column:
    """Why an argument isn't a package name; null for names and flags."""
    like = lambda p: F.rlike(token, F.lit(p))
    return (
        F.when(token.startswith("-"), None).when(like(r"^[.~/\\]"), "local path").when(like(r"^[A-Za-z]:[\\/]"), "local path").when(like(NOT_NAMES), "url")
        .when(like(r"^[^@/\s]+/[^@/\s]+\z"), "owner/repo").when(like(r"[$`*?]"), "expansion")
    )


def did_you_mean(names: DataFrame, known: DataFrame, most: int = 5) -> DataFrame:
    """(id, rank, suggestion, distance): the nearest of all known names of the ecosystem to names(id, name, ecosystem), by edits, then by name; known is a bounded list."""
    k = known.groupBy("ecosystem").agg(F.collect_list("name").alias("_known"))
    others = F.filter("_known", lambda x: x != F.col("name"))
    near = F.array_sort(F.transform(others, lambda x: F.struct(F.levenshtein(F.col("name"), x).alias("distance"), x.alias("suggestion"))))
    d = names.select("id", "name", "ecosystem").join(small(k), "ecosystem").select("id", F.inline(F.slice(near, 1, most)))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "suggestion"))
    return d.withColumn("rank", rank).where(F.col("rank") <= most).select("id", "rank", "suggestion", "distance")
