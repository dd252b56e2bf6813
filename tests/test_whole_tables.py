"""Queries answer for every row of their tables, beside expectations that leave out none."""

import duckdb

from tamis.operators import packages as pk
from tamis.plans import packages, urls, web

SF = "/root/testdata/sf0.001"


def table(sql: str) -> list[tuple]:
    """Rows of a query in DuckDB, with {table} for the tables of SF."""
    names = ("lineitem", "part", "pages")
    return duckdb.sql(sql.format(**{n: f"'{SF}/{n}.parquet'" for n in names})).fetchall()


def test_redirect_chain_of_every_order(spark):
    got = [(r.id, r.hops, r.followed) for r in web.redirect_chain(spark, SF).collect()]
    assert sorted(got) == sorted(table("SELECT l_orderkey, count(DISTINCT l_linenumber), count(DISTINCT l_linenumber) - 1 FROM {lineitem} GROUP BY 1"))


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_did_you_mean_of_every_name(spark):
    known = packages._popular(spark, SF).where("name not like '@%'").collect()
    want = []
    for r in packages._names(spark, SF).collect():
        near = sorted((edits(r.name, k.name), k.name) for k in known if k.ecosystem == r.ecosystem and k.name != r.name)
        want += [(r.id, i, name, n) for i, (n, name) in enumerate(near[:5], 1)]
    got = [(r.id, r.rank, r.suggestion, r.distance) for r in packages.did_you_mean(spark, SF).collect()]
    assert sorted(got) == sorted(want)


def test_did_you_mean_without_the_first_letter(spark):
    names = spark.createDataFrame([(1, "equests", "pypi"), (2, "erquests", "pypi"), (3, "xequests", "pypi"), (4, "érequests", "pypi"), (5, None, "pypi"), (6, "requests", "npm")], "id long, name string, ecosystem string")
    known = spark.createDataFrame([("pypi", "requests"), ("pypi", "exceptions"), ("pypi", "xlrd")], "ecosystem string, name string")
    got = {r.id: (r.suggestion, r.distance) for r in pk.did_you_mean(names, known, 1).collect()}
    assert got == {1: ("requests", 1), 2: ("requests", 2), 3: ("requests", 1), 4: ("requests", 1)}


def test_requirements_of_every_part(spark):
    fixed = "(VALUES ('requests', '2.31.0'), ('flask', '2.0'), ('-r', ''), ('numpy', ''), ('pkg', ''), ('a_b.c', '1.4.rc1')) AS t(name, version)"
    want = table(f"SELECT p_partkey, name, version FROM {{part}}, {fixed} UNION ALL SELECT p_partkey, 'part' || p_partkey, '1.' || p_partkey % 9 FROM {{part}}")
    assert sorted(tuple(r) for r in packages.requirements_parse(spark, SF).collect()) == sorted(want)


def test_host_argument_of_every_url(spark):
    db = duckdb.connect()
    for n in ("part", "pages"):
        db.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    want = db.sql(urls.SQL["host_argument"].replace(" WHERE id % 2 = 0", "")).fetchall()
    got = [(r.id, r.host) for r in urls.host_argument(spark, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) == db.sql("SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM pages)").fetchall()[0][0]


def beside(spark, plan, name: str, folder, **tables: str) -> list[tuple]:
    """Rows of a query on tables made by SQL, equal to those of its SQL."""
    db = duckdb.connect()
    for n, sql in tables.items():
        db.sql(f"COPY ({sql}) TO '{folder}/{n}.parquet'")
        db.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    want = db.sql(plan.SQL[name])
    got = plan.QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    text = lambda rows: sorted([tuple(r) for r in rows], key=str)
    assert text(got) == text(want.fetchall())
    return text(got)


def test_css_extract_of_cut_references(spark, tmp_path):
    headings = ["a &amp;&amp; b&amp", "&lt;b&gt; &quot;c&quot;", "&am", "&copy; &#39; &amp;lt; &AMP; &ampx", "x & y && z", "Zeit"]
    made = ", ".join(f"({i}, '{h}')" for i, h in enumerate(headings))
    pages = f"SELECT i::BIGINT AS page_id, 'http://a.org/' AS url, '<html><head></head><body><nav><ul><li><a href=\"/x?a=1&b=2\">x</a></li></ul></nav><article><h1>' || h || '</h1><p><b>t</b></p></article></body></html>' AS html FROM (VALUES {made}) AS t(i, h)"
    got = [r[1] for r in beside(spark, web, "css_extract", tmp_path, pages=pages)]
    assert got == ["a && b&amp", '<b> "c"', "&am", "&copy; &#39; &lt; &AMP; &ampx", "x & y && z", "Zeit"]


def test_css_extract_of_pages_without_the_bad_selector_s_elements(spark, tmp_path):
    pages = "SELECT 1::BIGINT AS page_id, 'http://a.org/' AS url, '<nav><ul><li><a href=\"/x\">x</a></li></ul></nav><article><h1>T</h1></article>' AS html"
    assert beside(spark, web, "css_extract", tmp_path, pages=pages) == [(1, "T", 1, True)]


def test_payment_url_verdict_of_shared_ids(spark, tmp_path):
    part = "SELECT unnest([5, 9, 1000005, 1000007, 1000009])::BIGINT AS p_partkey, 'blue steel' AS p_name"
    pages = "SELECT unnest([5, 6, 9])::BIGINT AS page_id, unnest(['https://a.example.org/x', 'http://b.example.org/', NULL]) AS url"
    got = beside(spark, urls, "payment_url_verdict", tmp_path, part=part, pages=pages)
    ids = [r[0] for r in got]
    assert [ids.count(i) for i in (5, 9, 1000005, 1000006, 1000007, 1000009)] == [1, 1, 4, 1, 1, 4]
