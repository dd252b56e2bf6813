"""Mixing, URL filters, LM scoring, the Jaccard join and fingerprints: against brute force and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from odd import SCHEMA, documents

from tamis.llm import components, fingerprint, htmltext, jaccard, keycount, lm, mixing, sigtree, urlfilter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_mixing_targets(docs):
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(documents()) == docs.count()
    size = Counter()
    for d in documents():
        size[d[3]] += len(words(d[1]))
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * size[s]}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else weight[s] * level
        if not over:
            break
        left -= sum(2 * size[s] for s in over)
        free -= over
    by_id = {r.doc_id: r for r in got}
    for d in documents():
        r = by_id[d[0]]
        assert r.source_size == size[d[3]] and abs(r.target - target[d[3]]) < 1e-6 or d[0] in (None, 7, 8)
        assert r.taken <= 2 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect()))


def test_mixing_takes_near_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 23), ["a", "a", "a", "b", "c"][i % 5]) for i in range(6000)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in (1, 3, 4):
        own = [r for r in got if r.doc_id % 5 == s]
        target = own[0].target
        assert abs(sum(r.taken for r in got if rows[r.doc_id][2] == rows[own[0].doc_id][2]) - target) < 0.01 * target


def test_mixing_repeats_rows(docs):
    out = mixing.mix_sources(docs)
    assert out.columns == docs.drop("size", "target").columns or set(out.columns) <= set(docs.columns)
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix_report(docs).collect()}
    n = Counter((r.doc_id, len(words(r.text))) for r in out.collect())
    assert all(n[k] == v for k, v in copies.items() if k[0] != 7)
    assert mixing.mix_report(docs.limit(0)).count() == 0 == mixing.mix_sources(docs.limit(0)).count()


def judged(url, rules):
    m = re.search(r"://([^/?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = re.search(r"://[^/?#]*([^?#]*)", url)[1] if m else ""
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[2] if best else "allow"


def test_url_filters(spark):
    rules = [*urlfilter.RULES, ("block", "org", "/x/y"), ("allow", "a.org", "/x"), ("block", "localhost", "/")]
    urls = ["http://Example.ORG/es/1?x#y", "https://example.org/en/17", "x://sub.example.org/en/2", "//org/", "http://org", "http://org?a", "http://notexample.org/es/", None, "", "mailto:x", "http://a.org/x/y", "http://u@EXAMPLE.org:80/es/", "ftp://", "http://de.com/de/", "http://localhost/", "http:///de/", "http://com//de/", "http://É.com/fr/é", "http://a..com/de/x", "http://ORG/a\nb"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls * 2)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, spark.createDataFrame(rules, "verdict string, host string, path string")).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls * 2)}
    assert urlfilter.judge(df.limit(0), spark.createDataFrame(rules, "verdict string, host string, path string")).count() == 0


def brute_lm(rows, trained, weights, uniform, total, distinct):
    """(id, score, full_score) of each row by plain counting; trained: numbers of rows that were learned from."""
    padded = [[None, None, *words(t), None] for _, t in rows]
    grams = lambda k: Counter(g for i in trained for g in own(i, k))

    def own(i, k):
        p = padded[i]
        return [tuple(p[j - k + 1 : j + 1]) for j in range(2, len(p))] if k else []

    counts = {k: grams(k) for k in (1, 2, 3)}
    for i, (key, _) in enumerate(rows):
        out = []
        for minus in (Counter(), Counter(g for k in (1, 2, 3) for g in own(i, k))):
            c = lambda g, m=minus: counts[len(g)][g] - (m[g] if i in trained else 0)
            n = total - (len(own(i, 1)) if minus and i in trained else 0)
            starts = c((None,))
            score, p = 0.0, padded[i]
            for j in range(2, len(p)):
                first = j == 2
                two, one = (starts, starts) if first else (c(tuple(p[j - 2 : j])), c((p[j - 1],)))
                b = 32 + int(math.log2(two)) if two > 0 else 1 + int(math.log2(one)) if one > 0 else 0
                parts = (c(tuple(p[j - 2 : j + 1])) / max(two, 1), c(tuple(p[j - 1 : j + 1])) / max(one, 1), c((p[j],)) / max(n, 1), uniform)
                score += math.log10(sum(w * x for w, x in zip(weights[b], parts, strict=True)) if n > 0 else uniform)
            out.append(round(score, 6))
        yield key, out[1], out[0]


def test_lm_counts_against_brute_force(spark, docs, monkeypatch):
    train = "doc_id <> 12"
    from pyspark.sql import functions as F

    learned = []
    real = lm.learn
    monkeypatch.setattr(lm, "learn", lambda h, u: learned.append((h, real(h, u), u)) or learned[-1][1])
    got = lm.score_texts(docs, F.expr(train)).collect()
    rows = [(d[0], d[1]) for d in documents()]
    c = Counter()
    for i, t in rows:
        if i is not None and i != 12:
            c.update([*words(t), None])
    total, distinct = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = [*words(t), None]
        want[i, len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    trained = {k for k, (i, _) in enumerate(rows) if i is not None and i != 12}
    histogram, weights, uniform = learned[0]
    assert Counter((r.doc_id, round(r.score, 6), round(r.full_score, 6)) for r in got) == Counter(brute_lm(rows, trained, weights, uniform, total, distinct))
    held = {r[0] for r in docs.where(F.expr(train) & (F.pmod(F.xxhash64(F.lit("held"), F.col("doc_id").cast("string")), F.lit(10)) == 0)).select("doc_id").collect()}
    assert held and histogram[:, 4].sum() == sum(len(words(t)) + 1 for i, t in rows if i in held)
    assert lm.score_texts(docs.limit(0), F.lit(True)).count() == 0
    none = lm.score_texts(docs, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and len(none) == len(rows) and {r.score for r in none} == {0.0}


def test_lm_scores_repeated_texts_apart(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 400, 40))
    once = [(i, text()) for i in range(300)]
    twice = [(1000 + 500 * k + i, t) for i, t in enumerate(text() for _ in range(30)) for k in (0, 1)]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_texts(spark.createDataFrame(once + twice, "doc_id long, text string"), F.lit(True)).collect()}
    assert min(got[i] for i, _ in twice) > max(got[i] for i, _ in once)


def test_lm_beats_the_base(spark):
    held = [r for r in lm.op8_lm_scoring(spark, SF).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in held)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_weights():
    """They sum to one, follow the likelihood's maximum, and buckets without events take their neighbour's."""
    rng = np.random.default_rng(1)
    events = np.stack([rng.choice([32, 34, 3, 0], 400), rng.choice([1, -2, -9], 400), rng.choice([1, -4, -12], 400), rng.choice([1, -6, -11], 400), rng.integers(1, 30, 400)], 1)
    events[events[:, 0] < 32, 1] = 1
    events[events[:, 0] == 0, 2] = 1
    w = lm.learn(events, 1e-4)
    assert np.allclose(w.sum(1), 1) and not w[:32, 0].any() and not w[0, 1]
    assert (w[33] == w[32]).all() and (w[40] == w[34]).all() and (w[7] == w[3]).all()
    for b in (32, 3):
        own = events[events[:, 0] == b]
        p = np.concatenate([np.where(own[:, 1:4] > 0, 0, 2.0 ** (own[:, 1:4] / (2, 2, 1))), np.full((len(own), 1), 1e-4)], 1)
        like = lambda v: (own[:, 4] * np.log(p @ v)).sum()  # noqa: E731, B023
        for k in range(4):
            for m in range(4):
                near = w[b] + 0.02 * (np.arange(4) == k) - 0.02 * (np.arange(4) == m)
                if (near >= 0).all():
                    assert like(w[b]) > like(near) - 1
    assert np.allclose(lm.learn(np.zeros((0, 5)), 0.5).sum(1), 1)


def brute_components(rows, percent=75):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    up = list(range(len(sets)))
    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = up[x], up[y]
                up = [new if u == old else u for u in up]
    least = {}
    for k, (i, _) in enumerate(sets):
        least[up[k]] = min(least.get(up[k], i), i, key=lambda v: (v is None, v or 0))
    return Counter((i, len(s), least[up[k]] if s else i) for k, (i, s) in enumerate(sets))


def test_jaccard_against_brute_force(docs):
    got = jaccard.near_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == brute_components([(d[0], d[1]) for d in documents()])
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_jaccard_tiles_and_chains(spark, monkeypatch):
    """A chain of edits longer than a tile, a shared passage, and copies."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(900)]
    text = [vocabulary[k] for k in rng.integers(0, 900, 60)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(text)))
        if i % 3 == 2:
            text = text.copy()
            text[(i * 7) % 60] = f"z{i}"
    passage = " ".join(vocabulary[k] for k in rng.integers(0, 900, 55))
    rows += [(200 + i, passage + " " + " ".join(vocabulary[k] for k in rng.integers(0, 900, 5 + i))) for i in range(30)]
    monkeypatch.setattr(jaccard, "TILE", 900)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, jaccard.near_duplicates(df).collect())) == brute_components(rows)


@pytest.mark.parametrize("seed", range(6))
def test_signature_tree(seed):
    rng = np.random.default_rng(seed)
    sets = []
    for _ in range(300):
        if sets and rng.random() < 0.6:
            old = sets[rng.integers(len(sets))]
            s = np.unique(np.concatenate([old[rng.random(len(old)) > 0.12], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)]))
        else:
            s = np.unique(rng.integers(0, 2**63, rng.integers(1, 60)).astype(np.uint64))
        sets.append(s if len(s) else np.array([7], np.uint64))
    forest = sigtree.Forest(len(sets))
    sigtree.links(sets, 75, forest)
    plain = sigtree.Forest(len(sets))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                plain.join(i, j)
    assert [forest.find(i) for i in range(300)] == [plain.find(i) for i in range(300)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 3), (200, 201), (201, 203), (300, 300), (50, 60), (60, 50)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} == {got[100]} and {got[i] for i in (200, 201, 203)} == {200} and 300 not in got and got[60] == 50
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_packing():
    rng = np.random.default_rng(3)
    parts, want = [], Counter()
    for code in (0, 1, 1 << 40, 2 << 40 | 7):
        key, count = np.unique(rng.integers(0, 2**keycount.BITS, 2000).astype(np.uint64) & np.uint64(2**keycount.BITS - 2**20), return_counts=True)
        parts.append((code, key, count))
        want.update({(code, int(k)): int(n) for k, n in zip(key, count, strict=True)})
    found = Counter()
    for r in keycount._pack(9, 1, [*parts, (3, np.zeros(0, np.uint64), np.zeros(0, np.int64))], 5).to_pylist():
        assert r["p"] >> 5 == 1 and r["s"] == 9
        low = keycount._unpack(r["sizes"], r["heads"], r["plain"], r["steps"])
        codes = np.repeat(np.frombuffer(r["segments"], "<i8"), np.frombuffer(r["sizes"], "<u4"))
        for code, b, n in zip(codes.tolist(), low.tolist(), keycount.numbers(r["counts"]).tolist(), strict=True):
            found[code, (r["p"] & 31) << keycount.BITS - 5 | b] += n
    assert found == want


@pytest.mark.parametrize("size", [1, 3, 7, 1000])
def test_segments_do_not_depend_on_batches(monkeypatch, size):
    import pyarrow as pa

    monkeypatch.setattr(keycount, "SEGMENT_BYTES", 50)
    monkeypatch.setattr(keycount, "SEGMENT_DOCS", 6)
    rng = np.random.default_rng(5)
    rows = sorted((int(s), int(c), i) for i, (s, c) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(-1, 3, 200), strict=True)))
    texts = [None if k % 9 == 0 or c < 0 else "x" * (k * 7919 % 40) for s, c, k in rows]
    columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array(texts, pa.string()), pa.array([r[2] for r in rows])]
    table = pa.Table.from_arrays(columns, names=["s", "cls", "text", "id"])
    want, key = {}, None
    for (s, c, k), t in zip(rows, texts, strict=True):
        if (s, c) != key:
            key, number, size_, n = (s, c), 0, 0, 0
        want.setdefault((s, c, number), []).append(k)
        size_, n = size_ + len(t or ""), n + 1
        if c >= 0 and (size_ >= 50 or n >= 6):
            number, size_, n = number + 1, 0, 0
    got = {}
    for s, c, number, part in keycount.streamed(iter(table.to_batches(max_chunksize=size))):
        got.setdefault((s, c, number), []).extend(part.column("id").to_pylist())
    assert got == want


def paragraphs(text):
    return {p.strip(" ") for p in re.findall(r"[^\n.!?]+[.!?]*", text)} - {""}


def test_fingerprints_against_brute_force(docs):
    got = fingerprint.compare_versions(docs).collect()
    rows = sorted(((d[0], d[1] or "") for d in documents()), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        a, b, c = paragraphs(t), paragraphs(edited), paragraphs(nxt)
        like = lambda x, y: 1.0 if not x and not y else 1 - len(x ^ y) / (len(x) + len(y))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    same = {}
    for r in fingerprint.fingerprint(docs).select("text", "fingerprint").collect():
        assert same.setdefault(r.text or "", r.fingerprint) == r.fingerprint


def test_fingerprints_one_row_and_none(spark, docs):
    one = spark.createDataFrame([(5, "A b. C d.")], "doc_id long, text string")
    assert [(r.n_chars, r.near_next) for r in fingerprint.compare_versions(one).collect()] == [(9, 1.0)]
    assert fingerprint.compare_versions(docs.limit(0)).count() == 0


def test_next_of_hot_ids(spark):
    """A third of all rows without an id, and a third with one id: both are cut, and order is by hashes of texts."""
    rows = [(None, f"null {i}. x") for i in range(300)] + [(50, f"hot {i}. y") for i in range(300)] + [(i, f"own {i}.") for i in range(300) if i != 50] + [(50, "hot 3. y"), (None, None)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    want = Counter((i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order))
    assert Counter(map(tuple, fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect())) == want


def test_fingerprint_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, fingerprint.op10_document_fingerprints(spark, SF).select("doc_id", "fingerprint", "edited_fingerprint").collect()))
    want = sorted(con.sql(f"SELECT doc_id, fingerprint, edited_fingerprint FROM ({fingerprint.SQL['op10_document_fingerprints']})").fetchall())
    assert got == want


PAGES = [
    ("<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>One, two,   three\nfour five six seven eight.<p>Second paragraph, with <b>bold</b> text &lt;here&gt;.</article><footer>&copy; x</footer></body></html>", "Title & more\n\nOne, two, three four five six seven eight.\n\nSecond paragraph, with bold text <here>."),
    ("", ""), (None, ""), ("<script>var a = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->", ""),
    ("<div class='sidebar'><p>Side text, that is rather long, with commas, and more.</p></div><div id='content'><p>Main text that is long enough, with a comma.</p><ul><li>an item</li></ul></div><div class='comments'><p>A reader comment that is long, too, indeed.</p></div>", "Main text that is long enough, with a comma.\n\nan item"),
    ("<body><p>short", "short"),
    ("<div><div hidden><p>hidden words that are quite long, really</p></div><p>Visible words that are long enough, surely.</p><form><p>Name your price, please, right now</p></form></div>", "Visible words that are long enough, surely."),
    ("<main>" + "<div>" * 3000 + "deep text, deep down" + "</div>" * 3000 + "</main>", "deep text, deep down"),
    ("<p>a < b and c > d &nbsp; &#x41;&#66; &notanentity; fin", "a < b and c > d AB &notanentity; fin".replace("&not", "¬")),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_extract_keeps_rows(spark):
    df = spark.createDataFrame([(i, f"u{i}", p, "text", 3) for i, (p, _) in enumerate(PAGES)] + [(None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: ("", 0)}
    assert htmltext.extract(df.limit(0)).count() == 0
