"""Quality scores on held-out labels, page texts on hand-made pages, and the whole pipeline."""

import collections
import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliopanel.llm import html_extract as H
from heliopanel.llm import quality_crf as C
from heliopanel.llm import queries as Q

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    field = C.Field(np.zeros(1), np.array([[0.4, -0.3], [0.1, 0.9]]), np.array([0, 0.5]), np.zeros(1), np.ones(1))
    per_text = np.array([1, 4, 3])
    scores = rng.normal(size=8)
    got = C.marginals(scores, per_text, field)
    at = 0
    for n in per_text:
        total, good = 0.0, np.zeros(n)
        for state in range(2 ** n):
            y = [(state >> k) & 1 for k in range(n)]
            value = field.starts[y[0]] + sum(scores[at + k] * (y[k] - 0.5) for k in range(n)) + sum(field.transitions[a, b] for a, b in zip(y, y[1:]))
            total += np.exp(value)
            good += np.exp(value) * np.array(y)
        assert np.allclose(got[at:at + n], good / total)
        at += n


def test_quality_on_held_out_documents(spark):
    out = Q.QUERIES["op2_quality_crf"](spark, SF).toPandas()
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    merged = out.merge(labels, on="doc_id")
    held = merged[merged.held_out]
    assert len(out) == 1000 and out.score.between(0, 1).all() and len(held) > 40
    assert (held.predicted == held.quality).mean() >= 0.95


def test_quality_edges(spark):
    rows = [(1, "A plain line, with words.\nAnd one more.", "x"), (2, None, "y"), (3, "", None), (None, "word " * 50_000, "z"), (1, "\n\n\n", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    for field in (None, C.train(df, labels), C.train(df.limit(0), labels)):
        out = C.score(df, field).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
        assert C.good_documents(df, field, least=0.0).columns == df.columns
    assert C.score(df.limit(0), None).count() == 0


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = [
    ("<nav>menu</nav><article><h1>Title</h1><p>One &amp; two <b>bold</b>\n  text<p>Next<br>line</article><footer>f</footer>", "Title\nOne & two bold text\nNext\nline"),
    ("<article><header><h1>H</h1></header><p>a</p><aside>x</aside><form>y<input></form><div class='ad box'>z</div><ul><li>i<li>j</ul><section id=comments><p>c</p></section></article>", "H\na\ni\nj"),
    ("<div class=sidebar>s</div><main><p>body text</p><script>var a='<p>';</script></main><div class='cookie-notice'>n</div>", "body text"),
    ("<p>only text &#233; &lt;b&gt;", "only text é <b>"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table><!-- c --><pre>x  y</pre></article>", "a\nb\nc\nx y"),
    ("<article>", ""), ("", ""), ("<article><p title='a>b'>q</p><p>1 < 2</article>", "q\n1 < 2"),
    ("<article><p>one <span class='advert'>buy</span>two</p></article>", "one\ntwo"),
]


@pytest.mark.parametrize("body, text", CASES)
def test_page_text(body, text):
    assert H.main_text(page(body), set(), set()) == text


NAMED = [
    ("<div class='layout with-sidebar'><div class=sidebar>s</div><article><p>a</p></article></div>", "a"),
    ("<div class='no-sidebar'><p>a</p></div>", "a"), ("<article class='social-science'><p>a</p></article>", "a"),
    ("<article><div class='post-header'><h1>H</h1></div><p>a</p><div class='share'>s</div></article>", "H\na"),
]

NAMED += [
    ("<article><section id='search-algorithms'><p>a</p></section><p>b</p></article>", "a\nb"),
    ("<article><section id='related-work'><p>a</p></section><p>b</p></article>", "a\nb"),
    ("<article><div class='social-science'><p>a</p></div><p class='alert'>b</p></article>", "a\nb"),
    ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a\nx\nb"),
    ("<div>main body</div><article>teaser</article>", "main body\nteaser"),
    ("<div>more</div><article>the longer text</article>", "the longer text"),
]


@pytest.mark.parametrize("body, text", NAMED)
def test_names_drop_no_articles(body, text):
    assert H.main_text(page(body), set(), set()) == text


@pytest.mark.parametrize("source", [
    "<div>x" * 150_000, "<a " * 300_000, "<p>y<section>" * 60_000 + "</div>" * 60_000, "<u><div>" + "<b>" * 100_000 + "</u>" * 100_000,
    "<div class=ad>z" * 60_000, "<article>" * 100_000 + "w", "<table><tr><td>c" * 50_000])
def test_broken_pages_take_linear_time(source):
    start = time.perf_counter()
    H.main_text(source, set(), set())
    H.branches(source)
    assert time.perf_counter() - start < 25 * max(1, len(source) / 1e6)


def test_names_drop_no_important_branch(spark):
    rows = [(i, f"https://a.example/{i}", page(f"<div class='no-sidebar'><p>text {i}</p></div><div class=sidebar>same</div><div class=x>end {i}</div>")) for i in range(5)]
    out = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 5 and all(r.text == f"text {r.page_id}\nend {r.page_id}" for r in out)


@pytest.mark.parametrize("pages", [2, 7, 8])
def test_tree_speaks_from_two_pages_on(spark, pages):
    rows = [(i, f"https://a.example/{i}", page(f"<div class=x1>Start | About</div><div class=x2><p>text {i}</p></div><div class=x3>All rights</div>")) for i in range(pages)]
    rows.append((100, "https://b.example/", rows[0][2]))
    out = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {i: f"text {i}" for i in range(pages)} | {100: "Start | About\ntext 0\nAll rights"}


def test_tree_drops_what_pages_share(spark):
    words = np.array([f"w{i}" for i in range(500)])
    rng = np.random.default_rng(3)
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words, 30))
        rows.append((i, f"https://a.example/{i}", page(f"<div class=x1>Start | About | More</div><div class=x2><p>{text}</p><p>{text[::-1]}</p></div><div class=x3>All rights</div>"), i))
    rows += [(100, None, None, 0), (101, "nonsense", "", 0), (102, "https://b.example/", page("<p>few pages, all stays</p>"), 0), (0, rows[0][1], rows[0][2], 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, low int").withColumn("text", F.lit("old"))
    out = {r.page_id: r.text for r in H.extract_text(df).collect()}
    assert all("rights" not in out[i] and "About" not in out[i] and out[i].count("\n") == 1 for i in range(40))
    assert out[100] == out[101] == "" and out[102] == "few pages, all stays"
    assert H.extract_text(df).count() == 44 and H.extract_text(df.limit(0)).count() == 0


def test_articles_of_given_pages(spark):
    import html
    import re
    out = {r.page_id: (r.text, r.n_chars) for r in Q.QUERIES["op6_html_extract"](spark, SMALL).collect()}
    for page_id, source in duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner))
        want = "\n".join(b for b in blocks if b)
        assert out[page_id] == (want, len(want))


def test_style_tree_equals_brute_force(spark):
    pages = duckdb.sql(f"SELECT url, html FROM '{SMALL}/pages.parquet'").fetchall()
    rows = [("a" if i % 3 else "b", h) for i, (_, h) in enumerate(pages)] + [("c", None), ("a", "")]
    got = {(r.host, r.path): r for r in H.style_tree(spark.createDataFrame(rows, "host string, html string").repartition(4)).collect()}

    def entropy(values):
        counts = collections.Counter(values)
        return sum(n / len(values) * math.log(len(values) / n) for n in counts.values())

    seen = 0
    for host in "abc":
        found = [H.branches(h or "") for g, h in rows if g == host]
        for path in {p for f in found for p, kind, _ in f if kind == "P"}:
            count = sum(any(p == path and kind == "P" for p, kind, _ in f) for f in found)
            texts = [v for f in found for p, kind, v in f if p == path and kind == "T"]
            styles = [v for f in found for p, kind, v in f if p == path and kind == "S"]
            if count < 2:
                continue
            seen += 1
            content = 1 - sum(math.log(n) * n for n in collections.Counter(texts).values()) / (len(texts) * math.log(count))
            shape = min(1.0, entropy(styles) / math.log(count)) if styles else 0.0
            row = got[host, path]
            assert row.pages == count and abs(row.content - content) < 1e-9
            assert abs(row.importance - (H.CONTENT_SHARE * content + (1 - H.CONTENT_SHARE) * shape)) < 1e-9
    assert seen == len(got) > 5


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "MinHash near-dedup" in names
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*columns, "token_ids", "n_tokens"]
    rows = out.collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert rows and all(r.text == texts[r.doc_id] and len(r.token_ids) == r.n_tokens for r in rows)


def test_stages_on_odd_rows(spark):
    rows = [(1, "A fine line of words, and more.", "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (1, "A fine line of words, and more.", "en", "s", 1),
            (3, "long " * 60_000, None, None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd = df.withColumn("kept", F.lit(1)).withColumn("score", F.lit("s")).withColumn("taken", F.lit(2)).withColumn("token_ids", F.lit("t")).withColumn("id", F.lit(9))
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for docs in (df, odd, df.limit(0)):
            out = stage(spark, docs, SMALL)
            if place < 4:
                assert out.columns == docs.columns
            assert out.count() <= 3 * max(docs.count(), 1)
