"""Main text of pages: made pages whose text is known, and templates against counts by brute force."""

import random
from collections import defaultdict

import pyspark.sql.functions as F

from landloom.llm import html_text
from landloom.llm.html_text import extract_pages, main_blocks, parsed, site_templates, with_host

SCHEMA = "page_id long, url string, html string"
WORDS = [f"w{i}" for i in range(500)]


def said(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_rules():
    of = lambda page: main_blocks(page, set())
    assert of("") == [] and of("just words") == ["just words"]
    assert of("<p>a &amp; b&nbsp;&lt;c&gt; &#233;&#x41;<p>two\n\n  <b>bold</b>er<br>x</p>") == ["a & b <c> éA", "two bolder x"]
    assert of('<head><title>T</title><script>if (a<b) "</p>"</script><style>p{}</style></head><nav><a>Home</a></nav><header>Site</header><article><header><h1>Head</h1></header><p>One<!-- <p>no</p> --><ul><li>i<li>j</ul></article><aside>s</aside><footer>f</footer>') == ["Head", "One", "i", "j"]
    assert of('<article><h1>A</h1><p>b</p><div class="share-buttons">s</div><form>f</form><section id="comments"><article class="comment">c</article></section></article><article class="comment">d</article>') == ["A", "b"]
    assert of('<div class="cookie-notice">x</div><div class="layout has-sidebar"><div id="content"><p>t</p></div><div class="sideBar widget">w</div></div><p hidden>h</p><p style="display: none">h</p><p>u<span aria-hidden="true">v</span></p>') == ["t", "u"]
    assert of('<form action="/"><main><p>kept inside a form</p><nav>n</nav></main></form>') == ["kept inside a form"]
    assert of('<div class="ad">never closed<article><p>the article</p></article>') == ["the article"]
    assert of("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>") == ["a b", "c", "d", "e"]
    assert of('a < b <a title="x > y">c</a> & d <3 <!-- open') == ["a < b c & d <3"]
    assert of("</div></p>x</b><p>y") == ["x", "y"] and of("<p") == [] and of("<textarea>z") == []
    assert of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == ["deep"]
    assert of("<p>" + "long " * 200_000 + "<p>" + "&amp" * 1000) == [("long " * 200_000).strip(), "&" * 1000]


def site(rng, host, n, inside=False):
    """Pages of a host: menus and notices in divs without a telling class, half of the pages near copies of one."""
    rows, want = [], {}
    common = said(rng, 60)
    for i in range(n):
        body = [common + said(rng, 2) if i % 2 else said(rng, 40), said(rng, 30), "Same line in many articles."] + ([said(rng, 5)] if rng.random() < 0.5 else [])
        paragraphs = "".join(f"<p>{b}</p>" for b in body)
        title = f"Copies {host}" if i % 2 else said(rng, 4)
        menu, notice = "<div class='x1'><p>Start</p><p>Shop &amp; more</p></div>", f"<div><p>All rights with {host}</p></div>"
        own = f"<h1>{title}</h1>{paragraphs}"
        rows.append((len(rows), f"http://{host}/p{i}", f"<title>{title}</title>{menu}<div class=body>{own}</div>{notice}" if not inside else f"<title>{title}</title>{menu}<article>{own}</article>{notice}"))
        want[i] = "\n\n".join([title, *(b for b in body if inside or b != "Same line in many articles.")])
    return rows, want


def test_templates_of_hosts(spark):
    rng = random.Random(1)
    soup, want_soup = site(rng, "soup.example", 60)
    articles, want_articles = site(rng, "articles.example", 60, inside=True)
    few, _ = site(rng, "few.example", 4)
    rows = soup + [(1000 + i, u, h) for i, u, h in articles] + [(2000 + i, u, h) for i, u, h in few]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: got[i].text for i in want_soup} == want_soup
    different = {i: t for i, t in want_articles.items()}
    texts = {i: got[1000 + i].text for i in different}
    assert all(texts[i] in (t, t.replace("\n\nSame line in many articles.", "")) for i, t in different.items())
    assert "All rights with few.example" in got[2000].text and all(r.n_chars == len(r.text) for r in got.values())


def test_templates_against_counts(spark):
    rng = random.Random(2)
    rows, _ = site(rng, "a.example", 40)
    more, _ = site(rng, "B.example", 30, inside=True)
    df = with_host(spark.createDataFrame(rows + more + rows[:3], SCHEMA))
    subjects, seen, inner = defaultdict(set), defaultdict(set), {}
    for r in df.collect():
        blocks, subtrees, title = parsed(r.html)
        kept, subject = html_text.scope(blocks), html_text._subject(blocks, title)
        subjects[r.host].add(subject)
        for digest, first, after, within in subtrees:
            if kept & set(range(first, after)):
                seen[r.host, digest].add(subject)
                inner[r.host, digest] = within
    want = defaultdict(set)
    for (host, digest), of in seen.items():
        if len(of) >= max(html_text.LEAST_PAGES, (html_text.ARTICLE_SHARE if inner[host, digest] else html_text.SHARE) * len(subjects[host])):
            want[host].add(digest)
    assert {r.host: set(r.template) for r in site_templates(df).collect()} == dict(want) and "b.example" in subjects


def test_edges(spark, monkeypatch):
    rows = [(1, None, "<p>a</p>"), (None, "no scheme", "<p>b</p>"), (2, "http://h/x", None), (2, "http://h/x", None), (3, "http://h/x", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.select("*", F.lit("k").alias("host"), F.lit("t").alias("text"), F.lit(1).alias("template"), F.lit(2).alias("n_chars"))
    want = sorted([("1", "a", 1), ("None", "b", 1), ("2", "", 0), ("2", "", 0), ("3", "", 0)])
    for frame in (df, wide):
        assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract_pages(frame).collect()) == want
    monkeypatch.setattr(html_text, "BROADCAST_TEMPLATES", -1)
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in extract_pages(df).collect()) == want
    assert extract_pages(df.where("page_id > 9")).collect() == []


def test_articles_of_the_tables(spark):
    """On the given pages the text is that of the article's heading and paragraphs."""
    import html
    import re

    for r in extract_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
