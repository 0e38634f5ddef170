"""Extraction against known articles, template statistics against plain counts."""

import glob
import html
import os
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lociweave.llm import extraction, queries

FOLDER = "/root/testdata/sf0.001"
WORDS = "stone river light under market winter garden yellow paper window silent morning table green follow".split()


def prose(rng, n=30):
    return " ".join(rng.choices(WORDS, k=n))


def marked(rng):
    """A page with an article element; all around it is marked."""
    body = [prose(rng) for _ in range(rng.randint(1, 5))]
    parts = "".join(f"<p>{b}</p>" for b in body)
    page = f'<html><body><header><a href="/">Home</a> {prose(rng, 3)}</header><nav><ul><li><a>x</a><li><a>y</a></ul></nav><div class="cookie-notice">We use cookies {prose(rng, 20)}</div><article><h1>A title</h1>{parts}<aside>{prose(rng)}</aside><form><input>{prose(rng, 5)}</form><div class="share-buttons">Tell all</div></article><section id="comments"><article class="comment"><p>{prose(rng, 90)}</p></article></section><div class="sidebar">{prose(rng, 60)}</div><footer>{prose(rng, 8)}</footer></body></html>'
    return page, " ".join(["A title", *body])


def unmarked(rng):
    """A page of a template whose names say nothing; menus and texts around the article show by their recurrence."""
    body = [prose(rng) for _ in range(rng.randint(2, 6))]
    links = "".join(f"<li><a href='/{k}'>{prose(rng, 2)}</a></li>" for k in range(5))
    page = f'<html><body><div class="k1"><ul>{links}</ul></div><div class="k2"><div class="k3"><h1>Of {body[0][:11]}</h1>{"".join(f"<p>{b}</p>" for b in body)}<div class="k5">Tell a friend</div></div></div><div class="k4">All of this is ours</div></body></html>'
    return page, " ".join([f"Of {body[0][:11].strip()}", *body])


def pages_of(maker, host, n, seed):
    rng = random.Random(seed)
    made = [maker(rng) for _ in range(n)]
    return [(f"https://{host}/{k}", page) for k, (page, _) in enumerate(made)], [text for _, text in made]


@pytest.fixture(scope="module")
def site():
    a, x = pages_of(marked, "a.example.com", 20, 1)
    b, y = pages_of(unmarked, "b.example.com:80", 20, 2)
    c, z = pages_of(marked, "c.example.com", 1, 3)
    return [(k, u, h) for k, (u, h) in enumerate(a + b + c)], x + y + z


def test_extract(spark, site):
    rows, want = site
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("text", F.lit(1)).withColumn("key", F.lit(2)).repartition(4)
    got = {r["page_id"]: r for r in extraction.extract(df).collect()}
    assert [got[k]["text"] for k in range(len(want))] == want
    assert all(got[k]["n_chars"] == len(t) and got[k]["url"] == rows[k][1] for k, t in enumerate(want))


def test_many_templates_are_joined(spark, site, monkeypatch):
    monkeypatch.setattr(extraction, "BROADCAST_KEYS", 0)
    rows, want = site
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(len(want))] == want


def test_odd_rows(spark):
    long = "<p>" + "deep and wide " * 50_000 + "</p>"
    rows = [(None, None, "<p>a</p><p>b</p>"), (1, "https://x.org/", None), (1, "https://x.org/", None), (2, "https://x.org/2", ""), (3, "not a url", "plain text"), (4, "https://x.org/4", f"<article>{long}</article>"), (4, "https://x.org/4", "<article></article>"), (5, "https://x.org/5", "<script>var a='<p>no</p>'</script><style>p{}</style>"), (6, "https://x.org/6", "<div>" * 20_000 + "deep" + "</div>" * 20_000)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = Counter((r["page_id"], r["text"][:30]) for r in got)
    assert text == Counter([(None, "a b"), (1, ""), (1, ""), (2, ""), (3, "plain text"), (4, ("deep and wide " * 3)[:30]), (4, ""), (5, ""), (6, "deep")])
    assert max(r["n_chars"] for r in got) == 50_000 * 14 - 1
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_keep_their_text(spark):
    """A page that a host has many times is all template by its vectors; its paragraphs stay."""
    page, want = marked(random.Random(8))
    near = [page.replace("A title", f"Title {k}") for k in range(12)]
    rows = [(k, "http://h.org/", page) for k in range(12)] + [(k + 12, "http://n.org/", p) for k, p in enumerate(near)]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == want and got[k + 12] == want.replace("A title", f"Title {k}") for k in range(12))


def test_classes_against_plain_vectors(spark, site):
    rows, _ = site
    df = spark.createDataFrame(rows, "key long, url string, html string").repartition(5)
    got = defaultdict(set)
    for r in extraction.occurrences(df.withColumn("key", F.xxhash64("key"))).collect():
        got[r["host"], r["x1"], r["x2"], r["pages"], r["n"]].add(r["token"])
    vectors = defaultdict(dict)
    for k, url, source in rows:
        page = extraction.Page(source)
        tokens = Counter(e.token for e in page.elements) + Counter({extraction.hashed(e.token, "text", t): 1 for e, t in page.texts()})
        for token, n in tokens.items():
            vectors[extraction.host_of(url), token][k] = n
    want = defaultdict(set)
    for (host, token), v in vectors.items():
        want[host, tuple(sorted(v.items()))].add(token)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    found = {r["host"]: r for r in extraction.templates(extraction.occurrences(df.withColumn("key", F.xxhash64("key")))).collect()}
    assert set(found) == {"a.example.com", "b.example.com"}
    tags = [x["tag"] for x in found["b.example.com"]["frame"]]
    assert tags == ["#document", "html", "body", "div", "ul", "div", "div", "h1", "div", "div"]
    assert len(found["b.example.com"]["texts"]) == 2 and len(found["b.example.com"]["lists"]) == 2


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a&amp;b &lt;c&gt; &eacute;&#233;&#x41;&nbsp;x</p>", "a&b <c> ééA x"),
        ("<p>one<b>two</b>three<br>four</p>five", "onetwothree four five"),
        ("<p><b>open<br><p>next</b></p>", "open next"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<p>a<!-- <p>no</p> -->b<![CDATA[x]]></p><!-- open <p>never", "ab"),
        ("<script>if (a<b) '</p>'</script><p>x < y and a<3</p>", "x < y and a<3"),
        ('<a title="x > y" href=\'">\'>link</a> text', "link text"),
        ("<article>cut of<footer>f</footer> at the end <a href='", "cut of at the end"),
        ("<form><h1>T</h1><p>in a form that wraps all</p></form>", "T in a form that wraps all"),
        ('<body class="has-sidebar"><main><p>a b c</p><div style="display: none">no</div><div hidden>no</div></main></body>', "a b c"),
        ('<div class="comments-open"><article><h2>T</h2><p>words here</p></article></div>', "T words here"),
        ("<nav>unclosed<article><p>still</p></article>", "still"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>x</p></article>", "T by me x"),
        ("</div></p>stray", "stray"),
    ],
)
def test_one_page(source, want):
    assert extraction.main_text(source) == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_query_against_the_articles_as_marked(spark):
    got = {r["page_id"]: r["text"] for r in queries.QUERIES["op13_html_extraction"](spark, FOLDER).collect()}
    pages = spark.read.parquet(*glob.glob(f"{FOLDER}/pages.parquet")).collect()
    assert len(pages) == len(got)
    for r in pages:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " \0 ", inner))
        assert got[r["page_id"]] == " ".join(html.unescape(inner).replace("\0", " ").split())
