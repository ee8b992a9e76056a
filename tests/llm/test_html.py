"""HTML extraction: deduction against brute force, pages that only their template can tell apart, and awkward pages."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weeklark.llm import html

def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>T</title>{head}</head><body>{body}</body></html>"


def test_html_by_structure():
    text = html.main_text(page(
        '<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>'
        '<article><h1>Head &amp; tail</h1><p>One <b>bold</b>\n line<br>and more &#233;<p>Two<script>x("<p>no</p>")</script><aside>Related</aside>'
        '<form><label>Mail</label><input></form><div class="ad">Buy</div><section id="comments"><p>Nice!</p></section></article>'
        '<div class="sidebar"><p>Side</p></div><!-- gone --><footer>&copy; me</footer><style>p{}</style>'))
    assert text == "Head & tail\nOne bold line and more é\nTwo"
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("plain  text") == "plain text"
    assert html.main_text("<nav><ul><li>Menu<article><p>Body</article>") == "Body"
    assert html.main_text("<p>x" * 20_000).count("\n") == 19_999


def test_html_keeps_text_around_raw_elements():
    article = lambda body: html.main_text(f"<article><p>{body}</p></article>")
    assert article('a <svg class="x"/> b <svg><path d="M0"/><text>no</text></svg> c') == "a b c"
    assert article("a <math><mi>x</mi></math> b <math/> c") == "a x b c"
    assert article("a <noscript>n</noscript> <object>o</object> <xmp>p</xmp> b") == "a n o p b"
    assert article("a <svg> b <iframe src=y> c") == "a b c"
    assert article("a <script>if (x) y") == "a"


def test_html_templates(spark):
    shell = '<div class="top">Welcome to the site</div><div class="box1"><p>{}</p></div><div class="legal">All rights reserved</div>'
    rows = [(i, f"http://h.example/{i}", page(shell.format(f"Own words of page {i}"))) for i in range(12)]
    rows += [(100, "http://other.example/", page(shell.format("Alone"))), (101, None, page("<p>No host</p>")), (102, "http://h.example/x", None), (0, "http://h.example/0", rows[0][2])]
    got = html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))).collect()
    out = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(out[i] == f"Own words of page {i}" for i in range(12))
    assert out[100] == "Welcome to the site\nAlone\nAll rights reserved" and out[101] == "No host" and out[102] == ""
    assert html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").limit(0)).count() == 0


@given(st.text(alphabet="<>/pdivartcle =\"'!-&;é\n", max_size=80))
@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
def test_html_never_breaks(text):
    assert isinstance(html.main_text(text), str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


WORDS = [f"word{i}" for i in range(300)]


def site(r, host, n, furnished=False):
    """Pages without any telling tag or name; some have a box of constant words inside the article, some a box of links."""
    rows, want = [], {}
    for i in range(n):
        say = lambda k: " ".join(r.choices(WORDS, k=k))
        article = [say(6), *(say(r.randint(15, 40)) for _ in range(r.randint(1, 5)))]
        menu = "".join(f"<li><a href=/{j}>{say(1)}</a></li>" for j in range(r.randint(2, 5)))
        box = "<div class=q><p>Join the club today</p></div>" if furnished and i % 3 else ""
        body = f"<div class=a><ul>{menu}</ul></div><div class=b>{say(8)}</div><div class=c><h1>{article[0]}</h1>{box}" + "".join(f"<p>{p}" for p in article[1:]) + (
            f"</div><div class=d>All rights reserved by {host}</div>")
        rows.append((r.randrange(1 << 40), f"http://{host}/{i}", page(body)))
        want[rows[-1][0]] = "\n".join(article)
    return rows, want


def test_the_template_finds_the_article_where_tags_tell_nothing(spark):
    rows, want = site(random.Random(1), "plain.example", 20, furnished=True)
    got = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows)).collect()}
    assert got == want
    # Without templates the result is another: it is the classes and slots that choose.
    bare = {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows), min_pages=1000).collect()}
    assert all(bare[i] != want[i] and "All rights reserved" in bare[i] for i in want)


def test_renamed_tags_do_not_change_the_articles(spark, sf_dir):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    renamed = pages
    for old, new in [("nav", "div class=n"), ("article", "div class=m"), ("footer", "div class=o"), ('div class="ad"', "div class=u")]:
        name, into = old.split()[0], new.split()[0]
        renamed = renamed.withColumn("html", F.regexp_replace(F.regexp_replace("html", f"<{old}>", f"<{new}>"), f"</{name}>", f"</{into}>"))
    sizes = Counter(re.match("[a-z]+://([^/]+)", r["url"])[1] for r in pages.collect())
    many = {r["page_id"] for r in pages.collect() if sizes[re.match("[a-z]+://([^/]+)", r["url"])[1]] >= 8}
    here = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    there = {r["page_id"]: r["text"] for r in html.extract(renamed).collect()}
    assert len(many) > 50 and {i: there[i] for i in many} == {i: here[i] for i in many}
    by_tag = lambda h: re.search("<article>(.*?)(?:</article>|$)", h, re.S)[1]
    for r in pages.collect():
        blocks = [" ".join(html.html_lib.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:h1|p)>", by_tag(r["html"]))]
        assert here[r["page_id"]] == "\n".join(b for b in blocks if b)


def deduced_by_hand(pages, min_pages, support):
    """Vectors as they are: counts by page; classes by vector and slot, from parent links."""
    count, parent, kind = defaultdict(dict), {}, {}
    for i, page_ in enumerate(pages):
        for token, above, what, _, n, _, _ in html.tokens(page_):
            count[token][i] = n
            parent[token], kind[token] = above, what
    frequent = {t for t, on in count.items() if len(on) >= min_pages and len(on) >= support * len(pages)}
    classes = defaultdict(set)
    for t in frequent:
        at = parent[t]
        while at in frequent and count[at] == count[t]:
            at = parent[at]
        classes[tuple(sorted(count[t].items())), at].add(t)
    whole = set()
    for members in classes.values():
        if sum(1 if kind[t] & html.TEXT else 2 for t in members) >= 2:
            left = frozenset(t for t in members if not kind[t] & html.TEXT or 2 * len(count[t]) >= len(count.get(parent[t], count[t])))
            whole |= {left} if left else set()
    return whole


@pytest.mark.parametrize("seed", range(3))
def test_deduction_matches_brute_force(spark, seed):
    r = random.Random(seed)
    boxes = ["<div class=s><p>same</p><b>old</b></div>", "<p>lone</p>", "<div class=t><div>x</div></div>", "<ul><li>1<li>2</ul>", "<section>own {}</section>", "<p>two {}</p>", "<h2>three</h2><p>four</p>"]
    pages = [page("".join(r.sample(boxes, k=r.randint(1, len(boxes)))).replace("{}", str(r.random()))) for _ in range(25)]
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    hosted = html.with_host(frame(spark, rows).repartition(5))
    records = np.frombuffer(html.templates(hosted).first()["template"], html.TEMPLATE)
    classes = defaultdict(set)
    for t in records:
        classes[int(t["part"])].add(int(t["token"]))
    assert {frozenset(c) for c in classes.values()} == deduced_by_hand(pages, html.MIN_PAGES, html.SUPPORT)


def test_names_within_an_article_need_the_template(spark):
    lone = lambda body: html.main_text(page(f"<article><p>a</p>{body}<p>b</p></article>"))
    for name in ("social-story", "alert", "related-work", "notice", "share"):
        assert lone(f"<div class={name}><p>kept</p></div>") == "a\nkept\nb"
    assert lone("<div class=ad>x</div><section id=comments><p>y</p></section>") == "a\nb"
    say = lambda i, j: f"words {i} of {j} and more words"
    body = "<article><p>{}</p><p>{}</p><div class='share'><p>Tell {}</p></div></article>"
    rows = [(i, f"http://h.example/{i}", page(body.format(say(i, 1), say(i, 2), i))) for i in range(20)]
    rows.append((20, "http://h.example/20", page("<article><p>" + say(20, 1) + "</p><div class='alert'>mine</div></article>")))
    got = {x["page_id"]: x["text"] for x in html.extract(frame(spark, rows)).collect()}
    assert got == {i: say(i, 1) + "\n" + say(i, 2) for i in range(20)} | {20: say(20, 1) + "\nmine"}


def test_copies_of_a_page_keep_their_text(spark):
    body = "<article><h1>Title</h1><p>One and the same text.</p><p>More of it.</p></article><footer>f</footer>"
    rows = [(i, f"http://h.example/{i}", page(body)) for i in range(30)] + [(30, "http://h.example/0", page(body))] * 3
    got = html.extract(frame(spark, rows)).collect()
    assert len(got) == 33 and {x["text"] for x in got} == {"Title\nOne and the same text.\nMore of it."}


def test_large_templates_join_by_host(spark, monkeypatch):
    rows, want = site(random.Random(2), "plain.example", 20)
    monkeypatch.setattr(html, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(html, "DEAL", 3)
    assert {r["page_id"]: r["text"] for r in html.extract(frame(spark, rows + [(-1, None, "<p>alone")])).collect()} == want | {-1: "alone"}


def test_memory_is_linear_in_nesting():
    def peak(n):
        tracemalloc.start()
        list(html.tokens("<div class=x>" * n + "text"))
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    assert peak(20_000) < 14 * peak(2_000)
