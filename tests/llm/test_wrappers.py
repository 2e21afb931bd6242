"""Wrapper inference: what alignment decides, odd pages, and time."""

import html
import random
import re
import time

import pytest

from scorelake.llm import wrappers as W

DATA = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def _got(spark, rows):
    return {r["page_id"]: r for r in W.query(spark.createDataFrame(rows, PAGES)).collect()}


def _plain(page):
    return W.extract(W.Page(page), None)[0]


def _wrapper(pages):
    out = W.Page(pages[0]).wrapper()
    for p in pages[1:]:
        out = W.align(out, W.Page(p).wrapper())
    return out


def test_alignment_resolves_mismatches():
    pages = ["<div>Site<p>a</p></div>", "<div>Site<p>b</p><ul><li>1<li>2</ul></div>", "<div>Site<p>c</p><ul><li>3</ul></div>"]
    assert W.expression(_wrapper(pages)) == '<div>"<p>#</>(<ul>(<li>#</>)+</>)?</>'
    assert W.expression(_wrapper(["<p>a</p><ul></ul>", "<ul></ul><p>b</p>"])) == "((<p>#</>)?(<ul></>)?)*"


def test_alignment_does_not_depend_on_the_order():
    rng, pages = random.Random(1), []
    for i in range(40):
        body = "".join(rng.choice([f"<p>t{rng.random()}</p>", "<h2>head</h2>", f"<ul>{'<li>x</li>' * rng.randint(0, 5)}</ul>", "<div class=note>Same</div>"]) for _ in range(rng.randint(0, 6)))
        pages.append(f"<nav><a>m</a></nav><div>Top</div><div>{body}</div>")
    want = W.packed(_wrapper(pages))
    for _ in range(5):
        rng.shuffle(pages)
        parts = [_wrapper(pages[k::4]) for k in range(4)]
        merged = W.unpacked(W.packed(parts[0]))
        for p in parts[1:]:
            merged = W.align(merged, p)
        assert W.unpacked(W.packed(merged)) == W.unpacked(want)


def test_template_text_and_link_lists_are_left_out_without_article_markup(spark):
    page = "<body><div>My site</div><div><h1>Title {0}</h1><p>Body {0} with <a href=x>a link</a> in it.</p></div><ul><li><a>Story {1}</a><li><a>Story {2}</a></ul><p>All rights reserved</p></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i, 2 * i, 3 * i)) for i in range(6)]
    rows += [(100, "http://b.example/only", page.format(7, 8, 9))]
    got = _got(spark, rows)
    assert all(got[i]["text"] == f"Title {i}\nBody {i} with a link in it." and got[i]["by_wrapper"] for i in range(6))
    # the same page by itself: nothing tells what is template, but the links still are a list
    assert got[100]["text"] == "My site\nTitle 7\nBody 7 with a link in it.\nAll rights reserved"
    assert "My site" in _plain(rows[0][2]) and "Story" in _plain(rows[0][2])


def test_a_host_of_equal_pages_keeps_its_text(spark):
    rows = [(i, "http://a.example/", "<div><p>Only text</p></div>") for i in range(5)]
    assert {r["text"] for r in _got(spark, rows).values()} == {"Only text"}


def test_the_article_is_kept_whole(spark):
    page = "<header>Site</header><aside>x</aside><article class='post has-sidebar'><header><h1>Title</h1></header><p class=share-price>Stock up 3</p><p>Same on all pages</p><nav>toc</nav><form>f</form><div class='ad'>buy</div><div id=comments><article class=comment>me too</article></div><footer>by me</footer><p>End {}</p></article><section class='page-with-header'>outside</section>"
    got = _got(spark, [(i, "http://a.example/", page.format(i)) for i in range(4)])
    assert all(got[i]["text"] == f"Title\nStock up 3\nSame on all pages\nEnd {i}" for i in got)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<div class=sidebar><article>inside</article></div><p>out</p>", "inside"),
        ("<form><div><h1>T</h1><article>in a form</article></div></form>", "T\nin a form"),
        ("<form><h1>T</h1><p>x</p></form><form>ask</form>", "T\nx"),
        ("<body class=search><main>m<article>a</article></main>", "a"),
        ("<main>m</main><div>o</div>", "m"),
        ("<p>a<p>b<div>c</p>d", "a\nb\nc\nd"),
        ("<!-- <article> --><p>only a comment has one</p>", "only a comment has one"),
        ("<div class=cookie-notice>c</div><div class=no-sidebar>s</div><div role=navigation>n</div><div hidden>h</div>", "s"),
    ],
)
def test_odd_markup(page, want):
    p = W.Page(page)
    got = W.extract(p, W.labelled(p.wrapper(), p.has_region))
    assert got == (want if not page.startswith("<form><div>") else "in a form", True)


def test_equals_the_article_on_the_test_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r for r in W.query(pages).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = "\n".join(y for y in (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", a))) if y)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["url"], got[r["page_id"]]["by_wrapper"]) == (want, r["url"], True)


def test_pages_that_a_wrapper_does_not_know(spark):
    """A foreign page is read by HTML's meaning, in linear time."""
    known = spark.createDataFrame([(i, "http://a.example/", f"<div>Site</div><p>t{i}</p><ul><li>{i}</ul>") for i in range(4)], PAGES)
    wrappers = W.infer(known)
    foreign = "<div>Site</div><section>new</section>" + "<p>x</p><li>y" * 5000 + "<nav>n</nav>"
    rows = spark.createDataFrame([(1, "http://a.example/", foreign), (2, "http://a.example/", "<div>Site</div><p>seen</p>"), (3, "http://other.example/", "<p>z</p>")], PAGES)
    got = {r["page_id"]: r for r in W.extract_pages(rows, wrappers).collect()}
    assert not got[1]["by_wrapper"] and got[1]["text"] == "new\n" + "\n".join(["x\ny"] * 5000)
    assert got[2]["by_wrapper"] and got[2]["text"] == "seen" and got[3]["text"] == "z" and not got[3]["by_wrapper"]
    page, labels = W.Page(foreign), W.labelled(_wrapper(["<div>Site</div><p>t</p>", "<p>a<li>b"]), False)
    began = time.time()
    W.extract(page, labels)
    assert time.time() - began < 1


def _texts(spark, pages):
    got = _got(spark, [(i, "http://a.example/", p) for i, p in enumerate(pages)])
    return [got[i]["text"] for i in range(len(pages))]


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<div class='header'><h1>Title {}</h1></div><p>Body</p>", "Title {}\nBody"),
        ("<p class='legal'>The court ruled {}.</p><p class='comment'>No comment {}.</p><h2 class=ad>Ads {}</h2><li class=menu>Soup {}", "The court ruled {}.\nNo comment {}.\nAds {}\nSoup {}"),
        ("<div class=notice>Price up {}</div><p>x {}</p><span class=share>Share {}</span>", "Price up {}\nx {}\nShare {}"),
        # the same on all pages, and named as something beside the article
        ("<div class=notice>We use cookies</div><p class=disclaimer>Not advice</p><p>x {}</p><div class=share>Share {}</div><p>Same</p>", "x {}\nSame"),
        ("<div class=header><h1>Same title</h1></div><h1 class=header>Same too</h1><p>x {}</p>", "Same too\nx {}"),
    ],
)
def test_inside_an_article_names_alone_say_nothing(spark, inner, want):
    """Names of classes decide only with the alignment, or for containers of adverts, forms, menus, sharing and comments."""
    got = _texts(spark, ["<nav>n</nav><article>" + inner.replace("{}", str(i)) + "</article>" for i in range(4)])
    assert got == [want.replace("{}", str(i)) for i in range(4)]


def test_without_the_wrapper_nothing_weak_goes(spark):
    """One page: the alignment tells nothing, so the notice stays; the wrapper makes the difference."""
    page = "<article><div class=notice>We use cookies</div><p>x {}</p></article>"
    assert _plain(page) == "We use cookies\nx {}" and _texts(spark, [page]) == ["We use cookies\nx {}"]
    assert _texts(spark, [page.format(i) for i in range(3)]) == ["x 0", "x 1", "x 2"]


def test_template_is_told_by_position(spark):
    """Unmarked hosts: a shared paragraph within the text, references between paragraphs, and a title in a named block."""
    page = "<div>Site</div><div class=page-header><h1>Title {0}</h1></div><div><p>First {0}</p><p>The trial goes on.</p><ul><li><a href=x>Ref {0}</a><li><a href=y>Ref b</a></ul><p>Last {0}</p></div><ul><li><a>Story {0}</a><li><a>More</a></ul><p>All rights reserved</p>"
    want = "Title {0}\nFirst {0}\nThe trial goes on.\nRef {0}\nRef b\nLast {0}"
    assert _texts(spark, [page.format(i) for i in range(4)]) == [want.format(i) for i in range(4)]
    tail = "<div>Site</div><div><p>First {0}</p><p>The trial goes on.</p></div>"
    assert _texts(spark, [tail.format(i) for i in range(3)]) == [f"First {i}\nThe trial goes on." for i in range(3)]
    alone = "<div class='page-header'><h1>Title</h1></div><p>x</p>"
    assert _texts(spark, [alone]) == ["Title\nx"]


def test_many_labels_in_any_order_of_merging():
    """Three parts of a host with 60 classes each, and a line that all pages of one part share: the same in any order."""
    rng = random.Random(4)

    def part(k):
        pages = []
        for i in range(6):
            classes = "".join(chr(97 + k) + chr(97 + (10 * i + j) // 26) + chr(97 + (10 * i + j) % 26) + " " for j in range(10)).split()
            pages.append("<body>" + "".join(f"<div class={c}>t{k}{i}{c}</div>" for c in classes) + ("<div class=foot>Imprint</div>" if k == 0 else "") + f"<p>x{k}{i}</p></body>")
        return pages

    parts, texts = [part(k) for k in range(3)], set()
    pages = [p for x in parts for p in x]
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        a, b, c = (W.unpacked(W.packed(_wrapper(parts[k]))) for k in order)
        left = W.align(W.align(a, b), c)
        a, b, c = (W.unpacked(W.packed(_wrapper(parts[k]))) for k in order)
        right = W.align(a, W.align(b, c))
        rng.shuffle(pages)
        mixed = _wrapper(pages)
        assert W.unpacked(W.packed(left)) == W.unpacked(W.packed(right)) == W.unpacked(W.packed(mixed))
        labels = W.labelled(left, False)
        texts.add("|".join(W.extract(W.Page(p), labels)[0] for x in parts for p in x))
    assert len(texts) == 1 and "Imprint" in texts.pop()


def test_very_long_and_deep_pages(spark):
    long = "<article>" + "".join(f"<p>word{i} <b>bold</b><ul><li>i{i}</ul>" for i in range(20000)) + "</article>"
    deep = "<div>" * 20000 + "deep" + "</div>" * 20000 + "<article>after</article>"
    began = time.time()
    got = _got(spark, [(1, "http://a.example/", long), (2, "http://a.example/", "<article><p>x</article>"), (3, "http://b.example/", deep), (4, "http://c.example/", "<div>" * 3000 + "text")])
    assert time.time() - began < 60
    assert got[1]["text"].startswith("word0 bold\ni0\nword1") and got[1]["text"].count("\n") == 39999
    assert (got[3]["text"], got[4]["text"]) == ("after", "text")


def test_many_labels_and_hosts(spark):
    rows = [(i, f"http://h{i % 3}.example/", f"<div class={'a' * (1 + i % 20)}x><p>t{i}</p></div><div class=q{i}>n{i}</div>" + "".join(f"<x{k + i}>v</x{k + i}>" for k in range(90))) for i in range(30)]
    got = _got(spark, rows)
    assert all(r["by_wrapper"] and r["text"].startswith(f"t{i}\nn{i}") for i, r in got.items())


def test_empty_table_repeated_rows_and_clashing_columns(spark):
    assert W.query(spark.createDataFrame([], PAGES)).count() == 0
    rows = [(1, "http://a.example/", "<p>x</p>", "h", "w"), (1, "http://a.example/", "<p>x</p>", "h", "w"), (None, None, None, None, None)]
    got = W.query(spark.createDataFrame(rows, PAGES + ", host string, text string")).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == [("1", "x", 1), ("1", "x", 1), ("None", "", 0)]
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "by_wrapper"}
