import html as entities
import re
import time

import pytest

from spanrules.llm import html_text

SF = "/root/testdata/sf0.01"


def text_of(source):
    return html_text.Page(source).main_text({}, {}, html_text.THRESHOLD)


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home">
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div id="cookie-notice">We use cookies</div><div class="ad-box">Buy</div>
    <main><article><h1>Caf&eacute; &amp;  news</h1><p>One <b>bold</b>
    line<br>more<p>Two &lt;3 <!-- gone --> x<ul><li>a<li>b</ul>
    <form>Name <input></form><script>var t = "</p>";</script><table><tr><td>c<td>d</table>
    <section class="comments"><p>First!</p></section></article></main>
    <aside>Side</aside><div role="complementary">More</div><footer>End</footer></body></html>"""
    assert text_of(page) == "Café & news\nOne bold line more\nTwo <3 x\na\nb\nc\nd"


def test_broken_markup():
    assert text_of("") == ""
    assert text_of("plain  text") == "plain text"
    assert text_of("<p>a < b <p>c</p") == "a < b\nc"
    assert text_of("<nav><ul><li>x<article><p>kept</article><p>after") == "kept\nafter"
    assert text_of("<article><p>cut &amp and <a href='x") == "cut & and"
    assert text_of("<script>never closed <p>x") == ""
    assert text_of("</div></p><p>ok") == "ok"
    assert text_of("<p>" * 3000 + "deep") == "deep"
    assert text_of("<div>" * 3000 + "deep") == "deep"


STORY = "<h1>Title</h1><p>The story of the page, told at some length.</p><p>It goes on here.</p>"
TOLD = "Title\nThe story of the page, told at some length.\nIt goes on here."


@pytest.mark.parametrize("wrapper", [
    "<div class='container with-sidebar'>{}</div>", "<div class='content no-sidebar'>{}</div>",
    "<main class='has-header'>{}</main>", "<form id='aspnetForm'>{}</form>", "<div class='sidebar layout'>{}</div>",
    "<div class='ads-free'>{}</div>", "<div id='popup'><div class='widget'>{}</div></div>"])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<article class='topic social'>{}</article>",
                                   "<article class='post comment-open'>{}</article>", "<div class='text'>{}</div>"])
def test_wrappers_with_names_of_noise(wrapper, inner):
    noise = ("<nav>Menu</nav><div class='sidebar'><p>Popular now</p></div><form><p>Your mail</p></form>"
             "<div class='cookie-notice'>We use cookies, and so on and so forth, at more length than any story has"
             " on this page, as such notices do when lawyers had a hand in them, twice over and again.</div>")
    assert text_of(f"<body>{wrapper.format(inner.format(STORY) + noise)}<footer>End</footer></body>") == TOLD
    assert text_of(f"<body>{noise}{wrapper.format(inner.format(STORY))}</body>") == TOLD


def test_names_inside_an_article():
    assert text_of("<article><div class='post-header'><h1>Title</h1></div><p>Text</p></article>") == "Title\nText"
    long = "<p>" + "So many words of a reader. " * 50 + "</p>"
    assert text_of(f"<article><p>Short</p><section class='comments'>{long}</section></article>") == "Short"
    assert text_of(f"<article><p>Short</p></article><div id='comments'><article>{long}</article></div>") == "Short"
    assert text_of(f"<article>{STORY}</article><div class='related'><article>Other</article></div>") == TOLD
    assert text_of(f"<div class='x'>{STORY}</div><div class='related'><article>Other</article></div>") == TOLD
    assert text_of("<div class='cookie-notice'><p>Only this</p></div>") == ""


def test_elements_within_a_line():
    assert text_of("<p>a<button>b</button>c <select><option>d</select>e</p>") == "ac e"
    assert text_of("<p>a<button>b <p>c") == "ab\nc"   # never closed: read on
    assert text_of("<head><title>T</title></head><p>no body tag</p>") == "no body tag"


@pytest.mark.parametrize("part", ["<script/>", "<div>x", "</section><div>", "<button>x", "<p>x", "<article>x</div>",
                                  "<li>x", "<a title='"])
def test_long_unclosed_markup_takes_linear_time(part):
    start = time.process_time()
    html_text.Page(part * 40_000).style()
    text_of(part * 40_000)
    assert time.process_time() - start < 8


def test_style_hashes_tell_texts_apart():
    def of(source):
        page = html_text.Page(source)
        return {page.key[i]: page.style()[page.key[i]][0] for i in range(len(page.key))}

    one, two = of("<ul><li>a<li>b</ul><p>c"), of("<ul><li>a<li>d</ul><p>c")
    assert one.keys() == two.keys() and [one[k] == two[k] for k in one] == [False, False, False, True]
    assert of("<div>a</div><div>b</div>") == of("<div>a</div><div>b</div>") != of("<div>b</div><div>a</div>")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "k") for i, u, h in rows],
                                 "page_id long, url string, html string, keys int, host string")


def test_style_tree_drops_what_a_host_repeats(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div class='x9'>Top of the site</div><div class='y'>Story number {i} of many"
             f"</div><div class='z{i}'>Read all {'stories' if i % 2 else 'news'}</div></body>") for i in range(40)]
    rows += [(100 + i, "http://b.example/", "<body><div class='x9'>Top of the site</div><div class='y'>Once</div></body>")
             for i in range(2)]
    rows += [(200 + i, "http://c.example/p", "<body><article><p>The same article</p></article></body>") for i in range(30)]
    df = html_text.extract(pages(spark, rows))
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in df.collect()}
    assert all(got[i] == f"Story number {i} of many" for i in range(40))
    assert got[100] == got[101] == "Top of the site\nOnce"   # two pages tell nothing
    assert all(got[200 + i] == "The same article" for i in range(30))


def test_copies_of_a_page_say_nothing_about_its_host(spark):
    def page(story, i, top="Top of the site"):
        return (f"<body><div class='x'>{top}</div><div class='story'><p>{story}</p><p>And more of it.</p></div>"
                f"<aside>Visitor {i}</aside></body>")

    copy = "The one story that this host has in many copies"
    rows = [(i, "http://a.example/", page(copy, i)) for i in range(8)]
    rows += [(100 + i, "http://b.example/", page(copy, i)) for i in range(80)]
    rows += [(200 + i, "http://b.example/", page(f"A story of its own, number {i}, of some length", i)) for i in range(20)]
    # the top line of each differs, so that all are distinct: the story is the largest part and stays
    rows += [(300 + i, "http://c.example/", page(copy, i, f"Seen {i}")) for i in range(40)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages(spark, rows)).collect()}
    assert all(got[i] == f"Top of the site\n{copy}\nAnd more of it." for i in range(8))   # one page tells nothing
    assert all(got[100 + i] == f"{copy}\nAnd more of it." for i in range(80))
    assert all(got[200 + i] == f"A story of its own, number {i}, of some length\nAnd more of it." for i in range(20))
    assert all(f"{copy}\nAnd more of it." in got[300 + i] for i in range(40))


def test_importance_is_normalised_entropy(spark):
    rows = [(i, "http://a.example/", f"<body><p>{i % 4}</p></body>") for i in range(16)]
    page = html_text.Page("<body><p>0</p></body>")
    r = html_text.site_styles(pages(spark, rows)).first()
    content = dict(zip(r["keys"], r["content"]))
    order = dict(zip(r["keys"], r["presentation"]))
    key = page.key[-1]
    assert abs(content[key] - 0.5) < 1e-9     # log 4 / log 16
    assert abs(order[key]) < 1e-9


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "no url", ""), (3, None, "<p>x"), (3, None, "<p>x"), (4, "HTTP://A/b", "<p>" + "y " * 200_000)]
    got = sorted((r["page_id"], r["url"], r["n_chars"]) for r in html_text.extract(pages(spark, rows)).collect()
                 if r["url"] is not None)
    assert got == [(2, "no url", 0), (4, "HTTP://A/b", 399_999)]
    assert html_text.extract(pages(spark, rows)).where("url IS NULL").count() == 3
    assert html_text.extract(pages(spark, [])).count() == 0


def test_real_pages(spark):
    def truth(source):
        body = source.split("<article>", 1)[1].split("</article>")[0]
        blocks = (" ".join(entities.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split())
                  for b in re.split(r"</?(?:p|h1)>", body))
        return "\n".join(b for b in blocks if b)

    table = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in table.collect()}
    rows = html_text.extract(table).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
