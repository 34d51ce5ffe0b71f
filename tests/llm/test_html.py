import pytest

from postlens.llm import html

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body class="page">
<header class="site"><h1>Site name</h1></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div id="cookie-notice">We use cookies</div><aside><p>Side</p></aside>
{article}
<div class="comments"><p>First!</p></div><form><p>Mail</p></form><footer>Foot</footer><script>if (a < b) "</p>";</script>"""


def wrap(*pages):
    found = None
    for page in pages:
        found = html.joined(found, {"pages": 1, "items": html.expression(html.parse(page))})
    return found


def shown(*bodies):
    return html.regular_expression(wrap(*bodies)["items"])


def test_texts_become_slots_and_equal_texts_stay():
    assert shown("<p>a</p><b>x</b>", "<p>c</p><b>x</b>") == f"<p>#TEXT</><b>'{html.text_item('x')[1]}'</>"


def test_missing_tags_become_optional():
    assert "(<i>" in shown("<p>a</p><i>b</i><b>c</b>", "<p>a</p><b>c</b>") and ")?" in shown("<p>a</p><i>b</i>", "<p>a</p>")


def test_repeated_tags_become_groups():
    assert shown("<ul><li>a<li>b<li>c</ul>", "<ul><li>d</ul>") == "<ul>(<li>#TEXT</>)+</>"
    assert shown("<div></div>", "<div><p>x</p><p>y</p></div>") == "<div>(<p>#TEXT</>)*</>"


def test_wrappers_align_like_pages():
    pages = [PAGE.format(article=f"<article><h1>T{i}</h1>{'<p>x</p>' * (i % 3)}<ul><li>{i}</ul></article>") for i in range(12)]
    one = wrap(*pages)
    two = html.joined(wrap(*pages[:5]), wrap(*pages[5:]))
    assert html.regular_expression(one["items"]) == html.regular_expression(two["items"]) and two["pages"] == 12
    assert [html.main_text(p, one) for p in pages] == [html.main_text(p, two) for p in pages]


@pytest.mark.parametrize(
    "article",
    [
        "<article><h1>Title &amp; more</h1><p>One   two<br>three &eacute;</p><div class=ad>Buy</div><p>Four</article>",
        "<main><h1>Title &amp; more</h1><p>One two\nthree &#233;</p><section id='reader-comments'><p>no</p></section><p>Four</p></main>",
        "<article><header class='entry-header'><h1>Title &amp; more</h1></header><p>One two three &#xe9;</p><p>Four</p>"
        "<article class='comment'><p>me</p></article><footer>by</footer></article>",
    ],
)
def test_article_without_the_rest(article):
    assert html.main_text(PAGE.format(article=article)) == "Title & more\nOne two three é\nFour"


def test_without_article_tag_the_wrapper_finds_the_region():
    body = "<div class=wrap><div class=left><p>Menu text</p></div><div class=post><h2>T{0}</h2><p>{1}</p><p>last{0}</p></div></div>"
    pages = [PAGE.format(article=body.format(i, f"long text number {i} " * 9)) for i in range(12)]
    wrapper = wrap(*pages)
    assert html.main_text(pages[3], wrapper) == "T3\n" + ("long text number 3 " * 9).strip() + "\nlast3"


def test_unchanged_template_text_goes():
    pages = [f"<article><p>Share this story</p><h1>T</h1><div><p>text {i}</p></div></article>" for i in range(12)]
    assert html.main_text(pages[5], wrap(*pages)) == "T\ntext 5"
    same = ["<article><p>only</p></article>"] * 12
    assert html.main_text(same[0], wrap(*same)) == "only"


def test_broken_pages():
    assert html.main_text("") == "" and html.main_text("a < b & c") == "a < b & c"
    assert html.main_text('<p>x<a href="') == "x" and html.main_text("<p>x</") == "x"
    assert html.main_text("<p>x<!-- y") == "x" and html.main_text("<p>x<script>y") == "x"
    assert html.main_text("<div>" * 5000 + "deep") == "deep"
    assert html.main_text("<p>" + "w " * 200_000).count("w") == 200_000


def test_all_rows_with_nulls_and_repeats(spark):
    page = PAGE.format(article="<article><p>Text</p></article>")
    rows = [(1, "http://a.example/x", page), (2, "http://a.example/y", page), (2, "http://a.example/y", page), (3, None, page), (None, "x", None)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS host", "2 AS wrapper", "3 AS text")
    got = html.extract(frame).collect()
    assert len(got) == 5 and all(r["text"] == ("Text" if r["page_id"] else "") for r in got)
    assert html.extract(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "extra",
    ["<blockquote>once</blockquote>", "<ul><li>once</ul>", "<h4>once</h4>", "<h2>H</h2><p>once", "<p>a <em>once</em> b</p>",
     "<table><tr><td>once</table>", "<figure><figcaption>once</figcaption></figure>", "<ul>" + "<li>once" * 12 + "</ul>"],
)
def test_text_of_one_page_stays(extra):
    pages = [f"<article><p>Share this story</p><h1>T{i}</h1><p>a{i}</p><h3>s{i}</h3><p>b{i}</p></article>" for i in range(11)]
    for place in ("</article>", "<h1>", "<h3>"):
        odd = "<article><p>Share this story</p><h1>T</h1><p>a</p><h3>s</h3><p>b</p></article>".replace(place, extra + place)
        for order in ([*pages, odd], [odd, *pages]):
            text = html.main_text(odd, wrap(*order))
            assert text.count("once") == extra.count("once"), text


def test_copies_keep_their_body():
    for outside in ("", "<p>Visit {0}</p>"):
        pages = [outside.format(i) + "<article><h1>T</h1><p>only paragraph</p></article>" for i in range(12)]
        assert {html.main_text(p, wrap(*pages)) for p in pages} == {"T\nonly paragraph"}
    pages = [f"<article><h1>T{i}</h1><p>only paragraph</p>{'<hr><p>rare</p>' * (i < 2)}</article>" for i in range(12)]
    for i, page in enumerate(pages):
        assert html.main_text(page, wrap(*pages)) == f"T{i}\nonly paragraph" + "\nrare" * (i < 2)
    others = [f"<article><h1>T</h1><p>text {i}</p></article>" for i in range(12)]
    copies = ["<article><h1>T</h1><p>same</p><blockquote>copied</blockquote></article>"] * 12
    assert html.main_text(copies[0], wrap(*others, *copies)) == "T\nsame\ncopied"


@pytest.mark.parametrize(
    "page",
    [
        '<div id="content" class="has-sidebar"><article><p>Text</p></article></div>',
        '<main class="with-sidebar"><p>Text</p></main>',
        '<article class="post category-legal"><p>Text</p></article>',
        '<article class="commentary"><p>Text</p></article>',
        '<div class="sidebar-layout"><article><p>Text</p></article></div>',
        '<div class="widget"><main><article><p>Text</p></article></main></div>',
        '<article><section id="search"><p>Text</p></section></article>',
        '<article><section class="warning"><p>Text</p></section></article>',
        '<article><div class="menu-planning social-policy"><p>Text</p></div></article>',
        '<article><div class="modal"><p>Text</p></div></article>',
    ],
)
def test_names_drop_no_article(page):
    page += '<div class="comments"><article class="comment"><p>me</p></article></div><div class="sidebar">side</div>'
    assert html.main_text(page) == "Text"


def test_what_holds_most_of_the_changing_text_stays():
    pages = [f'<div class="side">menu</div><div class="legal"><h2>T{i}</h2><p>{f"long text {i} " * 9}</p></div>' for i in range(12)]
    pages = [p + f'<div class="comments">{f"reply {i} " * 99}</div>' for i, p in enumerate(pages)]
    assert html.main_text(pages[4], wrap(*pages)) == "T4\n" + ("long text 4 " * 9).strip()


@pytest.mark.parametrize("n", [3, 12])
def test_title_and_lead_beside_the_region_stay(n):
    body = """<div class=wrap><div class=left><h2>Menu</h2><p>Menu text</p></div><div class=post><h1>Title {0}</h1><p class=lead>lead {0}</p>
    <div class=entry><p>{1}</p><p>{1}</p></div>{2}</div></div>"""
    pages = [PAGE.format(article=body.format(i, f"long text number {i} " * 9, "<div>once</div>" * (i == 2))) for i in range(n)]
    for rows in (pages, [*pages, pages[0]]):
        for i, page in enumerate(pages):
            long = (f"long text number {i} " * 9).strip()
            want = ["Title {0}".format(i), f"lead {i}", long, long] + ["once"] * (i == 2)
            found = None
            for row in rows:
                found = html.joined(found, html.own(row))
            assert html.main_text(page, found).split("\n") == want


def test_wrappers_are_broadcast_by_bytes(spark, caplog):
    few = spark.createDataFrame([("a", "x" * 900), ("b", "y")], "of string, wrapper string")
    pages = spark.createDataFrame([("a",), ("c",)], "host string")

    def plan(most):
        return pages.join(html.sized(few, most), pages["host"] == few["of"], "left")._jdf.queryExecution().executedPlan().toString()

    with caplog.at_level("INFO", logger=html.__name__):
        assert "BroadcastHashJoin" in plan(1000) and "Broadcast" not in plan(100)
    assert "the largest 900" in caplog.text


def blog(i, body_class, article_class):
    return (
        f'<html><body class="{body_class}"><div class="top">Site slogan here</div><article class="{article_class}"><h1>Title {i}</h1>'
        f"<p>First words of page {i} on topic {i * 7}.</p><p>More of {i * 3}.</p></article><div class=\"shop\">Buy our stuff now</div></body></html>"
    )


def test_classes_of_single_pages_part_nothing(spark):
    pages = [(i, f"http://a.test/{i}", blog(i, f"single page-id-{i}", f"post post-{i}")) for i in range(30)]
    got = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    for r in got:
        i = r["page_id"]
        assert r["text"] == f"Title {i}\nFirst words of page {i} on topic {i * 7}.\nMore of {i * 3}."


def test_wrapper_of_a_host_stays_below_its_bound(monkeypatch):
    import json

    monkeypatch.setattr(html, "WRAPPER_BYTES", 4000)
    held = None
    for i in range(1500):
        name = "".join(chr(97 + int(d)) for d in str(i))
        held = html.bounded(html.joined(held, html.own(blog(i, "single", f"post slug{name}"))))
    assert held["pages"] == 1500 and len(json.dumps(held)) <= 4000 + 2000


def test_a_wrapper_above_the_bound_keeps_its_rarest_elements(monkeypatch):
    """Wrappers made in tasks, and merged, are whole."""
    import json

    import pyarrow as pa

    monkeypatch.setattr(html, "WRAPPER_BYTES", 4000)
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(256)]
    pages = [blog(i, "single", f"post slug{name}") for i, name in enumerate(names)]
    parts = []
    for half in (pages[:128], pages[128:]):
        found = list(html._infer(iter([pa.RecordBatch.from_arrays([pa.array(["h"] * 128), pa.array(half)], ["host", "html"])])))
        assert [b.num_rows for b in found] == [1]
        parts.append(found[0].column("wrapper").to_pylist()[0])
    merged = html._merge((pa.scalar("h"),), pa.table({"host": ["h", "h"], "wrapper": parts})).column("wrapper").to_pylist()[0]
    assert all(f"slug{name}" in merged for name in names) and json.loads(merged)["pages"] == 256
