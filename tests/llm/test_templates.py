"""Templates of hosts whose pages say little by names."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger.llm import main_text
from skyledger.sources.tables import table


def texts(spark, pages):
    rows = [(i, f"http://h.example.org/{i}", page) for i, page in enumerate(pages)]
    found = main_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r["text"] for r in sorted(found)]


def test_slot_in_nested_tables(spark):
    def page(i):
        story = " ".join(f"story{i}x{k}" for k in range(60))
        cell = "<table><tbody><tr><td>"
        inner = f"{cell}{cell}<table><tbody><tr><td id=left>links {i}</td><td id=mid>{story}</td></tr></tbody></table></td></tr></tbody></table></td></tr></tbody></table>"
        return f"<html><body>{inner}</body></html>"

    assert all(t.startswith(f"story{i}x0 ") and "links" not in t for i, t in enumerate(texts(spark, map(page, range(6)))))


def test_template_text_in_the_slot_goes(spark):
    def page(i):
        story = "".join(f"<p>story {i} part {k}</p>" for k in range(9))
        once = "<p>said here only</p>" if i == 2 else ""
        return f"<body><article><h1>Title {i}</h1><div class=box><p>Join our list</p><p>Day {i}</p></div>{story}{once}<p>Read more soon</p></article></body>"

    for i, text in enumerate(texts(spark, map(page, range(5)))):
        want = [f"Title {i}", f"Day {i}", *[f"story {i} part {k}" for k in range(9)], *["said here only"] * (i == 2)]
        assert text == "\n".join(want)


def test_copies_of_a_page_keep_their_text(spark):
    assert texts(spark, ["<article><p>one</p><p>two</p></article>"] * 4) == ["one\ntwo"] * 4


def story(i, n=60):
    return "".join(f"<p>story {i} part {k} {'word ' * (i * 7 % 11)}</p>" for k in range(n))


def test_the_template_decides(spark, data):
    """Without a template no page has its article alone; with it each has, and just so when all names are taken away."""
    pages = table(spark, data, "pages").select("page_id", "url", "html")
    bare = F.regexp_replace(F.regexp_replace("html", "<(/?)(nav|article|footer)(?=[ >])", "<$1div"), ' class="ad"', "")
    whole = {r["page_id"]: main_text.slot_text(main_text.parse(r["html"])) for r in pages.collect()}
    named = {r["page_id"]: r["text"] for r in main_text.main_texts(pages).collect()}
    unnamed = {r["page_id"]: r["text"] for r in main_text.main_texts(pages.withColumn("html", bare)).collect()}
    assert named == unnamed
    assert all(named[k] != whole[k] for k in named)


def test_depth_does_not_matter(spark):
    deep = "<div>" * 40
    found = texts(spark, [f"<body><div>menu {i}</div>{deep}{story(i)}{'</div>' * 40}<div>foot {i}</div></body>" for i in range(5)])
    assert all(t.startswith(f"story {i} part 0") and "menu" not in t and "foot" not in t for i, t in enumerate(found))


def test_one_page_of_an_unknown_host_has_a_template(spark):
    (text,) = texts(spark, [f"<body><div>Home About</div><div>{story(1)}</div><div>the end</div></body>"])
    assert text.startswith("story 1 part 0") and "Home" not in text and "the end" not in text


def test_names_settle_which_of_two_like_slots_goes(spark):
    page = lambda i: f"<body><div class=menu>a b</div><div id=text>{story(i)}</div><div class=comments>{story(i + 3, 40).replace('story', 'reply')}</div></body>"
    found = texts(spark, map(page, range(6)))
    assert all(t.startswith(f"story {i} part 0") and "reply" not in t and "a b" not in t for i, t in enumerate(found))


def test_parts_of_the_same_kind_stay_together(spark):
    page = lambda i: f"<body><div>a b</div><article>{''.join(f'<section>{story(i * 5 + k, 9)}</section>' for k in range(2 + i % 3))}</article></body>"
    for i, text in enumerate(texts(spark, map(page, range(9)))):
        assert all(f"story {i * 5 + k} part 8" in text for k in range(2 + i % 3)) and "a b" not in text


def test_a_page_of_another_layout_loses_what_is_known_to_be_beside(spark):
    pages = [f"<body><div id=nav>menu {i}</div><div id=text>{story(i)}</div></body>" for i in range(8)]
    found = texts(spark, [*pages, "<body><div id=nav>menu 8</div><div id=odd><p>other</p></div></body>"])
    assert found[8] == "other"


def test_cells_without_closing_tags_are_siblings():
    page = main_text.parse("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>")
    assert [len(b.around) for b in page.blocks] == [3, 3, 3, 6, 3]
