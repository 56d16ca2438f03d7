import html as entities
import re

from conftest import SF, rows

from wardline.llm import wrapper
from wardline.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body>
<div id="top">Site name</div><div class="menu"><a href="/">Home</a></div>
<div id="story"><h1>Head {n}</h1><p>First &amp; {n}<br>more <b>bold</b> text.<p>Second   {n}
line.</p><form><p>Name</p></form><div class="comments"><p>I agree {n}</p></div></div>
<div class="x">Always the same words here.</div><footer>&copy; {n}</footer></body>"""


def test_varying_slots_become_content(spark):
    pages = [(i, "http://Site.org/p", PAGE.format(n=f"number {i}")) for i in range(6)]
    pages.append((6, "http://site.org:80/q", PAGE.format(n="number 0")))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = dict(rows(wrapper.main_text(frame), "page_id", "text"))
    for i in range(6):
        assert found[i] == f"Head number {i}\n\nFirst & number {i} more bold text.\n\nSecond number {i} line."
    assert found[6] == found[0]


def test_article_of_the_given_pages(spark):
    def want(page):
        inside = page[page.index("<article>") + 9:page.index("</article>")].replace("<br>", " ")
        blocks = (re.sub(r"</?b>", "", b) for b in re.split(r"</?(?:p|h1)>", inside))
        return "\n\n".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))

    given = rows(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "url", "html")
    found = QUERIES["op10_wrapper_text"](spark, SF)
    assert rows(found) == sorted(((i, u, want(h), len(want(h))) for i, u, h in given), key=repr)


def test_given_pages_without_article_elements():
    """The wrapper finds the content where no element is marked as the article: the given pages give the same texts with a plain
    div in its place. The adverts differ from page to page like content does, so their names tell them; without any names all of the
    content is found still, and the adverts with it."""
    import collections

    import pyarrow.parquet as pq

    hosts = collections.defaultdict(list)
    for row in pq.read_table(f"{SF.replace('0.001', '0.01')}/pages.parquet").to_pylist():
        hosts[re.match(r"https?://([^/]+)", row["url"])[1]].append(row["html"])
    same = inside = total = 0
    for pages in hosts.values():
        plain = [p.replace("<article", "<div").replace("</article", "</div") for p in pages]
        nameless = [re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|[^\s>]+)", "", p) for p in plain]
        marked, own, bare = (wrapper.induce(x) for x in (pages, plain, nameless))
        for given, without, none in zip(pages, plain, nameless, strict=True):
            want = wrapper.extract(given, marked)
            same += wrapper.extract(without, own) == want
            inside += set(want.split("\n\n")) <= set(wrapper.extract(none, bare).split("\n\n"))
            total += 1
    # The two others share most of their text with another page of the host.
    assert total == 250 and same >= 248 and inside >= 245


def test_copies_are_not_template(spark):
    page = "<html><body><article><p>Copied text.</p></article></body></html>"
    frame = spark.createDataFrame([(i, "https://a.b/c", page) for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in wrapper.main_text(frame).collect()} == {"Copied text."}


def test_edges(spark):
    long = "<p>" + "word " * 40_000 + "</p>" + "<div>" * 3 + "<p>x</p>" * 3000
    pages = [
        (1, None, None, "t"), (2, "http://h/x", None, "t"), (3, "http://h/x", "", "t"), (None, "not a url", "<p>a</p>b", "t"),
        (5, "http://h/", "plain &lt;text&gt; only", "t"), (6, "http://h/", "<p>open <b>never closed", "t"),
        (7, "http://g/", long, "t"), (8, "", "<p class='ad'>no</p><nav>no</nav><p>yes</p></div></p>", "t"),
        (8, "", "<p class='ad'>no</p><nav>no</nav><p>yes</p></div></p>", "t"), (9, "http://k/", "<script>a</script><", "t"),
        (10, "http://k/", "a < b <!-- c", "t"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    found = wrapper.main_text(frame)
    assert found.columns == ["page_id", "url", "html", "text"]
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.page_id, []).append(r.text)
    assert by_id[1] == by_id[2] == by_id[3] == [""] and by_id[None] == ["a\n\nb"] and by_id[8] == ["yes", "yes"]
    assert by_id[6] == ["open never closed"] and len(by_id[7][0]) > 200_000
    assert wrapper.main_text(frame.limit(0)).collect() == []


def test_matching_keeps_order_and_takes_the_most_nodes():
    a = wrapper.induce(["<body><div><p>1</p><ul><li>x</li></ul></div><div><p>2</p></div></body>"])
    body = a.kids[0]
    nodes = wrapper.children(wrapper.parse("<body><div><p>9</p><ul><li>y</li></ul></div></body>"))[0]
    assert wrapper.match(body.kids, wrapper.groups(wrapper.children(nodes))) == [(0, 0)]


def frame_of(spark, pages, url="http://mixed.org/"):
    return spark.createDataFrame([(i, url, p) for i, p in enumerate(pages)], "page_id long, url string, html string")


def test_host_of_two_layouts(spark):
    around = "<body><div class='top'>Site name</div>{}<div class='x'>Same words on all pages.</div></body>"
    one = [around.format(f"<article><p>Article number {n} of many.</p></article><p>Outside {n}</p>") for n in range(6)]
    two = [around.format(f"<div id='story'><p>Story number {n} of many.</p></div>") for n in range(3)]
    want = [f"Article number {n} of many." for n in range(6)] + [f"Story number {n} of many." for n in range(3)]
    assert [r.text for r in wrapper.main_text(frame_of(spark, one + two)).orderBy("page_id").collect()] == want
    # A layout that the sample hasn't seen.
    assert wrapper.extract(one[0], wrapper.induce(two)) == want[0]


def test_names_of_layouts_and_sections(spark):
    page = """<body><form id="all" class="search-form"><div id="page" class="site has-sidebar"><div class="container nav-open menu">{}</div>
<div class="menu"><p>Some menu {}</p></div></div></form></body>"""
    inside = """<h1>Title {0}</h1><section id="related-work"><p>Related work {0} was done.</p></section>
<div id="search-algorithms"><p>Search {0} is fast.</p></div><p class="notice-period">Notice {0} is a month.</p>
<div class="share-links"><a href="#">Share this {0} now</a></div><div class="sponsored">Buy {0}</div>"""
    want = "\n\n".join(("Title {0}", "Related work {0} was done.", "Search {0} is fast.", "Notice {0} is a month."))
    for tag in ("article", "div"):
        pages = [page.format(f"<{tag}>{inside.format(n)}</{tag}>", n) for n in range(5)]
        found = [r.text for r in wrapper.main_text(frame_of(spark, pages)).orderBy("page_id").collect()]
        assert found == [want.format(n) for n in range(5)]


def test_rare_layout_of_a_hot_host(spark):
    often = "<body><div id='a'><p>Often {n}.</p></div><div class='b'>Words of all pages.</div></body>"
    rare = "<body><div id='r'><p>Rare {n}.</p></div><table class='q'><tr><td>Words of the rare layout.</td></tr></table></body>"
    pages = [often.format(n=n) for n in range(396)] + [rare.format(n=n) for n in range(4)]
    found = wrapper.main_text(frame_of(spark, pages).repartition(7)).orderBy("page_id").collect()
    assert [r.text for r in found] == [f"Often {n}." for n in range(396)] + [f"Rare {n}." for n in range(4)]


def test_a_large_host_is_merged_in_rounds(spark, monkeypatch):
    pages = [PAGE.format(n=f"number {i}") for i in range(120)]
    frame = frame_of(spark, pages).unionAll(frame_of(spark, pages[:9], "http://small.org/")).repartition(5)
    want = rows(wrapper.main_text(frame), "page_id", "text")
    for parts, size in ((2, 3), (4, 1)):  # 20 and 30 times the first parts, merged in rounds of two and four
        monkeypatch.setattr(wrapper, "PARTS", parts)
        monkeypatch.setattr(wrapper, "PAGES", size)
        assert rows(wrapper.main_text(frame), "page_id", "text") == want


def test_parts_of_a_wrapper_add_up():
    pages = [PAGE.format(n=f"number {i}") for i in range(40)]
    parts = [wrapper.Slot("html"), wrapper.Slot("html")]
    for i, page in enumerate(pages):
        tree = wrapper.parse(page)
        wrapper.merge(parts[i % 2], wrapper.page_slots(tree, wrapper.Facts(tree)))
    wrapper.merge(parts[0], wrapper.from_flat(wrapper.flat(parts[1])))
    assert wrapper.packed(parts[0]) == wrapper.packed(wrapper.induce(pages))


def test_texts_of_a_slot_are_bounded_and_none_is_lost():
    slot = wrapper.Slot("p")
    for i in range(5000):
        one = wrapper.Slot("p")
        one.pages, one.members, one.texts = 1, 2, {7 if i % 10 < 7 else -i: 1, i + 100: 1}
        slot.add(one)
    slot.decide()
    assert slot.constant == {7} and len(slot.texts) <= 2 * wrapper.KEPT


def test_template_inside_articles(spark):
    page = """<body><article><h1>Title {n}</h1><p>The text of page {n} is this.</p><p>And more of it, number {n}.</p>
<div>Pass this on to friends.</div><section><p>Ann: fine work.</p></section><p>The editors take no blame.</p></article></body>"""
    copies = [f"<body><article><p>{'A copied text with many words. ' * 5}</p><p>Change {n}.</p></article></body>" for n in range(6)]
    frame = frame_of(spark, [page.format(n=n) for n in range(8)]).unionAll(frame_of(spark, copies, "http://copies.org/"))
    found = {(r.url, r.page_id): r.text for r in wrapper.main_text(frame).collect()}
    for n in range(8):
        assert found["http://mixed.org/", n] == f"Title {n}\n\nThe text of page {n} is this.\n\nAnd more of it, number {n}."
    assert all("A copied text" in found["http://copies.org/", n] for n in range(6))


def test_long_lists_and_deep_pages(spark):
    def page(n, sections):
        body = "".join(f"<h2>Head {n} {i}</h2><p>Section {i} of page {n}.</p>" for i in range(sections))
        return f"<body><div id='all'>{body}<hr><div><p>No. 5, Long Street</p></div><p>All our legal words.</p></div></body>"

    pages = [page(n, 1) for n in range(7)] + [page(7, 400)]
    found = [r.text for r in wrapper.main_text(frame_of(spark, pages)).orderBy("page_id").collect()]
    for n, text in enumerate(found):
        assert text == "\n\n".join(
            f"Head {n} {i}\n\nSection {i} of page {n}." for i in range(1 if n < 7 else 400))
    # 5,000 elements around the text, and blocks and menus in the depth.
    deep = "<div>" * 5000 + "<p>One {0}.</p><nav>Menu</nav><p>Two {0}.</p><aside>Aside</aside>" + "</div>" * 5000 + "<p>End {0}.</p>"
    deep = "<body>" + deep + "</body>"
    found = wrapper.main_text(frame_of(spark, [deep.format(n) for n in range(4)])).orderBy("page_id").collect()
    assert [r.text for r in found] == [f"One {n}.\n\nTwo {n}.\n\nEnd {n}." for n in range(4)]


def test_windows_match_once_and_in_order():
    def slots(labels):
        return [wrapper.Slot(x) for x in labels]

    right = slots(["a", *["h2", "p"] * 300, "mid", *["h2", "p"] * 5, "z"])
    left = slots(["a", *["h2", "p"] * 3, "mid", *["h2", "p"] * 400, "z"])
    pairs = wrapper._matched(left, right)
    assert len(pairs) == 3 + 6 + 10 and pairs == sorted(pairs)
    assert all(left[i].label == right[j].label for i, j in pairs)
    assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
