import html
import random
import re

import pytest

from tessera.llm import dom, wrapper


def page(rng, host, body=None, extra=""):
    words = lambda n: " ".join(rng.choice("lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy".split()) for _ in range(n))
    paragraphs = body or [words(rng.randint(8, 30)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f'<li><a href="/{words(1)}">{words(1)}</a></li>' for _ in range(4))
    text = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<html><head><title>{words(3)}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><div class="ad">{words(4)}</div><article>{text}{extra}</article><footer>&copy; {host}</footer></body></html>', " ".join(paragraphs)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, skeleton string")


def test_articles_of_many_hosts(spark):
    rng, rows, want = random.Random(1), [], {}
    for i in range(80):
        host = f"www.h{min(i % 9, 4)}.example"
        text, want[i] = page(rng, host)
        rows.append((i, f"https://{host}/a?b#{i}", text))
    rows += [(100, None, rows[0][2]), (101, "no url", rows[1][2]), (102, "http://lone.example/", rows[2][2]), (103, "http://www.h4.example/", None), (104, "http://www.h4.example/", ""), (105, "http://www.h4.example/", "no markup &amp; <b>bold</b>"), (2, rows[2][1], rows[2][2])]
    want |= {100: want[0], 101: want[1], 102: want[2], 103: "", 104: "", 105: "no markup & bold"}
    out = wrapper.extract(spark, rows_of(spark, rows)).collect()
    assert len(out) == len(rows)
    assert {r.page_id: r.text for r in out} == want
    assert {r.page_id: r.url for r in out} == {i: u for i, u, _ in rows}


def test_constant_slots_are_template_where_markup_tells_nothing(spark):
    """Pages of plain divs: what never changes goes, what varies stays."""
    rng, rows, want = random.Random(2), [], {}
    for i in range(12):
        body = " ".join(rng.choice("red green blue white black".split()) for _ in range(12))
        rows.append((i, f"http://plain.example/{i}", f"<body><div>Welcome to the plain site</div><div><div>{body}</div></div><div>All rights reserved by nobody at all</div></body>"))
        want[i] = body
    assert {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()} == want


def test_copies_do_not_make_an_article_template(spark):
    text, want = page(random.Random(3), "copy.example")
    rows = [(i, "http://copy.example/", text) for i in range(20)]
    assert {r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()} == {want}


def test_joined_wrappers_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, f"http://h{i % 3}.example/", page(rng, "h", extra="<p>Read more</p>")[0]) for i in range(30)]
    want = {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()}
    assert not any("Read more" in t for t in want.values())
    monkeypatch.setattr(wrapper, "BROADCAST_HOSTS", 1)
    assert {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()} == want


def test_slots_choose_the_content_of_pages_with_articles(spark):
    """Every article and a text outside of them vary and stay; a long notice inside an article never changes and goes."""
    rng, rows, want = random.Random(5), [], {}
    words = lambda n: " ".join(rng.choice("red green blue white black".split()) for _ in range(n))
    notice = "This notice of more than forty characters stands on every page of the host"
    for i in range(12):
        a, b, c, d = words(6), words(30), words(40), words(25)
        rows.append((i, f"http://many.example/{i}", f"<body><nav>{words(3)}</nav><div>Welcome to all</div><article><p>{a}</p></article><article><p>{b}</p><p>{notice}</p></article><div>{c}</div><main><p>{d}</p></main></body>"))
        want[i] = " ".join((a, b, c, d))
    assert {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()} == want


def test_without_the_template_notices_stay(spark, monkeypatch):
    """Ablation: the same pages without what alignment says about their slots."""
    rng = random.Random(12)
    words = lambda n: " ".join(rng.choice("red green blue white black".split()) for _ in range(n))
    rows, want = [], {}
    for i in range(14):
        title, body, extra = words(3), words(25), words(9)
        rows.append((i, f"http://blocks.example/{i}", f"<body><div><div>Shop at our sister site today</div><h1>{title}</h1><div>{body}</div><div>All prices without warranty</div></div><div>{extra}</div></body>"))
        want[i] = f"{title} {body} {extra}"
    assert {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()} == want
    monkeypatch.setattr(wrapper, "LEAST_PAGES", 10**6)
    without = {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()}
    assert all("sister site" in t and "without warranty" in t for t in without.values())


def test_digests_have_63_bits():
    found = [dom.digest(f"text {k}") for k in range(2000)]
    assert len(set(found)) == 2000 and all(0 < d < 1 << 63 for d in found) and max(found) > 1 << 60
    assert dom.digest(" a\n b ") == dom.digest("a b")


def test_shared_paragraph_of_a_small_host_stays(spark):
    rng, shared = random.Random(6), "This paragraph of more than forty characters is shared by all five pages"
    pages = [page(rng, "small.example", extra=f"<p>{shared}</p>") for _ in range(5)]
    rows = [(i, "http://small.example/", text) for i, (text, _) in enumerate(pages)]
    assert {r.page_id: r.text for r in wrapper.extract(spark, rows_of(spark, rows)).collect()} == {i: f"{want} {shared}" for i, (_, want) in enumerate(pages)}


def test_empty(spark):
    assert wrapper.extract(spark, rows_of(spark, [])).count() == 0


@pytest.mark.parametrize(("source", "text"), [
    ("<article><p><b>a<br><p>b  c\n d</p>e&nbsp;f</article>", "a b c d e f"),
    ("<main><h1>T</h1><aside>no</aside><div class='cookie-notice'>no</div><p>x<i>y</i>z</p><section id=comments><p>no</p></section></main>", "T xyz"),
    ("<p>a<script>if (a < b) '</p>'</script>b<!-- <p>no</p> -->c", "abc"),
    ("<header>no</header><article><header><h1>yes</h1></header>text</article>", "yes text"),
    ("<form><p>no</p></form>&lt;p&gt; &amp;c", "<p> &c"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a b c d"),
    ("<body class='no-sidebar'><div class='has-sidebar'><article>x</article><div class='side sidebar-left'>no</div></div></body>", "x"), ("<div id=with_nav>x</div><div class=top-nav>no</div>", "x"),
    ("<p title='a hidden class=ad gem' data-hidden>x</p><p hidden>no</p>", "x"),
    ("<article>x", "x"), ("</div></p>a<", "a<"), ("<div>no</div><article><p>short</p></article><article><p>a much longer one</p></article>", "short a much longer one"),
    ("<main><article>a teaser</article><div>the long text of the page itself</div></main><div>no</div>", "a teaser the long text of the page itself"),
    ("<main><article>the long text of the page itself</article><div>no more</div></main>", "the long text of the page itself"),
])
def test_reader(source, text):
    tree = dom.parse(source)
    assert wrapper.main_text(tree, [False] * len(tree.tag)) == text


def test_deep_and_broken_markup_is_read():
    for source in ("<div>" * 5000 + "x", "<b><i>" * 3000 + "x" + "</b></i>" * 3000, "<a " * 2000 + "x"):
        dom.parse(source)
    assert len(dom.parse("<p>x" * 20_000).tag) == 40_001


@pytest.mark.parametrize("depth", [130, 5000])
def test_deep_elements_open_and_close(depth):
    source = f"<div><article><p>first</p>{'<div>' * depth}<nav>no</nav>{'</div>' * depth}<p>rest</p></article><div>outside</div></div>"
    tree = dom.parse(source)
    assert wrapper.main_text(tree, [False] * len(tree.tag)) == "first rest"
    assert wrapper.main_text(tree, [False] * len(tree.tag), True) == "first rest outside"


def test_deep_pages_are_aligned():
    one, other = ("<div>" * 3000 + "<b>x</b>" * k + "</div><i>y</i>" * 3000 for k in (1, 2))
    a, b = dom.parse(one), dom.parse(other)
    pivot = dom.Skeleton.of(b)
    found = dom.align(a, a.digests(), pivot, pivot.shapes())
    assert sum(y >= 0 for y in found) == len(a.tag) and found[0] == 0


def matching(a, ta, b, tb):
    """Largest simple tree matching by the textbook recursion."""
    if ta.label[a] != tb.label[b]:
        return 0
    best = [[0] * (len(tb.children[b]) + 1)]
    for x in ta.children[a]:
        row = [0]
        for j, y in enumerate(tb.children[b]):
            row.append(max(best[-1][j + 1], row[j], best[-1][j] + matching(x, ta, y, tb)))
        best.append(row)
    return 1 + best[-1][-1]


def test_alignment_is_a_largest_matching():
    rng = random.Random(9)

    def some(depth):
        return "".join(f"<{t}>{some(depth - 1) if depth else ''}{'x' if rng.random() < 0.3 else ''}</{t}>" for t in (rng.choice(["div", "b", "i"]) for _ in range(rng.randint(0, 4))))

    for _ in range(150):
        a, b = dom.parse(some(3)), dom.parse(some(3))
        pivot = dom.Skeleton.of(b)
        found = dom.align(a, a.digests(), pivot, pivot.shapes())
        pairs = [(x, y) for x, y in enumerate(found) if y >= 0]
        assert len({y for _, y in pairs}) == len(pairs) == matching(0, a, 0, b)
        for x, y in pairs:
            assert a.label[x] == b.label[y] and (x == 0 or found[a.parent[x]] == b.parent[y])


def test_long_lists_are_matched_as_well_as_short_ones(monkeypatch):
    """A surplus element near the start, lists of more cells than a table holds: all lines meet their like."""
    line = lambda k, page: f"<p>fixed {k}</p>" if k % 3 == 0 else f"<p>{page} {k}</p>"
    one = "<body><h2>only here</h2>" + "".join(line(k, "one") for k in range(1, 900)) + "<ol><li>x</li></ol></body>"
    other = "<body>" + "".join(line(k, "other") for k in range(-1, 900)) + "</body>"
    a, b = dom.parse(one), dom.parse(other)
    pivot = dom.Skeleton.of(b)
    found = dom.align(a, a.digests(), pivot, pivot.shapes())
    fixed = [node for node, text in enumerate(a.text) if text.startswith("fixed")]
    assert len(fixed) == 299 and all(found[n] >= 0 and b.text[found[n]] == a.text[n] for n in fixed)
    assert sum(y >= 0 for y in found) == len(a.tag) - 5  # all but the h2, its text, the list, its item and text

    rng = random.Random(10)
    for cells in (1, 4, 30):
        monkeypatch.setattr(dom, "CELLS", cells)
        for _ in range(60):
            source = lambda: "".join(f"<{t}>{'<b>x</b>' * rng.randint(0, 2)}</{t}>" for t in rng.choices(["p", "i", "h2"], k=rng.randint(0, 12)))
            a, b = dom.parse(source()), dom.parse(source())
            pivot = dom.Skeleton.of(b)
            assert sum(y >= 0 for y in dom.align(a, a.digests(), pivot, pivot.shapes())) == matching(0, a, 0, b)


def test_regular_expression_agrees_on_the_tables(spark):
    def plain(source):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", inner)).split())

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: plain(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in wrapper.extract(spark, pages).collect()} == want
