import math
import re
from collections import Counter, defaultdict

from stratamill.llm.common import table
from stratamill.llm.html_extract import DAMPING, content, extract, low_marks, parse, style_tree


def texts(page):
    return [b.text for b in parse(page)[0] if not b.apart]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;c<b> d</b>e<br>f<p>g<!-- <p>x</p> --></p> h") == ["a & b c de f", "g", "h"]
    assert texts('<script>var t="</p>";</script><style>p{}</style><nav>m</nav><div class="side-bar ad">x<p>y</p></div><ul><li>1<li>2</ul>z<p') == ["1", "2", "z"]
    assert texts('<div class="comments"><article>c</article></div><main>k<form>f</form><aside>s</aside></main><footer>&copy; f') == ["k"]
    assert texts("<table><tr><td>1<td>2<tr><td>3</table><h1>T</h1>") == ["1", "2", "3", "T"]
    assert texts("a < b and 3 > 2 <i>x</i></b></div>y") == ["a < b and 3 > 2 x", "y"]


def test_style_tree_drops_what_a_site_repeats(spark):
    page = "<html><body><div class=top>Welcome</div><div class=txt><p>Story {0}</p><p>More {0}</p></div><div class=low>All rights</div></body></html>"
    rows = [(i, f"http://a.example/{i}", page.format(i), 1, "x") for i in range(20)] + [(50, "http://b.example/1", page.format(50), 1, "x"), (51, None, None, 1, "x"), (52, "http://c.example", "", 1, "x")]
    got = {r.page_id: (r.text, r.n_chars) for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string, _host int, text string")).collect()}
    assert all(got[i][0] == f"Story {i}\n\nMore {i}" for i in range(20))
    assert got[50][0] == "Welcome\n\nStory 50\n\nMore 50\n\nAll rights" and got[51] == got[52] == ("", 0)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_the_table(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    for r in extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        want = [" ".join(re.sub(r"<b>|</b>|<br>", " " if "<br>" in t else "", t).split()) for t in re.split(r"</?(?:h1|p)>", body)]
        assert r.text.replace("&", "") == "\n\n".join(w for w in want if w).replace("&amp;", "").replace("&quot;", '"').replace("&amp", "").replace("&", "") and r.n_chars == len(r.text)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def text_by_id(spark, rows):
    return {r.page_id: r.text for r in extract(pages_of(spark, rows)).collect()}


def test_style_tree_decides_pages_with_an_article_too(spark):
    page = "<body><main><div class=x1>Join our mailing list</div><h1>Title {0}</h1><p>Story {0}</p></main></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(20)]
    body = " ".join(["The body of this page is in a plain element."] * 5)
    rows.append((30, "http://b.example/1", f"<div><p>{body}</p></div><article>Another page</article><article>And one more</article>"))
    got = text_by_id(spark, rows)
    assert all(got[i] == f"Title {i}\n\nStory {i}" for i in range(20))
    assert got[30] == f"{body}\n\nAnother page\n\nAnd one more"


def test_names_in_values_and_parts_of_names_set_nothing_apart():
    assert texts('<article><header class="entry-header"><h1>T</h1></header><h2 id="market-share">a</h2><h2 id="related-work">b</h2><h2 id="notice-period">c</h2></article>') == ["T", "a", "b", "c"]
    assert texts('<div class="content has-sidebar"><article><p>k</p></article></div>') == ["k"]
    assert texts("""<p style="overflow:hidden">a</p><p title='a hidden gem'>b</p><p data-hidden="false">c</p><p hidden>d</p><p class=x hidden="">e</p><p aria-hidden=true>f</p>""") == ["a", "b", "c"]
    assert texts('<form id="page"><div class="widget"><article>k</article>m</div></form><div class="sidebar"><main>n</main></div>') == ["k", "n"]
    assert texts('<div class="related"><article>t</article></div><article>k<div class="share">s</div><div class="notice">n</div></article><div id="notice">o</div>') == ["k", "n"]


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div class=top>Welcome</div><div class=txt><p>Story {0}</p></div></body>"
    long = " ".join(["A sentence that all the near copies share."] * 4)
    rows = [(i, f"http://a.example/{i}", page.format(0)) for i in range(8)]
    rows += [(i, f"http://b.example/{i}", page.format(max(i, 40))) for i in range(10, 50)]
    rows += [(i, f"http://c.example/{i}", f"<article><p>{long}</p><p>Edition {i}</p></article>") for i in range(60, 70)]
    got = text_by_id(spark, rows)
    assert all(got[i] == "Welcome\n\nStory 0" for i in range(8))
    assert all(got[i] == f"Story {max(i, 40)}" for i in range(10, 50))
    assert all(got[i] == f"{long}\n\nEdition {i}" for i in range(60, 70))


def plain_tree(pages):
    """Importance of the element and content nodes of one site by recursion, and the nodes that are low at 0.3."""
    looks, parts, below, size, seen = defaultdict(list), defaultdict(Counter), defaultdict(set), {}, set()
    for page in pages:
        found, elements = parse(page, "s")
        if (key := tuple(b.text for b in found if not b.apart)) in seen:
            continue
        seen.add(key)
        for node in {e.node for e in elements}:
            looks[node].append({tuple(e.kids) for e in elements if e.node == node})
        for e in elements:
            if len(e.chain) > 1:
                below[e.chain[-2]].add(e.node)
        for node, text in {(b.node, b.text) for b in found}:
            parts[node][text] += 1
            size[text] = len(text)
    weight = lambda e: sum(n * size[t] for t, n in parts[e].items()) + sum(map(weight, below[e]))
    leaf = {(e, t): 1 - math.log(n) / math.log(len(looks[e])) if len(looks[e]) > 1 else 1.0 for e in parts for t, n in parts[e].items()}

    def value(e):
        inner = sum(n * size[t] * leaf[e, t] for t, n in parts[e].items()) + sum(map(value, below[e]))
        kinds, m = Counter(k for page in looks[e] for k in page), len(looks[e])
        if set(kinds) == {()}:
            return inner
        total = sum(kinds.values())
        spread = -sum(n / total * math.log(n / total) for n in kinds.values())
        g = DAMPING ** len(kinds)
        return (1 - g) * (min(1.0, spread / math.log(m)) if m > 1 else 1.0) * weight(e) + g * inner

    importance = {e: value(e) / weight(e) for e in looks if weight(e)}
    most = lambda e: max([importance.get(e, 0.0), *map(most, below[e])])
    low = {content(e, t) for (e, t), x in leaf.items() if parts[e][t] > 1 and x < 0.3} | {e for e in importance if len(looks[e]) > 1 and most(e) < 0.3}
    return leaf, importance, low


def test_style_tree_is_that_of_a_plain_recursion(spark):
    side = "<div class=s><ul>{}</ul><div class=d{}>Follow us</div></div>"
    page = "<body><div class=top>Welcome<span>!</span></div>{side}<div class=txt><h1>T{i}</h1>{body}</div><div class=low><p>All rights</p><p>{year}</p></div></body>"
    pages = [page.format(i=i, side=side.format("".join(f"<li>Item {k}</li>" for k in (1, 2, 3, 90 + i)), "x" if i % 4 else "") if i % 5 else "", body=f"<p>Body of page {i}</p>" * (i % 3 + 1) + "<table><tr><td>1</table>" * (i % 2), year=2000 + i % 2) for i in range(24)]
    pages += pages[:6]
    leaf, importance, low = plain_tree(pages)
    rows = spark.createDataFrame([(x, "s") for x in pages], "html string, site string").repartition(3)
    texts, elements = style_tree(rows, "html", "site")
    got = {r.content: round(r.importance, 9) for r in texts.collect()}
    assert got == {content(e, t): round(x, 9) for (e, t), x in leaf.items()} and len(got) > 30
    assert {r.node: round(r.importance, 9) for r in elements.collect()} == {e: round(x, 9) for e, x in importance.items()}
    assert {r.mark for r in low_marks(texts, elements, 0.3).collect()} == low and any(e in low for e in importance)


def test_a_low_branch_takes_its_short_texts_along(spark):
    page = "<body><div class=s><ul><li>Home page</li><li>All our stories</li><li>Write to us</li><li>No {0}</li></ul></div><div class=t><p>Story number {0} is told here</p></div></body>"
    rows = [(i, f"http://a.example/{i}", page.format(i)) for i in range(30)]
    want = {i: f"Story number {i} is told here" for i in range(30)}
    assert text_by_id(spark, rows) == want
    assert {r.page_id: r.text for r in extract(pages_of(spark, rows + rows[:3]), most=0).collect()} == want


def test_few_pages_odd_rows_and_long_pages(spark):
    page = "<div class=a>Welcome to the site</div><div class=b><p>{0}</p></div>"
    long = "word " * 60_000
    rows = [(1, "http://a.example/1", page.format("First story")), (2, "http://a.example/2", page.format("Second story")), (2, "http://a.example/2", page.format("Second story"))]
    rows += [(None, None, "<p>x</p>"), (4, None, None), (5, "http://b.example", ""), (6, "http://b.example/6", f"<article><p>{long}</p></article>"), (7, "http://c.example", "<div>" * 3000 + "deep" + "</div>" * 3000)]
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in extract(pages_of(spark, rows)).collect()), key=str)
    assert [x[2] for x in got] == ["x", "First story", "Second story", "Second story", "", "", long.strip(), "deep"]
    assert [x[3] for x in got][-2:] == [len(long) - 1, 4]
    assert texts("<p data-x=it's>First par</p><p>don't lose</p>") == ["First par", "don't lose"] and texts('<article style="overflow:hidden"><p>Real text</p></article>') == ["Real text"]
