import html
import re

import pytest
from pyspark.sql.functions import array, lit

from presswork.llm import htmlwrap as H
from presswork.llm.common import table

from .conftest import frame


def site(i):
    items = "".join(f"<li><a href=/{k}>topic {k}</a>" for k in range(3 + i % 3))
    extra = f"<h2>Part {i}</h2><p>More of {i}.</p>" if i % 2 else ""
    return f"""<!doctype html><html><head><title>T{i}</title><style>p{{}}</style><script>if(a<b)"</p>"</script></head><body class="has-sidebar">
<header><h1>The Site</h1></header><div id="cookie-banner-{i}">We use cookies.</div><nav><ul>{items}</ul></nav>
<div class="wrap"><div class="sidebar"><h3>Popular</h3><ul>{items}</ul></div><div class="post-body"><h2>Title {i}</h2>
<p>First &amp; best &eacute; paragraph {i},\n  with <b>bold</b>&nbsp;text.<p>Second of {i * 7}<br>on two lines{extra}<ul><li>item {i}<li>point {i * 3}</ul>
<div class="advert">Buy {i} now</div><div>Read our terms</div><form><p>Mail: <input></p></form></div>
<div id="comments"><article class="comment"><p>A reader's comment {i} that goes on and on and on.</p></article></div></div><footer>&copy; us</footer></body></html>"""


def wrapped(pages):
    w = None
    for p in dict.fromkeys(pages):
        w = H.align(w, H.page_wrapper(p)) if w else H.page_wrapper(p)
    return w


def test_site_without_article_element():
    pages = [site(i) for i in range(6)]
    w = wrapped(pages)
    kept = H.kept_slots(w)
    assert H.main_text(pages[2], kept) == "Title 2\nFirst & best é paragraph 2, with bold text.\nSecond of 14\non two lines\nitem 2\npoint 6"
    assert "Part 3\nMore of 3." in H.main_text(pages[3], kept)
    e = H.expression(w)
    assert "(<li> TEXT </li>)+" in e and "<nav>" in e


def test_alignment_makes_optional_and_repeated_groups():
    level = lambda *k: H.level_of(list(k))
    assert level("a", "b", "b", "c") == [[["a"], False, False], [["b"], True, False], [["c"], False, False]]
    assert level("p", "h", "p", "x") == [[["p", "h"], True, False], [["x"], False, False]]
    assert H.align_levels(level("a", "c"), level("a", "b", "c")) == [[["a"], False, False], [["b"], False, True], [["c"], False, False]]
    assert H.align_levels(level("a", "b", "c"), level("a", "c")) == [[["a"], False, False], [["b"], False, True], [["c"], False, False]]
    assert H.align_levels(level("a", "b"), level("b", "a"))[0][1] is True
    a, b, c = (H.page_wrapper(x) for x in ("<div><p>x<p>y</div>", "<div><p>x</div><i>t</i>", "<div><h1>z</h1></div>"))
    one = H.align(H.align(H.loads(H.dumps(a)), H.loads(H.dumps(b))), H.loads(H.dumps(c)))
    assert H.loads(H.dumps(one)) == one
    assert H.expression(one).count("<p>") == 1 and "?" in H.expression(one)


def test_a_wrapper_covers_its_pages():
    """Each page's stream matches the expression of the wrapper of all."""
    pages = [site(i) for i in range(5)] + ["<body><p>a<p>b", "<body><div>x</div><p>c"]
    w = wrapped(pages)

    def matches(seq, kinds):
        pattern = ""
        code = {}
        letter = lambda k: code.setdefault(k, chr(0x4E00 + len(code)))
        for names, repeated, optional in seq:
            own = "(?:" + "|".join(letter(k) for k in names) + ")"
            pattern += own + ("*" if repeated and optional else "+" if repeated else "?" if optional else "")
        return re.fullmatch(pattern, "".join(letter(k) for k in kinds)) is not None

    for p in pages:
        for path, elements in H.tokens(p)[1].items():
            for kinds in elements:
                assert matches(w[path]["seq"], kinds), (path, kinds, w[path]["seq"])


@pytest.mark.parametrize("page,text", [
    ("", ""), ("plain words", "plain words"), ("<p>only<p>paras", "only\nparas"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p>a<", "a<"), ("<p>a</p", "a"), ("<!-- c", ""), ("x &lt;b&gt; &#233; &#x41; &bogus; &am", "x <b> é A &bogus; &am"), ('<p title="a>b">t</p>', "t"),
    ("<div>" * 3000 + "deep", "deep"), ("<textarea><p>no</p></textarea><p>yes", "yes"), ("<P>UP</P><SCRIPT>x</SCRIPT>", "UP"),
    ("<main><article><header><h1>Head</h1><p>by me</p></header><p>x<br>y</p><aside>no</aside></article><section class=comments><p>c</p></section></main>", "Head\nx\ny"),
    ("<div class='ad'><article><p>still the article</p></article></div>", ""),
])
def test_literal_pages(page, text):
    w = H.page_wrapper(page)
    assert H.main_text(page, H.kept_slots(w)) == text


def plain(page):
    """The given tables' pages: blocks of the article element."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
    body = re.sub(r"</?(?:p|h1|br)>", "\0", m[1]) if m else ""
    body = re.sub(r"<[/a-zA-Z][^>]*(?:>|\Z)", "", body)
    blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in body.split("\0"))
    return "\n".join(b for b in blocks if b)


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.extract(pages).collect()}
    rows = pages.collect()
    assert got == {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in rows}


def test_edge_rows_and_fan_in(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "FAN_IN", 2)
    schema = "page_id long, url string, html string, wrapper string, _key string, host string, text string"
    rows = [(i, f"https://Site.example/{i}", site(i), "clash", "clash", "clash", "clash") for i in range(9)]
    rows += [(20, None, "<p>no url</p>", *["clash"] * 4), (21, "not a url", None, *["clash"] * 4), (22, "http://e", "", *["clash"] * 4), (None, "http://n", "<p>no id</p>", *["clash"] * 4),
             (3, "https://site.example/3", site(3), *["clash"] * 4), (23, "http://long", "<article>" + "<p>word</p>" * 50_000 + "</article>", *["clash"] * 4)]
    df = frame(spark, tmp_path, rows, schema, parts=7)
    out = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    assert len(out) == len(rows) and all(n == len(t) for _, t, n in out)
    by = dict((i, t) for i, t, _ in out)
    kept = H.kept_slots(wrapped([site(i) for i in range(9)]))
    assert all(by[i] == H.main_text(site(i), kept) for i in range(9))
    assert (by[20], by[21], by[22], by[None]) == ("no url", "", "", "no id") and by[23].count("\n") == 49_999
    assert H.extract(spark.createDataFrame([], schema)).count() == 0


def test_each_layout_of_a_host_has_its_region(spark, tmp_path):
    """Minority layouts, page-specific ids and pages without a host keep their text."""
    say = lambda i: f"Words of page {i} that " + f"go on {i} times, " * 12
    cover = lambda i, body: f"<body class='page slug-{chr(97 + i)}x'><nav><a href=/>home</a></nav>{body}<footer>end</footer></body>"
    html_of = lambda i: cover(i, [f"<main><p>{say(i)}</p></main>", f"<article class=post><p>{say(i)}</p></article>",
                                  f"<div class=plain><p>{say(i)}</p></div>", f"<article id='on-{chr(97 + i)}-things'><p>{say(i)}</p></article>"][0 if i < 12 else i % 4])
    rows = [(i, None if i % 2 else "http://mixed.example/x", html_of(i)) for i in range(20)]
    two = "".join(f"<article id='{n}'><p>{say(k)}</p></article>" for k, n in enumerate(["left-one", "other", "third"]))
    rows.append((50, "http://many.example", two))
    df = frame(spark, tmp_path, rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert {i: got[i] for i in range(20)} == {i: say(i).strip() for i in range(20)}
    assert got[50] == "\n".join(say(k).strip() for k in range(3))


def test_words_of_one_page_do_not_grow_the_wrapper(spark, tmp_path):
    say = "<p>some text</p>"
    rows = [(i, "http://s.example", f"<body class='p-{c}'><article id='slug-{c}'><h2 id='{c}q'>{c}</h2>{say}</article></body>") for i, c in enumerate("abcdefghij")]
    df = frame(spark, tmp_path, rows, "page_id long, url string, html string").withColumnsRenamed({"html": "_html"}).withColumn("_host", lit("s"))
    shared = H.shared_words(df.select("_host", "_html"))
    assert shared.count() == 0
    w = H.wrappers(df.select("_host", "_html", array().cast("array<string>").alias("shared"))).collect()
    assert len(w) == 1 and len(H.loads(w[0].wrapper)) == 5


def test_copies_of_a_page_make_no_constants():
    """A list or box that only one article has stays, however often the article is stored."""
    page = lambda i, more: f"<body><div class=wrap><p>{f'Text {i} goes on. ' * 20}</p>{more}</div></body>"
    box = "<ul><li>first point<li>second point</ul><div>A boxed remark.</div>"
    own = page(0, box)
    pages = [own] * 5 + [page(i, "") for i in range(1, 6)]
    assert "first point\nsecond point\nA boxed remark." in H.main_text(own, H.kept_slots(wrapped(pages)))
    assert "boxed" not in H.main_text(own, H.kept_slots(wrapped([page(i, box) for i in range(6)])))
    some = [page(i, "<div>Rare box.</div>") for i in range(3)] + [page(i, "") for i in range(3, 40)]
    assert "Rare box." in H.main_text(some[0], H.kept_slots(wrapped(some)))
    article = lambda i: f"<article><p>{f'Text {i} goes on. ' * 20}</p><div>Our terms.</div><ul><li><a href=/a>Source one</a><li><a href=/b>Source two</a></ul></article>"
    got = H.main_text(article(1), H.kept_slots(wrapped([article(i) for i in range(6)])))
    assert got.endswith("Our terms.\nSource one\nSource two")


def test_constants_of_any_length_counted_over_all_pages(spark, tmp_path):
    """A notice on most of a host's different pages goes, short or long; one on fewer stays, however often these are stored."""
    page = lambda host, i, more: f"<body><div class=wrap><p>{f'Text {i} of {host} goes on. ' * 20}</p>{more}</div></body>"
    notice = {f"n{n}": "<div>" + ("terms " * n)[: n - 1] + ".</div>" for n in (150, 250, 5000)}
    rows = [(host, page(host, i, box)) for host, box in notice.items() for i in range(6)]
    box = "<div>A boxed remark.</div>"
    rows += [("most", page("most", i, box if i < 31 else "")) for i in range(60)]
    rows += [("few", page("few", i, box if i < 29 else "")) for i in range(60)]
    rows += [("copies", page("copies", 0, box))] * 70 + [("copies", page("copies", i, "")) for i in range(1, 6)]
    df = frame(spark, tmp_path, [(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string", parts=5)
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    for i, (host, p) in enumerate(rows):
        told = p.split("<p>")[1].split("</p>")[0].strip()
        assert got[i] == (f"{told}\nA boxed remark." if box in p and host in ("few", "copies") else told), (host, i)


@pytest.mark.parametrize("attributes", ["class='col col-md-4 order-2 mt-3 sidebar'", "class='a b c d' id='comments'", "class='a b c d e f advert g'"])
def test_every_class_word_and_the_id_tell_main_text_apart(attributes):
    page = f"<body><article><p>The text itself, which is long enough.</p><div {attributes}><p>Not the text.</p></div></article></body>"
    assert H.not_main(H.kind_of("div", attributes)) and H.not_main(H.kind_of("div", attributes, set()))
    assert H.main_text(page, H.kept_slots(H.page_wrapper(page))) == "The text itself, which is long enough."
