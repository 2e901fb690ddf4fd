"""Feed files, quarantine, HTML links, robots rules, store and incremental ingest."""

import os

import pytest

from presswork.operators.robots import robots_allowed, rules_frame
from presswork.sources import feeds as FD
from presswork.sources.html import links_to_items, scan_html_links
from presswork.sources.manifest import entry, publish, state
from presswork.sources.store import read_store
from presswork.streaming.ingest import incremental_ingest, ingest_frame

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>x</title>
<item><title> First  &amp; best </title><link> https://A.example.com/p?utm_source=z&amp;b=1 </link>
<pubDate>Sun, 15 Feb 2026 19:40:00 +0000</pubDate><description><![CDATA[<p>Body <b>one</b></p>]]></description></item>
<item><title></title><link>https://a.example.com/empty-title</link></item>
<item><title>Second</title><link>https://a.example.com/2</link><pubDate>2026-02-15T10:00:00+05:30</pubDate></item>
<item><title>Dup of first</title><link>https://a.example.com/p?b=1</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>y</title>
<entry><title type="html">Atom &lt;one&gt;</title><link rel="alternate" href="https://b.example.org/1"/>
<link href="https://b.example.org/other"/><updated>2026-02-15T19:40:00+05:30</updated>
<content type="html">&lt;p&gt;content only&lt;/p&gt;</content></entry>
<entry><title>Atom two</title><link href="https://b.example.org/2"/><published>2026-02-14T08:00:00Z</published>
<updated>2026-02-15T00:00:00Z</updated><summary>the summary</summary><content>ignored</content></entry>
</feed>"""
BROKEN = "<rss><channel><item><title>broken</channel>"


def land(root, name, text):
    os.makedirs(os.path.dirname(os.path.join(root, name)), exist_ok=True)
    with open(os.path.join(root, name), "w") as f:
        f.write(text)


def test_feeds_and_quarantine(spark, tmp_dir):
    land(tmp_dir, "srcA/feed1.xml", RSS)
    land(tmp_dir, "srcB/feed1.xml", ATOM)
    land(tmp_dir, "srcC/feed1.xml", BROKEN)
    items, bad = FD.scan_feeds(spark, tmp_dir)
    arts = FD.items_to_articles(items).orderBy(*FD.ARRIVAL_ORDER).collect()
    assert [(a.source, a.title, a.url) for a in arts] == [
        ("srcA", "First & best", "https://a.example.com/p?b=1"),
        ("srcA", "Second", "https://a.example.com/2"),
        ("srcA", "Dup of first", "https://a.example.com/p?b=1"),
        ("srcB", "Atom <one>", "https://b.example.org/1"),
        ("srcB", "Atom two", "https://b.example.org/2"),
    ]
    assert arts[0].content == "Body one" and arts[0].published_at.isoformat() == "2026-02-15T19:40:00"
    assert arts[1].published_at.isoformat() == "2026-02-15T10:00:00"      # wall clock: offset dropped
    assert arts[3].content == "content only" and arts[4].content == "the summary"
    assert arts[4].published_at.isoformat() == "2026-02-14T08:00:00"      # published before updated
    assert [r.file_path.split("/")[-2] for r in bad.collect()] == ["srcC"]
    utc = FD.items_to_articles(items, dates="utc").filter("source = 'srcB'").orderBy("entry_ord").collect()
    assert utc[0].published_at.isoformat() == "2026-02-15T14:10:00"


def test_incremental_ingest_rerun_adds_nothing(spark, tmp_dir):
    landing, store, ck = f"{tmp_dir}/landing", f"{tmp_dir}/store", f"{tmp_dir}/ck"
    land(landing, "srcA/a.xml", RSS)
    incremental_ingest(spark, landing, store, ck)
    first = read_store(spark, store).orderBy("arrival_id").collect()
    assert [r.url for r in first] == ["https://a.example.com/p?b=1", "https://a.example.com/2"]
    assert first[0].title == "First & best"                                # first arrival wins
    land(landing, "srcB/b.xml", ATOM)
    land(landing, "srcA/a-again.xml", RSS)                                   # re-landed copy
    incremental_ingest(spark, landing, store, ck)
    again = read_store(spark, store).collect()
    assert len(again) == 4 and max(r.arrival_id for r in again) > max(r.arrival_id for r in first)
    counts = ingest_frame(FD.read_feed_files(spark, landing), store).collect()
    assert sum(r.inserted for r in counts) == 0
    assert sorted(r.arrival_id for r in again) == [0, 1, 2, 3]             # dense over batches


def test_dedup_key_mode(spark, tmp_dir):
    land(tmp_dir, "srcA/a.xml", RSS.replace("Dup of first", "First &amp; best").replace(
        "https://a.example.com/p?b=1</link></item>", "https://a.example.com/other</link><pubDate>Sun, 15 Feb 2026 08:00:00 GMT</pubDate></item>"))
    store = f"{tmp_dir}/store"
    counts = ingest_frame(FD.read_feed_files(spark, tmp_dir), store, mode="key").collect()
    assert sum(r.inserted for r in counts) == 2      # same title|domain|date -> one row


def test_html_links(spark):
    html = ('<nav><a href="/rel">Rel <b>link</b></a> <A HREF=\'http://x.org/abs#f\' class="article-link big">Abs &amp; co</A>'
            '<a href="">empty</a><a href="/x">  </a><a href="mailto:me@x">Mail</a><a class="other" href="/o">Other</a></nav>')
    pages = spark.createDataFrame([(1, "https://h.example.com/base/", html)], "page_id long, url string, html string")
    links = scan_html_links(pages).orderBy("link_ord").collect()
    assert [(r.href, r.title) for r in links][:2] == [("/rel", "Rel link"), ("http://x.org/abs#f", "Abs & co")]
    items = links_to_items(scan_html_links(pages), "pages").orderBy("entry_ord").collect()
    assert [i.url for i in items] == ["https://h.example.com/base/rel", "http://x.org/abs", "https://h.example.com/base/o"]
    sel = scan_html_links(pages, selector="a.article-link").collect()
    assert [r.title for r in sel] == ["Abs & co"]


def test_html_links_with_marks_in_attributes_and_without_ends(spark):
    html = ('<a href="/x" title="1>2">one</a><a href=/two title=it\'s>two <b>b</b><a\nhref=\'/3\' data-x="<a href=/no>">three</a> rest'
            '<abbr title="a">no anchor</abbr><a href="/4" title = "x > y">four<p>more</p></A ><a name="n"/><a href="/last">la<!-- </a> -->st')
    pages = spark.createDataFrame([(1, "https://h.example.com/", html), (2, "https://h.example.com/", "<p>none</p>"), (3, "u", None)],
                                  "page_id long, url string, html string")
    links = scan_html_links(pages).orderBy("link_ord").collect()
    assert [(r.page_id, r.link_ord, r.href, r.title) for r in links] == [
        (1, 0, "/x", "one"), (1, 1, "/two", "two b"), (1, 2, "/3", "three"), (1, 3, "/4", "four more"), (1, 4, "", ""), (1, 5, "/last", "la st")]


def test_html_links_of_large_pages(spark):
    html = "<a href='/a' " + "data-x='>' " * 20_000 + ">" + "<i>x</i>" * 50_000 + "</a>" + "<a>" * 50_000
    links = scan_html_links(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    assert links.count() == 50_001 and len(links.filter("link_ord = 0").first().title) == 99_999


def test_robots(spark):
    urls = spark.createDataFrame([("https://a.com/private/x",), ("https://a.com/private/ok",), ("https://a.com/pub",),
                                  ("https://b.com/anything",)], "url string")
    rules = rules_frame(spark, [("a.com", 0, True, "/private/ok"), ("a.com", 1, False, "/private")])
    got = {r.url: r.allowed for r in robots_allowed(urls, rules).collect()}
    assert got == {"https://a.com/private/x": False, "https://a.com/private/ok": True, "https://a.com/pub": True,
                   "https://b.com/anything": True}


def test_source_registry(spark):
    reg = FD.source_registry(spark).collect()
    assert len(reg) == 9 and reg[0].source_ord == 0 and reg[0].kind == "rss"


ROBOTS = {
    "a.com": "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: presswork\nDisallow: /tmp # comment\n",
    "b.com": "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /x/y\nDisallow: /x\n",
    "c.com": "# nothing for us\nUser-agent: Presswork-Bot\nUser-agent: googlebot\nDisallow:\n",
    "d.com": "Disallow: /ignored-no-agent\nUser-agent: *\n\nDisallow: /also-ignored\n",
    "e.com": "User-agent: *\nCrawl-delay: 5\nUser-agent: presswork\nDisallow: /slow\n",
    "f.com": "User-agent: *\nDisallow: /a%20b\nDisallow: /c+d\nDisallow: *\n",
}
PATHS = ["/", "/private", "/private/ok/1", "/tmp/x", "/x", "/x/y/z", "/slow", "/ignored-no-agent", "/also-ignored", "/z",
         "/a%20b/1", "/a b", "/c+d", "/c%2Bd", "/c d", "/q?x=1"]


def test_robots_txt_parsing_matches_stdlib(spark):
    from urllib.robotparser import RobotFileParser

    from presswork.operators.robots import rules_for_agent

    agent = "presswork/1.0 (+test)"
    bodies = spark.createDataFrame(list(ROBOTS.items()), "host string, body string")
    rules = rules_for_agent(bodies, agent)
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h in ROBOTS for p in PATHS], "url string")
    got = {r.url: r.allowed for r in robots_allowed(urls, rules).collect()}
    want = {}
    for h, body in ROBOTS.items():
        rp = RobotFileParser()
        rp.parse(body.splitlines())
        for p in PATHS:
            want[f"https://{h}{p}"] = rp.can_fetch(agent, f"https://{h}{p}")
    assert got == want


def test_stream_micro_batches_keep_arrival_order(spark, tmp_dir):
    landing, store, ck = f"{tmp_dir}/landing", f"{tmp_dir}/store", f"{tmp_dir}/ck"
    for i in range(3):
        body = RSS.replace("First  &amp; best", f"Copy {i}").replace("https://a.example.com/2", f"https://a.example.com/only-{i}")
        land(landing, f"src{i}/f.xml", body)
    incremental_ingest(spark, landing, store, ck, max_files_per_trigger=1)
    rows = read_store(spark, store).orderBy("arrival_id").collect()
    batches = sorted(state(spark, store).of("data"), key=lambda b: b.first_id)
    assert [(b.first_id, b.n) for b in batches] == [(0, 2), (2, 1), (3, 1)]    # one micro-batch per file
    shared = [r for r in rows if r.url == "https://a.example.com/p?b=1"]
    assert len(shared) == 1 and shared[0].arrival_id == 0
    assert len(rows) == 1 + 3                                  # the shared URL once + one unique URL per file


def test_missing_landing_folder_reads_as_empty(spark, tmp_dir):
    items, bad = FD.scan_feeds(spark, f"{tmp_dir}/nothing-landed-yet")
    assert items.count() == 0 and bad.count() == 0


NEWER = """<rss version="2.0" xmlns:content="c" xmlns:dc="d"><channel>
<item><title>Encoded</title><link>https://a.example.com/enc</link><dc:date>2026-02-15T10:00:00Z</dc:date>
<content:encoded><![CDATA[<p>whole text with </item> inside</p>]]></content:encoded></item>
<item><title>Two digits</title><link>https://a.example.com/yy</link><pubDate>Sun, 15 Feb 26 19:40:00 GMT</pubDate></item>
</channel></rss>"""
PREFIXED = """<atom:feed xmlns:atom="http://www.w3.org/2005/Atom"><atom:title>f</atom:title><atom:entry><atom:title>Pre</atom:title>
<atom:link href="https://p.example.com/1"/><atom:updated>2026-02-15T10:00:00Z</atom:updated><atom:summary>text</atom:summary></atom:entry></atom:feed>"""


def test_encoded_content_dc_date_cdata_two_digit_years_and_prefixes(spark, tmp_dir):
    land(tmp_dir, "s1/a.xml", NEWER)
    land(tmp_dir, "s2/b.xml", PREFIXED)
    items, bad = FD.scan_feeds(spark, tmp_dir)
    rows = {r.title: r for r in FD.items_to_articles(items).collect()}
    assert rows["Encoded"].content == "whole text with inside" and rows["Encoded"].published_at.isoformat() == "2026-02-15T10:00:00"
    assert rows["Two digits"].published_at.isoformat() == "2026-02-15T19:40:00"
    assert rows["Pre"].url == "https://p.example.com/1" and rows["Pre"].content == "text"
    assert bad.count() == 0


def test_malformed_entries_are_quarantined_alone(spark, tmp_dir):
    land(tmp_dir, "s/a.xml", RSS.replace("<title>Second</title>", "<title>Second</titel>"))
    items, bad = FD.scan_feeds(spark, tmp_dir)
    assert [(r.entry_ord, r.reason) for r in bad.collect()] == [(2, "malformed entry")] and items.count() == 3


RSS_ARCHIVE = """\n<?xml version="1.0"?><rss version="2.0"><channel><items><li/></items>%s</channel></rss>\n<rss><channel><item><title>next</title>
<link>https://e.example/n</link></item></channel></rss><rss><channel><item><title>cut</title><link>https://e.example/c"""


def archive_item(i):
    end = "</titel>" if i == 3 else "</title>"
    body = "<![CDATA[a </item> b]]>" if i == 4 else "x" * (i % 7)
    return f'<item rdf:about="u{i}"><title>t{i}{end}<link>https://e.example/{i}</link><description>{body}</description></item>\n'


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_archive_is_split_between_entries(spark, tmp_dir, split):
    n = 60
    land(f"{tmp_dir}/s", "big.xml", RSS_ARCHIVE % "".join(archive_item(i) for i in range(n)))
    land(f"{tmp_dir}/s", "empty.xml", "")
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = FD.read_feed_archive(spark, str(tmp_dir))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        rows = out.orderBy("file_path", "doc_ord", "entry_ord").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert [r.title for r in rows] == [None if i == 3 else f"t{i}" for i in range(n)] + ["next", None]
    assert {i: r.reason for i, r in enumerate(rows) if r.reason} == {3: "malformed entry", n + 1: "entry without an end"}
    assert rows[4].summary_raw.strip() == "a </item> b" and rows[5].source == "s"
    assert (len({r.doc_ord for r in rows}) > 3) == (split < 1000)


def test_archive_gives_what_whole_files_give(spark, tmp_dir):
    atom = "<atom:feed><atom:entry><atom:title>%s</atom:title><atom:link href='https://e.example/1'/></atom:entry></atom:feed>"
    land(f"{tmp_dir}/a", "1.xml", atom % "one" + atom % "two" + atom % "two")
    whole, _ = FD.scan_feeds(spark, str(tmp_dir))
    split = FD.read_feed_archive(spark, str(tmp_dir), "atom", prefix="atom").filter("reason IS NULL")
    cols = ["source", "kind", *FD.ITEM_COLUMNS]
    assert sorted(split.select(cols).collect(), key=str) == sorted(whole.select(cols).collect(), key=str)
    assert split.count() == 3
    assert FD.read_feed_archive(spark, f"{tmp_dir}/none").count() == 0
    with pytest.raises(ValueError):
        FD.read_feed_archive(spark, str(tmp_dir), "html")


def test_html_links_live_anchors_only(spark):
    html = ('<!-- <a href="/c">commented</a> --><script>var x = \'<a href="/s">script</a>\';</script><style><a href="/t">t</a></style>'
            '<a data-href="/wrong" href="/right">Right</a><a data-href="/none">No href</a><a data-class="x" class="y" href="/z">Z</a>')
    pages = spark.createDataFrame([(1, "https://h.example.com", html)], "page_id long, url string, html string")
    assert [(r.href, r.title) for r in scan_html_links(pages).orderBy("link_ord").collect()] == [("/right", "Right"), ("", "No href"), ("/z", "Z")]
    assert [r.title for r in scan_html_links(pages, selector="a.x").collect()] == []
    assert [r.title for r in scan_html_links(pages, selector="a.y").collect()] == ["Z"]


def test_robots_with_nulls_and_repeated_rows(spark):
    urls = spark.createDataFrame([(1, "https://a.com/private", None), (1, "https://a.com/private", None), (2, None, "x"), (None, "https://a.com/pub", None)],
                                 "id int, url string, _rules string")
    rules = rules_frame(spark, [("A.com", 0, False, "/private"), ("a.com", 1, True, "/"), ("a.com", 2, False, None)])
    got = robots_allowed(urls, rules)
    assert got.columns == ["id", "url", "_rules", "allowed"]
    assert sorted((str(r.id), r.allowed) for r in got.collect()) == [("1", False), ("1", False), ("2", True), ("None", True)]


def test_registry_order_robots_and_quarantine_in_one_ingest(spark, tmp_dir):
    from presswork.streaming.ingest import ingest_batch

    landing, store = f"{tmp_dir}/landing", f"{tmp_dir}/store"
    for name in ("Asecond", "Zfirst", "Unlisted", "Shut"):
        land(landing, f"{name}/f.xml", RSS.replace("First  &amp; best", f"From {name}").replace("/2<", f"/{name}<"))
    land(landing, "Zfirst/broken.xml", BROKEN)
    registry = spark.createDataFrame([("rss", "Zfirst", "https://z.com/feed", None, 0), ("rss", "Asecond", "https://a.com/feed", None, 1),
                                      ("rss", "Shut", "https://shut.com/feed", None, 2), ("html", "site", "https://h.com/", "a.news", 3)],
                                     "kind string, name string, url string, link_tag string, source_ord int")
    rules = rules_frame(spark, [("shut.com", 0, False, "/")])
    pages = spark.createDataFrame([("site", 2148, "https://h.com/", '<a class="news" href="/n">N</a><a href="/o">O</a>'),
                                   ("other", 2148, "https://o.com/", '<a href="/p">P</a>'), ("other", 3, "https://shut.com/x", '<a href="/q">Q</a>')],
                                  "source string, page_id long, url string, html string")
    done = ingest_batch(spark, store, FD.read_feed_files(spark, landing), pages, sources=registry, robots=rules)
    rows = read_store(spark, store).orderBy("arrival_id").collect()
    assert [(r.source, r.title) for r in rows] == [("Zfirst", "From Zfirst"), ("Zfirst", "Second"), ("Asecond", "Second"), ("Unlisted", "Second"),
                                                   ("site", "N"), ("other", "P")]
    assert {r.source: (r.items, r.inserted) for r in done.counts.collect()}["site"] == (1, 1)
    assert done.quarantined == 1
    again = ingest_batch(spark, store, FD.read_feed_files(spark, landing), pages, sources=registry, robots=rules)
    assert again.quarantined == 0 and sum(r.inserted for r in again.counts.collect()) == 0
    assert [r.reason for r in spark.read.parquet(f"{store}/_quarantine").collect()] == ["no feed document"]


def test_key_mode_keeps_urls_unique(spark, tmp_dir):
    from presswork.operators.dedup import new_articles

    rows = [("u1", "t1", "d", 0, 0), ("u1", "t2", "d", 0, 1), ("u2", "t1", "d", 0, 2), ("u3", "t3", "d", 0, 3)]
    df = spark.createDataFrame(rows, "url string, title string, domain string, source_ord int, entry_ord int").selectExpr(
        "*", "concat(title, '|', domain) AS dedupe_key")
    assert sorted(r.url for r in new_articles(df, None, "key").collect()) == ["u1", "u3"]
    store = df.filter("url = 'u3'")
    assert sorted(r.url for r in new_articles(df, store, "key").collect()) == ["u1"]


def test_many_batches_and_partitions_keep_ids_apart(spark, tmp_dir):
    from presswork.sources.store import assign_arrival_ids, next_arrival_id

    publish(spark, f"{tmp_dir}/s", entry("data", "data/x", first_id=40_000 * 5, next_id=40_000 * 5 + 5, n=5, seq=40_000))
    assert next_arrival_id(spark, f"{tmp_dir}/s") == 200_005
    assert next_arrival_id(spark, f"{tmp_dir}/none") == 0
    ids = [r.arrival_id for r in assign_arrival_ids(spark.range(500).repartition(40), 7, ["id"]).orderBy("id").collect()]
    assert ids == list(range(7, 507))


def test_checkpoint_folder_is_needed_on_a_cluster():

    from presswork.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
