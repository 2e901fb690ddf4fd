"""Literal cases for the column functions and rule operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from presswork import rules as R
from presswork.functions import dates as D
from presswork.functions import text as T
from presswork.functions import urls as U
from presswork.operators import enrich, report, trends


def val(spark, col, data="x string", rows=(("",),)):
    return [r[0] for r in spark.createDataFrame(list(rows), data).select(col.alias("out")).collect()]


def test_canonicalize_url(spark):
    got = val(spark, U.canonicalize_url(F.col("x")), rows=[("HTTPS://Ex.COM:80/a?b=2&utm_source=x&a=#f",),
                                                           ("http://h/p?q=a%20b&z=~*&k=%zz&UTM_SOURCE=1",),
                                                           ("example.com/x",)])
    assert got[0] == "https://ex.com:80/a?a=&b=2"
    # decode/encode round trip like urlencode: blanks -> '+', '~' kept, '*' escaped; case-sensitive tracking keys
    assert got[1] == "http://h/p?UTM_SOURCE=1&k=%25zz&q=a+b&z=~%2A"
    assert got[2] == "https:///example.com/x"


def test_get_domain_and_resolve(spark):
    assert val(spark, U.get_domain(F.col("x")), rows=[("https://www.Ex.com:8080/x",)]) == ["www.ex.com:8080"]
    got = spark.createDataFrame([("/q", "https://h/p/"), ("http://o/x", "https://h/"), ("rel", "https://h/")],
                                "href string, page string").select(U.resolve_link("href", "page")).collect()
    assert [r[0] for r in got] == ["https://h/p/q", "http://o/x", "rel"]


def test_strip_and_clean(spark):
    assert val(spark, T.strip_html(F.col("x")), rows=[("a<b>c</b>d",), (None,)]) == ["acd", ""]
    assert val(spark, T.clean_whitespace(F.col("x")), rows=[("  a\t\n b ",), (None,)]) == ["a b", ""]


def test_html_to_text(spark):
    got = val(spark, T.html_to_text(F.col("x")), rows=[
        ("<p>Tom &amp; Jerry&#;x27;s<br>show</p><script>var a='<p>';</script><!-- c -->",),
        ("&lt;b&gt;bold&lt;/b&gt; &copy; 2026",)])
    assert got == ["Tom & Jerry's show", "bold © 2026"]


def test_sentences_and_clamp(spark):
    got = val(spark, F.array_join(T.split_sentences(F.col("x")), "|"), rows=[("One.  Two! Three? four", ), ("v1.2 ok",), ("",)])
    assert got == ["One.|Two!|Three?|four", "v1.2 ok", ""]
    got = val(spark, T.clamp_lines(F.col("x"), 2), rows=[("a\n\n b \nc",), ("S1. S2. S3.",), ("",), (None,)])
    assert got == ["a\nb", "S1.\nS2.", "", ""]


def test_tokens(spark):
    got = val(spark, F.array_join(T.tokens_alnum(F.col("x"), 3), " "), rows=[("Año CVE-2024 ça va ÉTÉ x1",)])
    assert got == ["año cve-2024 été"]   # 'ç' is not a word letter; 'ÉTÉ' -> 'été' ('É' is)


def test_since():
    assert D.parse_since_hours("7d") == 168 and D.parse_since_hours(" 48H ") == 48
    with pytest.raises(ValueError):
        D.parse_since_hours("3w")


def test_since_column(spark):
    assert val(spark, D.since_hours_col(F.col("x")), rows=[("7d",), ("48 h",), ("3w",)]) == [168, 48, None]


def test_written_dates(spark):
    want = {"Jan 2, 2024 10:00": (2024, 1, 2, 10), "January 2 2024": (2024, 1, 2), "2024/01/02 10:00": (2024, 1, 2, 10), "2 January 2024": (2024, 1, 2),
            "20240102T100000Z": (2024, 1, 2, 10), "20240102": (2024, 1, 2), "Tue Jan  2 10:00:00 2024": (2024, 1, 2, 10), "Tue Jan  2 10:00:01 UTC 2024": (2024, 1, 2, 10, 0, 1),
            "Tuesday, January 2, 2024 at 3:04 PM": (2024, 1, 2, 15, 4), "Sep. 3, 2024 12:30 am EST": (2024, 9, 3, 0, 30), "2 Jan 2024, 12:00 PM": (2024, 1, 2, 12),
            "2024/1/2 10:00:30 +05:30": (2024, 1, 2, 10, 0, 30), " 3 Sept 2024 ": (2024, 9, 3),
            "01/02/2024": None, "Febtember 2, 2024": None, "Jan 32, 2024": None, "20241301": None, "2024/02/30": None, "Jan 2, 2024 25:00": None, "tomorrow": None, "2024": None}
    got = val(spark, D.parse_pub_ts(F.col("x")), rows=[(k,) for k in want])
    assert dict(zip(want, got)) == {k: v and dt.datetime(*v) for k, v in want.items()}


def test_dates(spark):
    rows = [("2026-02-15T19:40:00+05:30",), ("Sun, 15 Feb 2026 19:40:00 GMT",), ("15 February 2026 19:40",),
            ("2026-02-15",), ("garbage",), ("2026",), (None,)]
    wall = val(spark, D.parse_pub_ts(F.col("x")), rows=rows)
    assert wall[:4] == [dt.datetime(2026, 2, 15, 19, 40), dt.datetime(2026, 2, 15, 19, 40),
                        dt.datetime(2026, 2, 15, 19, 40), dt.datetime(2026, 2, 15)]
    assert wall[4:] == [None, None, None]
    utc = val(spark, D.parse_iso_utc(F.col("x")), rows=rows)
    assert utc[0] == dt.datetime(2026, 2, 15, 14, 10) and utc[1] is None and utc[3] == dt.datetime(2026, 2, 15)


def test_categorize_order_and_substring(spark):
    got = val(spark, enrich.categorize(F.col("x")), rows=[("Ransomware patch",), ("Operation",), ("Hello there",), (None,)])
    assert got == ["ransomware", "malware", "general", "general"]


def test_severity(spark):
    df = spark.createDataFrame([("critical breach",), ("exploited in the wild",), ("",)], "x string")
    got = df.select(enrich.severity_score("x").alias("s")).select("s", enrich.severity_label("s")).collect()
    assert [tuple(r) for r in got] == [(6, "alta"), (4, "media"), (0, "baja")]
    assert val(spark, enrich.severity_tier(F.col("x")), rows=[("a KEV update",), ("guide",), ("zzz",)]) == ["alta", "baja", "baja"]


def test_soc_action_and_guidance(spark):
    df = spark.createDataFrame([("cloud", "alta"), ("nope", "baja")], "c string, s string")
    got = df.select(enrich.soc_action_a("c", "s"), enrich.md_guidance("s", 2), enrich.severity_rank("s")).collect()
    assert got[0][0] == R.SOC_ACTIONS_A["cloud"] + R.SOC_SUFFIX_A["alta"]
    assert got[1][0] == R.SOC_ACTION_DEFAULT_A + R.SOC_SUFFIX_DEFAULT_A
    assert got[0][1].startswith("(ALTA)") and got[1][1].startswith("(BAJA)")
    assert (got[0][2], got[1][2]) == (3, 1)


def test_trend_token_order(spark):
    df = spark.createDataFrame([(1, "(rce (rce fix")], "o int, t string")
    md = trends.trend_terms(df, "t", ["o"], "md", 10).collect()
    rep = trends.trend_terms(df, "t", ["o"], "report", 10).collect()
    assert [(r.term, r.cnt) for r in md] == [("rce", 2)]
    assert rep == []


def test_window_null_date_and_counts(spark):
    df = spark.createDataFrame(
        [(1, None, None), (2, dt.datetime(2026, 2, 15, 10), "alta"), (3, dt.datetime(2026, 2, 10), "xyz"),
         (4, dt.datetime(2026, 2, 15, 11), "")],
        "arrival_id long, published_at timestamp_ntz, severity string")
    win = report.recent_window(df, dt.datetime(2026, 2, 15, 12), "24h")
    latest = report.latest_n(win, 25).collect()
    assert [r.arrival_id for r in latest] == [4, 2, 1]           # undated inside the window, sorted last
    c = report.severity_counts(df).collect()[0]
    assert (c.critica, c.alta, c.media, c.baja) == (0, 1, 0, 2)   # null and '' count as baja; 'xyz' nowhere


def test_limit_bounds(spark):
    df = spark.createDataFrame([(1, None)], "arrival_id long, published_at timestamp_ntz")
    with pytest.raises(ValueError):
        report.latest_n(df, 201)


def test_results_do_not_depend_on_session_time_zone(spark):
    rows = [("2026-02-15T19:40:00+05:30",), ("Sun, 15 Feb 2026 19:40:00 GMT",)]
    before = val(spark, F.struct(D.parse_pub_ts(F.col("x")), D.parse_iso_utc(F.col("x"))), rows=rows)
    start_before = spark.range(1).select(report.window_start(dt.datetime(2026, 2, 15, 20), "24h")).first()[0]
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        after = val(spark, F.struct(D.parse_pub_ts(F.col("x")), D.parse_iso_utc(F.col("x"))), rows=rows)
        start_after = spark.range(1).select(report.window_start(dt.datetime(2026, 2, 15, 20), "24h")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert before == after and start_before == start_after == dt.datetime(2026, 2, 14, 20)


def test_url_cleanup_like_python_parser(spark):
    from urllib.parse import urlparse

    raw = " \x01http://Ex.COM/a\tb\n?q=1"
    got = val(spark, F.struct(U.canonicalize_url(F.col("x")), U.get_domain(F.col("x"))), rows=[(raw,)])[0]
    assert got[0] == "http://ex.com/ab?q=1" and got[1] == urlparse(raw).netloc.lower() == "ex.com"


def test_canonical_urls_equal_the_standard_library(spark):
    import itertools
    from urllib.parse import parse_qsl, urlencode, urlparse, urlunparse

    from presswork.functions.urls import canonicalize_url
    from presswork.rules import TRACKING_PARAMS

    # (how a path without a leading slash and without a host is written back depends on the library's version)
    values = ["", "1", "a+b", "100%+free", "a%zzb%20c", "%", "%4", "%41%c3%a9", "é ü", "x=y", "~*-._"]
    heads = ["HTTPS://Ex.COM:80/p", "http://h/p;", "http://h/p;?", "http://h/a;b;", "//h/x", "https://h", "http://h/a%20b/C"]
    urls = [f"{h}?k={a}&{b}=2&utm_source=z&&c" for h, (a, b) in itertools.product(heads, zip(values, reversed(values)))]
    urls += heads + [h + "#frag" for h in heads] + ["https://h/?b=1&a=2&a=1", "https://h/?gclid=1"]

    def want(u):
        p = urlparse(u)
        q = sorted((k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if k not in TRACKING_PARAMS)
        return urlunparse(p._replace(scheme=p.scheme.lower() or "https", netloc=p.netloc.lower(), fragment="", query=urlencode(q)))

    got = {r.u: r.c for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", canonicalize_url("u").alias("c")).collect()}
    assert {u: got[u] for u in urls} == {u: want(u) for u in urls}


def test_entities_are_decoded_again_after_the_markup(spark):
    from presswork.functions.text import html_to_text

    cases = {"&amp;amp; x": "& x", "a &lt;b&gt; c": "a c", "&amp;lt;i&amp;gt;": "<i>", "&amp;eacute;": "é"}
    got = {r.s: r.t for r in spark.createDataFrame([(c,) for c in cases], "s string").select("s", html_to_text("s").alias("t")).collect()}
    assert got == cases


def test_two_digit_years(spark):
    from presswork.functions.dates import parse_wall_clock

    cases = {"Sun, 15 Feb 26 19:40:00 GMT": "2026-02-15 19:40:00", "15 Feb 69 01:02 +0000": "1969-02-15 01:02:00", "15 Feb 68 01:02": "2068-02-15 01:02:00",
             "15 Feb 2026 01:02": "2026-02-15 01:02:00", "15 Feb 126 01:02": None}
    got = {r.s: r.t for r in spark.createDataFrame([(c,) for c in cases], "s string").select("s", parse_wall_clock("s").cast("string").alias("t")).collect()}
    assert got == cases


def test_references_decoded_as_the_standard_library_does(spark):
    import html
    import html.entities as entities
    import random

    rng = random.Random(7)
    parts = [*"&#;xX0169aAmplgtnoq \t\n<>é😀", "&amp;", "&lt", "&gt;", "&#x41", "&not", "&notin;", "&#38;"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    rows += [f"a&{n}z;" for n in entities.html5] + [f"&#{n};" for n in [*range(0x180), *range(0xD7FE, 0xE002), 0xFDD0, 0xFEFF, 0xFFFE, 0x10FFFF, 0x110000]]
    rows += ["&#00000000065;", "&#xFFFFFFFFFFFFFFFFFFFF;", "&#99999999999", "&", "&&amp;amp;", ""]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, s string").select("i", T.html_unescape("s").alias("u")).collect()
    assert {r.i: r.u for r in got} == {i: html.unescape(s) for i, s in enumerate(rows)}


def test_texts_are_cleaned_in_the_jvm_and_once(spark):
    """No text goes to Python, and a nested text is not evaluated again for every use of it."""
    from presswork.operators.enrich import enrich_b

    df = spark.createDataFrame([(1, "t", "a &amp; b")], "arrival_id int, title string, content string")
    plan = enrich_b(df).select("arrival_id", "summary")._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
    assert plan.count("&#;x") <= 2
    assert enrich_b(df).first().summary == "a & b"
