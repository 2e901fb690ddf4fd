"""RSS 2.0 / Atom feed sources over landed feed files.

Files are read whole (feeds are small documents), split into feed
documents and entries with regular expressions (keeping document and
entry order, which is arrival order), and each entry is parsed with the
built-in ``from_xml`` under an explicit all-string schema. Documents that
do not parse are *quarantined* (returned as a separate frame) instead of
failing the job; well-formed documents in the same run still load.

Archives, files too large for one task, are read by :func:`read_feed_archive`, which splits them between entries.

Layout: ``<landing>/<source>/<file>`` or ``<landing>/source=<source>/<file>``;
the source name comes from the folder. A ``sources`` registry
(``name, url, source_ord``) gives the order in which sources arrive; sources
that it does not list come after those it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswork import rules as R
from presswork.functions.dates import parse_iso_utc, parse_pub_ts
from presswork.functions.text import clean_whitespace, strip_html, truncate
from presswork.functions.urls import canonicalize_url, dedupe_key, get_domain
from presswork.session import path_exists, scratch_path

DOC_RE = r"(?s)<(rss|(?:[A-Za-z][\w.-]*:)?feed|rdf:RDF)\b.*?</\1\s*>"
# an element's end tag inside CDATA does not end it
ITEM_RE = r"(?s)<item\b(?:[^<]++|<!\[CDATA\[.*?\]\]>|<(?!/item\s*>))*+</item\s*>"
ENTRY_RE = r"(?s)<entry\b(?:[^<]++|<!\[CDATA\[.*?\]\]>|<(?!/entry\s*>))*+</entry\s*>"
# the namespace prefix of a feed element, as in <atom:feed>
PREFIX_RE = r"^<([A-Za-z][\w.-]*):feed\b"

RSS_ITEM_SCHEMA = ("title string, link string, pubDate string, description string, guid string, "
                   "`content:encoded` string, `dc:date` string, _corrupt_record string")
ATOM_ENTRY_SCHEMA = ("title string, link array<struct<_href: string, _src: string>>, published string, "
                     "updated string, summary string, content string, id string, _corrupt_record string")
XML_OPTS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}

def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file_path, body)`` — one row per landed file (no rows when nothing has landed)."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "file_path string, body string")
    return (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("body")))


def source_from_path(file_path: Column) -> Column:
    """``.../source=<name>/...`` when present, else the parent folder name."""
    keyed = F.regexp_extract(file_path, r"/source=([^/]+)/", 1)
    parent = F.regexp_extract(file_path, r"/([^/]+)/[^/]+$", 1)
    return F.when(keyed != "", keyed).otherwise(parent)


def feed_documents(files: DataFrame) -> DataFrame:
    """``(source, file_path, doc_ord, kind, doc)`` — closed ``<rss>``/``<feed>`` documents in file order."""
    return _documents(files.select("file_path", F.posexplode(F.regexp_extract_all(F.col("body"), F.lit(DOC_RE), 0)).alias("doc_ord", "doc")))


def _documents(docs: DataFrame) -> DataFrame:
    """Documents with their source and kind, element prefixes taken off."""
    prefix = F.regexp_extract("doc", PREFIX_RE, 1)
    kind = F.when(F.col("doc").startswith("<feed") | (prefix != ""), F.lit("atom")).otherwise(F.lit("rss"))
    bare = F.regexp_replace(F.col("doc"), F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1"))
    rest = [c for c in docs.columns if c not in ("file_path", "doc_ord", "doc")]
    return docs.select(source_from_path(F.col("file_path")).alias("source"), "file_path",
                       F.col("doc_ord").cast("bigint").alias("doc_ord"), kind.alias("kind"),
                       F.when(prefix != "", bare).otherwise(F.col("doc")).alias("doc"), *rest)


def _entries(docs: DataFrame, kind: str, pattern: str, schema: str) -> DataFrame:
    d = docs.filter(F.col("kind") == kind)
    it = d.select("source", "file_path", "doc_ord", "kind",
                  F.posexplode(F.regexp_extract_all(F.col("doc"), F.lit(pattern), 0)).alias("entry_ord", "x"))
    return it.withColumn("r", F.from_xml(F.col("x"), schema, XML_OPTS)).withColumn("entry_ord", F.col("entry_ord").cast("bigint"))


def parse_feeds(files: DataFrame) -> DataFrame:
    """Every entry of every landed feed file, parsed once, loaded or quarantined.

    ``(source, file_path, doc_ord, entry_ord, kind, title, link, published_raw, updated_raw, summary_raw, content_raw, guid,
    reason, content_hash)``: rows without a ``reason`` are entries. A file without any closed feed document (e.g. a truncated
    download) is one row with a reason and no places; an entry that does not parse is a row with a reason.
    """
    # a file without documents goes on as a row without a document, so that files are read and entries parsed once
    cut = F.regexp_extract_all(F.col("body"), F.lit(DOC_RE), 0)
    docs = _documents(files.select("file_path", F.posexplode_outer(cut).alias("doc_ord", "doc"), F.xxhash64("body").alias("_file")))
    rss, none = F.col("kind") == "rss", F.col("doc").isNull()
    own = F.when(rss, F.regexp_extract_all("doc", F.lit(ITEM_RE), 0)).otherwise(F.regexp_extract_all("doc", F.lit(ENTRY_RE), 0))
    entries = docs.select("source", "file_path", "doc_ord", "kind", "_file", none.alias("_none"), F.posexplode_outer(F.when(~none, own)).alias("entry_ord", "x"))
    entries = entries.filter(F.col("_none") | F.col("x").isNotNull())
    parsed = entries.withColumns({"_rss": F.when(rss, F.from_xml("x", RSS_ITEM_SCHEMA, XML_OPTS)),
                                  "_atom": F.when(~rss, F.from_xml("x", ATOM_ENTRY_SCHEMA, XML_OPTS))})
    bad = F.coalesce("_rss._corrupt_record", "_atom._corrupt_record").isNotNull()
    atom = _atom_columns(F.col("_atom"))
    fields = [F.when(~bad & ~F.col("_none"), F.when(rss, c).otherwise(atom[n])).alias(n) for n, c in _rss_columns(F.col("_rss")).items()]
    return parsed.select(
        "source", "file_path", "doc_ord", F.col("entry_ord").cast("bigint").alias("entry_ord"), F.when(~F.col("_none"), F.col("kind")).alias("kind"), *fields,
        F.when(F.col("_none"), "no feed document").when(bad, "malformed entry").alias("reason"),
        F.when(F.col("_none"), F.col("_file")).when(bad, F.xxhash64("x")).alias("content_hash"))


def quarantine(files: DataFrame) -> DataFrame:
    """What could not be loaded: ``(file_path, doc_ord, entry_ord, reason, content_hash)``; see :func:`parse_feeds`."""
    return parse_feeds(files).filter("reason IS NOT NULL").select("file_path", "doc_ord", "entry_ord", "reason", "content_hash")


ITEM_COLUMNS = ["title", "link", "published_raw", "updated_raw", "summary_raw", "content_raw", "guid"]


def _rss_columns(r: Column) -> dict[str, Column]:
    return dict(zip(ITEM_COLUMNS, (r["title"], r["link"], r["pubDate"], r["dc:date"], r["description"], r["content:encoded"], r["guid"])))


def _atom_columns(r: Column) -> dict[str, Column]:
    first = F.try_element_at(r["link"], F.lit(1))
    link = F.coalesce(F.nullif(first["_href"], F.lit("")), first["_src"], F.lit(""))
    return dict(zip(ITEM_COLUMNS, (r["title"], link, r["published"], r["updated"], r["summary"], r["content"], r["id"])))


def _items(docs: DataFrame, kind: str, pattern: str, schema: str, columns) -> DataFrame:
    it = _entries(docs, kind, pattern, schema).filter(F.col("r._corrupt_record").isNull())
    return it.select("source", "file_path", "doc_ord", "entry_ord", "kind", *[c.alias(n) for n, c in columns(F.col("r")).items()])


def scan_rss(docs: DataFrame) -> DataFrame:
    """RSS ``<item>`` rows of well-formed RSS documents, in entry order: ``pubDate`` (else ``dc:date``),
    ``description`` (else ``content:encoded``)."""
    return _items(docs, "rss", ITEM_RE, RSS_ITEM_SCHEMA, _rss_columns)


def scan_atom(docs: DataFrame) -> DataFrame:
    """Atom ``<entry>`` rows: first link's href (else src), published else updated, summary else content."""
    return _items(docs, "atom", ENTRY_RE, ATOM_ENTRY_SCHEMA, _atom_columns)


def read_feed_archive(spark: SparkSession, path: str, kind: str = "rss", prefix: str = "") -> DataFrame:
    """Entries of feed files of any size, each parsed once, loaded or quarantined; the columns of :func:`parse_feeds`.

    Files are split by bytes like any text: a record runs from one ``<item`` (``<entry`` of Atom) to the next, so that a
    file of many gigabytes is read by many tasks, each of which holds one entry at a time. ``doc_ord`` is the byte where an
    entry's split begins and ``entry_ord`` rises within it, so that :data:`ARRIVAL_ORDER` is the order of the file.
    ``kind``: ``rss`` or ``atom``; ``prefix``: that of the element names, as ``atom`` in ``<atom:entry>``.

    What lies before the first entry and after an entry's end tag is no entry and not looked at; the feed document around
    the entries need not be closed. An entry without its end tag (a cut file, or an opening tag inside its text) and one
    that is not well-formed are rows with a ``reason``. Empty files give no rows, nor does a path with nothing landed;
    repeated entries stay.
    """
    if kind not in ("rss", "atom"):
        raise ValueError(f"unknown feed kind {kind!r}; expected 'rss' or 'atom'")
    rss = kind == "rss"
    mark = f"{prefix}:" if prefix else ""
    opening = f"<{mark}{'item' if rss else 'entry'}"
    if path_exists(spark, path):
        records = spark.read.option("recursiveFileLookup", "true").option("lineSep", opening).text(path)
        records = records.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("doc_ord"), "value")
    else:
        records = spark.createDataFrame([], "file_path string, doc_ord bigint, value string")
    # the rest of an opening tag; other names that begin alike (<items>) go on with a letter
    records = records.withColumn("entry_ord", F.monotonically_increasing_id()).filter(F.col("value").rlike(r"^(\s[^<>]*)?>"))
    bare = F.concat(F.lit(opening), F.col("value"))
    if prefix:
        bare = F.regexp_replace(bare, f"(</?){prefix}:", "$1")
    x = F.nullif(F.regexp_extract(bare, "^" + (ITEM_RE if rss else ENTRY_RE), 0), F.lit(""))
    parsed = records.select("file_path", "doc_ord", "entry_ord", "value", x.alias("x"))
    parsed = parsed.withColumn("r", F.from_xml("x", RSS_ITEM_SCHEMA if rss else ATOM_ENTRY_SCHEMA, XML_OPTS))
    r = F.col("r")
    reason = F.when(F.col("x").isNull(), "entry without an end").when(r["_corrupt_record"].isNotNull(), "malformed entry")
    fields = (_rss_columns if rss else _atom_columns)(r)
    return parsed.select(
        source_from_path(F.col("file_path")).alias("source"), "file_path", "doc_ord", "entry_ord", F.lit(kind).alias("kind"),
        *[F.when(reason.isNull(), c).alias(n) for n, c in fields.items()], reason.alias("reason"),
        F.when(reason.isNotNull(), F.xxhash64("value")).alias("content_hash"))


def scan_feeds(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(items, quarantined)`` for every landed feed file under ``path``, from one parse that is kept."""
    parsed = parse_feeds(read_feed_files(spark, path))
    where = scratch_path(spark, "parsed-feeds")
    parsed.write.parquet(where)
    parsed = spark.read.schema(parsed.schema).parquet(where)
    items = parsed.filter("reason IS NULL").drop("reason", "content_hash")
    return items, parsed.filter("reason IS NOT NULL").select("file_path", "doc_ord", "entry_ord", "reason", "content_hash")


def entry_content(summary_raw, content_raw) -> Column:
    """Summary if non-empty, else the content value, else ''."""
    return F.coalesce(F.nullif(F.col(summary_raw) if isinstance(summary_raw, str) else summary_raw, F.lit("")),
                      F.col(content_raw) if isinstance(content_raw, str) else content_raw, F.lit(""))


def source_registry(spark: SparkSession, sources: list[tuple[str, str, str]] = R.DEFAULT_SOURCES) -> DataFrame:
    """Configured sources ``(kind, name, url, link_tag, source_ord)`` in list order."""
    rows = [(k, n, u, "a" if k == "html" else None, i) for i, (k, n, u) in enumerate(sources)]
    return spark.createDataFrame(rows, "kind string, name string, url string, link_tag string, source_ord int")


def items_to_articles(items: DataFrame, sources: DataFrame | None = None, dates: str = "wall_clock", beside: tuple[str, ...] = ()) -> DataFrame:
    """Feed items -> article rows (live ingest rules).

    Drops entries with empty title or link; canonical URL and its domain;
    publication time (``wall_clock``: zone dropped; ``utc``: ISO converted to
    UTC); key from the full cleaned title; content = tags stripped, cleaned,
    cut at 8000 ('' -> NULL). Arrival order: :data:`ARRIVAL_ORDER`.

    ``beside``: further columns of ``items`` that go along; rows with a value in the first of them (quarantined ones with
    their reason) are kept without a title or link too.
    """
    x = items.withColumn("title", clean_whitespace(F.col("title"))).withColumn("link", F.trim(F.coalesce("link", F.lit(""))))
    required = (F.col("title") != "") & (F.col("link") != "")
    x = x.filter(required | F.col(beside[0]).isNotNull() if beside else required)
    if sources is not None:
        # no forced broadcast: AQE broadcasts the registry when its runtime size is
        # under the threshold (a handful of configured sources) and shuffles otherwise
        reg = sources.groupBy(F.col("name").alias("_name")).agg(F.min("source_ord").alias("source_ord"))
        x = x.join(reg, F.col("source") == F.col("_name"), "left").drop("_name")
    else:
        x = x.withColumn("source_ord", F.lit(None).cast("int"))
    x = x.withColumn("listed", F.col("source_ord").isNull().cast("int"))
    if dates == "wall_clock":
        pub = parse_pub_ts(F.col("published_raw"), F.col("updated_raw"))
    elif dates == "utc":
        pub = F.coalesce(parse_iso_utc(F.col("published_raw")), parse_iso_utc(F.col("updated_raw")))
    else:
        raise ValueError(f"unknown date mode {dates!r}")
    content = truncate(clean_whitespace(strip_html(entry_content("summary_raw", "content_raw"))), R.CONTENT_MAX)
    x = (x.withColumn("url", canonicalize_url(F.col("link")))
         .withColumn("domain", get_domain(F.col("url")))
         .withColumn("published_at", pub))
    return x.select(
        "source", "domain", truncate(F.col("title"), R.TITLE_MAX).alias("title"), "url",
        F.lit(None).cast("string").alias("canonical_url"), "published_at",
        F.nullif(content, F.lit("")).alias("content"),
        F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("soc_action"),
        dedupe_key(F.col("title"), F.col("domain"), F.col("published_at")).alias("dedupe_key"),
        "listed", F.col("source_ord").cast("int").alias("source_ord"), "file_path", "doc_ord", "entry_ord", "guid", *beside,
    )


#: Arrival order: listed sources (0) before others (1), the registry's order, then files, documents and entries.
ARRIVAL_ORDER = ["listed", "source_ord", "file_path", "doc_ord", "entry_ord"]


# ---------------------------------------------------------------------------
# rendering feeds from a frame (used to land derived feeds for checks/demos)
# ---------------------------------------------------------------------------

def render_rss_feeds(articles: DataFrame, chunk: int = 2000) -> DataFrame:
    """``(source, chunk_id, xml)``: one RSS document per source and span of ``chunk``
    arrival ids (so at most ``chunk`` items), items in ``arrival_id`` order. Groups are
    bounded by the span, never by a source's size."""
    item = F.to_xml(F.struct(
        F.col("title").alias("title"), F.col("url").alias("link"),
        F.when(F.col("published_at").isNotNull(),
               F.concat(F.date_format("published_at", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000"))).alias("pubDate"),
        F.col("content").alias("description"), F.col("arrival_id").cast("string").alias("guid")), {"rowTag": "item"})
    return _bundle(articles, item, chunk,
                   lambda src: F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>'),
                                        src, F.lit("</title>")),
                   F.lit("</channel></rss>"))


def render_atom_feeds(articles: DataFrame, chunk: int = 2000) -> DataFrame:
    """Atom documents (default namespace) with ISO dates carrying a +05:30 offset."""
    entry = F.to_xml(F.struct(
        F.col("title").alias("title"),
        F.struct(F.col("url").alias("_href")).alias("link"),
        F.when(F.col("published_at").isNotNull(),
               F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))).alias("updated"),
        # undated entries carry their text as <content> instead of <summary>
        F.when(F.col("published_at").isNotNull(), F.col("content")).alias("summary"),
        F.when(F.col("published_at").isNull(), F.col("content")).alias("content"),
        F.col("arrival_id").cast("string").alias("id")), {"rowTag": "entry"})
    return _bundle(articles, entry, chunk,
                   lambda src: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>'), src, F.lit("</title>")),
                   F.lit("</feed>"))


def _bundle(articles: DataFrame, element: Column, chunk: int, head, tail: Column) -> DataFrame:
    x = articles.select("source", "arrival_id", element.alias("_x"))
    x = x.withColumn("chunk_id", F.floor(F.col("arrival_id") / F.lit(chunk)).cast("bigint"))
    g = x.groupBy("source", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("arrival_id", "_x"))).alias("_items"))
    body = F.array_join(F.transform(F.col("_items"), lambda e: e["_x"]), "")
    return g.select("source", "chunk_id", F.concat(head(F.col("source")), body, tail).alias("xml"))


def land_feeds(feeds: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Write rendered feeds as ``<path>/source=<name>/chunk=<zero-padded>/part-*`` files, below a folder for each value
    of the columns ``by``.

    One bounded feed document per folder; path order = (source, chunk) order,
    i.e. landing (arrival) order.
    """
    (feeds.withColumn("chunk", F.lpad(F.col("chunk_id").cast("string"), 12, "0"))
     .select(*by, "source", "chunk", "xml").write.mode("append").partitionBy(*by, "source", "chunk").text(path))
