"""Main text of web pages by wrappers that are inferred from the pages of a host.

A page's token stream (start tags, end tags, text) is read into levels, one per open element. The wrapper of a host is a
union-free regular expression per level, a sequence of

    kind      one child element of that kind, or a text slot
    kind?     an optional one
    (kind)+   a repeated one
    (a? b?)+  a repeated group of optional members

found by aligning the pages' streams one after the other: a kind that a stream repeats, or has in another order, makes
the stretch between its places a repeated group; a kind that one side lacks becomes optional; texts that differ turn a
constant into a slot. Aligning is associative enough to be done in any order, so a task first folds the pages of a host
that it meets into one wrapper; these are then aligned in groups of at most ``FAN_IN`` until each host has one. No task
ever holds a host's pages, and a wrapper's size depends on how many kinds of elements there are, not on pages.

A wrapper's slots are then labelled, with the lengths and link shares that were summed up over all pages of the host:
slots inside menus, headers, footers, sidebars, notices, adverts, forms, scripts and reader comments (by element, role
and class) go. A page's main region is, of the article and main elements that it has, the one with the most text (by
the means of the host), or without such an element the smallest one with most of the text; outside article and main
elements, constants in plain boxes and slots that consist of links go too. Pages are read again and the text in kept
slots is their main text. Class and id words that only one page of a host has do not tell kinds apart, so that slugs
neither hide a region nor make the wrapper grow with the pages.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import written

BATCH_BYTES = 4 << 20
FAN_IN = 32
#: Elements that are deeper count to the level of this depth.
MAX_DEPTH = 60
#: A constant is a text that all pages with the slot have, on at least so many different pages and most of the host's.
MIN_CONSTANT_PAGES = 3
#: Share of a page's text that the region of a page without article or main element must hold.
REGION_SHARE = 0.7

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup "
                   "time tt u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
IMPLIED_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
               "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = frozenset("table ul ol dl article main section div body".split())
# Which elements, roles and class or id words are not part of the main text.
NOT_MAIN_TAGS = frozenset("head title nav header footer aside form script style noscript template iframe object svg canvas select button "
                          "textarea dialog menu noembed noframes xmp datalist audio video map".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status "
                           "tablist".split())
NOT_MAIN_WORDS = frozenset("nav navbar navigation menu submenu header masthead footer sidebar aside ad ads advert adverts advertisement "
                           "advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification "
                           "alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments commentlist "
                           "reply replies respond disqus related recommended recommendations breadcrumb breadcrumbs pagination pager widget "
                           "toolbar login search skip tags byline-share outbrain taboola".split())
MAIN_WORDS = frozenset("content article post main body entry story text".split())
REGION_ROLES = frozenset(["main", "article"])

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
                   r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
TEXT = "#text"


def _attribute_words(attributes: str) -> tuple[dict, list[str]]:
    """Attributes that decide on a kind, and the class and id words, id last."""
    found = {}
    for m in ATTRIBUTE.finditer(attributes):
        k = m[1].lower()
        if k in ("class", "id", "role", "itemprop") and k not in found:
            found[k] = html_lib.unescape(m[2] or m[3] or m[4] or "").lower()
    words = [*found.get("class", "").split(), *(["#" + found["id"].strip()] if found.get("id", "").strip() else [])]
    return found, [DIGITS.sub("0", w.replace("/", "_").replace("@", "_")) for w in words]


def _deciding(word: str) -> list[str]:
    """The parts of a class or id word that tell main text apart."""
    return [w for w in re.split(r"[^a-z]+", word) if w in NOT_MAIN_WORDS or w in MAIN_WORDS or w.startswith("comment")]


def kind_of(name: str, attributes: str, shared: set | None = None) -> str:
    """An element's kind: its name, with role, id and class words where it has them; numbers in them do not count.

    Words that tell main text apart come first and all count, of others as many as make four. Of words that are not in
    ``shared``, those that only one page of the host has, only the parts that tell main text apart count.
    """
    if "=" not in attributes:
        return name
    found, words = _attribute_words(attributes)
    out = name
    if found.get("role"):
        out += "@" + found["role"].split()[0] if found["role"].split() else ""
    if found.get("itemprop") == "articlebody":
        out += "@article"
    first, others = [], []
    for w in words:
        parts = _deciding(w)
        if shared is not None and w not in shared:
            w = "-".join(dict.fromkeys(parts))
        if w:
            (first if parts else others).append(w)
    for w in [*dict.fromkeys(first), *others[: max(0, 4 - len(first))]]:
        out += "." + w
    return out


def _name(kind: str) -> str:
    return re.split(r"[@.]", kind, maxsplit=1)[0]


def tokens(page: str, shared: set | None = None):
    """The page as (path, block, text, in_link) per piece of text, and by path the child kinds of each element there.

    A path is a tuple of kinds. Inline elements without role, id or class open no level. Equal block numbers mean that
    no block border lies between two texts.
    """
    texts, levels = [], {(): [[]]}
    stack: list[tuple[str, str, bool]] = []  # (name, kind, opens a level)
    path: tuple[str, ...] = ()
    block, at, links = 0, 0, 0

    def add(raw):
        if raw and not raw.isspace():
            texts.append((path, block, html_lib.unescape(raw), links > 0))
            levels[path][-1].append(TEXT)
        elif raw:
            texts.append((path, block, " ", links > 0))

    def pop():
        nonlocal path, links
        name, _, level = stack.pop()
        if level:
            path = path[:-1]
        if name == "a":
            links -= 1

    n = len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at: m.start()])
        at = m.end()
        close, name, attributes, end = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not name or not end:
            continue  # a comment, or a tag that the page's end cuts off
        name = name.lower()
        if close:
            if name in ("p", "br"):
                block += 1
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name not in INLINE:
                        block += 1
                    while len(stack) > depth:
                        pop()
                    break
                if name in INLINE and stack[depth][0] not in INLINE:
                    break  # an inline end tag closes nothing outside its block
            continue
        if name in VOID:
            if name in ("br", "hr"):
                block += 1
            continue
        if name in CLOSES_P:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth][0] not in INLINE:
                    break
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in IMPLIED_END.get(name, ()):
                while len(stack) > depth:
                    pop()
                break
            if stack[depth][0] in SCOPES:
                break
        if name not in INLINE:
            block += 1
        kind = kind_of(name, attributes, shared)
        level = (kind != name or name not in INLINE) and len(path) < MAX_DEPTH
        if level:
            levels[path][-1].append(kind)
            path = (*path, kind)
            levels.setdefault(path, []).append([])
        if attributes.rstrip().endswith("/") and name not in INLINE and name in ("svg", "path", "use"):
            if level:
                path = path[:-1]
            continue
        stack.append((name, kind, level))
        if name == "a":
            links += 1
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = stop.start() if stop else n
    return texts, levels


# A level of a wrapper is a list of [kinds, repeated, optional]. A wrapper is {path: {"seq": level}}, and at a path
# that has text also "text": [pages, characters, characters in links, constant or None, smallest hashes of pages].


def level_of(kinds: list[str]) -> list:
    """The expression of one stream's level."""
    out: list = []
    where: dict[str, int] = {}
    for k in kinds:
        at = where.get(k)
        if at is None:
            where[k] = len(out)
            out.append([[k], False, False])
        else:
            _join(out, at, len(out) - 1)
            for kk in out[at][0]:
                where[kk] = at
    return out


def _join(level: list, a: int, b: int) -> None:
    """Make the items a..b one repeated group."""
    kinds = list(dict.fromkeys(k for item in level[a: b + 1] for k in item[0]))
    optional = all(item[2] for item in level[a: b + 1])
    level[a: b + 1] = [[kinds, True, optional]]


def align_levels(a: list, b: list) -> list:
    """The expression that covers both."""
    out = [[list(k), r, o] for k, r, o in a]
    hit = [False] * len(out)
    last = -1
    for kinds, repeated, optional in b:
        places = [i for i, item in enumerate(out) if not set(item[0]).isdisjoint(kinds)]
        if not places:
            last += 1
            out.insert(last, [list(kinds), repeated, True])
            hit.insert(last, True)
            continue
        lo, hi = places[0], places[-1]
        if lo <= last:  # met before, or in another order: a repeated group
            hi = max(hi, last)
        if hi > lo:
            _join(out, lo, hi)
            hit[lo: hi + 1] = [True]
            out[lo][1] = True
        item = out[lo]
        item[0] += [k for k in kinds if k not in item[0]]
        item[1] = item[1] or repeated or len(item[0]) > 1
        item[2] = item[2] or optional
        hit[lo] = True
        last = lo
    for i, h in enumerate(hit):
        if not h:
            out[i][2] = True
    return out


def _page_hash(page: str) -> int:
    return int.from_bytes(hashlib.blake2b(page.encode("utf-8", "surrogatepass"), digest_size=6).digest(), "little")


def page_wrapper(page: str, shared: set | None = None) -> dict:
    texts, levels = tokens(page, shared)
    out = {}
    for p, elements in levels.items():
        seqs = [level_of(list(x)) for x in dict.fromkeys(map(tuple, elements))]
        for own in seqs[1:]:
            seqs[0] = align_levels(seqs[0], own)
        out[p] = {"seq": seqs[0]}
    sums: dict = {}
    for path, _, text, link in texts:
        t = SPACE.sub(" ", text).strip()
        if t:
            sums.setdefault(path, []).append((t, link))
    out.setdefault((), {"seq": []})["pages"] = 1
    for path, own in sums.items():
        chars = sum(len(t) for t, _ in own)
        whole = " ".join(t for t, _ in own)
        same = hashlib.blake2b(whole.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        out[path]["text"] = [1, chars, sum(len(t) for t, link in own if link), same]
    return out


def align(a: dict, b: dict) -> dict:
    """The wrapper of the pages of both; ``a`` is changed."""
    for path, node in b.items():
        own = a.get(path)
        if own is None:
            a[path] = node
            continue
        if own["seq"] != node["seq"]:
            own["seq"] = align_levels(own["seq"], node["seq"])
        if "pages" in node:
            own["pages"] = own.get("pages", 0) + node["pages"]
        if "text" in node:
            if "text" in own:
                x, y = own["text"], node["text"]
                own["text"] = [x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else None]
            else:
                own["text"] = node["text"]
    return a


def dumps(wrapper: dict) -> str:
    nodes = [[list(p), n["seq"], n.get("text"), n.get("pages")] for p, n in sorted(wrapper.items())]
    return json.dumps(nodes, ensure_ascii=False, separators=(",", ":"))


def loads(data: str) -> dict:
    out = {}
    for path, seq, text, pages in json.loads(data):
        out[tuple(path)] = {"seq": seq} | ({"text": text} if text else {}) | ({"pages": pages} if pages else {})
    return out


def expression(wrapper: dict, path: tuple = ()) -> str:
    """The wrapper as a regular expression over tokens, for people to read."""
    parts = []
    for kinds, repeated, optional in wrapper[path]["seq"]:
        own = []
        for k in kinds:
            own.append("TEXT" if k == TEXT else f"<{k}> {expression(wrapper, (*path, k))} </{_name(k)}>".replace("  ", " "))
        if len(own) > 1:
            parts.append("(" + " ".join(f"({x})?" for x in own) + ")+")
        elif repeated:
            parts.append(f"({own[0]})" + ("*" if optional else "+"))
        else:
            parts.append(f"({own[0]})?" if optional else own[0])
    return " ".join(parts)


def not_main(kind: str) -> bool:
    name = _name(kind)
    if name in NOT_MAIN_TAGS:
        return True
    if name in ("html", "body", "main", "article"):
        return any(w in ("comment", "comments") for w in _words(kind))
    if any(r in NOT_MAIN_ROLES for r in kind.split(".")[0].split("@")[1:]):
        return True
    words = _words(kind)
    return any(w in NOT_MAIN_WORDS for w in words) and (not any(w in MAIN_WORDS for w in words) or any(w.startswith("comment") for w in words))


def _words(kind: str) -> list[str]:
    return [w for part in kind.split(".")[1:] for w in re.split(r"[^a-z]+", part) if w]


def _is_region(kind: str) -> bool:
    return _name(kind) in ("article", "main") or any(r in REGION_ROLES for r in kind.split(".")[0].split("@")[1:])


def _shut(path: tuple) -> bool:
    """Whether a slot lies in something that is not main text; headings in an article's own header stay."""
    for i, k in enumerate(path):
        if not_main(k):
            if _name(k) == "header" and any(_is_region(x) for x in path[:i]) and any(_name(x) in HEADINGS for x in path[i:]):
                continue
            return True
    return False


def open_slots(wrapper: dict) -> dict[tuple, tuple]:
    """By path of the slots outside what is not main text: mean weight on the pages that have it, paths of the regions
    it lies in, the sums, whether most of the host's pages have it."""
    out = {}
    pages = wrapper.get((), {}).get("pages", 0)
    for p, n in wrapper.items():
        if "text" in n and not _shut(p):
            t = n["text"]
            out[p] = (max(0, t[1] - 2 * t[2]) / t[0], [p[: i + 1] for i, k in enumerate(p) if _is_region(k)], t,
                      t[0] >= MIN_CONSTANT_PAGES and 2 * t[0] > pages)
    return out


def _below(p: tuple, root: tuple) -> bool:
    return p[: len(root)] == root


def _region_roots(own: dict[tuple, tuple]) -> list[tuple]:
    """The innermost regions with about as much text as the largest; all outermost ones if these hold less than half."""
    regions: dict[tuple, float] = {}
    for w, above, *_ in own.values():
        for r in above:
            regions[r] = regions.get(r, 0) + w
    most = max(regions.values(), default=0)
    whole = sum(x[0] for x in own.values())
    outer = [r for r in regions if not any(x != r and _below(r, x) for x in regions)]
    held = sum(regions[r] for r in outer)
    if not most or held < (1 - REGION_SHARE) * whole:
        return []
    large = [r for r, w in regions.items() if w >= REGION_SHARE * most]
    roots = [r for r in large if not any(x != r and _below(x, r) for x in large)]
    return roots if 2 * sum(regions[r] for r in roots) >= held else outer


def _block_root(own: dict[tuple, tuple]) -> tuple:
    """The smallest element with most of the text."""
    root, whole = (), sum(x[0] for x in own.values())
    while whole:
        below: dict[tuple, float] = {}
        for p, (w, *_) in own.items():
            if len(p) > len(root) and _below(p, root):
                below[p[: len(root) + 1]] = below.get(p[: len(root) + 1], 0) + w
        best = max(below.items(), key=lambda x: x[1], default=None)
        if best is None or best[1] < REGION_SHARE * whole or _name(best[0][-1]) in HEADINGS or _name(best[0][-1]) in ("p", "pre", "blockquote"):
            break
        root = best[0]
    return root


def kept_slots(wrapper: dict, paths=None, slots: dict | None = None) -> set[tuple]:
    """Paths of the slots that hold main text, of a page with text at ``paths`` or of all pages.

    The region is chosen among those that the page has, by the mean text of its slots over all pages of the host.
    """
    slots = open_slots(wrapper) if slots is None else slots
    own = slots if paths is None else {p: slots[p] for p in paths if p in slots}
    # what most pages repeat word for word does not tell where the text is, unless it is an article's
    firm = {p: x for p, x in own.items() if x[1] or x[2][3] is None or not x[3]} or own
    roots = _region_roots(firm) or [_block_root(firm)]
    inside = {p: x for p, x in own.items() if any(_below(p, r) for r in roots)}
    prose = lambda p, r: any(_name(k) in HEADINGS or _name(k) in ("p", "pre", "blockquote", "td", "dd", "figcaption") for k in p[len(r):])
    varied = any(x[2][3] is None for x in inside.values())
    out = set()
    for p, (_, above, t, common) in inside.items():
        root = next(r for r in roots if _below(p, r))
        constant = varied and t[3] is not None and common and p != root
        links = 2 * t[2] > t[1]
        # an article or main element is its author's, lists of links and all
        if above or prose(p, root) or not (constant or links):
            out.add(p)
    return out


def main_text(page: str, kept: set[tuple]) -> str:
    """The text in kept slots: white space inside a block as one space, blocks joined by line ends."""
    return _joined(tokens(page)[0], kept)


def _joined(texts: list, kept: set[tuple]) -> str:
    blocks: dict[int, list[str]] = {}
    for path, block, text, _ in texts:
        if path in kept:
            blocks.setdefault(block, []).append(text)
    lines = (SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def page_words(page: str) -> set[str]:
    """Class and id words of a page's tags."""
    seen = {m[3] if m[2] else m[7] for m in TOKEN.finditer(page) if m[2] and not m[1] or m[6] and not m[5]}
    return {w for attributes in seen if "=" in attributes for w in _attribute_words(attributes)[1]}


def _fold_words(batches):
    for batch in batches:
        found: dict[tuple, list] = {}
        for host, page in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist()):
            if page:
                h = _page_hash(page)
                for w in page_words(page):
                    x = found.setdefault((host, w), [h, h])
                    x[0], x[1] = min(x[0], h), max(x[1], h)
        yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in found], pa.string()), "word": pa.array([k[1] for k in found], pa.string()),
                                          "lo": pa.array([x[0] for x in found.values()], pa.int64()), "hi": pa.array([x[1] for x in found.values()], pa.int64())})


def shared_words(pages: DataFrame) -> DataFrame:
    """(whost, shared) of the hosts in ``pages`` (_host, _html): class and id words that two different pages have."""
    words = pages.mapInArrow(_fold_words, "host string, word string, lo long, hi long")
    words = words.groupBy("host", "word").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi")
    return written(words.groupBy(F.col("host").alias("whost")).agg(F.array_sort(F.collect_list("word")).alias("shared")), "html-words")


class _Known:
    """Word sets by host, made once for a host in a task."""

    def __init__(self):
        self.sets: dict[str, frozenset] = {}

    def of(self, host: str, words) -> frozenset:
        if host not in self.sets:
            if len(self.sets) > 1000:
                self.sets.clear()
            self.sets[host] = frozenset(words.as_py() or ())
        return self.sets[host]


def _fold_pages(batches):
    known = _Known()
    for batch in batches:
        hosts: dict[str, dict] = {}
        for host, page, words in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist(), batch.column("shared")):
            if page:
                w = page_wrapper(page, known.of(host, words))
                hosts[host] = align(hosts[host], w) if host in hosts else w
        yield pa.RecordBatch.from_pydict({"host": pa.array(list(hosts), pa.string()), "wrapper": pa.array([dumps(w) for w in hosts.values()], pa.string())})


def _fold_wrappers(pdf):
    pdf = pdf.sort_values("wrapper")
    out = None
    for data in pdf["wrapper"]:
        out = loads(data) if out is None else align(out, loads(data))
    pdf = pdf.iloc[:1].copy()
    pdf["wrapper"] = [dumps(out)]
    return pdf[["host", "wrapper"]]


def different(pages: DataFrame) -> DataFrame:
    """One row for each page of a host, however many copies ``pages`` (_host, _html, shared) has: what is counted and summed
    for a slot is over different pages. Copies are told by 128 bits of hashes and reduced where they are read."""
    marks = [F.xxhash64("_html").alias("_h1"), F.xxhash64(F.lit(1), "_html").alias("_h2")]
    return pages.select("*", *marks).dropDuplicates(["_host", "_h1", "_h2"]).drop("_h1", "_h2")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of the hosts in ``pages`` (_host, _html, shared), each row a page."""
    parts = written(pages.mapInArrow(_fold_pages, "host string, wrapper string"), "html-wrappers")
    while True:
        most = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        n = most.agg(F.max("n")).first()[0] or 0
        if n <= 1:
            return parts
        # groups of about FAN_IN wrappers; a host with few has one group
        groups = -(-n // FAN_IN)
        sized = parts.join(most, "host")
        group = F.pmod(F.xxhash64("wrapper"), F.least(F.lit(groups).cast("long"), F.ceil(F.col("n") / FAN_IN)))
        parts = written(sized.select("host", "wrapper", group.alias("g")).groupBy("host", "g").applyInPandas(_fold_wrappers, "host string, wrapper string"),
                        "html-wrappers")


def _extract(batches):
    words, known = _Known(), {}
    for batch in batches:
        out = []
        for page, host, shared, wrapper in zip(batch.column("_html").to_pylist(), batch.column("_host").to_pylist(), batch.column("shared"), batch.column("wrapper")):
            if not page or not wrapper.is_valid:
                out.append("")
                continue
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = open_slots(loads(wrapper.as_py()))
            texts = tokens(page, words.of(host, shared))[0]
            out.append(_joined(texts, kept_slots({}, {p for p, _, t, _ in texts if t.strip()}, known[host])))
        yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                         ["_key", "_url", "text", "n_chars"])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every row.

    Null and empty pages have an empty text. Pages without a URL, or with one without a host, are one host. Repeated
    rows are extracted one by one and align to themselves; an empty table gives an empty result; other columns are not
    read. ``br`` ends a block, as block elements do.
    """
    spark = pages.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(html).alias("_html"), host_of(F.col(url)).alias("_host"))
    words = shared_words(rows.select("_host", "_html"))
    rows = rows.join(words, F.col("_host") == F.col("whost"), "left").drop("whost")
    found = wrappers(different(rows.select("_host", "_html", "shared")))
    joined = rows.join(found, F.col("_host") == F.col("host"), "left").select("_key", "_url", "_html", "_host", "shared", "wrapper")
    kind = rows.schema["_key"].dataType.simpleString()
    out = joined.mapInArrow(_extract, f"_key {kind}, _url string, text string, n_chars long")
    return out.withColumnRenamed("_key", key).withColumnRenamed("_url", url)
