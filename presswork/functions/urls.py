"""URL and key column functions (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions._util import col_of
from presswork.functions.text import strip_ws
from presswork.rules import TRACKING_PARAMS

# scheme ':' ; '//' authority ; path ; '?' query ; '#' fragment
URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
# Schemes whose URLs always carry an authority part when re-assembled.
NETLOC_SCHEMES = ["http", "https", "ftp", "file", "ws", "wss", "sftp", "git", "rsync", "svn", "nfs"]


def url_cleanup(c) -> Column:
    """What URL parsing does first: drop leading C0 controls/spaces and every tab, CR and LF."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col_of(c), F.lit("")), r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, i)


def get_domain(c) -> Column:
    """Lower-cased authority (host, port, userinfo and ``www.`` kept); '' when absent."""
    return F.lower(F.regexp_extract(url_cleanup(c), AUTHORITY, 1))


def _decode(x: Column) -> Column:
    """'+' and %XX escapes decoded; a '%' that starts no escape stays as it is."""
    safe = F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(safe), x)


def _encode(x: Column) -> Column:
    # java.net.URLEncoder and Python's quote_plus differ only on '~' and '*'.
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_query(q) -> Column:
    """Decode pairs (blanks kept), drop tracking keys, sort by (key, value), re-encode."""
    pairs = F.filter(F.split(col_of(q), "&"), lambda p: p != F.lit(""))
    kv = F.transform(
        pairs,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("k"),
            _decode(
                F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise(F.lit(""))
            ).alias("v"),
        ),
    )
    tracking = F.array(*[F.lit(t) for t in TRACKING_PARAMS])
    kept = F.array_sort(F.filter(kv, lambda e: ~F.array_contains(tracking, e["k"])))
    return F.array_join(F.transform(kept, lambda e: F.concat(_encode(e["k"]), F.lit("="), _encode(e["v"]))), "&")


def canonicalize_url(c) -> Column:
    """Lower scheme (default https) and authority, drop fragment, canonical query; the path is untouched but for an
    empty trailing parameter."""
    url = url_cleanup(c)
    scheme = F.lower(_part(url, 1))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    netloc = F.lower(_part(url, 3))
    # an empty parameter part of the last path segment ('/p;') is not written back
    path = F.regexp_replace(_part(url, 4), r"(^|/)([^/;]*);$", "$1$2")
    query = canonical_query(_part(url, 5))
    with_auth = (netloc != "") | scheme.isin(NETLOC_SCHEMES)
    auth_path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    body = F.when(with_auth, F.concat(F.lit("//"), netloc, auth_path)).otherwise(path)
    q = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.concat(scheme, F.lit(":"), body, q)


def date_iso(ts) -> Column:
    """ISO date of a timestamp ('yyyy-MM-dd'); null stays null."""
    return F.date_format(col_of(ts), "yyyy-MM-dd")


def dedupe_key(title, domain, published=None) -> Column:
    """SHA-256 hex of ``lower(strip(title))|lower(strip(domain))|date-or-''``."""
    d = F.lit("") if published is None else F.coalesce(date_iso(published), F.lit(""))
    return F.sha2(
        F.concat_ws("|", F.lower(strip_ws(F.coalesce(col_of(title), F.lit("")))),
                    F.lower(strip_ws(F.coalesce(col_of(domain), F.lit("")))), d),
        256,
    )


def resolve_link(href, page_url) -> Column:
    """Root-relative href -> page URL without trailing '/' + href; otherwise unchanged."""
    h = col_of(href)
    base = F.regexp_replace(col_of(page_url), "/+$", "")
    return F.when(h.startswith("/"), F.concat(base, h)).otherwise(h)
