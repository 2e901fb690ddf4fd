"""Date and window-length functions.

Accepted publication-date formats (everything else becomes NULL):

* ISO-8601: ``yyyy-MM-dd``, optionally followed by ``T`` or a space and
  ``HH:mm[:ss[.fraction]]``, optionally followed by ``Z``, ``UTC``, ``GMT``
  or an offset ``+HH:MM`` / ``+HHMM`` / ``+HH``.
* RFC-822 / RFC-1123: ``[Wkd,] d Mon yyyy HH:mm[:ss] [zone]`` with an
  English month abbreviation (or full month name) and any zone suffix; a
  two-digit year is 1969-1999 from 69 on, else 2000-2068.
* Written forms (``WRITTEN``): ``[Weekday,] Month d, yyyy`` and ``d Month yyyy``
  with an optional time (``10:00``, ``3:04 PM``) and zone, ``yyyy/MM/dd``,
  ``yyyyMMdd[THHmmss]`` and ``Tue Jan  2 10:00:00 2024``.

Two semantics are offered. ``wall_clock`` (the default of the live tool)
keeps the printed wall-clock time and drops the zone. ``utc`` accepts only
ISO input and converts it to UTC using its offset (no offset = UTC).
Both produce ``TIMESTAMP_NTZ`` and never depend on the session time zone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions._util import col_of, let

ISO_RE = (
    r"^\s*(\d{4})-(\d{2})-(\d{2})"
    r"(?:[T ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?"
    r"\s*(Z|UTC|GMT|[+-]\d{2}(?::?\d{2})?)?\s*$"
)
RFC822_RE = (
    r"^\s*(?:[A-Za-z]+,?\s+)?(\d{1,2})\s+([A-Za-z]{3})[A-Za-z]*\.?\s+(\d{4}|\d{2})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s+.*)?\s*$"
)
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
SINCE_RE = r"^(\d+)\s*([hd])$"
HOURS_PER_UNIT = {"h": 1, "d": 24}


def parse_since_hours(s: str) -> int:
    """'24h' -> 24, '7d' -> 168; anything else raises ``ValueError`` (driver-side parameter)."""
    text = (s or "").strip().lower()
    amount, unit = text[:-1].rstrip(), text[-1:]
    if unit not in HOURS_PER_UNIT or not re.fullmatch(r"\d+", amount):
        raise ValueError("invalid window: use e.g. 24h or 7d")
    return int(amount) * HOURS_PER_UNIT[unit]


def since_hours_col(c, strict: bool = False) -> Column:
    """Column form of :func:`parse_since_hours`: NULL (or a raised error) when invalid."""
    s = F.lower(F.trim(col_of(c)))
    ok = F.coalesce(s.rlike(SINCE_RE), F.lit(False))
    n = F.regexp_extract(s, SINCE_RE, 1).cast("bigint")
    unit = F.regexp_extract(s, SINCE_RE, 2)
    hours = F.coalesce(*[F.when(unit == u, n * h) for u, h in HOURS_PER_UNIT.items()])
    bad = F.raise_error(F.concat(F.lit("invalid window: "), F.coalesce(s, F.lit("NULL")))).cast("bigint")
    return F.when(ok, hours).otherwise(bad if strict else F.lit(None).cast("bigint"))


def _iso_parts(s: Column):
    g = lambda i: F.regexp_extract(s, ISO_RE, i)
    frac = F.rpad(F.left(g(7), F.lit(6)), 6, "0")
    secs = F.concat(F.when(g(6) == "", F.lit("00")).otherwise(g(6)), F.lit("."), frac).cast("decimal(8,6)")
    hh = F.when(g(4) == "", F.lit("0")).otherwise(g(4)).cast("int")
    mi = F.when(g(5) == "", F.lit("0")).otherwise(g(5)).cast("int")
    wall = F.try_make_timestamp_ntz(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), hh, mi, secs)
    return wall, g(8)


def parse_iso_wall(c) -> Column:
    s = F.coalesce(col_of(c), F.lit(""))
    wall, _ = _iso_parts(s)
    return F.when(s.rlike(ISO_RE), wall)


def parse_rfc822_wall(c) -> Column:
    s = F.coalesce(col_of(c), F.lit(""))
    g = lambda i: F.regexp_extract(s, RFC822_RE, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(g(2))).cast("int")
    secs = F.when(g(6) == "", F.lit("0")).otherwise(g(6)).cast("decimal(8,6)")
    printed = g(3).cast("int")
    century = F.when(printed >= 69, 1900).otherwise(2000)
    year = F.when(F.length(g(3)) == 2, printed + century).otherwise(printed)
    ts = F.try_make_timestamp_ntz(year, month, g(1).cast("int"), g(4).cast("int"), g(5).cast("int"), secs)
    return F.when(s.rlike(RFC822_RE) & (month > 0), ts)


def _written_wall(c, pattern: str, order: str) -> Column:
    """A date whose numbers and month names stand where a pattern's groups do: ``order`` names the groups by letters
    (y year, m month, d day, H hour, M minute, S second, p am or pm)."""
    s = F.trim(F.coalesce(col_of(c), F.lit("")))
    g = {k: F.regexp_extract(s, pattern, i + 1) for i, k in enumerate(order)}
    name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.left(g["m"], F.lit(3)))).cast("int")
    month = F.coalesce(g["m"].try_cast("int"), F.when(name > 0, name))
    part = lambda k: F.when(g[k] == "", F.lit(0)).otherwise(g[k].try_cast("int")) if k in g else F.lit(0)
    hour = part("H")
    if "p" in g:
        half = F.lower(g["p"])
        hour = F.when(half == "", hour).when(hour % 12 == 0, F.when(half == "pm", 12).otherwise(0)).otherwise(hour + F.when(half == "pm", 12).otherwise(0))
    ts = F.try_make_timestamp_ntz(g["y"].try_cast("int"), month, g["d"].try_cast("int"), hour, part("M"), part("S").cast("decimal(8,6)"))
    return F.when(s.rlike(pattern), ts)


_CLOCK = r"(?:,?\s+(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(?:\s*([AaPp][Mm]))?)?"
_ZONE = r"(?:\s*(?:Z|[A-Za-z]{2,5}|[+-]\d{2}:?\d{2}))?$"
_DAY = r"^(?:[A-Za-z]{3,9},?\s+)?"
_MONTH = r"((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))\.?"
#: Other written dates that feeds carry, and what their groups are.
WRITTEN = [
    (_DAY + _MONTH + r"\s+(\d{1,2}),?\s+(\d{4})" + _CLOCK + _ZONE, "mdyHMSp"),                              # Jan 2, 2024 10:00
    (_DAY + r"(\d{1,2})\s+" + _MONTH + r",?\s+(\d{4})" + _CLOCK + _ZONE, "dmyHMSp"),                        # 2 January 2024
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})" + _CLOCK + _ZONE, "ymdHMSp"),                                          # 2024/01/02 10:00
    (r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})?)?" + _ZONE, "ymdHMS"),                         # 20240102T100000Z
    (_DAY + _MONTH + r"\s+(\d{1,2})\s+(\d{1,2}):(\d{2}):(\d{2})\s+(?:[A-Za-z]{2,5}\s+)?(\d{4})$", "mdHMSy"),  # Tue Jan  2 10:00:00 2024
]


def parse_wall_clock(c) -> Column:
    """First format that parses; the zone is dropped, not applied.

    ISO-8601, RFC 822, then the forms of ``WRITTEN``: the month by name before or after the day, slashes from the year
    on, digits alone, and the form of the C library. Numbers whose order is a matter of custom (``01/02/2024``) and
    names in other languages are null."""
    # the rarer forms are looked at row by row where the others fail, outside the generated code, which they would outgrow
    rarer = let(lambda s: F.coalesce(*[_written_wall(s, p, order) for p, order in WRITTEN]), s=F.coalesce(col_of(c), F.lit("")))
    return F.coalesce(parse_iso_wall(c), parse_rfc822_wall(c), rarer)


def parse_pub_ts(*cols) -> Column:
    """First parseable of several candidate columns (e.g. published, updated)."""
    return F.coalesce(*[parse_wall_clock(c) for c in cols])


def parse_iso_utc(c) -> Column:
    """ISO-8601 only, converted to UTC by its offset; no offset means UTC; else NULL."""
    s = F.coalesce(col_of(c), F.lit(""))
    wall, zone = _iso_parts(s)
    off = F.regexp_replace(zone, ":", "")
    sign = F.when(F.left(off, F.lit(1)) == "-", F.lit(-1)).otherwise(F.lit(1))
    oh = F.substr(off, F.lit(2), F.lit(2))
    om = F.substr(off, F.lit(4), F.lit(2))
    minutes = F.when(off.rlike(r"^[+-]\d{2}"), sign * (oh.cast("int") * 60 + F.when(om == "", F.lit(0)).otherwise(om.cast("int")))).otherwise(F.lit(0))
    return F.when(s.rlike(ISO_RE), F.timestamp_add("MINUTE", -minutes, wall))
