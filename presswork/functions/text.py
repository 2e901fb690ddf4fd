"""Text column functions.

All functions take and return ``Column`` and are built from JVM-side
Spark SQL expressions; no text is sent to Python.
"""

from __future__ import annotations

import html as _html
import html.entities as _entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.functions._util import col_of, let, lit_str
from presswork.rules import CLAMP_FALLBACK_MAX, TOKEN_STRIP_CHARS, WORD_CLASS

# The whitespace set of Python's ``str.isspace`` as a character class and as a string.
WS_CLASS = "[\\p{IsWhite_Space}\\x1C-\\x1F]"
WS_CHARS = "".join(chr(c) for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                    0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
# A run that is not one space already, so that cleaning passes over the single spaces of a text.
WS_RUN = f"{WS_CLASS}(?:(?<! )|{WS_CLASS}){WS_CLASS}*"
# Line boundaries of Python's ``str.splitlines``; of a pair the two characters are a boundary each, with a blank line between.
LINE_BREAK = "[\\n\\r\\x{0B}\\f\\x{1C}-\\x{1E}\\x{85}\\x{2028}\\x{2029}]"
# Sentence boundary: whitespace run that follows ., ! or ?.
SENTENCE_SPLIT = "(?<=[.!?]) "
TAG_RE = "<[^>]+>"


def clean_whitespace(c) -> Column:
    """Runs of Unicode whitespace become one space; trimmed; null -> ''."""
    return F.trim(F.regexp_replace(F.coalesce(col_of(c), F.lit("")), lit_str(WS_RUN), F.lit(" ")))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def strip_html(c) -> Column:
    """Delete every ``<...>`` span, insert nothing, decode nothing; null -> ''."""
    return F.regexp_replace(F.coalesce(col_of(c), F.lit("")), lit_str(TAG_RE), F.lit(""))


#: Character references by name, the names that end without ``;`` longest first, and the code points whose reference
#: is not the code point itself; all as the standard library decodes them.
_NAMED: dict[str, dict[str, str]] = {}
for _name, _chars in _entities.html5.items():
    _NAMED.setdefault(_name[0], {})[_name] = _chars
_LEGACY = sorted((n for n in _entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_ODD = {n: _html.unescape(f"&#{n};") for n in [*range(0xA0), *range(0xFDD0, 0xFDF0), *(p << 16 | e for p in range(17) for e in (0xFFFE, 0xFFFF))]}
_ODD = {str(n): c for n, c in _ODD.items() if c != chr(n)}


def _code_point(digits: Column, base: int) -> Column:
    """The text of a numeric reference's digits: U+FFFD for what is no character, '' for what a document may not hold."""

    def text(d):
        n = F.when(F.char_length(d) <= 7, F.conv(d, base, 10)).cast("int")
        # a space leads, so that U+FEFF is not taken for a byte order mark
        chars = F.decode(F.unhex(F.concat(F.lit("00000020"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")
        none = (F.char_length(d) > 7) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        odd = F.try_element_at(F.from_json(F.lit(json.dumps(_ODD)), "map<string,string>"), n.cast("string"))
        return F.when(none, F.lit("\ufffd")).otherwise(F.coalesce(odd, F.substring(chars, 2, 1)))

    return let(text, d=F.regexp_replace(digits, lit_str("^0+(?=.)"), F.lit("")))


def _reference(piece: Column) -> Column:
    """A text that followed ``&``, with the reference that it may begin with decoded."""

    def rest(length):
        return F.substr(piece, length + 1)

    def numeric(decimal, hexadecimal):
        own = lambda m: F.regexp_replace(m, lit_str("[#xX;]"), F.lit(""))
        return (F.when(decimal != "", F.concat(_code_point(own(decimal), 10), rest(F.char_length(decimal))))
                .when(hexadecimal != "", F.concat(_code_point(own(hexadecimal), 16), rest(F.char_length(hexadecimal))))
                .otherwise(F.concat(F.lit("&"), piece)))

    def of_group(table):
        whole = let(lambda name: F.concat(F.try_element_at(table, name), rest(F.char_length(name))),
                    name=F.regexp_extract(piece, "^[^\\t\\n\\f <&#;]{1,32};?", 0))
        begun = let(lambda name: F.concat(F.try_element_at(table, name), rest(F.char_length(name))),
                    name=F.regexp_extract(piece, "^(?:" + "|".join(_LEGACY) + ")", 0))
        return F.coalesce(whole, begun, F.concat(F.lit("&"), piece))

    groups = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,map<string,string>>")
    number = let(numeric, decimal=F.regexp_extract(piece, "^#[0-9]+;?", 0), hexadecimal=F.regexp_extract(piece, "^#[xX][0-9a-fA-F]+;?", 0))
    return F.when(F.substring(piece, 1, 1) == "#", number).otherwise(let(of_group, table=F.try_element_at(groups, F.substring(piece, 1, 1))))


def html_unescape(c) -> Column:
    """HTML5 character references (named, decimal, hexadecimal) decoded once, as the standard library's ``unescape`` does."""

    def pieces(x):
        return let(lambda p: F.concat(p[0], F.array_join(F.transform(F.slice(p, 2, F.size(p)), _reference), "")), p=F.split(x, "&", -1))

    return let(lambda x: F.when(F.instr(x, "&") > 0, pieces(x)).otherwise(x), x=col_of(c))


def html_to_text(c, drop_invisible: bool = True) -> Column:
    """Entity-repair, unescape, drop markup, clean whitespace.

    Markup is removed *after* unescaping, so escaped tags are treated as
    tags; what is left is unescaped once more, as reading it as markup does
    (``&amp;amp;`` becomes ``&``). With ``drop_invisible`` the content of comments and of
    ``script``/``style``/``template`` elements is not text.
    """
    x = F.coalesce(col_of(c), F.lit(""))
    x = F.replace(x, F.lit("&#;x"), F.lit("&#x"))
    x = F.replace(x, F.lit("&#;X"), F.lit("&#X"))
    x = F.replace(x, F.lit("&#;#"), F.lit("&#"))

    def without_markup(x):
        if drop_invisible:
            x = F.regexp_replace(x, lit_str("(?s)<!--.*?(-->|$)"), F.lit(" "))
            x = F.regexp_replace(
                x, lit_str("(?is)<(script|style|template)\\b[^>]*>.*?(</\\1\\s*>|$)"), F.lit(" ")
            )
        return F.regexp_replace(x, lit_str("<[A-Za-z/!?][^>]*>"), F.lit(" "))

    x = let(lambda t: F.when(F.instr(t, "<") > 0, without_markup(t)).otherwise(t), t=html_unescape(x))
    return clean_whitespace(html_unescape(x))


def split_sentences(c) -> Column:
    """Clean, split at whitespace after ``.``/``!``/``?``, drop empties -> ARRAY<STRING>."""
    t = clean_whitespace(c)
    return F.filter(F.split(t, lit_str(SENTENCE_SPLIT)), lambda s: s != F.lit(""))


def split_lines(c) -> Column:
    """Python ``splitlines`` + ``strip``, dropping blank lines -> ARRAY<STRING>."""
    lines = F.transform(F.split(F.coalesce(col_of(c), F.lit("")), lit_str(LINE_BREAK)), strip_ws)
    return F.filter(lines, lambda s: s != F.lit(""))


def clamp_lines(c, max_lines: int = 5) -> Column:
    """>=2 non-blank lines: first N trimmed lines; else first N sentences; else first 500 chars."""

    def short(cleaned, sents):
        return (F.when(F.size(sents) > 0, F.trim(F.array_join(F.slice(sents, 1, max_lines), "\n")))
                .otherwise(F.left(cleaned, F.lit(CLAMP_FALLBACK_MAX))))

    def sentences(cleaned):
        return F.filter(F.split(cleaned, lit_str(SENTENCE_SPLIT)), lambda s: s != F.lit(""))

    def pick(raw, lines):
        return (F.when(raw == "", F.lit(""))
                .when(F.size(lines) >= 2, F.array_join(F.slice(lines, 1, max_lines), "\n"))
                .otherwise(let(lambda t: let(short, cleaned=t, sents=sentences(t)), t=clean_whitespace(raw))))

    # the text itself is bound first: it may be costly, and it is read more than once
    return let(lambda x: let(pick, raw=x, lines=split_lines(x)), x=F.coalesce(col_of(c), F.lit("")))


def word_pattern(min_len: int) -> str:
    return f"{WORD_CLASS}{{{int(min_len)},}}"


def tokens_alnum(c, min_len: int = 3) -> Column:
    """Regex word tokens (letters incl. Spanish accents, digits, '-'), lower-cased."""
    return F.transform(
        F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), lit_str(word_pattern(min_len)), 0), F.lower
    )


def strip_token(c) -> Column:
    """Strip punctuation ``.,:;()[]{}'"!?`` from both ends of a token."""
    return F.btrim(col_of(c), F.lit(TOKEN_STRIP_CHARS))


def tokens_ws(c) -> Column:
    """Clean + lower + split on spaces -> ARRAY<STRING> of raw (unstripped) tokens."""
    t = F.lower(clean_whitespace(c))
    return F.filter(F.split(t, " "), lambda s: s != F.lit(""))


def truncate(c, n: int) -> Column:
    """First ``n`` code points."""
    return F.left(col_of(c), F.lit(int(n)))


def first_line(c) -> Column:
    """Text before the first newline."""
    return F.substring_index(F.coalesce(col_of(c), F.lit("")), "\n", 1)
