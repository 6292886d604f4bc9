"""Text expressions: HTML clean-up, percent encoding, capitalised phrases. White space is Unicode's where the name says so."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is taken out of a page, in order, and what takes its place (fixed patterns).
REMOVED = (("(?is)<script.*?</script>", ""), ("(?is)<style.*?</style>", ""), ("(?is)<!--.*?-->", ""), ("<[^>]+>", " "), (r"\s+", " "))


#: Names that count without a semicolon, the longest first.
_BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
#: Numbers that stand for signs of another code page, or for none (fixed values of the standard).
_MOVED = {k: bytes([k]).decode("cp1252") if k not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(k) for k in range(0x80, 0xA0)} | {0: "\ufffd", 0x0D: "\r"}
_ENDS = [0x10000 * plane + last for plane in range(0x11) for last in (0xFFFE, 0xFFFF)]
#: Entities that most pages have no others than; the ampersand's comes last, as what it makes is not read again.
_COMMON = ("lt", "gt", "quot", "apos", "nbsp", "copy", "middot", "#39", "amp")


def _sign(code: Column) -> Column:
    """The character of a number (long, null for one too large); the replacement character where there is none, nothing for control signs and numbers that are no characters."""
    moved = F.from_json(F.lit(json.dumps({str(k): v for k, v in _MOVED.items()})), "map<string,string>")
    code = F.coalesce(code, F.lit(0x110000).cast("long"))
    none = code.between(1, 8) | (code == 0x0B) | code.between(0x0E, 0x1F) | code.between(0x7F, 0x9F) | code.between(0xFDD0, 0xFDEF) | code.isin(_ENDS)
    good = (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(good, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.coalesce(F.try_element_at(moved, code.cast("string")), F.when(none, F.lit("")).otherwise(plain))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decoded(text: Column) -> Column:
    """Entities of HTML as their characters, once, as the standard reads them: what an ampersand's entity makes is not read again.

    Names with a semicolon are looked up as a whole; else the longest name that counts without one begins the rest. Numbers may have any number of leading zeros.
    """
    named = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    bare = f"^({'|'.join(_BARE)})"

    def number(piece: Column) -> Column:
        """What comes after an ampersand and begins with a number sign."""
        parts = F.regexp_extract(piece, "^#0*([0-9]+);?", 1), F.regexp_extract(piece, "^#[xX]0*([0-9a-fA-F]+);?", 1)
        digits = _let(parts[0], lambda d: F.when(d != "", F.concat(_sign(F.when(F.length(d) <= 7, d.cast("long"))), F.regexp_replace(piece, "^#[0-9]+;?", ""))))
        hexed = _let(parts[1], lambda d: F.when(d != "", F.concat(_sign(F.when(F.length(d) <= 6, F.conv(d, 16, 10).cast("long"))), F.regexp_replace(piece, "^#[xX][0-9a-fA-F]+;?", ""))))
        return F.coalesce(digits, hexed, F.concat(F.lit("&"), piece))

    def name(piece: Column) -> Column:
        whole = F.regexp_extract(piece, "^[A-Za-z][A-Za-z0-9]{1,30};", 0)
        known = _let(whole, lambda w: F.when(w != "", F.concat(F.try_element_at(named, w), F.substr(piece, F.length(w) + F.lit(1)))))
        short = _let(F.regexp_extract(piece, bare, 1), lambda w: F.when(w != "", F.concat(F.try_element_at(named, w), F.substr(piece, F.length(w) + F.lit(1)))))
        return F.coalesce(known, short, F.concat(F.lit("&"), piece))

    one = lambda piece: F.when(piece.startswith("#"), number(piece)).otherwise(name(piece))
    parts = F.split(text, "&", -1)
    many = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    few = text
    for k in _COMMON:
        few = F.replace(few, F.lit(f"&{k};"), F.lit("'" if k == "#39" else html5[f"{k};"]))
    rare = text.rlike(f"&(?!(?:{'|'.join(_COMMON)});)")
    return F.when(~text.contains("&"), text).when(~rare, few).otherwise(many)


def clean_html(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, white space is folded, entities are decoded after that."""
    for pattern, instead in REMOVED:
        html = F.regexp_replace(html, pattern, instead)
    return F.trim(decoded(html))


def without_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", ""))


def html_title(html: Column) -> Column:
    return without_tags(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def html_headers(html: Column, level: int) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(f"(?is)<h{level}[^>]*>(.*?)</h{level}>"), F.lit(1)), without_tags)


def html_meta(html: Column, name: str) -> Column:
    """Content of a meta element whose name comes before its content; empty if there is none."""
    return F.regexp_extract(html, f"(?i)<meta[^>]*name=[\"']{name}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)


def html_keywords(html: Column) -> Column:
    found = html_meta(html, "keywords")
    return F.when(found == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(found, ","), lambda x: F.trim(x)))


def html_json_ld(html: Column) -> Column:
    """Valid JSON-LD blocks, as text."""
    blocks = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(blocks, lambda x: F.trim(x)), lambda x: F.try_parse_json(x).isNotNull())


def html_microdata(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("(?is)<[^>]*itemscope[^>]*>.*?</[^>]+>"), F.lit(0))


def percent_encoded(text: Column) -> Column:
    """Everything but letters, digits and -_.~ as %XX."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def pascal(name: Column) -> Column:
    """snake_case to PascalCase; empty gives Entity."""
    parts = F.array_remove(F.split(name, "[_\\- ]+"), "")
    return F.when(F.size(parts) == 0, F.lit("Entity")).otherwise(F.array_join(F.transform(parts, F.initcap), ""))


def phrases(text: Column) -> Column:
    """Runs of capitalised words."""
    return F.regexp_extract_all(text, F.lit(r"\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*"), F.lit(0))
