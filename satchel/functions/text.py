"""Text expressions used by scanning and by the layouts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from satchel.functions.paths import _c

# Limits and markers of a file preview.
PREVIEW_CHARS = 4000
PREVIEW_CUT = "\r\n[…preview truncated…]"

_LINE_END = "\r\n|\r|\n"


def line_of(text: Column | str, start: Column) -> Column:
    """1-based line of a 0-based character offset; CR, LF and CRLF each end one line."""
    return F.size(F.split(F.substring(_c(text), F.lit(1), start.cast("int")), _LINE_END, -1))


def longest_backtick_run(text: Column | str) -> Column:
    runs = F.regexp_extract_all(_c(text), F.lit("(`+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def fence(text: Column | str) -> Column:
    """A backtick fence longer than any run inside, and at least three long."""
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_backtick_run(text) + 1))


def xml_clean(text: Column | str) -> Column:
    """Drop characters XML 1.0 does not allow."""
    return F.regexp_replace(
        _c(text), r"[^\x09\x0A\x0D\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def _replace_all(col: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def xml_text(text: Column | str) -> Column:
    """Escape element content; a carriage return survives as an entity."""
    return _replace_all(_c(text), (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#xD;")))


def xml_attribute(text: Column | str) -> Column:
    return _replace_all(xml_text(text), (('"', "&quot;"), ("\n", "&#xA;"), ("\t", "&#x9;")))


def json_string(text: Column | str) -> Column:
    """A quoted JSON string."""
    body = F.to_json(F.struct(_c(text).alias("v")))
    return F.coalesce(F.substring(body, 6, 2147483647), F.lit('""}')).substr(
        F.lit(1), F.greatest(F.length(body) - 6, F.lit(2)))


def trim_space(text: Column | str) -> Column:
    """Trim Unicode white space at both ends."""
    blank = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return F.regexp_replace(F.regexp_replace(_c(text), f"^{blank}++", ""), f"(?<!{blank}){blank}++\\z", "")


def ends_line(text: Column) -> Column:
    """CRLF when the text does not already end with a line feed."""
    return F.when(F.endswith(text, F.lit("\n")), F.lit("")).otherwise(F.lit("\r\n"))


def preview_cut(text: Column | str) -> Column:
    """First 4,000 characters and a marker when something was cut."""
    t = _c(text)
    return F.when(
        F.length(t) > PREVIEW_CHARS, F.concat(F.substring(t, 1, PREVIEW_CHARS), F.lit(PREVIEW_CUT))
    ).otherwise(t)
