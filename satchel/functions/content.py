"""Classifying and decoding file bodies held as binary columns."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from satchel.functions.binding import let
from satchel.functions.paths import _c, extension

# Fixed value: only this many leading bytes are looked at to classify a file.
SNIFF_BYTES = 8000

# Byte-order marks.  UTF-32 LE starts like UTF-16 LE, so it is first.
BOMS = (
    ("UTF-32BE", "0000FEFF"),
    ("UTF-32LE", "FFFE0000"),
    ("UTF-8", "EFBBBF"),
    ("UTF-16BE", "FEFF"),
    ("UTF-16LE", "FFFE"),
)

# Spellings of an encoding declaration that Spark decodes itself.
NATIVE_NAMES = {
    "utf8": "UTF-8", "utf-8": "UTF-8",
    "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "iso-latin-1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1", "iso8859-1": "ISO-8859-1",
    "ascii": "US-ASCII", "us-ascii": "US-ASCII",
}
_DECLARATION = r"^[ \t\f]*#.*?coding[:=][ \t]*([-_.a-zA-Z0-9]+)"


def _x(hex_bytes: str) -> Column:
    return F.unhex(F.lit(hex_bytes))


def head(content: Column | str) -> Column:
    return F.substring(_c(content), 1, SNIFF_BYTES)


def bom_encoding(content: Column | str) -> Column:
    """Encoding named by a byte-order mark, or null."""
    c = _c(content)
    chain = F
    for encoding, mark in BOMS:
        chain = chain.when(F.startswith(c, _x(mark)), F.lit(encoding))
    return chain


def bom_length(encoding: Column) -> Column:
    chain = F
    for name, mark in BOMS:
        chain = chain.when(encoding == name, F.lit(len(mark) // 2))
    return chain.otherwise(F.lit(0))


def has_nul(content: Column | str) -> Column:
    return F.contains(head(content), _x("00"))


def is_binary(content: Column | str) -> Column:
    """A NUL byte in the head, unless a byte-order mark says it is text."""
    return bom_encoding(content).isNull() & has_nul(content)


def declared_encoding(content: Column | str, path: Column | str) -> Column:
    """Encoding declared on the first two lines of a ``.py``/``.pyw`` file, or null."""
    lines = F.split(F.decode(head(content), "ISO-8859-1"), "\r\n|\r|\n", 3)

    def named(found: Column) -> Column:
        first = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
        second = F.coalesce(F.get(found, F.lit(1)), F.lit(""))
        may_be_second = F.rlike(first, F.lit(r"^[ \t\f]*(#|$)"))
        on_second = F.when(may_be_second, F.regexp_extract(second, _DECLARATION, 1))
        return F.coalesce(F.nullif(F.regexp_extract(first, _DECLARATION, 1), F.lit("")), F.nullif(on_second, F.lit("")))

    return F.when(
        extension(path).isin(".py", ".pyw"), let(lines, lambda x: F.translate(F.lower(named(x)), "_", "-")))


def encoding(content: Column | str, path: Column | str) -> Column:
    """Byte-order mark first, then a declaration, else UTF-8."""
    known = F.create_map(*[F.lit(x) for pair in NATIVE_NAMES.items() for x in pair])
    declared = let(declared_encoding(content, path), lambda d: F.coalesce(F.element_at(known, d), d))
    return F.coalesce(bom_encoding(content), declared, F.lit("UTF-8"))


def _utf8_prefix_valid(content: Column) -> Column:
    """Strict UTF-8, allowing a multi-byte character clipped at the end of the head."""
    h = head(content)
    clipped = F.length(content) > SNIFF_BYTES
    ok = F.lit(False)
    for cut in (1, 2, 3):
        trimmed = F.substring(content, 1, SNIFF_BYTES - cut)
        ok = ok | (F.is_valid_utf8(trimmed.cast("string")) & _lead(content, cut))
    return F.is_valid_utf8(h.cast("string")) | (clipped & ok)


def _lead(content: Column, cut: int) -> Column:
    """The last ``cut`` bytes of the head start a longer character."""
    tail = F.hex(F.substring(content, SNIFF_BYTES - cut + 1, cut))
    first = {1: "^(C[2-9A-F]|D|E|F[0-4])", 2: "^(E|F[0-4])", 3: "^F[0-4]"}[cut]
    return F.rlike(tail, F.lit(first + "[0-9A-F]*$"))


def text_like(content: Column | str, path: Column | str) -> Column:
    """``text``, ``binary``, or ``undecodable`` for bytes its encoding does not allow."""
    c = _c(content)
    h = head(c)
    latin = F.decode(h, "ISO-8859-1")
    controls = F.length(F.regexp_replace(latin, r"[^\x00-\x08\x0B\x0E-\x1F]", ""))
    enc = encoding(c, path)
    return (
        F.when(F.length(c) == 0, F.lit("text"))
        .when(bom_encoding(c).isNotNull(), F.lit("text"))
        .when(has_nul(c), F.lit("binary"))
        .when(controls * 100 > F.length(h) * 5, F.lit("binary"))
        .when((enc == "UTF-8") & ~_utf8_prefix_valid(c), F.lit("undecodable"))
        .when((enc == "US-ASCII") & F.rlike(latin, F.lit(r"[\x80-\xFF]")), F.lit("undecodable"))
        .otherwise(F.lit("text"))
    )


def _native_decode(body: Column, enc: Column) -> Column:
    """Strict decode of the encodings Spark knows; null when the bytes are malformed."""
    utf8 = F.try_validate_utf8(body.cast("string"))
    ascii_text = F.decode(body, "ISO-8859-1")
    chain = F.when(enc == "UTF-8", utf8).when(enc == "ISO-8859-1", F.decode(body, "ISO-8859-1"))
    chain = chain.when(
        enc == "US-ASCII", F.when(~F.rlike(ascii_text, F.lit(r"[^\x00-\x7F]")), ascii_text)
    )
    for name in ("UTF-16BE", "UTF-16LE", "UTF-32BE", "UTF-32LE"):
        chain = chain.when(enc == name, _strict_wide(body, name))
    return chain


def _strict_wide(body: Column, name: str) -> Column:
    """Wide encodings replace malformed input by U+FFFD; accept only an exact round trip."""
    spark_name = name.replace("-32BE", "-32")
    if name == "UTF-32LE":
        # Reorder each unit, then read it as the big-endian form.
        body = F.unhex(F.regexp_replace(
            F.hex(body), "([0-9A-F]{2})([0-9A-F]{2})([0-9A-F]{2})([0-9A-F]{2})", "$4$3$2$1"))
        spark_name = "UTF-32"
    units = F.length(body) % (4 if "32" in name else 2) == 0
    if "32" in name:
        good = lambda text: ~F.contains(text, F.lit("\ufffd"))
    else:
        good = lambda text: F.encode(text, spark_name) == body
    return F.when(units, let(F.decode(body, spark_name), lambda text: F.when(good(text), text)))


@F.pandas_udf(T.StringType())
def _codec_decode(body: pd.Series, enc: pd.Series) -> pd.Series:
    """Code pages Spark does not know; strict, null when not decodable."""

    def one(raw: bytes | None, codec: str | None) -> str | None:
        if raw is None or codec is None:
            return None
        try:
            if b"# coding: ascii\n".decode(codec) != "# coding: ascii\n":
                return None
            return bytes(raw).decode(codec, "strict")
        except (LookupError, UnicodeError):
            return None

    return pd.Series([one(b, e) for b, e in zip(body, enc)], dtype=object)


@F.pandas_udf(T.StringType())
def _codec_capped(body: pd.Series, enc: pd.Series) -> pd.Series:
    """The same code pages after a cut: what the cut leaves of a character becomes U+FFFD."""

    def one(raw: bytes | None, codec: str | None) -> str | None:
        if raw is None or codec is None:
            return None
        try:
            reader = codecs.getincrementaldecoder(codec)("replace")
        except LookupError:
            return None
        text = reader.decode(bytes(raw), False)
        return text + ("\ufffd" if reader.getstate()[0] else "")

    return pd.Series([one(b, e) for b, e in zip(body, enc)], dtype=object)


NATIVE = ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16BE", "UTF-16LE", "UTF-32BE", "UTF-32LE")


def _after_bom(content: Column, enc: Column) -> Column:
    skip = bom_length(F.when(bom_encoding(content).isNotNull(), enc))
    return F.substring(content, skip + 1, F.length(content))


def decode(df: DataFrame, content: str = "content", path: str = "path", rare_code_pages: bool = True) -> DataFrame:
    """Add ``encoding`` and ``text`` (null when the bytes are malformed).

    Only rows that declare a code page Spark does not know send bytes to Python.
    """
    c = F.col(content)
    out = df.withColumn("encoding", encoding(c, path))
    native = F.col("encoding").isin(*NATIVE)
    text = let(_after_bom(c, F.col("encoding")), lambda body: _native_decode(body, F.col("encoding")))
    if not rare_code_pages:
        return out.withColumn("text", text)
    out = out.withColumn("__rare", F.when(~native, c))
    return (
        out.withColumn("__decoded", _codec_decode("__rare", F.when(~native, F.col("encoding"))))
        .withColumn("text", F.when(native, text).otherwise(F.col("__decoded")))
        .drop("__rare", "__decoded")
    )


def capped_text(content: Column | str, limit: Column | int) -> Column:
    """The first ``limit`` bytes as text; a clipped last character becomes one U+FFFD."""
    n = F.lit(limit) if isinstance(limit, int) else limit
    return F.make_valid_utf8(F.substring(_c(content), F.lit(1), n.cast("int")).cast("string"))


def capped_decode(content: Column | str, enc: Column, limit: Column, rare_code_pages: bool = True) -> Column:
    """Decode the first ``limit`` bytes; whatever the cut damages becomes U+FFFD."""
    c = _c(content)
    skip = bom_length(F.when(bom_encoding(c).isNotNull(), enc))
    unit = F.when(enc.startswith("UTF-32"), F.lit(4)).when(enc.startswith("UTF-16"), F.lit(2)).otherwise(F.lit(1))

    def lenient(body: Column) -> Column:
        clipped = F.length(body) % unit
        whole = F.substring(body, F.lit(1), F.length(body) - clipped)
        damaged = F.when(clipped > 0, F.lit("\ufffd")).otherwise(F.lit(""))
        plain = F.make_valid_utf8(body.cast("string"))
        wide = let(whole, lambda w: F.concat(_native_decode(w, enc), damaged))
        return F.when(enc == "UTF-8", plain).otherwise(F.coalesce(wide, plain))

    cut = F.substring(c, F.lit(1), limit.cast("int"))
    if rare_code_pages:
        rare = ~enc.isin(*NATIVE)
        # Only rows of a code page Spark does not know send their bytes to Python.
        other = _codec_capped(F.when(rare, cut), F.when(rare, enc))
        return F.when(rare, F.coalesce(other, F.make_valid_utf8(cut.cast("string")))).otherwise(
            capped_decode(content, enc, limit, rare_code_pages=False))
    return F.when(limit < skip, F.make_valid_utf8(cut.cast("string"))).otherwise(
        let(F.substring(cut, skip + 1, F.length(c)), lenient))
