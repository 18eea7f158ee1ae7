"""Byte / text conversions as Spark column expressions (F-1 .. F-8, PF-1).

Everything here is built from JVM-side functions, so it stays inside whole-stage
code generation where Spark allows it. Keep data as BINARY as long as possible:
an ARRAY of ints costs 4-8x the memory of the same bytes, and `transform`
lambdas are interpreted. Convert to arrays only for the final output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_to_bytes(text: ColumnOrName, charset: str = "UTF-8") -> Column:
    """F-1: STRING -> BINARY in `charset` (UTF-8 by default)."""
    return F.encode(_c(text), charset)


def bytes_to_array(b: ColumnOrName) -> Column:
    """F-3: BINARY -> ARRAY<INT> of unsigned byte values 0..255.

    ISO-8859-1 maps every byte to the code point of the same value, so
    splitting the decoded string into characters and taking each code point
    yields the bytes. The empty input needs its own branch (`split('')`
    returns one empty string).
    """
    b = _c(b)
    chars = F.split(F.decode(b, "ISO-8859-1"), "")
    return F.when(F.octet_length(b) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(chars, lambda ch: F.ascii(ch))
    )


def text_to_array(text: ColumnOrName, charset: str = "UTF-8") -> Column:
    """F-2: STRING -> ARRAY<INT> of its encoded bytes."""
    return bytes_to_array(text_to_bytes(text, charset))


def array_to_bytes(a: ColumnOrName) -> Column:
    """ARRAY<INT> (values 0..255) -> BINARY."""
    return F.unhex(F.array_join(F.transform(_c(a), lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def int_to_byte(x: ColumnOrName) -> Column:
    """F-8: one int 0..255 -> a one-byte BINARY (values above 255 must be filtered first)."""
    return F.unhex(F.lpad(F.hex(_c(x)), 2, "0"))


def bytes_to_text_strict(b: ColumnOrName) -> Column:
    """F-4: BINARY -> STRING, raising on malformed UTF-8."""
    return F.decode(_c(b), "UTF-8")


def array_to_text_strict(a: ColumnOrName) -> Column:
    """F-4 on a byte list."""
    return bytes_to_text_strict(array_to_bytes(a))


def bytes_to_text_safe(b: ColumnOrName, default: str | None = None) -> Column:
    """F-5 on BINARY: decoded text, or `default` when the bytes are not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(_c(b).cast("string")), F.lit(default).cast("string"))


def array_to_text_safe(a: ColumnOrName, default: str | None = None) -> Column:
    """F-5: byte list -> text, or `default` on any error, values outside 0..255 included."""
    a = _c(a)
    in_range = F.forall(a, lambda x: (x >= 0) & (x <= 255))
    return F.when(in_range, bytes_to_text_safe(array_to_bytes(a), default)).otherwise(
        F.lit(default).cast("string")
    )


def bytes_to_text_replace(b: ColumnOrName) -> Column:
    """F-6: BINARY -> STRING, each malformed sequence replaced by U+FFFD."""
    return F.make_valid_utf8(_c(b).cast("string"))


def array_to_int_string(a: ColumnOrName) -> Column:
    """F-7: byte list -> decimal values separated by one space."""
    return F.array_join(_c(a).cast("array<string>"), " ")


def drop_overflow(a: ColumnOrName) -> Column:
    """PF-1 (lenient): drop ids above 255, which are not bytes."""
    return F.filter(_c(a), lambda x: x <= 255)


def check_no_overflow(a: ColumnOrName) -> Column:
    """PF-1 (strict): the array itself, or a runtime error if an id exceeds 255."""
    a = _c(a)
    return F.when(
        F.assert_true(~F.exists(a, lambda x: x > 255), "token id above 255").isNull(), a
    )
