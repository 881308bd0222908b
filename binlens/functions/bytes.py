"""Little-endian field decoding on binary columns, all in Catalyst expressions.

``hex(reverse(binary))`` is wrong for bytes >= 0x80 (reverse goes through a UTF-8 string), so
a little-endian value is built from the hex of the raw slice with its byte pairs re-ordered and
``conv``-ed once. Offsets may be columns (e.g. relative to ``e_lfanew``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def byte_slice(content: Column, offset, width) -> Column:
    """``width`` bytes starting at 0-based ``offset`` (shorter at the end of the data)."""
    return content.substr(_c(offset) + 1, _c(width))


def le_uint(content: Column, offset, width: int) -> Column:
    """Unsigned little-endian integer of ``width`` bytes (1, 2, 4 or 8) at 0-based ``offset``.

    Null when the data ends before the field. 8 bytes give ``decimal(20,0)``, which holds every unsigned
    64-bit value; narrower fields give ``bigint``.
    """
    h = F.hex(byte_slice(content, offset, width))
    pairs = [F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]
    le = F.concat(*pairs)
    value = F.conv(le, 16, 10).cast("decimal(20,0)" if width == 8 else "bigint")
    return F.when(F.length(h) == 2 * width, value)


def ascii_field(content: Column, offset, width: int) -> Column:
    """Fixed-width byte string (e.g. a section name): trailing NULs removed, decoded as Latin-1
    so every byte maps to one character and nothing is coerced away (spaces are kept)."""
    raw = F.decode(byte_slice(content, offset, width), "ISO-8859-1")
    return F.regexp_replace(raw, "\u0000+$", "")


def hex_field(content: Column, offset, width: int) -> Column:
    """Opaque byte block rendered as upper-case hex (reserved words such as e_res)."""
    return F.hex(byte_slice(content, offset, width))


def starts_with_bytes(content: Column, offset, hex_value: str) -> Column:
    n = len(hex_value) // 2
    return F.hex(byte_slice(content, offset, n)) == F.lit(hex_value.upper())
