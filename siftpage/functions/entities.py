"""Character references in HTML text and attribute values, decoded JVM-side."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

COMMON = ("amp", "nbsp", "quot", "lt", "gt", "apos", "copy", "middot", "raquo", "laquo")


def _table() -> dict[str, str]:
    """The HTML 4 names plus ``apos``, taken from the standard library."""
    table = {name: chr(code) for name, code in name2codepoint.items()}
    table["apos"] = "'"
    return table


def _named(name: Column) -> Column:
    table = _table()
    out = None
    for key in COMMON:
        out = (
            F.when(name == key, F.lit(table[key]))
            if out is None
            else out.when(name == key, F.lit(table[key]))
        )
    rare = F.create_map(
        *[F.lit(x) for key, char in table.items() if key not in COMMON for x in (key, char)]
    )
    return out.otherwise(F.try_element_at(rare, name))


def _numbered(digits: Column) -> Column:
    """``65`` or ``x41`` to a character; null outside the valid range."""
    is_hex = F.lower(F.left(digits, F.lit(1))) == "x"
    code = F.when(
        is_hex, F.conv(F.substring(digits, 2, 8), 16, 10).cast("long")
    ).otherwise(F.left(digits, F.lit(8)).try_cast("long"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(valid, char)


def _decode_piece(piece: Column) -> Column:
    name = F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]*);", 1)
    digits = F.regexp_extract(piece, r"^&#([0-9]+|[xX][0-9a-fA-F]+)", 1)
    named = F.concat(_named(name), F.substr(piece, F.length(name) + 3))
    tail = F.regexp_replace(piece, r"^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
    numbered = F.concat(_numbered(digits), tail)
    return (
        F.when(name != "", F.coalesce(named, piece))
        .when(digits != "", F.coalesce(numbered, piece))
        .otherwise(piece)
    )


def decode_entities(text: Column) -> Column:
    """Named references need their semicolon, numeric ones do not; anything else stays as it is."""
    pieces = F.transform(F.split(text, "(?=&)"), _decode_piece)
    return F.when(~F.contains(text, F.lit("&")), text).otherwise(F.array_join(pieces, ""))
