"""Bytes of documents as text, by their byte-order mark, what they declare, or UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the Western and Turkish Windows code pages differ from Latin-1, as those standards have them.
_WESTERN = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘",
    0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
_TURKISH = {0xD0: "Ğ", 0xDD: "İ", 0xDE: "Ş", 0xF0: "ğ", 0xFD: "ı", 0xFE: "ş"}

#: Names under which the code pages are declared.
WESTERN = ("windows-1252", "cp1252", "iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii")
TURKISH = ("windows-1254", "cp1254", "iso-8859-9", "latin5", "latin-5")
#: Bytes in which a declaration is looked for.
HEAD = 1024


def _code_page(data: Column, differs: dict[int, str]) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, differs)), "".join(differs.values()))


def declared(data: Column) -> Column:
    """The encoding that an XML or HTML head names, lower-cased; empty if none."""
    head = F.lower(F.decode(F.substring(data, 1, HEAD), "ISO-8859-1"))
    xml = F.regexp_extract(head, r"^[^<]*<\?xml[^>]*\sencoding\s*=\s*[\"']([a-z0-9_.:-]+)", 1)
    return F.when(xml != "", xml).otherwise(F.regexp_extract(head, r"<meta\s[^>]*charset\s*=\s*[\"']?\s*([a-z0-9_.:-]+)", 1))


def decoded(data: Column) -> Column:
    """``data`` as text: UTF-16 by its mark or its first character, the Western and Turkish code pages if declared, else UTF-8.

    A mark is left out; bytes that are not UTF-8 become U+FFFD, a last half character of UTF-16 goes; null stays null.
    """
    begins = lambda *b: F.substring(data, 1, len(b)) == F.lit(bytes(b))
    rest = lambda n: F.substring(data, F.lit(n + 1), F.octet_length(data) - n)
    wide = lambda n, kind: F.decode(F.substring(data, F.lit(n + 1), F.octet_length(data) - n - F.octet_length(data) % 2), kind)
    plain = lambda b: F.make_valid_utf8(b.cast("string"))
    named = declared(data)
    return (
        F.when(begins(0xEF, 0xBB, 0xBF), plain(rest(3)))
        .when(begins(0xFF, 0xFE), wide(2, "UTF-16LE")).when(begins(0xFE, 0xFF), wide(2, "UTF-16BE"))
        .when(begins(0x3C, 0x00), wide(0, "UTF-16LE")).when(begins(0x00, 0x3C), wide(0, "UTF-16BE"))
        .when(named.isin(*TURKISH), _code_page(data, _WESTERN | _TURKISH)).when(named.isin(*WESTERN), _code_page(data, _WESTERN))
        .otherwise(plain(data))
    )
