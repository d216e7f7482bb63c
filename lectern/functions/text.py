"""Text columns: whitespace, sentences, bounded chunks.  All of it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schemas import ABBREVIATIONS, MIN_CHUNK_CHARS

#: White space as Unicode has it, and the separators of the C0 set.
_SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"[{_SPACES}]"
_ODD_SPACE = f"[{_SPACES[1:]}]"
_LINE_END = "\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
#: The end of a sentence, behind the point where it is cut: not the full stop of an abbreviation.
_END = rf"(?<=[.!?…])(?<!(?:{'|'.join(x[:-1] for x in ABBREVIATIONS)})\.)"


def strip(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.btrim(text, F.lit(_SPACES))


def collapse_ws(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{_SPACE}+", " "))


def normal_lines(text: Column) -> Column:
    """The non-empty lines, each with single spaces: the paragraphs of a text."""
    text = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t]{2,}|\t", " ")
    return F.filter(F.transform(F.split(text, _LINE_END), lambda x: strip(x)), lambda x: x != "")


def normalize_text(text: Column) -> Column:
    """The paragraphs with an empty line between them."""
    return F.array_join(normal_lines(text), "\n\n")


def split_sentences(text: Column) -> Column:
    """Sentences, cut at white space after . ! ? or an ellipsis, but not after an abbreviation."""
    return F.filter(F.transform(F.split(text, rf"{_END}{_SPACE}+"), lambda x: strip(x)), lambda x: x != "")


def hard_split(text: Column, limit: int) -> Column:
    """Pieces of at most ``limit``: cut at the last space that leaves half a piece, else at the limit."""
    return F.regexp_extract_all(F.trim(text), F.lit(rf"(?s) *(.{{1,{limit}}}\z|.{{{limit // 2},{limit}}}(?= )|.{{{limit}}})"), F.lit(1))


def pack_units(units: Column, limit: int) -> Column:
    """Units joined by a space, first fit in order, as long as they stay within ``limit``."""
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(none.alias("done"), F.lit(None).cast("string").alias("last"))
    close = lambda a: F.when(a["last"].isNull(), a["done"]).otherwise(F.array_append(a["done"], a["last"]))

    def step(a: Column, unit: Column) -> Column:
        fits = a["last"].isNotNull() & (F.length(a["last"]) + 1 + F.length(unit) <= limit)
        return F.when(fits, F.struct(a["done"].alias("done"), F.concat(a["last"], F.lit(" "), unit).alias("last"))).otherwise(F.struct(close(a).alias("done"), unit.alias("last")))

    return F.aggregate(units, start, step, close)


def paragraph_chunks(paragraph: Column, limit: int) -> Column:
    """The chunks of one paragraph; packing never joins paragraphs, so each is on its own.

    Where every sentence keeps to the limit and spaces are plain, a chunk is the longest piece that ends a
    sentence, which one pattern finds; the pieces then make up the whole paragraph again.  Other paragraphs
    are cut into sentences, those into pieces, and packed.
    """
    bounded = lambda s: F.when(F.length(s) > limit, hard_split(s, limit)).otherwise(F.array(s))
    packed = pack_units(F.flatten(F.transform(split_sentences(paragraph), bounded)), limit)
    pattern = rf"(?s)\G ?+(.{{1,{limit}}}\z|.{{1,{limit}}}{_END}(?= ))"
    quick = F.array(F.regexp_extract_all(paragraph, F.lit(pattern), F.lit(1)))
    whole = lambda q: (F.length(F.array_join(q, " ")) == F.length(paragraph)) & ~paragraph.rlike(_ODD_SPACE)
    long = F.get(F.transform(quick, lambda q: F.when(whole(q), q).otherwise(packed)), F.lit(0))
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(long)


def chunk_text(text: Column, limit: int) -> Column:
    """All chunks of a text in order, none longer than ``limit``."""
    if limit < MIN_CHUNK_CHARS:
        raise ValueError(f"chunks need a limit of at least {MIN_CHUNK_CHARS}")
    return F.flatten(F.transform(normal_lines(text), lambda p: paragraph_chunks(p, limit)))


def enforce_limit(chunks: Column, limit: int) -> Column:
    """Chunks without blanks, those over ``limit`` cut again; an error if one is still too long."""
    if limit < MIN_CHUNK_CHARS:
        raise ValueError(f"chunks need a limit of at least {MIN_CHUNK_CHARS}")
    clean = F.filter(F.transform(chunks, strip), lambda c: c != "")
    cut = F.flatten(F.transform(clean, lambda c: F.when(F.length(c) > limit, chunk_text(c, limit)).otherwise(F.array(c))))
    checked = lambda x: F.when(F.length(x) > limit, F.raise_error(F.lit("a chunk is over the limit"))).otherwise(x)
    return F.transform(cut, lambda x: checked(x))


def escape_metadata(text: Column) -> Column:
    """A value for a line of chapter metadata: special characters escaped, line ends as spaces."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for special in "=;#":
        text = F.replace(text, F.lit(special), F.lit("\\" + special))
    return F.translate(text, "\n\r", "  ")


def format_duration(seconds: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds, of rounded seconds."""
    s = F.greatest(F.rint(seconds), F.lit(0.0)).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return (
        F.when(hours > 0, F.format_string("%d sa %02d dk", hours, minutes))
        .when(minutes > 0, F.format_string("%d dk %02d sn", minutes, s % 60))
        .otherwise(F.format_string("%d sn", s))
    )
