"""Paths inside a book archive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.schemas import COVER_SUFFIXES


def normalize_path(path: Column) -> Column:
    """``path`` without empty and ``.`` steps, each ``..`` taking back the step before it."""
    none = F.expr("cast(array() as array<string>)")
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        over = (part == "..") & (F.size(done) == 0) & rooted
        return F.when(part.isin("", ".") | over, done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.array_append(done, part))

    body = F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")
    return F.when(rooted, F.concat(F.lit("/"), body)).otherwise(F.when(body == "", ".").otherwise(body))


def strip_fragment(href: Column) -> Column:
    return F.split_part(href, F.lit("#"), F.lit(1))


def unquote(text: Column) -> Column:
    """Percent escapes decoded; a plus sign stays, text that does not decode stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def resolve_href(base: Column, href: Column) -> Column:
    """The archive path that ``href`` in the document ``base`` points at, with its fragment."""
    raw, fragment = unquote(F.regexp_replace(strip_fragment(href), r"\?.*", "")), unquote(F.regexp_extract(href, "#(.*)", 1))
    folder = F.regexp_extract(base, "^(.*/)", 1)
    path = F.when(raw == "", normalize_path(base)).when(raw.startswith("/"), normalize_path(raw)).otherwise(normalize_path(F.concat(folder, raw)))
    return F.when(fragment == "", path).otherwise(F.concat(path, F.lit("#"), fragment))


def suffix_pick(href: Column, media_type: Column) -> Column:
    """The cover's suffix by name, else by media type; unknown kinds count as .jpg."""
    named = F.lower(F.regexp_extract(href, r"[^/.](\.[^./]+)$", 1))
    guessed = F.when(media_type == "image/png", ".png").when(media_type == "image/webp", ".webp").otherwise(".jpg")
    suffix = F.when(named == "", guessed).otherwise(named)
    return F.when(suffix.isin(*COVER_SUFFIXES), suffix).otherwise(".jpg")
