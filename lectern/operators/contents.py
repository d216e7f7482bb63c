"""Tables of contents against chapters: mapping, fallbacks and the default selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.paths import normalize_path, strip_fragment

#: Numbers in one range of a selector.
MOST_SELECTED = 100_000


def map_toc(toc: DataFrame, chapters: DataFrame) -> DataFrame:
    """``toc`` with the chapter each row's document is, null if none; of equal paths the last chapter counts."""
    by_path = chapters.groupBy("book_id", normalize_path(F.col("source_href")).alias("path")).agg(F.max("chapter_index").alias("chapter_index"))
    rows = toc.withColumn("path", normalize_path(strip_fragment(F.col("href"))))
    return rows.join(by_path, ["book_id", "path"], "left").drop("path")


def represented(chapters: DataFrame, mapped: DataFrame) -> DataFrame:
    """Chapters that some contents row points at."""
    return chapters.join(mapped.filter("chapter_index is not null"), ["book_id", "chapter_index"], "left_semi")


def missing(chapters: DataFrame, mapped: DataFrame) -> DataFrame:
    """Chapters that no contents row points at."""
    return chapters.join(mapped.filter("chapter_index is not null").select("book_id", "chapter_index"), ["book_id", "chapter_index"], "left_anti")


def usable(chapters: DataFrame, mapped: DataFrame) -> DataFrame:
    """(book_id, has_toc): whether a book's contents point at any of its chapters."""
    found = mapped.groupBy("book_id").agg(F.bool_or(F.col("chapter_index").isNotNull()).alias("found"))
    return chapters.select("book_id").distinct().join(found, "book_id", "left").select("book_id", F.coalesce("found", F.lit(False)).alias("has_toc"))


def fallback(chapters: DataFrame, mapped: DataFrame) -> DataFrame:
    """Contents rows for chapters outside the contents: off in books with usable contents, else on."""
    rows = missing(chapters, mapped).join(usable(chapters, mapped), "book_id")
    return rows.select("book_id", F.col("title"), F.col("source_href").alias("href"), "chapter_index", F.when(F.col("has_toc"), "spine").otherwise("spine_no_toc").alias("source"), (~F.col("has_toc")).alias("default_selected"))


def full_contents(chapters: DataFrame, mapped: DataFrame) -> DataFrame:
    """The contents of every book: its own rows where usable, and the fallback rows."""
    good = mapped.join(usable(chapters, mapped).filter("has_toc"), "book_id", "left_semi")
    own = good.select("book_id", "title", "href", "chapter_index", F.lit("toc").alias("source"), F.lit(True).alias("default_selected"))
    return own.unionByName(fallback(chapters, mapped))


def default_selection(chapters: DataFrame, mapped: DataFrame) -> DataFrame:
    """Chapters narrated unless the user says otherwise: the listed ones, or all in books without contents."""
    listed = represented(chapters, mapped).select("book_id", "chapter_index", F.lit(True).alias("listed"))
    rows = chapters.join(listed, ["book_id", "chapter_index"], "left").join(usable(chapters, mapped), "book_id")
    return rows.filter(~F.col("has_toc") | F.coalesce("listed", F.lit(False))).select(*chapters.columns)


def explicit_selection(chapters: DataFrame, wanted: DataFrame) -> DataFrame:
    """Chapters that the user's (book_id, chapter_index) rows name."""
    return chapters.join(wanted, ["book_id", "chapter_index"], "left_semi")


def selector_expand(selector):
    """``1,3-5,9`` as sorted distinct numbers; null if a part is not a number or range from 1 up, or none is left.

    A range of more than MOST_SELECTED numbers is no selection of chapters and gives null too.
    """
    parts = F.filter(F.transform(F.split(selector, ","), lambda p: F.trim(p)), lambda p: p != "")
    sound = F.forall(parts, lambda p: p.rlike("^[0-9]+( *- *[0-9]+)?$"))
    first = lambda p: F.trim(F.split_part(p, F.lit("-"), F.lit(1))).try_cast("int")
    last = lambda p: F.when(p.contains("-"), F.trim(F.split_part(p, F.lit("-"), F.lit(2))).try_cast("int")).otherwise(first(p))
    ranges = F.forall(parts, lambda p: (first(p) > 0) & (last(p) >= first(p)) & (last(p) - first(p) < MOST_SELECTED))
    numbers = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(first(p), F.least(last(p), first(p) + (MOST_SELECTED - 1)))))))
    return F.when(sound & (F.size(parts) > 0), F.when(ranges, numbers))


def selection_rollup(nodes: DataFrame) -> DataFrame:
    """(book_id, path, state) of every contents node and of all nodes above: all, none or some, from the leaves up.

    ``nodes`` are (book_id, path, chapter_index, selected), a path being the ordinals from the root.  Rows that name the same chapter
    move together and are on if any of them is; a node with others below takes its state from the leaves there.  Each leaf is counted
    for all nodes above it in one aggregation, however deep the tree is.
    """
    above = lambda n: F.slice("path", F.lit(1), n)
    inner = nodes.filter(F.size("path") > 1).select("book_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), above)).alias("path")).distinct()
    alias = nodes.filter("chapter_index is not null").groupBy("book_id", "chapter_index").agg(F.bool_or("selected").alias("shared"))
    leaves = nodes.join(inner, ["book_id", "path"], "left_anti").join(alias, ["book_id", "chapter_index"], "left")
    leaves = leaves.select("book_id", "path", F.coalesce("shared", "selected").alias("on"))
    each = leaves.select("book_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), above)).alias("path"), "on")
    state = F.when(F.bool_and("on"), "all").when(F.bool_or("on"), "some").otherwise("none")
    return each.groupBy("book_id", "path").agg(state.alias("state"))
