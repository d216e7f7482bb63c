"""Book archives: members, package tables, contents and covers, for many books at once.

``archives`` are (path, content) rows, as Spark's binaryFile source gives them.  Only unpacking runs in
Python, an archive at a time out of batches of bounded bytes; everything after it is columns.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.encoding import decoded
from lectern.functions.markup import heading, html_blocks, nav_links
from lectern.functions.paths import resolve_href, strip_fragment, suffix_pick
from lectern.functions.text import collapse_ws, strip
from lectern.operators.ordered import numbered, position_bucket
from lectern.schemas import CHAPTER_PREFIX, DEFAULT_LANGUAGE, MIN_CHAPTER_CHARS, NO_TITLE, UNKNOWN_AUTHOR
from lectern.sources.batches import for_python

CONTAINER = "META-INF/container.xml"
NCX_TYPE, NCX_DEPTH = "application/x-dtbncx+xml", 6
XML = {"ignoreNamespace": "true", "mode": "PERMISSIVE"}
_CONTAINER = "rootfiles struct<rootfile:array<struct<`_full-path`:string>>>"
_PACKAGE = (
    "metadata struct<title:array<string>,creator:array<string>,language:array<string>,meta:array<struct<_name:string,_content:string>>>,"
    "manifest struct<item:array<struct<_id:string,_href:string,`_media-type`:string,_properties:string>>>,"
    "spine struct<_toc:string,itemref:array<struct<_idref:string>>>"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def members(archives: DataFrame) -> DataFrame:
    """(path, member, data, error) of every file in every archive; one row with an error for those that do not open."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(path, n, z.read(n), None) for n in z.namelist() if not n.endswith("/")]
                except (zipfile.BadZipFile, TypeError, RuntimeError) as e:
                    rows = [(path, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=["path", "member", "data", "error"])

    return for_python(archives.select("path", "content")).mapInPandas(run, "path string, member string, data binary, error string")


def packages(files: DataFrame) -> DataFrame:
    """(path, opf_path, p): the parsed package of every archive that has one."""
    text = decoded(F.col("data"))
    roots = files.filter(F.col("member") == CONTAINER).select("path", F.from_xml(text, _CONTAINER, XML).alias("c"))
    roots = roots.select("path", F.get("c.rootfiles.rootfile", F.lit(0))["_full-path"].alias("member")).filter("member is not null")
    parsed = files.join(roots, ["path", "member"]).select("path", F.col("member").alias("opf_path"), F.from_xml(text, _PACKAGE, XML).alias("p"))
    return parsed.filter(F.col("p").isNotNull())


def books(pkgs: DataFrame) -> DataFrame:
    """(path, title, author, language) with the fallbacks for what is missing."""
    first = lambda c: F.nullif(collapse_ws(F.get(f"p.metadata.{c}", F.lit(0))), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    return pkgs.select("path", F.coalesce(first("title"), stem).alias("title"), F.coalesce(first("creator"), F.lit(UNKNOWN_AUTHOR)).alias("author"), F.coalesce(first("language"), F.lit(DEFAULT_LANGUAGE)).alias("language"))


def manifest(pkgs: DataFrame) -> DataFrame:
    """(path, item_id, href, media_type, properties, member, pos); of equal ids the last one counts."""
    rows = pkgs.select("path", "opf_path", F.posexplode("p.manifest.item").alias("pos", "i")).filter("i._id <> '' and i._href <> ''")
    item = F.struct("pos", F.col("i._href").alias("href"), F.coalesce("i._media-type", F.lit("")).alias("media_type"), F.split(F.trim(F.coalesce("i._properties", F.lit(""))), r"\s+").alias("properties"), resolve_href(F.col("opf_path"), F.col("i._href")).alias("member"))
    return rows.groupBy("path", F.col("i._id").alias("item_id")).agg(F.max_by(item, "pos").alias("x"), F.min("pos").alias("at")).select("path", "item_id", "x.href", "x.media_type", "x.properties", "x.member", F.col("at").alias("pos"))


def spine(pkgs: DataFrame) -> DataFrame:
    """(path, spine_pos, item_id) in reading order."""
    return pkgs.select("path", F.posexplode("p.spine.itemref").alias("spine_pos", "r")).select("path", "spine_pos", F.col("r._idref").alias("item_id")).filter("item_id <> ''")


def spine_manifest(spine_rows: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """The spine with its manifest items; references to nothing go."""
    return spine_rows.join(manifest_rows.drop("pos"), ["path", "item_id"])


def member_lookup(items: DataFrame, files: DataFrame) -> DataFrame:
    return items.join(files.select("path", "member", "data"), ["path", "member"])


def readable(items: DataFrame) -> DataFrame:
    return items.filter(F.col("media_type").contains("html") | F.lower("href").rlike(r"\.(xhtml|html|htm)$"))


def chapters(files: DataFrame) -> DataFrame:
    """(path, chapter_index, title, text, source_href) of every archive's readable spine documents."""
    pkgs = packages(files)
    html = F.col("html")
    docs = member_lookup(readable(spine_manifest(spine(pkgs), manifest(pkgs))), files)
    rows = docs.withColumn("html", decoded(F.col("data"))).select("path", "spine_pos", F.col("member").alias("source_href"), heading(html).alias("heading"), F.array_join(html_blocks(html), "\n\n").alias("text"))
    rows = numbered(rows.filter(F.length(strip(F.col("text"))) >= MIN_CHAPTER_CHARS), ["path"], position_bucket(F.col("spine_pos")), ["spine_pos"], "chapter_index")
    return rows.select("path", "chapter_index", F.coalesce("heading", F.concat(F.lit(CHAPTER_PREFIX), "chapter_index")).alias("title"), "text", "source_href")


def pick(pkgs: DataFrame, manifest_rows: DataFrame, wanted, fallback) -> DataFrame:
    """Per archive the manifest item with the ``wanted`` id, else the first that meets ``fallback``."""
    named = pkgs.select("path", wanted.alias("item_id")).join(manifest_rows, ["path", "item_id"]).select("path", F.struct("pos", "href", "media_type", "member").alias("named"))
    first = manifest_rows.filter(fallback).groupBy("path").agg(F.min_by(F.struct("pos", "href", "media_type", "member"), "pos").alias("first"))
    return named.join(first, "path", "full").select("path", F.coalesce("named", "first").alias("x")).select("path", "x.href", "x.media_type", "x.member")


def covers(pkgs: DataFrame, manifest_rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, suffix, data) of every archive's cover."""
    named = F.get(F.filter("p.metadata.meta", lambda m: (m["_name"] == "cover") & (m["_content"] != "")), F.lit(0))["_content"]
    chosen = pick(pkgs, manifest_rows, named, F.array_contains("properties", "cover-image"))
    return member_lookup(chosen, files).select("path", suffix_pick(F.col("href"), F.col("media_type")).alias("suffix"), "data")


def ncx_items(pkgs: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    return pick(pkgs, manifest_rows, F.col("p.spine._toc"), F.col("media_type") == NCX_TYPE)


def _ncx_schema(depth: int) -> str:
    inner = f",navPoint:array<{_ncx_schema(depth - 1)}>" if depth > 1 else ""
    return f"struct<navLabel:struct<text:string>,content:struct<_src:string>{inner}>"


def _titled(level, depth: int, has_kids: bool):
    """The points of a level that have a title or points below them."""

    def title(e):
        return F.nullif(collapse_ws(e["x"]["navLabel"]["text"]), F.lit(""))

    shown = F.filter(level, lambda e: title(e).isNotNull() | (e["x"]["navPoint"].isNotNull() if has_kids else F.lit(False)))
    return F.transform(shown, lambda e: F.struct(e["at"].alias("node_path"), F.lit(depth).alias("depth"), F.coalesce(title(e), F.lit(NO_TITLE)).alias("title"), e["x"]["content"]["_src"].alias("src")))


def _next_level(level):
    def below(e):
        return F.transform(e["x"]["navPoint"], lambda c, i: F.struct(F.array_append(e["at"], i).alias("at"), c.alias("x")))

    return F.flatten(F.filter(F.transform(level, below), lambda kids: kids.isNotNull()))


def ncx_points(items: DataFrame, files: DataFrame, depth: int = NCX_DEPTH) -> DataFrame:
    """(path, node_path, depth, title, href) of every navigation point, level by level."""
    docs = member_lookup(items, files).select("path", "member", F.from_xml(decoded(F.col("data")), f"navMap struct<navPoint:array<{_ncx_schema(depth)}>>", XML).alias("n"))
    level = F.transform("n.navMap.navPoint", lambda x, i: F.struct(F.array(i).alias("at"), x.alias("x")))
    levels = []
    for n in range(1, depth + 1):  # the points of a level stay in their book's row until all levels are there
        levels.append(_titled(level, n, n < depth))
        if n < depth:
            level = _next_level(level)
    none = F.expr("cast(array() as array<struct<node_path:array<int>,depth:int,title:string,src:string>>)")
    rows = docs.select("path", "member", F.explode(F.concat(*(F.coalesce(x, none) for x in levels))).alias("e"))
    return rows.select("path", "e.node_path", "e.depth", "e.title", F.coalesce(resolve_href(F.col("member"), F.col("e.src")), F.lit("")).alias("href"))


def nav_entries(items: DataFrame, files: DataFrame) -> DataFrame:
    """(path, pos, depth, title, href) of every link of the archives' navigation documents."""
    docs = member_lookup(items, files).select("path", "member", decoded(F.col("data")).alias("html")).select("path", "member", F.posexplode(nav_links(F.col("html"))).alias("pos", "l"))
    return docs.select("path", "pos", "l.depth", "l.title", resolve_href(F.col("member"), F.col("l.href")).alias("href"))


def contents(files: DataFrame) -> DataFrame:
    """(path, title, href, document): the navigation document's entries, or the NCX points of archives without any."""
    pkgs = packages(files)
    items = manifest(pkgs)
    nav = pick(pkgs, items, F.lit(None).cast("string"), F.array_contains("properties", "nav"))
    entries = nav_entries(nav, files).select("path", "title", "href")
    points = ncx_points(ncx_items(pkgs, items), files).select("path", "title", "href").join(entries.select("path").distinct(), "path", "left_anti")
    return entries.unionByName(points).withColumn("document", strip_fragment(F.col("href")))
