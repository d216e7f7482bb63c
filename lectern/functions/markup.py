"""HTML pages as text columns, inside the JVM: one expression finds the tags, a fold keeps the open elements.

``narratable`` gives a page with bare tags and without what is not read out; all else works on that.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse_ws
from lectern.schemas import DROPPED

BLOCK_OPEN = r"(?i)<(?:p|blockquote|li|h[1-4])(?:\s[^>]*)?>"
BLOCK_CLOSE = r"(?i)</(?:p|blockquote|li|h[1-4]|ul|ol|div|article|section|body|html)\s*>"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


#: Entities that most pages hold and no others; one that is none of them.
_COMMON = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\u00a0"}
_RARE = r"&(?!(?:lt|gt|quot|#39|apos|nbsp|amp);)(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: Attributes: quotes count after an equals sign.
_ATTRIBUTES = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+){0,500}+"
#: A comment; a script or style with what is in it; a tag.  What is not closed runs to the end.
_TOKEN = rf"<!--(?s:.*?)(?:-->|\z)|(?i)<(script|style)\b{_ATTRIBUTES}>(?s:.*?)(?:</\1\s*+>|\z)|<[/!?]?[A-Za-z]{_ATTRIBUTES}>"
#: Elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
#: Tokens folded at a time.
_TOKENS_AT_ONCE = 512


def _let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it is named; functions over arrays work out each mention anew."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _named() -> Column:
    """Characters by entity, as the standard library lists them; one literal."""
    names = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'"}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _character(entity: Column) -> Column:
    """What an entity stands for; itself if that is no character."""
    inner = F.substring(F.replace(entity, F.lit(";"), F.lit("")), 3, 9)
    code = F.when(entity.rlike("^&#[xX]"), F.conv(F.substring(inner, 2, 9), 16, 10).cast("long")).when(entity.startswith("&#"), inner.cast("long"))
    sound = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    number = F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    return F.coalesce(number, F.try_element_at(_named(), entity), entity)


def decode_entities(text: Column) -> Column:
    """``text`` with named and numbered entities as characters, each decoded once."""

    def decoded(t: Column) -> Column:
        pieces, found = F.split(t, _ENTITY, -1), F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0))
        rare = F.array_join(F.zip_with(pieces, F.transform(found, _character), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
        common = t
        for entity, character in {**_COMMON, "&amp;": "&"}.items():  # the ampersand last
            common = F.replace(common, F.lit(entity), F.lit(character))
        return F.when(~t.contains("&"), t).when(t.rlike(_RARE), rare).otherwise(common)

    return _let(text, decoded)


def inline_text(html: Column) -> Column:
    """The text of a fragment: tags as blanks, entities decoded, white space collapsed."""
    return collapse_ws(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def _dropped(tags: Column) -> Column:
    """For each of ``tags``, (name, close), "x" if it is in an element that is not read out or begins one, else "k", in one string.

    An end tag closes the innermost open element of its name and all inside; one without such an element closes nothing.
    """
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("out"), F.lit("").alias("marks"))

    def step(a: Column, t: Column) -> Column:
        stack, out, name = a["stack"], a["out"], t["name"]
        from_end = F.array_position(F.reverse(stack), name).cast("int")
        kept = F.size(stack) - from_end  # elements left open by an end tag
        opens = (name != "") & ~t["close"]
        new = F.when(opens, F.array_append(stack, name)).when(t["close"] & (from_end > 0), F.slice(stack, F.lit(1), kept)).otherwise(stack)
        now = F.when(opens & (out == 0) & name.isin(*DROPPED), F.size(stack) + 1).when(t["close"] & (from_end > 0) & (out > kept), 0).otherwise(out)
        return F.struct(new.alias("stack"), now.alias("out"), F.concat(a["marks"], F.when((now > 0) | (out > 0), "x").otherwise("k")).alias("marks"))

    def run(a: Column, at: Column) -> Column:
        begin = F.struct(a["stack"].alias("stack"), a["out"].alias("out"), F.lit("").alias("marks"))
        end = lambda b: F.struct(b["stack"].alias("stack"), b["out"].alias("out"), F.concat(a["marks"], b["marks"]).alias("marks"))
        return F.aggregate(F.slice(tags, at, F.lit(_TOKENS_AT_ONCE)), begin, step, end)

    starts = F.when(F.size(tags) > 0, F.sequence(F.lit(1), F.size(tags), F.lit(_TOKENS_AT_ONCE))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(starts, start, run, lambda a: a["marks"])


def _tag(token: Column) -> Column:
    """The name of a token's tag, lower-cased, and whether it is an end tag; no name for what opens nothing."""
    name = F.lower(F.regexp_extract(token, r"^</?([A-Za-z][^\s/>]*)", 1))
    close = token.startswith("</")
    empty = (~close & (name.isin(*VOID) | token.endswith("/>"))) | name.isin("script", "style")
    return F.struct(F.when(empty, "").otherwise(name).alias("name"), close.alias("close"), F.when(name.isin("script", "style"), "").otherwise(name).alias("shown"))


def narratable(html: Column) -> Column:
    """A page with bare tags, without comments and the elements that are not read out, whatever is in their attributes.

    An element that is not closed ends with the one around it, a script or comment with the page.
    """
    plain = lambda piece: F.replace(piece, F.lit("<"), F.lit("&lt;"))

    def shown(m: Column, piece: Column) -> Column:
        t = m["tag"]
        bare = F.when(t["shown"] == "", " ").otherwise(F.concat(F.when(t["close"], "</").otherwise("<"), t["shown"], F.lit(">")))
        return F.when(m["mark"] == "x", " ").otherwise(F.concat(bare, plain(piece)))

    def joined(tags: Column, pieces: Column) -> Column:
        marked = F.zip_with(tags, F.split(_dropped(tags), ""), lambda t, m: F.struct(t.alias("tag"), m.alias("mark")))
        marked = F.slice(marked, F.lit(1), F.size(tags))
        return F.concat(plain(F.get(pieces, F.lit(0))), F.array_join(F.zip_with(marked, F.slice(pieces, F.lit(2), F.size(tags)), shown), ""))

    tags = F.transform(F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0)), _tag)
    return _let(tags, lambda ts: _let(F.split(html, _TOKEN, -1), lambda ps: joined(ts, ps)))


def html_blocks(html: Column) -> Column:
    """The texts of the page's blocks in order, empty ones dropped; the whole text if it has no block.

    A block runs from its opening tag to the next block's, or to the first tag that closes a block, so nested
    and unclosed blocks give each text once.
    """
    full = lambda texts: F.filter(texts, lambda b: b != "")

    def blocks(kept: Column) -> Column:
        pieces = F.split(kept, BLOCK_OPEN, -1)
        inner = F.transform(F.slice(pieces, F.lit(2), F.lit(1 << 30)), lambda p: inline_text(F.get(F.split(p, BLOCK_CLOSE, 2), F.lit(0))))
        return _let(full(inner), lambda bs: F.when(F.size(bs) > 0, bs).otherwise(full(F.array(inline_text(kept)))))

    return _let(narratable(html), blocks)


def heading(html: Column) -> Column:
    """The text of the first h1, else h2, h3 or title that is not empty; null if all are."""
    text = lambda kept, tag: F.nullif(inline_text(F.regexp_extract(kept, rf"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))
    return _let(narratable(html), lambda kept: F.coalesce(*(text(kept, tag) for tag in ("h1", "h2", "h3", "title"))))


def nav_part(html: Column) -> Column:
    """The contents list of a page: the first nav that says it is one, else the first nav."""
    named = F.regexp_extract(html, r"(?is)<nav\s[^>]*(?:type|role)\s*=\s*[\"'][^\"']*toc[^\"']*[\"'][^>]*>(.*?)</nav\s*>", 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(html, r"(?is)<nav(?:\s[^>]*)?>(.*?)</nav\s*>", 1))


def nav_links(html: Column) -> Column:
    """(depth, node, href, title) of every link in a page's contents list, in order.

    The list is cut at its list tags and links; the depth is the number of lists open at that point.  ``node`` is the path of
    ordinals from 0 of the link: a list's links are below the link before the list, -1 if there is none.
    """
    tokens = F.regexp_extract_all(nav_part(html), F.lit(r"(?is)(<[ou]l(?:\s[^>]*)?>|</[ou]l\s*>|<a\s[^>]*>.*?</a\s*>)"), F.lit(1))
    step = lambda t: F.when(t.rlike(r"(?i)^</[ou]l"), -1).when(t.rlike(r"(?i)^<[ou]l"), 1).otherwise(0)
    links = F.expr("cast(array() as array<struct<depth:int,node:array<int>,href:string,title:string>>)")
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit(0)).alias("counts"), links.alias("links"))

    def add(a: Column, t: Column) -> Column:
        counts, depth, by = a["counts"], F.greatest(a["depth"] + step(t), F.lit(0)), step(t)
        size = F.size(counts)
        node = F.transform(counts, lambda c, i: F.when(i + 1 < size, c - 1).otherwise(c))
        link = F.struct(a["depth"].alias("depth"), node.alias("node"), decode_entities(F.regexp_extract(t, r"(?is)\shref\s*=\s*[\"']([^\"']*)", 1)).alias("href"), inline_text(t).alias("title"))
        counted = F.transform(counts, lambda c, i: F.when(i + 1 == size, c + 1).otherwise(c))  # links so far in each open list
        opened = F.when(a["depth"] > 0, F.array_append(counts, F.lit(0))).otherwise(counts)
        closed = F.when(size > 1, F.slice(counts, F.lit(1), size - 1)).otherwise(counts)
        counts = F.when(by == 0, counted).when(by == 1, opened).otherwise(closed)
        return F.struct(depth.cast("int").alias("depth"), counts.alias("counts"), F.when(by == 0, F.array_append(a["links"], link)).otherwise(a["links"]).alias("links"))

    return F.aggregate(tokens, start, add, lambda a: a["links"])
