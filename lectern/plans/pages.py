"""Page queries: blocks, headings, navigation, metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import markup
from lectern.functions.text import collapse_ws
from lectern.plans.tables import table
from lectern.schemas import CHAPTER_PREFIX, DEFAULT_LANGUAGE, DROPPED, UNKNOWN_TITLE


def html_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(markup.html_blocks(F.col("html"))).alias("pos", "block"))


def nav_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(markup.nav_links(F.col("html"))).alias("pos", "link")).select("page_id", "pos", "link.depth", F.array_join(F.transform("link.node", lambda n: n.cast("string")), ".").alias("node"), "link.href", "link.title")


def title_fallback(spark, d):
    bare = F.when(F.col("page_id") % 4 == 0, F.regexp_replace("html", r"(?is)<h1.*?</h1>|<title.*?</title>", "")).when(F.col("page_id") % 4 == 1, F.regexp_replace("html", r"(?is)<h1.*?</h1>", "<h1> </h1>")).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.coalesce(markup.heading(bare), F.concat(F.lit(CHAPTER_PREFIX), F.col("page_id"))).alias("title"))


def metadata_fallback(spark, d):
    title = F.nullif(collapse_ws(F.when(F.col("page_id") % 3 > 0, F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).otherwise(" \t ")), F.lit(""))
    lang = F.nullif(F.regexp_extract("html", r"(?i)<html lang=\"([a-z]*)\"", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", F.coalesce(title, F.lit(UNKNOWN_TITLE)).alias("title"), F.coalesce(lang, F.lit(DEFAULT_LANGUAGE)).alias("language"))


QUERIES = {"a3_nav_links": nav_links, "a5_html_blocks": html_blocks, "c3_title_fallback": title_fallback, "c4_metadata_fallback": metadata_fallback}

_DECODE = "{x}"
for _name, _code in (("lt", 60), ("gt", 62), ("quot", 34), ("#39", 39), ("apos", 39), ("nbsp", 160), ("middot", 183), ("copy", 169), ("amp", 38)):  # those that pages hold, the ampersand last
    _DECODE = f"replace({_DECODE}, '&{_name};', chr({_code}))"


def _inline(x: str) -> str:
    bare = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({_DECODE.format(x=bare)}, '\s+', ' ', 'g'))"


def _kept(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in DROPPED:
        x = rf"regexp_replace({x}, '(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>', ' ', 'g')"
    return x


_FIRST = ", ".join(_named for _named in (f"nullif({_inline(rf'regexp_extract(k, ' + chr(39) + rf'(?is)<{t}(?:\s[^>]*)?>(.*?)</{t}\s*>' + chr(39) + ', 1)')}, '')" for t in ("h1", "h2", "h3", "title")))
_TOKENS = r"'(?is)(<[ou]l(?:\s[^>]*)?>|</[ou]l\s*>|<a\s[^>]*>.*?</a\s*>)'"

ORACLES = {
    "a5_html_blocks": rf"""WITH k AS (SELECT page_id, {_kept('html')} AS k FROM pages), s AS (SELECT page_id, k, regexp_split_to_array(k, '{markup.BLOCK_OPEN}')[2:] AS ps FROM k),
      b AS (SELECT page_id, k, list_filter(list_transform(ps, lambda p: {_inline(f"regexp_split_to_array(p, '{markup.BLOCK_CLOSE}')[1]")}), lambda b: b <> '') AS bs FROM s),
      f AS (SELECT page_id, CASE WHEN len(bs) > 0 THEN bs ELSE list_filter([{_inline('k')}], lambda b: b <> '') END AS bs FROM b)
      SELECT page_id, CAST(unnest(range(0, len(bs))) AS INTEGER) AS pos, unnest(bs) AS block FROM f""",
    "a3_nav_links": rf"""WITH n AS (SELECT page_id, regexp_extract(html, '(?is)<nav(?:\s[^>]*)?>(.*?)</nav\s*>', 1) AS nav FROM pages),
      t AS (SELECT page_id, unnest(range(0, len(ts))) AS i, unnest(ts) AS t FROM (SELECT page_id, regexp_extract_all(nav, {_TOKENS}) AS ts FROM n)),
      d AS (SELECT *, sum(CASE WHEN regexp_matches(t, '(?i)^</[ou]l') THEN -1 WHEN regexp_matches(t, '(?i)^<[ou]l') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, CAST(depth AS INTEGER) AS depth,
        CASE WHEN depth = 1 THEN CAST(count(*) FILTER (depth = 1) OVER (PARTITION BY page_id ORDER BY i) - 1 AS VARCHAR) END AS node,
        {_DECODE.format(x="regexp_extract(t, '(?is)[ ]href=.([^" + chr(34) + "]*)', 1)")} AS href, {_inline('t')} AS title FROM d WHERE regexp_matches(t, '(?i)^<a')""",
    "c3_title_fallback": rf"""WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(html, '(?is)<h1.*?</h1>|<title.*?</title>', '', 'g') WHEN 1 THEN regexp_replace(html, '(?is)<h1.*?</h1>', '<h1> </h1>', 'g') ELSE html END AS html FROM pages),
      k AS (SELECT page_id, {_kept('html')} AS k FROM b) SELECT page_id, coalesce({_FIRST}, 'Bolum ' || page_id) AS title FROM k""",
    "c4_metadata_fallback": r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(CASE WHEN page_id % 3 > 0 THEN regexp_extract(html, '(?is)<title>(.*?)</title>', 1) ELSE '' END, '\s+', ' ', 'g')), ''), 'Bilinmeyen Kitap') AS title,
      coalesce(nullif(regexp_extract(html, '(?i)<html lang="([a-z]*)"', 1), ''), 'tr') AS language FROM pages""",
}
