"""Archive queries: pages are packed into book archives, which are then read like any others."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from lectern.plans.tables import table
from lectern.sources import archives as A

PAGES_PER_BOOK = 20


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One archive of at most PAGES_PER_BOOK pages; books differ in how they name contents and cover, and some have no cover."""
    pdf = pdf.sort_values("page_id")
    out, ids, number = io.BytesIO(), pdf["page_id"].tolist(), int(pdf["number"].iloc[0])
    ncx, up = ("toc.ncx", "") if number % 2 == 0 else ("nav/t.ncx", "../")
    cover = {0: ("cv", "c.PNG", "image/png", ""), 1: ("img", "art/c.jpeg", "image/jpeg", ' properties="cover-image"')}.get(number % 3)
    items = "".join(f'<item id="p{i}" href="text/p{i}.xhtml" media-type="application/xhtml+xml"/>' for i in ids)
    if cover:
        items = f'<item id="{cover[0]}" href="{cover[1]}" media-type="{cover[2]}"{cover[3]}/>' + items
    points = "".join(f'<navPoint><navLabel><text>Page {i}</text></navLabel><content src="{up}text/p{i}.xhtml#top"/><navPoint><navLabel><text>Part of {i}</text></navLabel><content src="{up}text/p{i}.xhtml#part"/></navPoint></navPoint>' for i in ids)
    opf = (
        f'<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{escape(pdf["book"].iloc[0])}</dc:title><dc:language>xx</dc:language><meta name="cover" content="{"cv" if number % 3 == 0 else "gone"}"/></metadata>'
        f'<manifest><item id="ncx" href="{ncx}" media-type="{A.NCX_TYPE}"/>{items}</manifest>'
        f'<spine{" toc=" + chr(34) + "ncx" + chr(34) if number % 2 == 0 else ""}>{"".join(f"<itemref idref={chr(34)}p{i}{chr(34)}/>" for i in ids)}<itemref idref="gone"/></spine></package>'
    )
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in (
            (A.CONTAINER, '<container><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'),
            ("OEBPS/content.opf", opf), (f"OEBPS/{ncx}", f"<ncx><navMap>{points}</navMap></ncx>"), *([(f"OEBPS/{cover[1]}", f"cover {number}")] if cover else []),
            *((f"OEBPS/text/p{i}.xhtml", html or "") for i, html in zip(ids, pdf["html"])),
        ):
            z.writestr(zipfile.ZipInfo(name), body)
    return pd.DataFrame({"path": [pdf["book"].iloc[0] + ".epub"], "content": [out.getvalue()]})


def _files(spark, d):
    number = F.floor(F.col("page_id") / PAGES_PER_BOOK)
    packed = table(spark, d, "pages").select("page_id", "html", number.alias("number"), F.format_string("books/b%d", number).alias("book")).groupBy("book").applyInPandas(_pack, "path string, content binary")
    return A.members(packed)


def archive_members(spark, d):
    return _files(spark, d).select("path", "member", F.octet_length("data").alias("bytes"))


def _with(spark, d, make):
    files = _files(spark, d)
    pkgs = A.packages(files)
    return make(files, pkgs, A.manifest(pkgs))


QUERIES = {
    "a1_archive_members": archive_members,
    "a2_opf_tables": lambda s, d: _with(s, d, lambda f, p, m: m.select("path", "item_id", "href", "media_type", "member")),
    "a4_ncx_points": lambda s, d: _with(s, d, lambda f, p, m: A.ncx_points(A.ncx_items(p, m), f).select("path", F.array_join(F.transform("node_path", lambda n: n.cast("string")), ".").alias("node"), "depth", "title", "href")),
    "d1_spine_manifest": lambda s, d: _with(s, d, lambda f, p, m: A.spine_manifest(A.spine(p), m).select("path", "spine_pos", "item_id", "member")),
    "d2_member_lookup": lambda s, d: _with(s, d, lambda f, p, m: A.member_lookup(A.spine_manifest(A.spine(p), m), f).select("path", "spine_pos", "member", F.sha2("data", 256).alias("sha256"))),
    "d12_cover_pick": lambda s, d: _with(s, d, lambda f, p, m: A.covers(p, m, f).select("path", "suffix", F.octet_length("data").alias("bytes"))),
    "d13_ncx_pick": lambda s, d: _with(s, d, lambda f, p, m: A.ncx_items(p, m).select("path", "member")),
    "a1_book_chapters": lambda s, d: A.chapters(_files(s, d)),
}

_B = f"b AS (SELECT page_id, coalesce(html, '') AS html, page_id // {PAGES_PER_BOOK} AS number, 'books/b' || (page_id // {PAGES_PER_BOOK}) || '.epub' AS path, row_number() OVER (PARTITION BY page_id // {PAGES_PER_BOOK} ORDER BY page_id) - 1 AS i FROM pages)"
_P = f"WITH {_B}, p AS (SELECT DISTINCT path, number, CASE WHEN number % 2 = 0 THEN 'toc.ncx' ELSE 'nav/t.ncx' END AS ncx FROM b)"

ORACLES = {
    "a2_opf_tables": f"""{_P} SELECT path, 'p' || page_id AS item_id, 'text/p' || page_id || '.xhtml' AS href, 'application/xhtml+xml' AS media_type, 'OEBPS/text/p' || page_id || '.xhtml' AS member FROM b
      UNION ALL SELECT path, 'cv', 'c.PNG', 'image/png', 'OEBPS/c.PNG' FROM p WHERE number % 3 = 0 UNION ALL SELECT path, 'img', 'art/c.jpeg', 'image/jpeg', 'OEBPS/art/c.jpeg' FROM p WHERE number % 3 = 1
      UNION ALL SELECT path, 'ncx', ncx, 'application/x-dtbncx+xml', 'OEBPS/' || ncx FROM p""",
    "a4_ncx_points": f"""WITH {_B} SELECT path, CAST(i AS VARCHAR) AS node, 1 AS depth, 'Page ' || page_id AS title, 'OEBPS/text/p' || page_id || '.xhtml#top' AS href FROM b
      UNION ALL SELECT path, i || '.0', 2, 'Part of ' || page_id, 'OEBPS/text/p' || page_id || '.xhtml#part' FROM b""",
    "d1_spine_manifest": f"WITH {_B} SELECT path, CAST(i AS INTEGER) AS spine_pos, 'p' || page_id AS item_id, 'OEBPS/text/p' || page_id || '.xhtml' AS member FROM b",
    "d2_member_lookup": f"WITH {_B} SELECT path, CAST(i AS INTEGER) AS spine_pos, 'OEBPS/text/p' || page_id || '.xhtml' AS member, sha256(html) AS sha256 FROM b",
    "d12_cover_pick": f"{_P} SELECT path, CASE WHEN number % 3 = 0 THEN '.png' ELSE '.jpeg' END AS suffix, CAST(length('cover ' || number) AS INTEGER) AS bytes FROM p WHERE number % 3 < 2",
    "d13_ncx_pick": f"{_P} SELECT path, 'OEBPS/' || ncx AS member FROM p",
}
