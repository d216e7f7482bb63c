"""Book archives made in memory and read as tables."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.functions.encoding import decoded
from lectern.operators import contents
from lectern.sources import archives as A
from lectern.sources.batches import ARROW_BYTES

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
LONG = "a chapter needs some words to be read"


def book(items, spine, files, meta="", attrs=""):
    out = io.BytesIO()
    opf = (
        f'<package xmlns="http://www.idpf.org/2007/opf"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title> My\n Book </dc:title>{meta}</metadata>'
        f"<manifest>{''.join(f'<item {i}/>' for i in items)}</manifest><spine {attrs}>{''.join(f'<itemref idref={chr(34)}{s}{chr(34)}/>' for s in spine)}</spine></package>"
    )
    with zipfile.ZipFile(out, "w") as z:
        for name, body in {"META-INF/container.xml": CONTAINER, "OEBPS/content.opf": opf, **files}.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("books")
    page = lambda title, text=LONG: f"<html><body><h1>{title}</h1><p>{text}</p></body></html>"
    html = 'media-type="application/xhtml+xml"'
    made = {
        "nav": book(
            [f'id="n" href="nav.xhtml" {html} properties="x nav"', f'id="c1" href="text/c1.xhtml" {html}', f'id="c2" href="text/c%202.xhtml" {html}', f'id="h" href="hidden.xhtml" {html}', 'id="cv" href="c.JPEG" properties="cover-image"'],
            ["c1", "c2", "none"],
            {"OEBPS/nav.xhtml": '<nav><ol><li>no</li></ol></nav><nav epub:type="toc"><ol><li><a href="text/c1.xhtml">One</a><ol><li><a href="text/c%202.xhtml#start">Two &amp; more</a></li></ol></li></ol></nav>', "OEBPS/text/c1.xhtml": page("First"), "OEBPS/text/c 2.xhtml": page("Second"), "OEBPS/hidden.xhtml": page("Hidden"), "OEBPS/c.JPEG": b"jpg"},
        ),
        "ncx": book(
            ['id="t" href="toc.ncx" media-type="application/x-dtbncx+xml"', f'id="c1" href="c1.xhtml" {html}', f'id="c1" href="c1b.xhtml" {html}', f'id="s" href="short.xhtml" {html}', 'id="img" href="img.gif" media-type="image/gif"'],
            ["s", "c1"],
            {"OEBPS/toc.ncx": "<ncx><navMap><navPoint><navLabel><text> Part </text></navLabel><content src='c1b.xhtml#a'/><navPoint><navLabel><text>Deep</text></navLabel><content src='c1b.xhtml#b'/></navPoint></navPoint><navPoint/></navMap></ncx>", "OEBPS/c1.xhtml": page("Old"), "OEBPS/c1b.xhtml": page(""), "OEBPS/short.xhtml": page("S", "tiny"), "OEBPS/img.gif": b"gif"},
            meta='<dc:creator xmlns:dc="http://purl.org/dc/elements/1.1/">Someone</dc:creator><meta name="cover" content="img"/>', attrs='toc="t"',
        ),
        "bad": b"not a zip", "empty": book([], [], {}),
    }
    for name, data in made.items():
        (folder / f"{name}.epub").write_bytes(data)
    (folder / "other.txt").write_text("x")
    rows = A.members(A.read_archives(spark, str(folder)))
    return rows.withColumn("path", F.regexp_extract("path", r"([^/]*)\.epub$", 1)).cache()


def test_members_and_damaged_archives(files):
    assert [(r.path, r.error) for r in files.filter("error is not null").collect()] == [("bad", "BadZipFile")]
    assert files.filter("path = 'nav'").count() == 7


def test_package_tables(files):
    p = A.packages(files)
    assert {(r.path, r.title, r.author, r.language) for r in A.books(p).collect()} >= {("nav", "My Book", "Bilinmeyen Yazar", "tr"), ("ncx", "My Book", "Someone", "tr")}
    items = {(r.path, r.item_id): r for r in A.manifest(p).collect()}
    assert items["ncx", "c1"].member == "OEBPS/c1b.xhtml" and items["nav", "c2"].member == "OEBPS/text/c 2.xhtml" and items["nav", "n"].properties == ["x", "nav"]


def test_chapters(files):
    got = sorted((r.path, r.chapter_index, r.title, r.source_href) for r in A.chapters(files).collect())
    assert got == [("nav", 1, "First", "OEBPS/text/c1.xhtml"), ("nav", 2, "Second", "OEBPS/text/c 2.xhtml"), ("ncx", 1, "Bolum 1", "OEBPS/c1b.xhtml")]


def test_contents_and_selection(files):
    toc = A.contents(files)
    assert {(r.path, r.title, r.href) for r in toc.collect()} == {
        ("nav", "One", "OEBPS/text/c1.xhtml"), ("nav", "Two & more", "OEBPS/text/c 2.xhtml#start"), ("ncx", "Part", "OEBPS/c1b.xhtml#a"), ("ncx", "Deep", "OEBPS/c1b.xhtml#b"),
    }
    rename = lambda df: df.withColumnRenamed("path", "book_id")
    chapters = rename(A.chapters(files))
    mapped = contents.map_toc(rename(toc), chapters)
    assert mapped.filter("chapter_index is null").isEmpty() and contents.default_selection(chapters, mapped).count() == 3


def test_nested_points(files):
    p = A.packages(files)
    points = A.ncx_points(A.ncx_items(p, A.manifest(p)), files).collect()
    assert sorted((r.node_path, r.depth, r.title) for r in points) == [([0], 1, "Part"), ([0, 0], 2, "Deep")]


def test_covers(files):
    p = A.packages(files)
    assert {(r.path, r.suffix, bytes(r.data)) for r in A.covers(p, A.manifest(p), files).collect()} == {("nav", ".jpeg", b"jpg"), ("ncx", ".jpg", b"gif")}


def test_bytes_are_decoded_by_mark_declaration_or_utf8(spark):
    turkish = "İğne, şöyle ığ €"
    cases = [
        ("mark".encode("utf-8-sig"), "mark"), (b"\xff\xfe" + "Ünlü".encode("utf-16-le"), "Ünlü"), (b"\xfe\xff" + "Ünlü".encode("utf-16-be"), "Ünlü"), ("<p>şık".encode("utf-16-le"), "<p>şık"), (b"\xff\xfea\x00b", "a"),
        (b"<?xml version='1.0' encoding='Windows-1254'?><p>" + turkish.encode("cp1254"), f"<?xml version='1.0' encoding='Windows-1254'?><p>{turkish}"),
        (b'<html><meta http-equiv="x" content="text/html; charset=ISO-8859-9"><p>' + "ÇĞŞ".encode("cp1254"), '<html><meta http-equiv="x" content="text/html; charset=ISO-8859-9"><p>ÇĞŞ'),
        (b'<meta charset=latin1>' + "Café – ž".encode("cp1252"), "<meta charset=latin1>Café – ž"), (b"bad \xff byte", "bad � byte"), ("söz".encode(), "söz"), (b"", ""), (None, None),
    ]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, data binary").select("i", decoded(F.col("data")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [w for _, w in cases]


def test_archives_in_other_encodings(spark):
    html = 'media-type="application/xhtml+xml"'
    wide = f"<html><body><h1>Geniş</h1><p>{LONG}</p></body></html>".encode("utf-16")
    narrow = b"<?xml version='1.0' encoding='windows-1254'?><html><body><h1>" + "Şiir".encode("cp1254") + b"</h1><p>" + LONG.encode() + b"</p></body></html>"
    nav = "<html><nav epub:type='toc'><ol><li><a href='a.xhtml'>Öykü</a></li></ol></nav></html>".encode("utf-16")
    made = book([f'id="n" href="nav.xhtml" {html} properties="nav"', f'id="a" href="a.xhtml" {html}', f'id="b" href="b.xhtml" {html}'], ["a", "b"], {"OEBPS/a.xhtml": wide, "OEBPS/b.xhtml": narrow, "OEBPS/nav.xhtml": nav})
    rows = A.members(spark.createDataFrame([("x.epub", made)], "path string, content binary"))
    assert sorted((r.chapter_index, r.title) for r in A.chapters(rows).collect()) == [(1, "Geniş"), (2, "Şiir")]
    assert [(r.title, r.href) for r in A.contents(rows).collect()] == [("Öykü", "OEBPS/a.xhtml")]


def test_archives_reach_python_in_batches_of_bounded_bytes(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting, None)
    spark.conf.unset(setting)
    try:
        big = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("path"), F.encode(F.repeat(F.lit("x"), 2 << 20), "UTF-8").alias("content"))
        opened = A.members(big)
        assert spark.conf.get(setting, None) == f"{ARROW_BYTES}b"
        assert opened.filter("error = 'BadZipFile'").count() == 40
        sizes = [r.n for r in big.mapInArrow(lambda batches: (pa.RecordBatch.from_pylist([{"n": b.nbytes}]) for b in batches), "n long").collect()]
        assert sum(sizes) > 40 * (2 << 20) and max(sizes) < ARROW_BYTES + (3 << 20)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
