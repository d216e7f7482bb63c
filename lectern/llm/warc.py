"""WARC archives: written as Spark text files, read back with verified record boundaries.

Writing: every row is a record; the text sink's line separator is the blank line that ends a record.  Of
records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is a response,
the others are revisits that name it.  Payloads are compared by SHA-256 and never gathered; which digests
repeat is broadcast while few do, and joined with the payloads spread over all tasks beyond that.

Reading: the text source splits the files at the record magic, in as many tasks as there are blocks, so a
piece begins after each magic, also after one inside a payload.  Each piece with a readable header is a
candidate that says where its successor starts.  Candidates that follow each other exactly are one run; over
the runs, pointers are doubled from each file's start until nothing new is reached, and only candidates on
that chain are records.  A record whose payload holds the magic is put together from its pieces, which a second
read of its file finds by their byte offsets.  Archives of other writers are read too, gzipped ones as Spark
reads them, one task a file.

A null payload is empty; a null id is written as an empty one and never the response of others, unless all
of them have none.  Repeated rows with the smallest id are all responses.  Line ends and magics in a URL are
escaped.
No row gives no record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import BROADCAST_ROWS, join_spread, new_path, settle, table

MAGIC, BREAK = "WARC/1.", "\r\n\r\n"
REVISIT_BYTES = 100
RECORDS_PER_FILE = 50_000


def _one_line(url):
    """A URL that cannot end a header line and does not hold the magic."""
    for plain, escaped in (("\r", "%0D"), ("\n", "%0A"), (MAGIC, MAGIC.replace("/", "%2F"))):
        url = F.replace(url, F.lit(plain), F.lit(escaped))
    return url


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write ``pages`` as uncompressed WARC files under ``path``."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    copies = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    copies = settle(copies, "warc-copies")
    if copies.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(copies), "digest", "left")
    else:
        rows = join_spread(rows, copies, ["digest"], "n", F.xxhash64("id", "url"))
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    sent = F.when(again, "").otherwise(F.col("body"))
    header = F.concat(
        F.lit(MAGIC + "1\r\nWARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "'\r\nWARC-Date: 'yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Record-ID: <urn:record:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _one_line(F.col("url"))), F.lit("")),
        F.when(again, F.concat(F.lit("\r\nWARC-Refers-To: <urn:record:"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("size").cast("string"),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(sent).cast("string"), F.lit(BREAK),
    )
    rows.select(F.concat(header, sent).alias("value")).write.option("lineSep", BREAK).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, n, value): what lies between magics; n orders the pieces of a block."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value")


def _placed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``start``, the byte of its file at which the magic before a piece begins, whatever tasks read it."""
    step = F.octet_length("value").cast("long") + len(MAGIC) if "value" in pieces.columns else F.col("bytes") + len(MAGIC)
    blocks = pieces.groupBy("file", "block").agg(F.sum(step).alias("total"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.coalesce(F.sum("total").over(ahead), F.lit(0).cast("long")).alias("base"))
    inside = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.withColumn("offset", F.coalesce(F.sum(step).over(inside), F.lit(0).cast("long"))).join(blocks, ["file", "block"])
    return rows.withColumn("start", F.col("base") + F.col("offset") - len(MAGIC)).drop("base", "offset")


def _field(header, name: str):
    return F.nullif(F.regexp_extract(header, rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A settled row for each piece: its offset in the file and what its header, if it is one, says."""
    rows = _pieces(spark, path)
    header = F.substring_index("value", BREAK, 1)
    rows = rows.withColumn("bytes", F.octet_length("value").cast("long")).withColumn("header", F.when(F.col("value").rlike(r"^[01]\r\n") & F.contains("value", F.lit(BREAK)), header))
    head = F.col("header")
    rows = rows.withColumn("length", F.expr("try_cast(nullif(regexp_extract(header, '(?i)\\\\r\\\\nContent-Length: *([0-9]+)', 1), '') as bigint)")).withColumn("head_bytes", F.octet_length(head).cast("long") + len(BREAK))
    whole = F.col("head_bytes") + F.col("length") <= F.col("bytes")
    body = F.expr("substring(cast(value as binary), cast(head_bytes + 1 as int), cast(length as int))")
    rows = rows.select(
        "file", "block", "n", "bytes", "length", "head_bytes",
        F.when(whole, F.sha2(body, 256)).alias("digest"),
        F.regexp_extract(head, r"(?i)\r\nWARC-Record-ID: *<(?:urn:record:)?([^>\r\n]*)>", 1).alias("id"),
        F.lower(_field(head, "WARC-Type")).alias("type"),
        _field(head, "WARC-Target-URI").alias("uri"),
        F.nullif(F.regexp_extract(head, r"(?i)\r\nWARC-Refers-To: *<(?:urn:record:)?([^>\r\n]*)>", 1), F.lit("")).alias("refers_to"),
        F.regexp_extract(head, r"(?i)\r\nWARC-Payload-Digest: *sha256:([0-9a-f]*)", 1).alias("said_digest"),
        F.expr("try_cast(regexp_extract(header, '(?i)\\\\r\\\\nWARC-Payload-Length: *([0-9]+)', 1) as bigint)").alias("said_bytes"),
    )
    rows = _placed(settle(rows, "warc-pieces"))
    return settle(rows.withColumn("next", F.col("start") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(BREAK)), "warc-candidates")


def reachable(found: DataFrame) -> DataFrame:
    """The rows of ``candidates`` on the chain of records from their file's start."""
    order = Window.partitionBy("file", "block").orderBy("start")
    chained = found.filter(F.col("next").isNotNull() & (F.col("start") >= 0))
    chained = chained.withColumn("new", (~F.lag("next").over(order).eqNullSafe(F.col("start"))).cast("int"))
    chained = chained.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chained = settle(chained.withColumn("run", F.min("start").over(Window.partitionBy("file", "block", "run"))).drop("new"), "warc-runs")

    exits = chained.groupBy("file", "run").agg(F.max("next").alias("exit"))
    landing = chained.select("file", F.col("start").alias("exit"), F.col("run").alias("to"))
    jump = settle(exits.join(landing, ["file", "exit"]).select("file", "run", "to", "exit"), "warc-jumps")
    first, links = jump, jump.select("file", "run", "to")
    reached = settle(chained.filter("start = 0").select("file", F.lit(0).cast("long").alias("run")), "warc-reached")
    known, before = reached.count(), -1
    while known > before:
        further = reached.join(links, ["file", "run"]).select("file", F.col("to").alias("run"))
        reached = settle(reached.unionAll(further).distinct(), "warc-reached")
        links = settle(links.alias("a").join(links.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("a.to") == F.col("b.run"))).select("a.file", "a.run", "b.to"), "warc-links")
        known, before = reached.count(), known
    entered = first.join(reached, ["file", "run"]).groupBy("file", F.col("to").alias("run")).agg(F.min("exit").alias("entry"))
    entered = entered.unionByName(reached.filter("run = 0").select("file", "run", F.lit(0).cast("long").alias("entry"))).groupBy("file", "run").agg(F.min("entry").alias("entry"))
    return chained.join(entered, ["file", "run"]).filter(F.col("start") >= F.col("entry")).drop("entry", "run")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, uri, refers_to, said_digest, said_bytes, length, digest) of every record under ``path``."""
    found = candidates(spark, path)
    records = settle(reachable(found), "warc-records")
    split = records.filter("digest is null").select("file", "start", "next", "length", "head_bytes")
    if not split.isEmpty():  # payloads that hold the magic
        marks = found.select("file", F.col("start").alias("piece")).join(split.select("file").distinct(), "file", "left_semi")
        owners = records.select("file", F.col("start").alias("piece"), F.col("start").alias("owner"), F.col("digest").isNull().alias("open"))
        last = Window.partitionBy("file").orderBy("piece").rowsBetween(Window.unboundedPreceding, 0)
        marks = marks.join(owners, ["file", "piece"], "left")
        marks = marks.withColumn("open", F.last("open", True).over(last)).withColumn("start", F.last("owner", True).over(last)).filter("open")
        marks = settle(marks.select("file", "piece", "start"), "warc-marks")
        again = _pieces(spark, path).join(marks.select("file").distinct(), "file", "left_semi")
        parts = _placed(again).withColumnRenamed("start", "piece").join(marks, ["file", "piece"])
        joined = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("piece", "value"))).alias("parts"))
        joined = joined.join(split, ["file", "start"]).withColumn("all", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC))
        body = F.expr("substring(cast(`all` as binary), cast(head_bytes + 1 as int), cast(length as int))")
        whole = joined.filter(F.octet_length("all") >= F.col("head_bytes") + F.col("length")).select("file", "start", F.sha2(body, 256).alias("rest"))
        records = records.join(whole, ["file", "start"], "left").withColumn("digest", F.coalesce("digest", "rest")).drop("rest")
    return records.select("id", "type", "uri", "refers_to", "said_digest", "said_bytes", "length", "digest")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = F.col("type") == "revisit"
    return read_archives(spark, path).select(
        F.expr("try_cast(id as bigint)").alias("page_id"),
        F.when(back, F.col("said_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(back, F.col("said_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


QUERIES = {"op6_warc": op6_warc}

ORACLES = {
    "op6_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
}
