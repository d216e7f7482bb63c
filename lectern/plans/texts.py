"""Text queries: paragraphs, sentences, bounded chunks, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.plans import sql
from lectern.plans.tables import LIMIT, documents, spine, table

PIECE, WIDE = 120, 760


def _docs(spark, d):
    return documents(spark, d).select("doc_id", "text")


def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def paragraphs(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.normal_lines(F.col("text"))).alias("pos", "paragraph"))


def _each(rows, values, name):
    return rows.select("doc_id", "pos", F.posexplode(values).alias("n", name))


def split_sentences(spark, d):
    return _each(paragraphs(spark, d), T.split_sentences(F.col("paragraph")), "sentence")


def hard_split(spark, d):
    return _each(paragraphs(spark, d), T.hard_split(F.col("paragraph"), PIECE), "piece")


def pack_units(spark, d):
    return _each(paragraphs(spark, d), T.pack_units(T.split_sentences(F.col("paragraph")), LIMIT), "chunk")


def chunk_text(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.chunk_text(F.col("text"), LIMIT)).alias("n", "chunk"))


def enforce_limit(spark, d):
    wide = T.chunk_text(F.col("text"), WIDE)
    return _docs(spark, d).select("doc_id", F.posexplode(T.enforce_limit(wide, LIMIT)).alias("n", "chunk"))


def escape_metadata(spark, d):
    return _docs(spark, d).select("doc_id", T.escape_metadata(F.col("text")).alias("value"))


def format_duration(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.format_duration(F.col("o_totalprice") / 16).alias("label"))


def collapse_ws(spark, d):
    return _docs(spark, d).select("doc_id", T.collapse_ws(F.col("text")).alias("text"))


def chunk_shape(spark, d):
    sizes = spine(spark, d).select("book_id", F.explode(T.chunk_text(F.col("text"), LIMIT)).alias("c")).select("book_id", F.length("c").alias("size"))
    band = F.least(F.floor(F.col("size") / 22), F.lit(9)).alias("band")
    return sizes.groupBy("book_id", band).agg(F.count(F.lit(1)).alias("n_chunks"), F.max("size").alias("max_chars"), F.min("size").alias("min_chars"))


def min_text(spark, d):
    return spine(spark, d).select("book_id", "doc_id", F.length("text").alias("n_chars"))


def prepare_summary(spark, d):
    """Chunks, characters, the longest chunk and the chunks added by the limit guard, per book, of texts chunked for a wider engine."""
    raw = spine(spark, d).select("book_id", T.chunk_text(F.col("text"), WIDE).alias("raw"))
    rows = raw.select("book_id", F.size("raw").alias("n_raw"), T.enforce_limit(F.col("raw"), LIMIT).alias("chunks"))
    n = F.size("chunks")
    chars = F.aggregate("chunks", F.lit(0).cast("long"), lambda a, c: a + F.length(c))
    longest = F.array_max(F.transform("chunks", F.length))
    return rows.groupBy("book_id").agg(
        F.sum(n).alias("total_chunks"),
        F.sum(chars).alias("total_chars"),
        F.max(longest).alias("max_chunk_chars"),
        F.sum(F.greatest(n - F.col("n_raw"), F.lit(0))).alias("repaired_chunks"),
    )


QUERIES = {
    "i1_normalize_text": normalize_text,
    "i2_paragraphs": paragraphs,
    "i3_split_sentences": split_sentences,
    "i4_hard_split": hard_split,
    "i5_pack_units": pack_units,
    "i6_chunk_text": chunk_text,
    "i7_enforce_limit": enforce_limit,
    "i8_escape_metadata": escape_metadata,
    "i9_format_duration": format_duration,
    "i10_collapse_ws": collapse_ws,
    "i12_chunk_shape": chunk_shape,
    "c2_min_text": min_text,
    "e2_prepare_summary": prepare_summary,
    "a9_table_scan": lambda spark, d: table(spark, d, "orders").filter(F.col("o_totalprice") > 100000).select("o_orderkey", "o_custkey"),
}

_PARAGRAPHS = f"p AS (SELECT doc_id, unnest(range(0, len(l))) AS pos, unnest(l) AS paragraph FROM (SELECT doc_id, {sql.lines('text')} AS l FROM documents))"


def _each_sql(values: str, name: str) -> str:
    return f"WITH {_PARAGRAPHS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(unnest(range(0, len(v))) AS INTEGER) AS n, unnest(v) AS {name} FROM (SELECT doc_id, pos, {values} AS v FROM p)"


def _chunks_sql(values: str) -> str:
    return f"SELECT doc_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS n, unnest(v) AS chunk FROM (SELECT doc_id, {values} AS v FROM documents)"


_WIDE_CUT = f"flatten(list_transform({sql.chunks('text', WIDE)}, lambda c: CASE WHEN length(c) > {LIMIT} THEN {sql.chunks('c', LIMIT)} ELSE [c] END))"
_SECONDS = "CAST(greatest(round_even(o_totalprice / 16, 0), 0) AS BIGINT)"

ORACLES = {
    "i1_normalize_text": f"SELECT doc_id, array_to_string({sql.lines('text')}, chr(10) || chr(10)) AS text FROM documents",
    "i2_paragraphs": f"WITH {_PARAGRAPHS} SELECT doc_id, CAST(pos AS INTEGER) AS pos, paragraph FROM p",
    "i3_split_sentences": _each_sql(sql.sentences("paragraph"), "sentence"),
    "i4_hard_split": _each_sql(sql.hard_split("paragraph", PIECE), "piece"),
    "i5_pack_units": _each_sql(sql.pack(sql.sentences("paragraph"), LIMIT), "chunk"),
    "i6_chunk_text": _chunks_sql(sql.chunks("text", LIMIT)),
    "i7_enforce_limit": _chunks_sql(_WIDE_CUT),
    "i8_escape_metadata": r"SELECT doc_id, translate(replace(replace(replace(replace(text, '\', '\\'), '=', '\='), ';', '\;'), '#', '\#'), chr(10) || chr(13), '  ') AS value FROM documents",
    "i9_format_duration": f"""SELECT o_orderkey, CASE WHEN s >= 3600 THEN printf('%d sa %02d dk', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%d dk %02d sn', s // 60, s % 60)
      ELSE printf('%d sn', s) END AS label FROM (SELECT o_orderkey, {_SECONDS} AS s FROM orders)""",
    "i10_collapse_ws": r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents",
    "i12_chunk_shape": f"""WITH {sql.CHUNKED}, c AS (SELECT book_id, length(unnest(chunks)) AS size FROM chunked)
      SELECT book_id, least(size // 22, 9) AS band, count(*) AS n_chunks, max(size) AS max_chars, min(size) AS min_chars FROM c GROUP BY ALL""",
    "c2_min_text": f"WITH {sql.SPINE} SELECT book_id, doc_id, length(text) AS n_chars FROM spine",
    "e2_prepare_summary": f"""WITH {sql.SPINE}, c AS (SELECT book_id, len({sql.chunks('text', WIDE)}) AS n_raw, list_transform({_WIDE_CUT}, lambda c: length(c)) AS sizes FROM spine)
      SELECT book_id, CAST(sum(len(sizes)) AS BIGINT) AS total_chunks, CAST(coalesce(sum(list_sum(sizes)), 0) AS BIGINT) AS total_chars, max(list_max(sizes)) AS max_chunk_chars,
        CAST(sum(greatest(len(sizes) - n_raw, 0)) AS BIGINT) AS repaired_chunks FROM c GROUP BY book_id""",
    "a9_table_scan": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000",
}
