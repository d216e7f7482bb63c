"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every run of ``LINES`` consecutive lines of a text is a window.  Windows are compared by two 64-bit hashes
across all documents; the first occurrence of a window, by document id and then by place, stays, and each
later one covers its lines.  Covered lines go, whichever windows cover them.

Lines are what newlines separate, compared as they are.  A text of fewer lines has no window and stays; a
null text stays null and has no lines.  Rows that repeat a document id are told apart by their text; rows
that repeat both lose the same lines.  A null id comes before all others.

Both sides of each join grow with the corpus, so the joins are sort-merge joins at every size.  Windows that
hold more than a thousandth of all repeated ones are joined apart, so a line block found in a third of the
documents is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import join_spread, settle, table

LINES = 3


def repeated_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, digest, at): the places, from 0, of all but the first occurrence of every repeated window."""
    split = docs.select(F.col(doc).alias("id"), F.xxhash64(text).alias("digest"), F.split(text, "\n", -1).alias("lines"))
    hashed = split.select("id", "digest", F.transform("lines", lambda x: F.xxhash64(x)).alias("a"), F.transform("lines", lambda x: F.xxhash64(F.lit("second"), x)).alias("b"))

    def over(name):
        return lambda i: F.xxhash64(*(F.element_at(F.col(name), (i + n).cast("int")) for n in range(1, LINES + 1)))

    starts = F.when(F.size("a") >= LINES, F.sequence(F.lit(0), F.size("a") - LINES))
    windows = hashed.select("id", "digest", F.posexplode(F.arrays_zip(F.transform(starts, over("a")).alias("a"), F.transform(starts, over("b")).alias("b"))).alias("at", "w"))
    windows = settle(windows.select("id", "digest", "at", "w.a", "w.b"), "line-windows")
    place = F.struct("id", "digest", "at")
    often = settle(windows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"), "repeated-windows")
    again = join_spread(windows, often, ["a", "b"], "n", F.xxhash64("id", "digest", "at"), "inner", merge=True)
    return again.filter(~place.eqNullSafe(F.col("first"))).select("id", "digest", "at")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``text`` rid of covered lines, ``n_lines`` (before) and ``n_removed``."""
    starts = repeated_windows(docs, doc, text)
    covered = starts.select("id", "digest", F.explode(F.sequence(F.col("at"), F.col("at") + LINES - 1)).alias("line"))
    gone = settle(covered.groupBy("id", "digest").agg(F.collect_set("line").alias("gone")), "covered-lines")
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.xxhash64(text).alias("_digest"), F.split(text, "\n", -1).alias("_lines")).alias("d")
    joined = rows.join(gone.alias("g").hint("merge"), F.col(f"d.{doc}").eqNullSafe(F.col("g.id")) & (F.col("d._digest") == F.col("g.digest")), "left")
    lines = F.col("d._lines")
    places = F.array_except(F.sequence(F.lit(1), F.size(lines)), F.transform(F.col("g.gone"), lambda i: i + 1))
    kept = F.when(F.col("g.gone").isNull(), lines).otherwise(F.transform(places, lambda i: F.element_at(lines, i)))
    return joined.select(
        *(F.array_join(kept, "\n").alias(c) if c == text else F.col(f"d.{c}") for c in docs.columns),
        F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")).cast("long").alias("n_removed"),
    )


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_linededup": op5_linededup}

ORACLES = {
    "op5_linededup": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS span
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY span ORDER BY doc_id, i) AS rn FROM w),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM r WHERE rn > 1) GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda x: NOT list_contains(gone, x)), lambda x: l[x + 1]), chr(10)), '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN c USING (doc_id)
"""
}
