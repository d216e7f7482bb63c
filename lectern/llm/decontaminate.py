"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is one window).  Of the
``GRAM``-word grams in a window the one with the smallest hash is selected, so a text's selected grams are few, and any
WINDOW words that a document shares with an item have a selected gram in common at the same place.  (An item of
fewer words is a gram of that many words, selected as it is.)  The selected grams of documents and items are joined
by their hash; each brings the hashes of the words around it, and a hit is extended word by word to both sides as
long as they agree, by at most the rest of a window.  What reaches WINDOW words is a shared span; longer spans
have more selected grams, whose extensions overlap.  Words are compared by 64-bit hashes.

Two bitmaps of the benchmark's grams and windows keep grams that cannot lead to a hit out of the join.  They have
at most 2^BITMAP_BITS bits each, whatever the benchmark's size, and only save work: the fuller they are, the more
grams the join has to turn down (``fill`` says how full).

Null or wordless texts have no windows: as documents they are clean, as items they match nothing.  Rows that
repeat a document get the same answer each; items with a null id are ignored, repeated items count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import bytetext
from lectern.llm.common import for_python, fresh, is_small, join_salted, settle, small, table

WINDOW, GRAM = 13, 5
#: A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
#: Bits of a bitmap: so many for each entry, and 2^BITMAP_BITS at most.
BITS_EACH, BITMAP_BITS = 16, 26
#: Words that a hit may be extended by to the left; to the right of a gram's start it is WINDOW.
BEFORE = WINDOW - GRAM

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True

_SEEDS = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("gram", pa.int64()), ("around", pa.list_(pa.int64()))]))
_WINDOWS = pa.list_(pa.int64())
_SCHEMA = "id {id}, digest bigint, n_words bigint, seeds array<struct<at:int,size:int,gram:bigint,around:array<bigint>>>, windows array<bigint>"


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def selected(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gram hashes) of the grams that are smallest in some window of their text."""
    grams = bytetext.gram_hashes(hashes, GRAM)
    least = bytetext.sliding_min(grams, BEFORE + 1)
    if not len(least):
        return np.zeros(0, np.int64), grams[:0]
    one_text = text[: len(least)] == text[WINDOW - 1 :]
    pad = np.full(BEFORE, ~np.uint64(0), np.uint64)  # greatest of the minima of the windows that hold a gram: the complement's least
    greatest = ~bytetext.sliding_min(np.concatenate([pad, np.where(one_text, ~least, ~np.uint64(0)), pad]), BEFORE + 1)
    held = np.concatenate([[0], np.cumsum(one_text)])
    at = np.arange(len(grams))
    some = held[np.minimum(at + 1, len(least))] > held[np.maximum(at - BEFORE, 0)]
    at = np.flatnonzero(some & (greatest == grams))
    return at, grams[at]


def _around(hashes: np.ndarray, text: np.ndarray, at: np.ndarray, filler: int) -> np.ndarray:
    """(grams, BEFORE + WINDOW) hashes of the words around each gram; ``filler`` beyond its text."""
    where = at[:, None] + np.arange(-BEFORE, WINDOW)
    inside = (where >= 0) & (where < len(hashes))
    where = np.clip(where, 0, len(hashes) - 1)
    return np.where(inside & (text[where] == text[at][:, None]), hashes[where].view(np.int64), np.int64(filler))


def _windows_around(hashes: np.ndarray, text: np.ndarray, at: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """For each gram whether some window that holds it is in ``bitmap``."""
    found = np.zeros(len(at), bool)
    for back in range(BEFORE + 1):
        first = at - back
        ok = np.flatnonzero((first >= 0) & (first + WINDOW <= len(hashes)) & ~found)
        ok = ok[text[first[ok]] == text[first[ok] + WINDOW - 1]]
        h = hashes[first[ok]].copy()
        for j in range(1, WINDOW):
            h = h * bytetext._P1 + hashes[first[ok] + j]
        found[ok] = _in(bitmap, bytetext.mix(h))
    return found


def _seeds_of(column, lengths: list[int], bitmaps: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The word count of each text, its selected grams, and without ``bitmaps``, so for items, the hashes of its windows."""
    counts, owners, parts = np.zeros(len(column), np.int64), [], []
    windows, window_owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for first, end, raw, offsets in bytetext.slices(column):
        data = _FOLD[raw]
        starts, ends, text = bytetext.words(_WORD[data], offsets)
        per = np.bincount(text, minlength=end - first)
        counts[first:end] = per
        if not len(starts):
            continue
        hashes, begins = bytetext.span_hashes(data, starts, ends), np.concatenate([[0], np.cumsum(per)])
        at, grams = selected(hashes, text)
        if bitmaps is None:
            whole = bytetext.gram_hashes(hashes, WINDOW)
            one_text = np.flatnonzero(text[: len(whole)] == text[WINDOW - 1 :]) if len(whole) else np.zeros(0, np.int64)
            windows.append(whole[one_text])
            window_owners.append(first + text[one_text])
        else:
            near = np.flatnonzero(_in(bitmaps[0], grams))
            near = near[_windows_around(hashes, text, at[near], bitmaps[1])]
            at, grams = at[near], grams[near]
        found = [(at, grams, GRAM)]
        for m in range(1, WINDOW) if bitmaps is None else lengths:
            h = bytetext.gram_hashes(hashes, m)
            ok = text[: len(h)] == text[m - 1 : m - 1 + len(h)]
            ok &= per[text[: len(h)]] == m if bitmaps is None else _in(bitmaps[0], h + np.uint64(m))
            p = np.flatnonzero(ok)
            found.append((p, h[p], -m))  # below zero: a whole item
        at, grams = np.concatenate([p for p, _, _ in found]), np.concatenate([h for _, h, _ in found])
        sizes = np.concatenate([np.full(len(p), m, np.int32) for p, _, m in found])
        owner = text[at]
        owners.append(first + owner)
        parts.append((at - begins[owner], sizes, grams, _around(hashes, text, at, 0 if bitmaps else 1)))
    return counts, _lists(len(column), owners, parts), _hash_lists(len(column), np.concatenate(window_owners), np.concatenate(windows))


def _lists(n: int, owners: list, parts: list) -> pa.Array:
    if not owners:
        return pa.array([[]] * n, _SEEDS)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    at, sizes, grams, around = (np.concatenate([p[i] for p in parts])[order] for i in range(4))
    width = BEFORE + WINDOW
    lists = pa.ListArray.from_arrays(np.arange(0, around.size + 1, width, dtype=np.int32), pa.array(around.ravel()))
    seeds = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(sizes), pa.array(grams.view(np.int64)), lists], fields=list(_SEEDS.value_type))
    return pa.ListArray.from_arrays(np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32), seeds)


def _hash_lists(n: int, owner: np.ndarray, hashes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32), pa.array(hashes.view(np.int64)))


def _seeds(rows: DataFrame, key: str, text: str, lengths: list[int], shared=None) -> DataFrame:
    """(id, digest, n_words, seeds, windows) of each row; digest tells apart rows that share an id.

    With ``shared``, broadcast bitmaps, the rows are documents; without, they are benchmark items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, seeds, windows = _seeds_of(b.column(2), lengths, shared.value if shared else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), seeds, windows], names=["id", "digest", "n_words", "seeds", "windows"])

    source = rows.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("digest"), F.col(text).cast("string").alias("text"))
    return for_python(source).mapInArrow(run, _SCHEMA.format(id=source.schema[0].dataType.simpleString()))


def bitmap_of(hashes: DataFrame, most: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the ``h`` of settled ``hashes``: BITS_EACH bits for each, 2^``most`` at most."""
    bits = max(6, min(most, int(np.ceil(np.log2(max(1, hashes.count() * BITS_EACH))))))
    slot = F.col("h").bitwiseAND((1 << bits) - 1)
    parts = hashes.groupBy(F.shiftright(slot, 6).alias("part")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).collect()
    out = np.zeros(1 << (bits - 6), "<i8")
    for r in parts:
        out[r.part] = r.bits
    return out.view(np.uint8)


def fill(bitmap: np.ndarray) -> float:
    """Share of a bitmap's bits that are set, which is the share of other grams that it lets pass."""
    return float(np.unpackbits(bitmap).mean())


def _agreeing(same: Column, most: int) -> Column:
    """How many of an array of booleans are true before the first that is not."""
    at = F.array_position(same, False)
    return F.when(at == 0, F.lit(most)).otherwise(at - 1).cast("int")


def _extended(seeds: DataFrame) -> DataFrame:
    """Joined ``seeds`` that are part of a shared span, with its words: ``lo`` to before ``hi``."""
    same = F.zip_with("around", "other", lambda a, b: a == b)
    left = _agreeing(F.reverse(F.slice(same, 1, BEFORE)), BEFORE)
    right = _agreeing(F.slice(same, BEFORE + 1, WINDOW), WINDOW)
    seeds = seeds.withColumn("left", left).withColumn("right", right)
    whole = F.col("size") < 0  # a short item is the gram itself
    ok = F.when(whole, F.col("right") >= -F.col("size")).otherwise((F.col("right") >= GRAM) & (F.col("left") + F.col("right") >= WINDOW))
    lo = F.when(whole, F.col("at")).otherwise(F.col("at") - F.col("left"))
    hi = F.col("at") + F.when(whole, -F.col("size")).otherwise(F.col("right"))
    return seeds.filter(ok).withColumn("lo", lo).withColumn("hi", hi)


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc, digest of the text, n_words, n_hit, n_items, items, contaminated) of every row of ``docs``.

    ``items`` are the ids of the items with a window in the document, sorted as strings.
    """
    spark = docs.sparkSession
    items = settle(_seeds(benchmark.filter(F.col(item).isNotNull()), item, item_text, []).select(F.col("id").cast("string").alias("item"), "seeds", "windows"), "bench-items")
    bench = items.select("item", F.explode("seeds").alias("s")).select("item", "s.size", "s.gram", F.col("s.around").alias("other"))
    bench = settle(bench.withColumn("context", F.xxhash64("size", "gram", "other")).distinct(), "bench-grams")
    lengths = sorted(-r["size"] for r in bench.filter("size < 0").select("size").distinct().collect())  # at most WINDOW values
    grams = settle(bench.select(F.when(F.col("size") < 0, F.col("gram") - F.col("size")).otherwise(F.col("gram")).alias("h")).distinct(), "bench-hashes")
    windows = settle(items.select(F.explode("windows").alias("h")).distinct(), "bench-windows")
    shared = spark.sparkContext.broadcast((bitmap_of(grams), bitmap_of(windows)))

    seen = settle(_seeds(docs, doc, text, lengths, shared).drop("windows"), "doc-grams")
    seeds = seen.filter(F.size("seeds") > 0).select("id", "digest", F.explode("seeds").alias("s")).select("id", "digest", "s.*").distinct()
    contexts = settle(bench.select("size", "gram", "other", "context").distinct(), "bench-contexts")
    if is_small(contexts):
        seeds = seeds.join(F.broadcast(contexts), ["size", "gram"])
    else:
        seeds = join_salted(settle(seeds, "doc-seeds"), contexts, ["size", "gram"], F.xxhash64("id", "at"))
    hit = settle(_extended(seeds).select("id", "digest", "lo", "hi", "context").distinct(), "hits")

    order = Window.partitionBy("id", "digest").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("hi") - F.greatest(F.col("lo"), F.coalesce(reach, F.lit(0)))
    spans = hit.select("id", "digest", "lo", "hi").distinct()
    covered = spans.select("id", "digest", F.greatest(new, F.lit(0)).alias("new")).groupBy("id", "digest").agg(F.sum("new").alias("n_hit"))
    named, of = settle(bench.select("context", "item").distinct(), "bench-named"), hit.select("id", "digest", "context").distinct()
    named = of.join(F.broadcast(named), "context") if is_small(named) else join_salted(settle(of, "hit-contexts"), named, ["context"], F.xxhash64("id", "digest"))
    named = named.select("id", "digest", "item").distinct()
    listed = named.groupBy("id", "digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}.digest").eqNullSafe(F.col(f"{b}.digest"))
    both = covered.alias("c").join(listed.alias("i"), same("c", "i")).select("c.id", "c.digest", "n_hit", "items")
    out = seen.select("id", "digest", "n_words").alias("s").join(both.alias("h"), same("s", "h"), "left")
    n_hit, named_items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("s.id").alias(doc),
        F.col("s.digest").alias("digest"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(named_items).cast("long").alias("n_items"),
        named_items.alias("items"),
        ((n_hit > 0) & (n_hit * ONE_IN >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated; all of them if the benchmark is empty."""
    digest = fresh(docs.columns, "_digest")
    hit = contamination(docs, benchmark, doc, text).filter("contaminated").select(F.col(doc).alias("_id"), F.col("digest").alias("_d")).distinct()
    hit = small(settle(hit, "contaminated"))
    marked = docs.withColumn(digest, F.xxhash64(text)).alias("d")
    return marked.join(hit.alias("x"), F.col(f"d.`{doc}`").eqNullSafe(F.col("x._id")) & (F.col(f"d.{digest}") == F.col("x._d")), "left_anti").drop(digest)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


QUERIES = {"op4_decontaminate": op4_decontaminate}

ORACLES = {
    "op4_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM bw WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bs),
ds AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS span
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, ms WHERE len(w) >= m)),
hit AS (SELECT ds.doc_id, ds.i, ds.m, bs.item_id FROM ds JOIN bs ON ds.m = bs.m AND ds.span = bs.span),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
}
