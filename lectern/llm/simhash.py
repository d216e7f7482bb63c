"""Near duplicates by SimHash, searched with pigeonring chains.

A fingerprint is cut into ``SEGMENTS`` equal segments on a ring.  If two fingerprints differ in at most
``BITS`` bits, then from some segment on, each chain of 1, 2, 3... consecutive segments differs in at most
length * BITS / SEGMENTS bits (rounded down).  With four segments and two bits the budgets are 0, 1, 1, 2:
a chain starts with an equal segment, and the next or the one after it is equal too.  So pairs of equal
segments are the index keys; a candidate pair must pass the chain test from the key's first segment before
its full distance is taken.

Rows without a link to another fingerprint form a component of their own.  A null text has no words, a
text without words has fingerprint zero, and repeated rows share one fingerprint and so one component.
A null doc_id never becomes a component's id unless all of its rows have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bytetext
from lectern.llm.common import for_python, fresh, join_spread, settle, small, table
from lectern.llm.graph import connected_components, node_key

SEGMENTS, BITS = 4, 2
#: A key with more fingerprints than this is searched by shared one-bit neighbours, which is exact too.
PAIRWISE = 32

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def fingerprints_of(column, shingle: int = 3) -> np.ndarray:
    """The SimHash of each text of an Arrow column."""
    out = np.zeros(len(column), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for first, end, raw, offsets in bytetext.slices(column):
        data = _FOLD[raw]
        space = data == 32
        keep = np.ones(len(data), bool)
        keep[1:] = ~(space[1:] & space[:-1])  # one space between words
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        data = data[keep]
        starts, ends, text = bytetext.words(data != 32, offsets)
        per = np.bincount(text, minlength=end - first)
        whole = np.flatnonzero((text[: -shingle + 1] == text[shingle - 1 :]) if len(text) >= shingle else np.zeros(0, bool))
        lo, hi, owner = starts[whole], ends[whole + shingle - 1], text[whole]
        short = np.flatnonzero((per > 0) & (per < shingle))
        if len(short):
            at = np.concatenate([[0], np.cumsum(per)])
            lo, hi, owner = np.concatenate([lo, starts[at[short]]]), np.concatenate([hi, ends[at[short + 1] - 1]]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            lo, hi, owner = lo[order], hi[order], owner[order]
        n = np.bincount(owner, minlength=end - first)
        ones = bytetext.bit_counts(bytetext.xxh64(data, lo, hi), n)
        out[first:end] = ((2 * ones > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """``keep`` columns and ``fp`` (BIGINT, the fingerprint's 64 bits) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(len(keep)), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(fp)], names=[*keep, "fp"])

    rows = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return for_python(rows).mapInArrow(run, f"{schema}, fp bigint")


def _segment(fp, i: int, of: int):
    return F.shiftrightunsigned(fp, 64 // of * (i % of)).bitwiseAND((1 << (64 // of)) - 1)


def _chain_ok(a, b, start: int, segments: int = SEGMENTS, bits: int = BITS):
    """Each chain of consecutive segments from ``start`` keeps within its proportional budget."""
    diff, spent, ok = a.bitwiseXOR(b), F.lit(0), F.lit(True)
    for length in range(1, segments + 1):
        spent = spent + F.bit_count(_segment(diff, start + length - 1, segments))
        ok = ok & (spent <= length * bits // segments)
    return ok


#: The keys that the chain budgets allow: a first segment, and the equal one that follows in the chain.
_KEYS = tuple((i, j) for i in range(SEGMENTS) for j in ((i + 1) % SEGMENTS, (i + 2) % SEGMENTS) if i < j or j == (i + 1) % SEGMENTS)


def links(distinct_fps: DataFrame, pairwise: int = PAIRWISE) -> DataFrame:
    """(src, dst) edges between distinct fingerprints ``fp`` that connect all those within BITS bits.

    Small keys give every pair that passes the chain and the distance test.  In a key with more than
    ``pairwise`` fingerprints each is filed under itself and all values one bit away: two fingerprints
    share such a value just when they differ in at most two bits, so a star per value connects the same
    fingerprints without forming the pairs; no value has more than 65.
    """
    fp = F.col("fp")
    keys = [F.struct(F.lit(n).alias("slot"), F.shiftleft(_segment(fp, i, SEGMENTS), 16).bitwiseOR(_segment(fp, j, SEGMENTS)).alias("value")) for n, (i, j) in enumerate(_KEYS)]
    filed = distinct_fps.select("fp", F.inline(F.array(*keys)))
    crowd = settle(filed.groupBy("slot", "value").count().filter("count > 1"), "simhash-crowds")
    filed = settle(join_spread(filed, crowd, ["slot", "value"], "count", F.xxhash64("fp"), "inner"), "simhash-keys")

    few = filed.filter(F.col("count") <= pairwise)
    a, b = F.col("a.fp"), F.col("b.fp")
    pairs = few.alias("a").join(few.alias("b"), (F.col("a.slot") == F.col("b.slot")) & (F.col("a.value") == F.col("b.value")) & (a < b))
    chain = F.lit(False)
    for n, (i, j) in enumerate(_KEYS):  # the pair's later segment starts a chain too if it is opposite
        starts = _chain_ok(a, b, i) | _chain_ok(a, b, j)
        chain = chain | ((F.col("a.slot") == n) & starts)
    near = pairs.filter(chain).filter(F.bit_count(a.bitwiseXOR(b)) <= BITS).select(a.alias("src"), b.alias("dst"))

    many = filed.filter(F.col("count") > pairwise).select("fp").distinct()
    around = F.array(fp, *(fp.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), n)) for n in range(64)))
    balls = many.select("fp", F.explode(around).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    star = balls.select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst")).filter("src <> dst")
    return near.unionByName(star).distinct()


def components(rows: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A settled (fp, root, component_id, n): of each distinct fingerprint of settled ``rows`` its component, the smallest ``doc`` in it and its rows."""
    classes = settle(rows.groupBy("fp").agg(F.min(doc).alias("first"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    reach = settle(connected_components(links(classes.select("fp"))), "simhash-reach")
    rooted = settle(classes.withColumn("node", node_key("fp")).join(reach, "node", "left").select("fp", "first", "n", F.coalesce("root", "node").alias("root")), "simhash-roots")
    least = settle(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("fps")), "simhash-components")
    named = join_spread(rooted, least, ["root"], "fps", F.col("fp")).select("fp", "root", "component_id", "n")
    return settle(named, "simhash-named")


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc, fp, component_id) of every row of ``docs``."""
    rows = settle(fingerprints(docs.select(F.col(doc).alias("id"), F.col(text).alias("text")), "text", ("id",), shingle), "simhash")
    found = join_spread(rows, components(rows, "id"), ["fp"], "n", F.xxhash64("id"))
    return found.select(F.col("id").alias(doc), "fp", "component_id")


def keep_first(docs: DataFrame, text: str = "text", doc: str = "doc_id", shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that are the first of their component; of rows that repeat its id, one.

    Null ids are a document's last resort: of components in which no row has an id, one row stays.
    """
    digest = fresh(docs.columns, "_digest")
    marked = docs.withColumn(digest, F.xxhash64(text))
    rows = settle(fingerprints(marked.select(F.col(doc).alias("_id"), F.col(digest).alias("_d"), F.col(text).alias("_body")), "_body", ("_id", "_d"), shingle), "simhash")
    rows = settle(join_spread(rows, components(rows, "_id"), ["fp"], "n", F.xxhash64("_id", "_d")).select("_id", "_d", "root", "component_id"), "simhash-rows")
    first = rows.filter(F.col("_id").eqNullSafe(F.col("component_id"))).groupBy("_id", "root").agg(F.min("_d").alias("_d"))
    same = lambda a, b: F.col(f"{a}._id").eqNullSafe(F.col(f"{b}._id")) & (F.col(f"{a}._d") == F.col(f"{b}._d"))
    drop = rows.select("_id", "_d").distinct().alias("r").join(first.alias("f"), same("r", "f"), "left_anti")
    drop = small(settle(drop, "simhash-drop")).alias("x")
    at = lambda other: F.col(f"d.`{doc}`").eqNullSafe(F.col(f"{other}._id")) & (F.col(f"d.{digest}") == F.col(f"{other}._d"))
    kept = marked.alias("d").join(drop, at("x"), "left_anti")
    twice = settle(rows.alias("r").join(first.alias("f"), same("r", "f"), "left_semi").groupBy("_id", "_d").count().filter("count > 1").select("_id", "_d"), "simhash-twice")
    if not twice.isEmpty():
        again = kept.alias("d").join(twice.alias("t"), at("t"), "left_semi").dropDuplicates([doc, digest])
        kept = kept.alias("d").join(twice.alias("t"), at("t"), "left_anti").unionByName(again)
    return kept.drop(digest)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
