"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Equal vectors are one class.  Each tree splits its classes again and again along random directions, at the
median, and those within ``SPILL`` of the median's rank go to both sides, until a leaf holds at most ``LEAF``.
Directions and medians depend on tree and depth only; the medians are fitted on a sample of about ``SAMPLE``
classes (documented bound), and every class is indexed: one pass gives it, for each tree, two words of
bits, its side and whether it spills at each depth.  Splitting then works on these slim rows, a run of depths
at a time.  A node skips the depths at which a split would leave more than ``WORTH`` of its comparisons, since it is
lopsided or much would spill; so a dense group is not copied over and over, and what is not split is compared in
blocks.  Pairs in a leaf
are verified by cosine in double precision, and their links, thinned to as many as connect the same vectors,
give the components.  Then all pairs of a component are compared, in blocks that give counts and store no pair,
so ``n_links`` is exact inside a component however many vectors are near each other.  Deeper trees part more
pairs, so there are more of them: enough to find a lone pair at the threshold with ``RECALL`` under a Gaussian model.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and nor do
vectors of different lengths.  Repeated rows are vectors of their own; a null id never names a component
unless all ids in it are null.  No row gives no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import for_python, hash63, join_spread, limit63, settle, table
from lectern.llm.graph import connected_components, node_key

COSINE, TREES, LEAF, SPILL, SEED = 0.9, 3, 2048, 0.05, 42
#: Depths that a tree has at most, and the first ones of each run of depths that is looked at together.
DEPTH, STRIDES = 56, (0, 8, 32)
#: Share of a node's comparisons that may be left for it to be split at a depth.
WORTH = 0.75
#: Classes that the medians are fitted on.
SAMPLE = 8192
#: Rows of one side of a comparison, and rows that are compared together at least.
BLOCK, TOGETHER = 2048, 256
#: Share of the lone pairs at the threshold that the forest is to find.
RECALL = 0.98


def directions(tree: int, width: int) -> np.ndarray:
    """(width, DEPTH) random directions of a tree, the same wherever they are made."""
    return np.random.default_rng([SEED, tree, width]).standard_normal((width, DEPTH)).astype(np.float32)


def trees_for(classes: int, cosine: float = COSINE, leaf: int = LEAF, spill: float = SPILL) -> int:
    """Trees that find a lone pair with ``cosine`` among so many classes with RECALL; TREES at least, one for a single leaf."""
    levels = math.ceil(math.log(max(1.0, classes / leaf)) / -math.log(0.5 + spill))
    y = np.linspace(0, 8, 8001)
    margin = y[np.searchsorted([0.5 * math.erfc(-a / math.sqrt(2)) for a in y], 0.5 + spill)]  # where the spill ends
    tail = np.array([0.5 * math.erfc((margin + cosine * a) / math.sqrt(2 * (1 - cosine**2))) for a in y])
    parted = 2 * float(np.sum((np.exp(-y * y / 2) * tail)[y >= margin])) * (y[1] - y[0]) / math.sqrt(2 * math.pi)
    together = (1 - parted) ** levels
    if levels == 0:
        return 1
    return TREES if together >= RECALL else max(TREES, math.ceil(math.log(1 - RECALL) / math.log(1 - together)))


def _keys(v: Column) -> list[Column]:
    """128 bits that stand for a vector."""
    return [F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2")]


def _sound(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes_of(rows: DataFrame, vec: str, key: str) -> DataFrame:
    """A settled (cls, h1, h2, n, first, width, u): the distinct linkable vectors, scaled to length one, how many rows share each, and their smallest id."""
    v = F.col(vec).cast("array<double>")
    grouped = rows.filter(_sound(v)).select(*_keys(v), v.alias("v"), F.col(key).alias("id")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.first("v").alias("v"))
    known = grouped.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "n", "first", F.size("v").alias("width"), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width, v = b.column("width").to_numpy(), b.column("v")
            flat, out = v.flatten().to_numpy(), np.empty(b.num_rows, object)
            ends = np.cumsum(width)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                out[at] = [u.tobytes() for u in unit(flat[(ends[at] - w)[:, None] + np.arange(w)])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(out, pa.binary())], names=["cls", "h1", "h2", "n", "first", "width", "u"])

    first = grouped.schema["first"].dataType.simpleString()
    return settle(for_python(known).mapInArrow(run, f"cls bigint, h1 bigint, h2 bigint, n bigint, first {first}, width int, u binary"), "vector-classes")


def _cuts(classes: DataFrame, trees: int, spill: float) -> dict[int, np.ndarray]:
    """For each width in the sample the (trees, 3, DEPTH) low end, middle and high end of the spill."""
    last = limit63(SAMPLE, classes.count())
    drawn: dict[int, list] = {}
    for r in classes.filter(hash63("h1", F.lit("sample")) <= last).select("width", "u").collect():
        drawn.setdefault(r.width, []).append(r.u)
    out = {}
    for width, us in drawn.items():
        x = np.frombuffer(b"".join(us)).reshape(-1, width).astype(np.float32)
        out[width] = np.array([np.quantile(x @ directions(t, width), [0.5 - spill, 0.5, 0.5 + spill], axis=0) for t in range(trees)])
    return out


def forest(classes: DataFrame, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """(fam, cls): the leaves of every tree; a leaf holds vectors of one length.

    A table of at most ``leaf`` classes is one leaf, and needs one tree.
    """
    if classes.count() <= leaf:
        return classes.select(F.xxhash64("width").alias("fam"), "cls")
    cuts = classes.sparkSession.sparkContext.broadcast(_cuts(classes, trees, spill))
    bit = np.int64(1) << np.arange(DEPTH, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths, us = b.column("width").to_numpy(), b.column("u").to_pylist()
            for w in np.unique(widths).tolist():
                at = np.flatnonzero(widths == w)
                x = np.frombuffer(b"".join(us[i] for i in at)).reshape(-1, w).astype(np.float32)
                for t in range(trees):
                    p = x @ directions(t, w)
                    low, middle, high = cuts.value[w][t] if w in cuts.value else np.zeros((3, DEPTH))
                    sides, spills = ((p > middle) * bit).sum(axis=1), (((p >= low) & (p <= high)) * bit).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(widths[at]), b.column("cls").take(pa.array(at)), pa.array(sides), pa.array(spills)], names=["tree", "width", "cls", "sides", "spills"])

    coded = for_python(classes.select("cls", "width", "u")).mapInArrow(run, "tree int, width int, cls bigint, sides bigint, spills bigint")
    level = settle(coded.select(F.xxhash64("tree", "width").alias("fam"), "cls", "sides", "spills"), "forest-level")
    done, rows = [], level.count()
    for top, end in zip(STRIDES, (*STRIDES[1:], DEPTH)):
        depths = range(top, end)
        sums = [F.expr(f"sum(shiftright({word}, {d}) & 1) AS {word}{d}") for d in depths for word in ("sides", "spills")]
        nodes = level.groupBy("fam").agg(F.count(F.lit(1)).alias("n"), *sums)
        left = ", ".join(f"IF(pow((sides{d} + spills{d} / 2) / n, 2) + pow((n - sides{d} + spills{d} / 2) / n, 2) <= {WORTH}D, {d}, NULL)" for d in depths)
        chosen = F.expr(f"slice(filter(array({left}), d -> d IS NOT NULL), 1, greatest(1, cast(ceil(log2(n / {leaf})) AS int)))")
        nodes = settle(nodes.select("fam", "n", F.when(F.col("n") > leaf, chosen).alias("chosen")), "forest-nodes")
        moved = join_spread(level, nodes, ["fam"], "n", F.col("cls"), "inner", total=rows)
        below = F.coalesce(F.aggregate("chosen", F.array("fam"), _divided), F.array("fam"))
        moved = settle(moved.select(F.explode(below).alias("fam"), "cls", "sides", "spills", F.col("chosen").isNotNull().alias("open")), "forest-level")
        done.append(moved.filter("not open").select("fam", "cls"))
        level = moved.filter("open").drop("open")
        rows = level.count()
        if not rows:
            return _union(done)
    return _union([*done, level.select("fam", "cls")])


def _bit(word: str, depth: Column) -> Column:
    return F.call_function("shiftright", F.col(word), depth).bitwiseAND(1)


def _divided(nodes: Column, depth: Column) -> Column:
    """The nodes below ``nodes`` that hold the row once they are split at ``depth``."""

    def below(node: Column) -> Column:
        to = lambda side: F.xxhash64(node, depth, side)
        low, high = F.lit(0).cast("long"), F.lit(1).cast("long")
        return F.when(_bit("spills", depth) == 1, F.array(to(low), to(high))).otherwise(F.array(to(_bit("sides", depth))))

    return F.flatten(F.transform(nodes, below))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def connected(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the edges p-q connect it with."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, p, label[q])
        np.minimum.at(new, q, label[p])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _near(pdf: pd.DataFrame, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, other rows, which pairs of them are near) of one group of ``_grouped``; one array twice if all its pairs are meant."""
    us, fams = pdf["u"].to_numpy(), pdf["fam"].to_numpy()
    size = np.array([len(u) for u in us])
    for w in np.unique(size):
        at = np.flatnonzero(size == w)
        at = at[np.argsort(fams[at], kind="stable")]
        x, fam = np.frombuffer(b"".join(us[at])).reshape(len(at), -1), fams[at]
        if pdf["large"].iloc[0] and pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            first = pdf["own"].to_numpy()[at] == pdf["i"].iloc[0]
            yield at[first], at[~first], x[first] @ x[~first].T >= cosine
            continue
        ends = np.append(np.flatnonzero(fam[1:] != fam[:-1]) + 1, len(fam))
        lo = 0
        for hi in ends.tolist():
            if hi - lo >= TOGETHER or hi == len(fam):
                near = (x[lo:hi] @ x[lo:hi].T >= cosine) & (fam[lo:hi, None] == fam[None, lo:hi])
                np.fill_diagonal(near, False)
                here = at[lo:hi]
                yield here, here, near
                lo = hi


def _grouped(families: DataFrame, classes: DataFrame, block: int):
    """``families`` (fam, cls, n) with their vectors, grouped for comparison.

    Small families share groups of about a block's rows.  A family of more than a block is cut into blocks by a
    hash, and each pair of its blocks is a group of its own.
    """
    sizes = settle(families.groupBy("fam").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "family-sizes")
    groups = max(1, -(-(sizes.agg(F.sum("members").alias("n")).first().n or 0) // block))
    placed = join_spread(families, sizes, ["fam"], "members", F.col("cls"), "inner")
    placed = placed.withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("cls", F.lit("block")), F.col("blocks")).cast("int")).withColumn("large", F.col("blocks") > 1)
    placed = placed.withColumn("part", F.when(F.col("large"), F.col("fam")).otherwise(F.pmod(F.xxhash64("fam", F.lit("part")), F.lit(groups))))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("large", "part", "fam", "cls", "n", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    return placed.join(classes.select("cls", "u"), "cls").groupBy("large", "part", "i", "j")


def links(classes: DataFrame, leaves: DataFrame, cosine: float = COSINE, block: int = BLOCK, thin: bool = False) -> DataFrame:
    """(src, dst) of the pairs of classes that share a leaf and have the cosine, src below dst.

    ``thin`` gives instead, from each comparison, one pair per class, which connect the same classes.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, found = pdf["cls"].to_numpy(), [np.zeros((2, 0), np.int64)]
        for a, b, near in _near(pdf, cosine):
            p, q = np.nonzero(near)
            if thin:
                label = connected(a[p], b[q], len(ids))
                both = np.union1d(a, b)
                found.append(np.stack([ids[label[both]], ids[both]]))
            else:
                found.append(np.stack([ids[a[p]], ids[b[q]]]))
        s, d = np.concatenate(found, axis=1)
        keep = s != d
        return pd.DataFrame({"src": np.minimum(s, d)[keep], "dst": np.maximum(s, d)[keep]})

    families = leaves.select("fam", "cls", F.lit(1).cast("long").alias("n"))
    return _grouped(families, classes, block).applyInPandas(compare, "src bigint, dst bigint").distinct()


def counted(members: DataFrame, classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(cls, others): the rows of other classes of its component that each class links with; ``members`` is a settled (fam, cls, n)."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        n, others = pdf["n"].to_numpy(), np.zeros(len(pdf), np.int64)
        for a, b, near in _near(pdf, cosine):
            others[a] += near @ n[b]
            if a is not b:
                others[b] += n[a] @ near
        return pd.DataFrame({"cls": pdf["cls"], "others": others})

    found = _grouped(members, classes, block).applyInPandas(count, "cls bigint, others bigint")
    return found.groupBy("cls").agg(F.sum("others").alias("others"))


def near_duplicates(rows: DataFrame, vec: str = "embedding", key: str = "vec_id", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id) of every row of ``rows``."""
    classes = classes_of(rows, vec, key)
    leaves = forest(classes, trees_for(classes.count(), cosine))
    reach = connected_components(settle(links(classes, leaves, cosine, thin=True), "vector-links"))
    keyed = classes.select("cls", "h1", "h2", "n", "first", node_key("cls").alias("node"))
    rooted = settle(keyed.join(reach, "node", "left").withColumn("fam", F.col("root")).drop("root"), "vector-roots")
    linked = counted(rooted.filter("fam is not null").select("fam", "cls", "n"), classes, cosine)
    known = rooted.join(linked, "cls", "left").select("h1", "h2", "n", "first", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("fam", "node").alias("root"))
    known = settle(known, "vector-known")
    least = settle(known.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members")), "vector-components")
    named = settle(join_spread(known, least, ["root"], "members", F.col("h1")).select("h1", "h2", "n", "n_links", "component_id"), "vector-named")
    v = F.col(vec).cast("array<double>")
    asked = rows.select(F.col(key).alias("id"), *(F.when(_sound(v), h).alias(n) for h, n in zip(_keys(v), ("h1", "h2"))))
    out = join_spread(asked, named, ["h1", "h2"], "n", F.xxhash64("id"))
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def op8_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


QUERIES = {"op8_embedding_neardup": op8_embedding_neardup}

ORACLES = {
    "op8_embedding_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, seen) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM reach r JOIN p ON p.a = r.seen)
SELECT e.vec_id, CAST((SELECT count(*) FROM p WHERE p.a = e.vec_id) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT vec_id, min(seen) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
"""
}
