"""Cross-tokenizer alignment by an associative monoid of fragments.

Both tokenizers cover the same bytes: a space and the text.  Where tokens of both end at the same byte, a group ends.
A fragment is what a byte range knows by itself: the tokens up to its first common end (its open prefix), the groups
between common ends (closed), and the tokens behind its last (its open suffix); without a common end it is all prefix.
Two neighbours compose into one: suffix and prefix become a closed group, or a longer prefix or suffix.  That is
associative, so a text is cut into ranges of ``RANGE`` bytes, their fragments are taken in any tasks, and those of a long
text are composed in a tree, ``FAN`` at a time.  A text of one range is done by the task that encodes it.  Groups are given out as soon as
they close, with their place; only open ends move up the tree.

Inside a group every stretch between two ends of either side is one link of the two tokens that cover it.  Links are
counted by pair of ids over the whole corpus, then each document's links are scored: the most frequent pairs, at most
``SENT``, are looked up where the document's pairs are read, the others, of which none is frequent, are joined.

A null or empty text, and one whose tokens of either side do not give back a space and the text, has no tokens.  Bytes
that are not UTF-8 count as U+FFFD.  Repeated rows and null ids are documents of their own.  No row gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from lectern.llm import vocab
from lectern.llm.common import for_python, settle, table

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a range, fragments composed by one task, bytes of texts aligned together.
RANGE, FAN, SLICE = 1 << 16, 8, 1 << 20
#: Pairs that are sent to every task at most, 17 bytes each.
SENT = 1 << 20

WHOLE, RANGED, ENDED = 0, 1, 2  # a document done, a range of a long one, groups that closed in a long one


class Vocabularies:
    """What ids of the two sides are: their bytes, lengths, and how they are written in groups."""

    def __init__(self, a: str, b: str):
        self.encode_a, self.encode_b = vocab.byte_level(a, plain=True, spaced=True), vocab.pieces(b)
        self.bytes_a, self.bytes_b = vocab.byte_level_bytes(a), vocab.piece_bytes(b)
        self.whole_a = {bytes([i]) for i in range(256)} <= set(self.bytes_a)  # then it can write any text
        self.long_a, self.long_b = (np.array([len(t) for t in side]) for side in (self.bytes_a, self.bytes_b))
        ids = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.width, self.shown = len(ids), [i + mark for mark in ",|;" for i in ids]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both sides of each text; None where they do not give the text back."""
        out = []
        for text, a, b in zip(texts, self.encode_a(texts), self.encode_b(texts)):
            a, b, want = vocab.numbers(a), vocab.numbers(b), f" {text}".encode()
            joined = lambda ids, side: b"".join(map(side.__getitem__, ids.tolist()))
            out.append((a, b) if text and joined(b, self.bytes_b) == want and (self.whole_a or joined(a, self.bytes_a) == want) else None)
        return out


_made: dict[tuple[str, str], Vocabularies] = {}


def vocabularies(a: str, b: str) -> Vocabularies:
    if (a, b) not in _made:
        _made[a, b] = Vocabularies(a, b)
    return _made[a, b]


@dataclass
class Groups:
    """Closed groups in a row: how they are written, and the pairs of their links, in order."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    pairs: np.ndarray


@dataclass
class Fragment:
    """The open ends of a byte range; ``cut`` if it has a common end, else all tokens are in the prefix."""

    cut: bool
    prefix: tuple[np.ndarray, np.ndarray]
    suffix: tuple[np.ndarray, np.ndarray]


NONE = (np.zeros(0, "<u4"), np.zeros(0, "<u4"))


def both(x: tuple, y: tuple) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])


def _common(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the rising ends of each side are the other side's, too."""
    in_a, in_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    if len(ends_a) and len(ends_b):
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        in_a = ends_b[at] == ends_a
        in_b[at[in_a]] = True
    return in_a, in_b


def closed(v: Vocabularies, a: np.ndarray, b: np.ndarray) -> Groups:
    """The groups of tokens that cover the same bytes on both sides."""
    ends_a, ends_b = np.cumsum(v.long_a[a]), np.cumsum(v.long_b[b])
    in_a, in_b = _common(ends_a, ends_b)
    stops = np.sort(np.concatenate([ends_a, ends_b[~in_b]]), kind="stable")  # two runs, merged
    pairs = a[np.searchsorted(ends_a, stops)].astype(np.int64) << 32 | b[np.searchsorted(ends_b, stops)]
    group_a, group_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    n = int(in_a.sum())
    many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    codes = np.empty(len(a) + len(b), np.int64)
    codes[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = a + v.width * in_a
    codes[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = b + v.width * 2 * in_b
    return Groups(len(a), len(b), n, "".join(map(v.shown.__getitem__, codes.tolist())), pairs)


def fragment(v: Vocabularies, a: np.ndarray, b: np.ndarray, start_a: int, start_b: int) -> tuple[Fragment, Groups | None]:
    """The open ends and the closed groups of the tokens that end in a range; its first ones start at these bytes."""
    cuts = [np.flatnonzero(c) for c in _common(start_a + np.cumsum(v.long_a[a]), start_b + np.cumsum(v.long_b[b]))]
    if not len(cuts[0]):
        return Fragment(False, (a, b), NONE), None
    (first_a, last_a), (first_b, last_b) = (c[[0, -1]] + 1 for c in cuts)
    inner = closed(v, a[first_a:last_a], b[first_b:last_b]) if len(cuts[0]) > 1 else None
    return Fragment(True, (a[:first_a], b[:first_b]), (a[last_a:], b[last_b:])), inner


def composed(v: Vocabularies, left: Fragment, right: Fragment) -> tuple[Fragment, Groups | None]:
    """The fragment of two neighbours, and the group that closes between them, if one does."""
    if not left.cut:
        return Fragment(right.cut, both(left.prefix, right.prefix), right.suffix), None
    if not right.cut:
        return Fragment(True, left.prefix, both(left.suffix, right.prefix)), None
    return Fragment(True, left.prefix, right.suffix), closed(v, *both(left.suffix, right.prefix))


FIELDS = pa.schema({
    "kind": pa.int8(), "row": pa.int64(), "key": pa.int64(), "place": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups": pa.string(),
    "pairs": pa.binary(), "times": pa.binary(), "cut": pa.bool_(), "prefix_a": pa.binary(), "prefix_b": pa.binary(), "suffix_a": pa.binary(), "suffix_b": pa.binary(),
    "start_a": pa.int64(), "start_b": pa.int64(),
})
KIND = from_arrow_schema(FIELDS)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, FIELDS)


def _given(kind: int, row: int, key: int | None, place: int, g: Groups, groups: str) -> dict:
    pairs, times = np.unique(g.pairs, return_counts=True)
    return {"kind": kind, "row": row, "key": key, "place": place, "n_a": g.n_a, "n_b": g.n_b, "n_groups": g.n_groups, "groups": groups, "pairs": pairs.tobytes(), "times": times.astype("<u4").tobytes()}


def _open(row: int, key: int | None, place: int, f: Fragment) -> dict:
    (pa_, pb), (sa, sb) = f.prefix, f.suffix
    return {"kind": RANGED, "row": row, "key": key, "place": place, "cut": f.cut, "prefix_a": pa_.tobytes(), "prefix_b": pb.tobytes(), "suffix_a": sa.tobytes(), "suffix_b": sb.tobytes()}


def _fragment_of(r: dict) -> Fragment:
    ids = [vocab.numbers(r[c]) for c in ("prefix_a", "prefix_b", "suffix_a", "suffix_b")]
    return Fragment(r["cut"], (ids[0], ids[1]), (ids[2], ids[3]))


def digest(text: str) -> str:
    return hashlib.sha256(text.removesuffix(";").encode()).hexdigest()


def _encoded(docs: DataFrame, key: str, text: str, a: str, b: str, size: int) -> DataFrame:
    """A settled row for each text of one range, with its groups as their digest, and for each range of longer ones its tokens."""

    def ranges(v: Vocabularies, row: int, k: int | None, ids: tuple) -> Iterator[dict]:
        ends = [np.cumsum(length[i]) for length, i in zip((v.long_a, v.long_b), ids)]
        bounds = np.arange(0, ends[0][-1] + size, size)
        cuts = [np.searchsorted(e, bounds, "right") for e in ends]
        for j in range(len(bounds) - 1):
            lo, hi = [c[j] for c in cuts], [c[j + 1] for c in cuts]
            tokens = Fragment(False, tuple(i[l:h] for i, l, h in zip(ids, lo, hi)), NONE)
            yield _open(row, k, j, tokens) | {f"start_{s}": int(e[l - 1]) if l else 0 for s, e, l in zip("ab", ends, lo)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a, b)
        for batch in batches:
            data, offsets = batch.column("text"), np.cumsum([0, *(s or 0 for s in batch.column("size").to_pylist())])
            rows, keys, lo = batch.column("row").to_pylist(), batch.column("key").to_pylist(), 0
            while lo < len(rows):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
                out = []
                for row, k, found in zip(rows[lo:hi], keys[lo:hi], v.tokens(vocab.strings(data.slice(lo, hi - lo)))):
                    if found is None:
                        out.append({"kind": WHOLE, "row": row, "key": k, "n_a": 0, "n_b": 0, "n_groups": 0, "groups": "", "pairs": b"", "times": b""})
                    elif v.long_a[found[0]].sum() <= size:
                        f, inner = fragment(v, *found, 0, 0)
                        g = _joined(v, f, inner)
                        out.append(_given(WHOLE, row, k, 0, g, digest(g.text)))
                    else:
                        for r in ranges(v, row, k, found):
                            out.append(r)
                            if len(out) >= 64:
                                yield _batch(out)
                                out = []
                yield _batch(out)
                lo = hi

    body = F.col(text).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), body.alias("text"), F.octet_length(body).alias("size"))
    return settle(for_python(rows).mapInArrow(run, KIND), "aligned-texts")


def _joined(v: Vocabularies, f: Fragment, inner: Groups | None) -> Groups:
    """All groups of a text that is one fragment: its prefix is its first group, its suffix is empty."""
    first = closed(v, *f.prefix)
    if inner is None:
        return first
    return Groups(first.n_a + inner.n_a, first.n_b + inner.n_b, first.n_groups + inner.n_groups, first.text + inner.text, np.concatenate([first.pairs, inner.pairs]))


def _long(ranges: DataFrame, a: str, b: str) -> DataFrame:
    """The groups of the long texts whose ``ranges`` are given, each row with its place in its text.

    Range j gives its inner groups place 2 * j + 1, and the group that ends with its first common end 2 * j.
    """

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a, b)
        for batch in batches:
            for r in batch.to_pylist():
                f, inner = fragment(v, *_fragment_of(r).prefix, r["start_a"], r["start_b"])
                rows = [_open(r["row"], r["key"], r["place"], f) | {"start_a": r["place"]}]
                yield _batch(rows + ([_given(ENDED, r["row"], r["key"], 2 * r["place"] + 1, inner, inner.text)] if inner else []))

    def compose(parts: pa.Table) -> pa.Table:
        v, (r, *others) = vocabularies(a, b), sorted(parts.to_pylist(), key=lambda r: r["place"])
        f, first, out = _fragment_of(r), r["start_a"], []
        for n in others:
            new = _fragment_of(n)
            had = f.cut
            f, group = composed(v, f, new)
            if group:
                out.append(_given(ENDED, r["row"], r["key"], 2 * n["start_a"], group, group.text))
            elif new.cut and not had:
                first = n["start_a"]
        out.append(_open(r["row"], r["key"], r["place"] // FAN, f) | {"start_a": first})
        return pa.Table.from_batches([_batch(out)])

    done = []
    level = settle(for_python(ranges).repartition("row", "place").mapInArrow(single, KIND), "aligned-fragments")
    while True:
        done.append(level.filter(F.col("kind") == ENDED))
        level = level.filter(F.col("kind") == RANGED)
        if not level.agg(F.max("place").alias("last")).first().last:
            break
        level = settle(level.groupBy("row", F.floor(F.col("place") / FAN).alias("above")).applyInArrow(compose, KIND), "aligned-composed")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(a, b)
        for batch in batches:
            for r in batch.to_pylist():
                g = closed(v, *_fragment_of(r).prefix)
                yield _batch([_given(ENDED, r["row"], r["key"], 2 * r["start_a"], g, g.text)])

    out = level.mapInArrow(first, KIND)
    for d in done:
        out = out.unionByName(d)
    return settle(out, "aligned-groups")


def _digests(groups: DataFrame) -> DataFrame:
    """(row, groups): the digest of each long text's groups, read in order, a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, held = None, None, ""
        found: list[tuple[int, str]] = []

        def end():
            state.update(held.removesuffix(";").encode())
            found.append((row, state.hexdigest()))

        for batch in batches:
            for r, text in zip(batch.column("row").to_pylist(), batch.column("groups").to_pylist()):
                if r != row:
                    if state:
                        end()
                    row, state, held = r, hashlib.sha256(), ""
                state.update(held.encode())
                held = text
        if state:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([d for _, d in found], pa.string())], names=["row", "groups"])

    pieces = groups.select("row", "place", "groups").repartition("row").sortWithinPartitions("row", "place").select("row", "groups")
    return for_python(pieces).mapInArrow(run, "row bigint, groups string")


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str = A, b: str = B, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(documents, links) of all texts, both settled.

    Documents are (row, key, n_a, n_b, n_groups, groups): ``row`` tells rows apart, ``groups`` is the digest of the list of
    groups.  Links are (row, pairs, times): id pairs as ``a << 32 | b`` in 64-bit numbers, and how often each is linked, in
    32-bit ones; a long text has several such rows.
    """
    found = _encoded(docs, key, text, a, b, size)
    names = ["row", "key", "n_a", "n_b", "n_groups", "groups"]
    short, ranges = found.filter(F.col("kind") == WHOLE), found.filter(F.col("kind") == RANGED)
    if ranges.isEmpty():
        return short.select(*names), short.select("row", "pairs", "times")
    long = _long(ranges, a, b)
    totals = long.groupBy("row").agg(F.max("key").alias("key"), *(F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups"))).join(_digests(long), "row")
    rows = settle(totals.select(*names), "aligned-long")
    return short.select(*names).unionByName(rows), short.select("row", "pairs", "times").unionByName(long.select("row", "pairs", "times"))


def pair_counts(links: DataFrame) -> DataFrame:
    """A settled (pair, n, best): how many links hold each id pair, and whether none of its B id's pairs has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, times = (np.frombuffer(b"".join(batch.column(c).to_pylist()), k) for c, k in (("pairs", "<i8"), ("times", "<u4")))
            kinds, of = np.unique(pairs, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(of, times, len(kinds)).astype(np.int64))], names=["pair", "n"])

    found = settle(for_python(links.select("pairs", "times")).mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    to = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    most = found.groupBy(to).agg(F.max("n").alias("most"))  # a row for each id of B, so as many as B has at most
    return settle(found.withColumn("b", to).join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-scores")


def scored(links: DataFrame, counts: DataFrame, most: int = SENT) -> DataFrame:
    """(row, n_best, count_sum): sums over the links of each row; a row may come more than once."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")  # at most 1,024 steps
    least, held = 0, 0
    for r in counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        held += r["count"]
        if held > most:
            least = r.step + 1
            break
    top = counts.filter(step >= least).orderBy("pair").toPandas()
    sent = links.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy(k) for c, k in (("pair", np.int64), ("n", np.int64), ("best", bool))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                parts = part.column("pairs").to_pylist()
                pairs, times = np.frombuffer(b"".join(parts), "<i8"), np.frombuffer(b"".join(part.column("times").to_pylist()), "<u4").astype(np.int64)
                rows = np.repeat(part.column("row").to_numpy(), [len(p) // 8 for p in parts])
                at = np.minimum(np.searchsorted(known, pairs), max(0, len(known) - 1))
                hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
                r, of = np.unique(rows[hit], return_inverse=True)
                sums = [np.zeros(len(r), np.int64) for _ in range(2)]
                for s, w in zip(sums, (best, n)):
                    np.add.at(s, of, w[at[hit]] * times[hit])
                one = lambda v, k: pa.array(v, k)
                left = len(rows) - hit.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.append(r, rows[~hit])), pa.array(np.append(np.zeros(len(r), np.int64), pairs[~hit]), mask=np.arange(len(r) + left) < len(r)),
                     one(np.append(np.zeros(len(r), np.int64), times[~hit]), pa.int64()), *(one(np.append(s, np.zeros(left, np.int64)), pa.int64()) for s in sums)],
                    names=["row", "pair", "times", "n_best", "count_sum"],
                )

    found = for_python(links).mapInArrow(run, "row bigint, pair bigint, times bigint, n_best bigint, count_sum bigint")
    near = found.filter("pair is null").select("row", "n_best", "count_sum")
    if not counts.filter(step < least).isEmpty():
        found = settle(found, "pair-links")
        near = found.filter("pair is null").select("row", "n_best", "count_sum")
        rare = found.filter("pair is not null").select("row", "pair", "times").join(counts.filter(step < least), "pair")
        near = near.unionAll(rare.select("row", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long"), F.col("times") * F.col("n")))
    return near


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, links = aligned(table(spark, sf_dir, "documents"))
    none = F.lit(0).cast("long")
    scores = scored(links, pair_counts(links))
    facts = docs.select("row", "key", "n_a", "n_b", "n_groups", "groups", none.alias("n_best"), none.alias("count_sum"), F.lit(True).alias("is_document"))
    nothing = F.lit(None)
    scores = scores.select("row", nothing.cast("long").alias("key"), none.alias("n_a"), none.alias("n_b"), none.alias("n_groups"), nothing.cast("string").alias("groups"), "n_best", "count_sum", F.lit(False).alias("is_document"))
    sums = (F.sum(c).alias(c) for c in ("n_a", "n_b", "n_groups", "n_best", "count_sum"))
    each = facts.unionByName(scores).groupBy("row").agg(F.max("key").alias("doc_id"), F.max("groups").alias("groups_sha256"), *sums)
    return each.select("doc_id", "n_a", "n_b", "n_groups", (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links"), "n_best", "count_sum", "groups_sha256")


QUERIES = {"op13_alignment": op13_alignment}
#: SQL has no tokenizers; the tests compare with tokens held against each other one by one.
ORACLES: dict[str, str] = {}
