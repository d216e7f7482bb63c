"""Quality classification by co-training of two views.

The content view is a text's hashed byte bigrams and trigrams with case and symbols kept, and the shares of
its words that repeat the one before, are single letters or end in a mark; the metadata view is the document's source, language, size and line layout.  Each is a logistic regression fitted on a sample of at
most about ``LABELLED`` labelled ids.  In each of ``ROUNDS`` rounds both views label every other document of
the corpus; of those that a view is sure of, a share that holds about ``PASSED_ON`` of each kind is dealt by hash
and taught to the other view.  Labelled rows held back from training calibrate each view and weigh the calibrated
views against each other; the result scores every document, and those with a score below ``ACCEPT`` are rejected.

``LABELLED`` and ``PASSED_ON`` bound what a classifier is fitted on, given labels and pseudo-labels; what is
labelled in a round, and what is scored, is every whole text.  Labels of a repeated id are averaged, null ones
ignored, and one of its rows is learned from; rows alike in all inputs are one pseudo-label.  With no labels, or
labels of one kind only, every document is accepted with the score 1.  Null texts and null metadata are empty;
repeated rows are scored each by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import bytetext
from lectern.llm.common import for_python, hash63, limit63, settle, table

LABELLED, ROUNDS, SURE = 5000, 4, 0.95
#: Pseudo-labels of each kind that a view passes on in a round, as expected; fewer if it is sure of fewer.
PASSED_ON = 150
#: How many times as many are kept while a round's labels are still being counted.
SPARE = 4
#: Of what each view, 0 or 1, is sure: kind 0 or 1.
GROUPS = ((0, 0), (0, 1), (1, 0), (1, 1))
_SURE_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
ACCEPT = 0.3
BUCKETS, SHAPES, SOURCES, LANGS = 1024, 3, 32, 16
ROWS_AT_ONCE = 512

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[9:14] = 32
_FOLD[48:58] = 48


def content_view(column) -> np.ndarray:
    """(rows, BUCKETS + SHAPES): normalised n-gram weights, and shares of repeated, short and marked words."""
    out = np.zeros((len(column), BUCKETS + SHAPES), np.float32)
    for first, end, raw, offsets in bytetext.slices(column):
        for lo in range(0, end - first, ROWS_AT_ONCE):
            hi = min(lo + ROWS_AT_ONCE, end - first)
            data = _FOLD[raw[offsets[lo] : offsets[hi]]].astype(np.uint32)
            text = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            counts = np.zeros((hi - lo) * BUCKETS, np.int64)
            pair = (data[:-1] << np.uint32(8)) | data[1:]
            for gram, own in ((pair | np.uint32(1 << 24), text[1:] == text[:-1]), ((pair[:-1] << np.uint32(8)) | data[2:], text[2:] == text[:-2])):
                slot = (gram * np.uint32(2654435761)) >> np.uint32(22)
                counts += np.bincount((text[: len(slot)] * BUCKETS + slot)[own], minlength=len(counts))
            v = np.sqrt(counts.reshape(-1, BUCKETS).astype(np.float32))
            out[first + lo : first + hi, :BUCKETS] = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        out[first:end, BUCKETS:] = _word_shapes(_FOLD[raw], offsets)
    return out


def _word_shapes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, text = bytetext.words(data != 32, offsets)
    n = len(offsets) - 1
    if not len(starts):
        return np.zeros((n, SHAPES), np.float32)
    h = bytetext.span_hashes(data, starts, ends)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    last = data[ends - 1]
    marked = (last < 128) & ~(((last | 32) >= 97) & ((last | 32) <= 122)) & (last != 48)
    share = lambda flag: np.bincount(text, flag, n) / np.maximum(np.bincount(text, minlength=n), 1)
    return np.stack([share(again), share(ends - starts == 1), share(marked)], axis=1)


def metadata_view(source: list, lang: list, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """(rows, SOURCES + LANGS + 3) of source, language, size, lines and mean line."""
    out = np.zeros((len(source), SOURCES + LANGS + 3), np.float32)
    at = np.arange(len(source))
    out[at, [zlib.crc32((s or "").encode()) % SOURCES for s in source]] = 1
    out[at, [SOURCES + zlib.crc32((s or "").encode()) % LANGS for s in lang]] = 1
    out[:, -3], out[:, -2], out[:, -1] = np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / np.maximum(lines, 1)) / 10
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights, the last one the intercept, of a ridge logistic regression by Newton's method.

    The rows stay in single precision, so that no second, wider copy of them is held; the system is solved in
    double precision.
    """
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        gradient = x.T @ (p - y).astype(np.float32) + penalty * w
        curved = np.zeros((x.shape[1], x.shape[1]))
        for lo in range(0, len(x), 1024):
            part = x[lo : lo + 1024]
            curved += (part * (p[lo : lo + 1024] * (1 - p[lo : lo + 1024]) + 1e-6)[:, None].astype(np.float32)).T @ part
        step = np.linalg.solve(curved + np.diag(penalty), gradient)
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


def margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]


def _inputs(docs: DataFrame, text: str) -> list:
    """The columns that the views read, under names of their own."""
    body, have = F.coalesce(F.col(text).cast("string"), F.lit("")), set(docs.columns)
    said = lambda c: (F.col(c).cast("string") if c in have else F.lit(None).cast("string"))
    lines = F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1
    return [body.alias("_q_text"), said("source").alias("_q_source"), said("lang").alias("_q_lang"), F.length(body).alias("_q_size"), lines.alias("_q_lines")]


def _views(b: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray]:
    size, lines = (b.column(at + i).to_numpy(zero_copy_only=False) for i in (3, 4))
    return content_view(b.column(at)), metadata_view(b.column(at + 1).to_pylist(), b.column(at + 2).to_pylist(), size, lines)


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _features(rows: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """The first column and both views of bounded ``rows``, (key, the inputs), in the order of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [pa.array([v.tobytes() for v in x], pa.binary()) for x in _views(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *packed], names=["key", "content", "meta"])

    got = for_python(rows).mapInArrow(run, f"key {rows.schema[0].dataType.simpleString()}, content binary, meta binary").collect()
    got.sort(key=lambda r: (r.key, r.content))
    unpack = lambda name, width: np.frombuffer(b"".join(r[name] for r in got), np.float32).reshape(len(got), width)
    return [r.key for r in got], unpack("content", BUCKETS + SHAPES), unpack("meta", SOURCES + LANGS + 3)


def chosen_labels(labels: DataFrame, doc: str = "doc_id", label: str = "quality") -> DataFrame:
    """A settled (_q_doc, _q_y) of the ids, about LABELLED, whose labels are learned from."""
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc).isNotNull())
    drawn = marked.filter(hash63(F.col(doc), F.lit("labelled")) <= limit63(LABELLED, marked.count()))
    return settle(drawn.groupBy(F.col(doc).alias("_q_doc")).agg((F.avg(label) >= 0.5).cast("double").alias("_q_y")), "quality-labels")


def sample(rows: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y, content, metadata) of the ``chosen`` ids, one row of each id, in an order drawn by hash."""
    inputs = [c for c in rows.columns if c not in ("_q_id", "_q_mark")]
    found = rows.join(F.broadcast(chosen), F.col("_q_id") == F.col("_q_doc")).groupBy("_q_id", "_q_y").agg(F.min(F.struct(*inputs)).alias("one"))
    fold = F.pmod(F.xxhash64("_q_id", F.lit("fold")), F.lit(1_000_000))
    keys, *views = _features(found.select(F.struct(fold.alias("fold"), F.col("_q_y").alias("y")).alias("key"), "one.*"))
    return np.array([k.y for k in keys], float), *views


def _sure(rows: DataFrame, weights: list[np.ndarray], turn: int, caps: list[int]) -> DataFrame:
    """Both views label all of ``rows``: a settled (g, mark, draw, seen, n).

    There is a row for each one of group ``g`` whose draw is at most its cap, with what the other view sees of it,
    and from each task a row with how many rows, ``n``, each group has there.
    """
    shared, inputs = rows.sparkSession.sparkContext.broadcast((weights, caps)), [c for c in rows.columns if c not in ("_q_id", "_q_mark")]
    draws = [hash63("_q_mark", F.lit(turn), F.lit(i)) for i in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, caps = shared.value
        names, sizes, seen = ["g", "mark", "draw", "seen", "n"], [0] * len(GROUPS), set()
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part, found = b.slice(lo, ROWS_AT_ONCE), []
                views = _views(part, 3)
                p = [_probability(margin(v, w)) for v, w in zip(views, weights)]
                mark, *draw = (part.column(i).to_numpy() for i in range(3))
                for g, (i, kind) in enumerate(GROUPS):
                    sure = p[i] >= SURE if kind else p[i] <= 1 - SURE
                    sizes[g] += int(sure.sum())
                    for at in np.flatnonzero(sure & (draw[i] <= caps[g])):
                        if (g, mark[at]) not in seen:  # rows alike, however many, are one
                            seen.add((g, mark[at]))
                            found.append((g, mark[at], draw[i][at], views[1 - i][at].tobytes(), 0))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _SURE_TYPES)], names=names)
        found = [(g, None, None, None, n) for g, n in enumerate(sizes)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), _SURE_TYPES)], names=names)

    said = for_python(rows.select("_q_mark", *draws, *inputs)).mapInArrow(run, "g int, mark long, draw long, seen binary, n long")
    return settle(said, "quality-sure")


def confident(rows: DataFrame, weights: list[np.ndarray], turn: int, expected: list[int] | None = None) -> list[dict[int, tuple[float, np.ndarray]]]:
    """What each view is told by the other in round ``turn``: the kind and its own features, by a row's mark.

    Both views label all of ``rows``.  Of the rows of a kind that a view is sure of, those are passed on whose
    hash falls in a share of PASSED_ON of their number.  That number is known when all are labelled, so the pass
    keeps what falls in a share SPARE times as large of the ``expected`` number, all rows by default; only for
    groups with fewer than a SPARE-th of that are the rows read again.
    """
    expected = expected or [rows.count()] * len(GROUPS)
    caps = [limit63(SPARE * PASSED_ON, n) for n in expected]
    said = _sure(rows, weights, turn, caps)
    n = {r.g: r.n for r in said.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    limits = [limit63(PASSED_ON, n[g]) if n.get(g) else -1 for g in range(len(GROUPS))]
    missed = [limit if limit > cap else -1 for limit, cap in zip(limits, caps)]
    if max(missed) >= 0:
        said = said.unionByName(_sure(rows, weights, turn, missed))
    limit = F.array(*map(F.lit, limits))[F.col("g")]
    told: list[dict] = [{}, {}]
    for r in said.filter(F.col("draw") <= limit).dropDuplicates(["g", "mark"]).collect():  # about 4 * PASSED_ON
        i, kind = GROUPS[r.g]
        told[1 - i][r.mark] = (float(kind), np.frombuffer(r.seen, np.float32))
    return told


def sure_of(weights: list[np.ndarray], views: tuple[np.ndarray, np.ndarray], total: int) -> list[int]:
    """How many of ``total`` rows each group should have, by the rows of ``views``; at least one."""
    p = [_probability(margin(v, w)) for v, w in zip(views, weights)]
    shares = [np.mean(p[i] >= SURE if kind else p[i] <= 1 - SURE) for i, kind in GROUPS]
    return [max(1, int(share * total)) for share in shares]


def cotrain(y: np.ndarray, views: tuple[np.ndarray, np.ndarray], ask: Callable[[list, int], list[dict]]) -> dict | None:
    """The calibrated, combined model of two views, or None if there are not two kinds of labels.

    ``ask`` gives what each view is told by the other, as ``confident`` does, for weights and a round.
    """
    at = np.arange(len(y))
    if len(set(y.tolist())) < 2:
        return None
    held = at[2::3] if len(y) >= 60 else at
    training = np.setdiff1d(at, held) if len(y) >= 60 else at
    if len(set(y[training].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = training = at
    told: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]

    def fit_view(i: int) -> np.ndarray:
        extra = [told[i][m] for m in sorted(told[i])]
        x = np.concatenate([views[i][training], *(v[None, :] for _, v in extra)])
        return logistic(x, np.concatenate([y[training], [kind for kind, _ in extra]]))

    weights = [fit_view(0), fit_view(1)]
    for turn in range(ROUNDS):
        for mine, more in zip(told, ask(weights, turn)):
            mine.update({m: v for m, v in more.items() if m not in mine})
        weights = [fit_view(0), fit_view(1)]
    scales = [logistic(margin(views[i][held], weights[i])[:, None], y[held], 1e-3) for i in (0, 1)]
    calibrated = np.stack([margin(margin(views[i][held], weights[i])[:, None], scales[i]) for i in (0, 1)], axis=1)
    return {"weights": weights, "scales": scales, "mix": logistic(calibrated, y[held], 1e-3)}


def _score(model: dict | None, views) -> list[np.ndarray]:
    if model is None:
        return [np.ones(len(views[0]))] * 3
    z = [margin(margin(v, w)[:, None], s) for v, w, s in zip(views, model["weights"], model["scales"])]
    return [_probability(m) for m in (*z, margin(np.stack(z, axis=1), model["mix"]))]


SCORES = ("p_content", "p_metadata", "score")


def scored(docs: DataFrame, model: dict | None, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns as one struct ``row``, and p_content, p_metadata and score, the probabilities of good quality, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS_AT_ONCE):
                part = b.slice(lo, ROWS_AT_ONCE)
                p = _score(shared.value, _views(part, 1))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, p)], names=["row", *SCORES])

    rows = docs.select(F.struct(*keep).alias("row"), *_inputs(docs, text))
    schema = T.StructType([rows.schema["row"]])
    for name in SCORES:
        schema = schema.add(name, "double")
    return for_python(rows).mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is ACCEPT or more."""
    return scored(docs, fit(docs, labels), docs.columns).filter(F.col("score") >= ACCEPT).select("row.*")


def fit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> dict | None:
    """The model learned from ``labels`` and, round by round, from every other row of ``docs``; None without two kinds of labels."""
    rows = docs.select(F.col(doc).alias("_q_id"), *_inputs(docs, text))
    rows = rows.withColumn("_q_mark", F.xxhash64("_q_id", "_q_text", "_q_source", "_q_lang"))
    chosen = chosen_labels(labels, doc)
    y, *views = sample(rows, chosen)
    others = rows.join(F.broadcast(chosen), F.col("_q_id") == F.col("_q_doc"), "left_anti")
    total = others.count()
    return cotrain(y, tuple(views), lambda weights, turn: confident(others, weights, turn, sure_of(weights, views, total)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("row.doc_id", *SCORES, (F.col("score") >= ACCEPT).alias("accepted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
