"""Language identification by nearest centroids of TF-IDF character n-gram vectors.

A text's vector counts the byte bigrams and trigrams of its lower-cased letters (all else is a blank), hashed
into ``BUCKETS``, square-rooted, weighted by the inverse document frequency over all training rows, and
normalised.  Each language has up to ``CENTROIDS`` centroids, from spherical k-means over a sample of about
``PER_LANGUAGE`` training rows of each, ``SAMPLE`` in all, but ``LEAST`` of each, of the ``LANGUAGES`` with the most training
rows (documented bounds; frequencies use every training row).  A text gets the
language of the centroid with the highest cosine; ``rejected`` says that it lies farther from it than nearly
all sampled texts of that language.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learned.
A null id is never held out and never trained on.  Repeated rows are classified each by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bytetext
from lectern.llm.common import for_python, hash63, limit63, table

BUCKETS, CENTROIDS, SAMPLE, PER_LANGUAGE, LEAST = 4096, 4, 4800, 600, 32
#: Languages that are learned, those with the most training rows; so the sample is LEAST * LANGUAGES vectors at most.
LANGUAGES = 256
#: Share of a language's sampled texts that may lie beyond its rejection distance.
BEYOND = 0.005
ROWS_AT_ONCE = 256

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def gram_counts(column) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, counts): the hashed n-gram counts of runs of at most ROWS_AT_ONCE texts."""
    for first, end, raw, offsets in bytetext.slices(column):
        for lo in range(0, end - first, ROWS_AT_ONCE):
            hi = min(lo + ROWS_AT_ONCE, end - first)
            data = _FOLD[raw[offsets[lo] : offsets[hi]]]
            upper = np.zeros(len(data), bool)  # capital Latin letters with accents, two bytes each
            upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
            data[upper] += 0x20
            text = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
            wide = data.astype(np.uint32)
            counts = np.zeros((hi - lo) * BUCKETS, np.int64)
            pair = (wide[:-1] << np.uint32(8)) | wide[1:]
            for gram, own in ((pair | np.uint32(1 << 24), text[1:] == text[:-1]), ((pair[:-1] << np.uint32(8)) | wide[2:], text[2:] == text[:-2])):
                slot = (gram * np.uint32(2654435761)) >> np.uint32(20)
                where = text[: len(slot)] * BUCKETS + slot
                counts += np.bincount(where[own], minlength=len(counts))
            yield first + lo, first + hi, counts.reshape(-1, BUCKETS)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts.astype(np.float32)) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def document_frequencies(rows: DataFrame, text: str) -> np.ndarray:
    """In how many of ``rows`` each bucket occurs; partial sums are added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, _, counts in gram_counts(b.column(0)):
                total += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(total)], names=["bucket", "n"])

    summed = for_python(rows.select(F.col(text).cast("string"))).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(BUCKETS)
    for r in summed.collect():  # BUCKETS rows
        df[r.bucket] = r.n
    return df


def sampled_vectors(rows: DataFrame, text: str, idf: np.ndarray) -> dict[str, np.ndarray]:
    """Vectors of a bounded sample of ``rows`` (with ``lang``), chosen by a hash of ``pick``."""
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // max(1, len(sizes))))
    shares = rows.sparkSession.createDataFrame([(k, limit63(each, n)) for k, n in sizes.items()], "lang string, last bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, counts in gram_counts(b.column(1)):
                packed = [v.tobytes() for v in vectors(counts, idf)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(packed, pa.binary())], names=["lang", "v"])

    chosen = rows.join(F.broadcast(shares), "lang").filter(hash63("pick", F.lit("sample")) <= F.col("last"))
    found: dict[str, list] = {}
    for r in for_python(chosen.select("lang", F.col(text).cast("string").alias("text"))).mapInArrow(run, "lang string, v binary").collect():
        found.setdefault(r.lang, []).append(np.frombuffer(r.v, np.float32))
    return {k: np.array(v) for k, v in sorted(found.items())}


def centroids_of(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from mutually distant first centres."""
    x = x[np.lexsort(x.T[:8])]
    c = [x.mean(axis=0)]
    for _ in range(min(k, len(x)) - 1):
        c.append(x[np.argmin((x @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.array([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(rows: DataFrame, text: str = "text") -> dict:
    """The model of training ``rows``: lang, ``text`` and ``pick``, a column that spreads the sample."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col(text).rlike(r"\p{L}"))
    n = rows.count()
    idf = np.log((n + 1.0) / (document_frequencies(rows, text) + 1.0)).astype(np.float32) if n else np.zeros(BUCKETS, np.float32)
    if n and not idf.any():  # every text alike
        idf[:] = 1
    names, centres, radii = [], [], []
    for lang, x in sampled_vectors(rows, text, idf).items() if n else ():
        c = centroids_of(x)
        names += [lang] * len(c)
        centres.append(c)
        radii += [float(np.quantile((x @ c.T).max(axis=1), BEYOND))] * len(c)
    return {"idf": idf, "names": names, "centroids": np.concatenate(centres) if centres else np.zeros((0, BUCKETS), np.float32), "least": np.array(radii)}


def predict(rows: DataFrame, model: dict, keep: tuple[str, ...], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score and rejected of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            n = b.num_rows
            lang, score, far = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            lettered = np.asarray(b.column(len(keep) + 1).to_pylist(), bool)
            if len(m["names"]):
                names = np.array(m["names"], object)
                for first, end, counts in gram_counts(b.column(len(keep))):
                    cos = vectors(counts, m["idf"]) @ m["centroids"].T
                    best = cos.argmax(axis=1)
                    top = cos[np.arange(len(best)), best].astype(float)
                    ok = lettered[first:end]
                    lang[first:end] = np.where(ok, names[best], "und")
                    score[first:end] = np.where(ok, np.clip(top, 0, 1), 0)
                    far[first:end] = ~ok | (top < m["least"][best])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], names=[*keep, "lang_pred", "score", "rejected"])

    body = F.col(text).cast("string")
    source = rows.select(*keep, body.alias("_text"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("_lettered"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return for_python(source).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    training = docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()).select("lang", "text", F.col("doc_id").alias("pick"))
    return predict(docs, fit(training), ("doc_id", "held_out"))


QUERIES = {"op1_langid": op1_langid}
ORACLES: dict[str, str] = {}
