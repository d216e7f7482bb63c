"""PCA whitening by weighted multiplicity covariance: equal vectors are fitted and whitened once.

An entry c becomes the whole number floor(``SCALE`` * c) + ``OFFSET``, and rows with equal numbers are one class, with
their count as its weight in the fit (or one).  Sums are exact; every class is centred by them before it is multiplied,
each task gives the products of its classes as one matrix, and matrices are added in a tree of tasks.  What the driver
sees is one matrix of the vectors' dimensions, however many rows there are: it takes its eigenvectors and sends
back ``COMPONENTS`` of them.  Each class is whitened once and joined to its rows.

Dropped: vectors that are null, empty, or hold null or non-finite entries, and vectors of another length than the
one most rows have (of equally frequent ones the shortest), which have no place in the same list.  Entries are held
within ``LIMIT`` before they are added up; a deviation beyond 64 bits is null.  A component whose share of the variance is
nil in double precision cannot be whitened: its values are 0, and it does not count in ``identity_error``.  Repeated rows and null ids are
rows of their own.  No row gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import for_python, join_spread, settle, table

SCALE, OFFSET = 64, 1_000_000
#: Largest whole number, either sign, that an entry may become.
LIMIT = 1 << 40
COMPONENTS = 32
#: Matrices that one task adds up.
FAN = 32
#: Classes multiplied at once.
TOGETHER = 4096


@dataclass
class Model:
    """What whitening needs: the rows and sums fitted on, unit eigenvectors in columns, their eigenvalues, the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """One over the root of each eigenvalue; 0 where there is no variance."""
        sound = self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return np.where(sound, 1 / np.sqrt(np.where(sound, self.values, 1)), 0.0)


def _whole(v: Column) -> Column:
    held = lambda c: F.greatest(F.least(c * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return F.transform(v, lambda c: F.floor(held(c)).cast("long") + OFFSET)


def _keys(x: Column) -> list[Column]:
    return [F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2")]


def _sound(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))


def classes_of(rows: DataFrame, vec: str, unit: bool = False) -> DataFrame:
    """A settled (h1, h2, n, weight, x): the different vectors of whole numbers, how many rows have each, its weight in the fit."""
    v = F.col(vec).cast("array<double>")
    grouped = rows.filter(_sound(v)).select(_whole(v).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    found = settle(grouped.select(*_keys(F.col("x")), "n", (F.lit(1).cast("long") if unit else F.col("n")).alias("weight"), "x"), "whiten-classes")
    usual = found.groupBy(F.size("x").alias("width")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "width").first()
    return found.filter(F.size("x") == (usual.width if usual else 0))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _added(parts: DataFrame) -> np.ndarray | None:
    """The sum of the matrices of ``parts`` (part, m), added FAN at a time; parts are taken in order, so one outcome."""
    parts = settle(parts, "whiten-parts")
    count = parts.count()
    while count > 1:

        def add(key, pdf):
            pdf = pdf.sort_values("part")
            total = np.sum([np.frombuffer(m) for m in pdf["m"]], axis=0)
            return pdf.head(1).assign(part=key[0], m=[total.tobytes()])

        parts = settle(parts.groupBy((F.floor(F.col("part") / FAN)).cast("int").alias("group")).applyInPandas(add, parts.schema), "whiten-parts")
        count = parts.count()
    found = parts.first()
    return None if found is None else np.frombuffer(found.m)


def covariance(classes: DataFrame, values: str, means, n: int) -> np.ndarray | None:
    """The covariance, divisor ``n``, of ``values`` weighted by ``weight``; ``means`` gives a task's matrix of values centred."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            weight = b.column("weight").to_numpy().astype(float)
            for lo in range(0, b.num_rows, TOGETHER):
                z = means(b.column(values).slice(lo, TOGETHER))
                product = (z * weight[lo : lo + TOGETHER, None]).T @ z
                total = product if total is None else total + product
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

    found = _added(for_python(classes.select("weight", values)).mapInArrow(run, "part int, m binary"))
    return None if found is None else found.reshape(int(len(found) ** 0.5), -1) / n


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums as doubles, each rounded once."""
    if (np.abs(x).max(initial=0) + 1) * n < 1 << 62:
        return (x * n - sums.astype(np.int64)).astype(float)
    return (x.astype(object) * n - sums).astype(float)


def _sums(classes: DataFrame) -> np.ndarray:
    """The exact sum of each dimension, weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x, weight = _matrix(b.column("x"), np.int64), b.column("weight").to_numpy()
            fits = (int(np.abs(x).max(initial=0)) + 1) * int(weight.sum()) < 1 << 62
            part = (x if fits else x.astype(object)).T @ weight
            total = part.astype(object) if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["at", "s"])

    parts = for_python(classes.select("weight", "x")).mapInArrow(run, "at int, s decimal(38,0)")
    return np.array([int(r.s) for r in parts.groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()], object)


def fit(classes: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of settled ``classes``; None without any."""
    n = classes.agg(F.sum("weight").alias("n")).first().n
    if not n:
        return None
    sums = _sums(classes)
    v = covariance(classes, "x", lambda c: _deviations(_matrix(c, np.int64), n, sums) / n, n)
    values, vectors = np.linalg.eigh(v)
    top = np.argsort(values, kind="stable")[::-1][:components]
    vectors = vectors[:, top]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(top))] < 0, -1.0, 1.0)
    return Model(n, sums, vectors, np.maximum(values[top], 0.0), float(np.trace(v)))


def _exact(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """The sum over dimensions of (n * x - S)^2 of each row, as whole numbers; None beyond 64 bits."""
    if n * (np.abs(x).max(initial=0) + 1) < 1 << 62:
        d = x * n - sums.astype(np.int64)
        if float(np.abs(d.astype(float)).max(initial=0)) ** 2 * x.shape[1] < 2.0**62:
            return (d * d).sum(axis=1).tolist()
    found = ((x.astype(object) * n - sums) ** 2).sum(axis=1)
    return [int(f) if f < 1 << 63 else None for f in found]


def whitened(rows: DataFrame, vec: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, unit: bool = False) -> tuple[DataFrame, Model | None, float]:
    """(key, deviation, whitened) of every sound row, the model, and the largest error of the covariance of ``whitened``.

    ``unit`` fits on the different vectors, each once, instead of on all rows.
    """
    kind = rows.select(F.col(key)).schema.fields[0].dataType.simpleString()
    classes = classes_of(rows, vec, unit)
    model = fit(classes, components)
    if model is None:
        return rows.limit(0).select(F.col(key), F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None, 0.0
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        turn = m.vectors * m.scales
        for b in batches:
            for lo in range(0, b.num_rows, TOGETHER):
                part = b.slice(lo, TOGETHER)
                x = _matrix(part.column("x"), np.int64)
                z = _deviations(x, m.n, m.sums) / m.n @ turn
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("h1", "h2", "n", "weight")), pa.array(_exact(x, m.n, m.sums), pa.int64()), lists], names=["h1", "h2", "n", "weight", "deviation", "whitened"])

    turned = settle(for_python(classes).mapInArrow(run, "h1 bigint, h2 bigint, n bigint, weight bigint, deviation bigint, whitened array<double>"), "whiten-turned")
    mean = [r.m for r in turned.select("weight", F.posexplode("whitened").alias("at", "z")).groupBy("at").agg((F.sum(F.col("z") * F.col("weight")) / model.n).alias("m")).orderBy("at").collect()]
    held = np.array(mean)
    error = np.abs((covariance(turned, "whitened", lambda c: _matrix(c, float) - held, model.n) - np.eye(len(held)))[np.ix_(model.scales > 0, model.scales > 0)]).max(initial=0.0)
    v = F.col(vec).cast("array<double>")
    asked = rows.filter(_sound(v)).select(F.col(key).cast(kind).alias("id"), *_keys(_whole(v)))
    joined = join_spread(asked, turned.drop("weight"), ["h1", "h2"], "n", F.xxhash64("id"), "inner")
    return joined.select(F.col("id").alias(key), "deviation", "whitened"), model, float(error)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, model, error = whitened(table(spark, sf_dir, "embeddings"))
    shares = [float(v / model.trace) if model.trace else 0.0 for v in model.values] if model else []
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    share = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("at"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation",
        "whitened", share.alias("explained"), F.lit(error).alias("identity_error"),
    )


QUERIES = {"op12_whitening": op12_whitening}
#: SQL has no eigenvectors; the tests compare with a fit over all rows in plain numpy.
ORACLES: dict[str, str] = {}
