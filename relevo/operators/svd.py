"""Truncated SVD of a sparse table by randomized range finding (V3), and projection on its components (V4, V6).

The rows of the matrix are a table ``(key, cols array<int>, vals array<double>)``; only they grow with the data. One pass
over them takes a basis Q of ``columns x (k + OVERSAMPLE)``, multiplies each block of rows with it (Y = X Q) and adds up
Z = X' Y in slices of columns, which are summed by key; the next basis is the orthonormal part of Z. After ``power`` such
passes the range is fixed, and the last pass also brings the triangular factor R of Y = U R, by a
tall-skinny QR: every task reduces its rows to one small R, and R's are stacked and factored again in a tree. Then U'X = R'^-1 Z'
is a small matrix, whose SVD gives the components. The driver holds matrices of ``columns x (k + OVERSAMPLE)``
numbers, which the size of the vocabulary bounds; rows of X and Y never leave their tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERSAMPLE = 10
POWER = 10
#: Rows that are made dense at a time (only in the columns that they use: the more rows, the emptier), columns of a slice of Z, pieces added in one group.
BLOCK_ROWS = 16
SLICE = 64
FAN = 16


@dataclass
class Svd:
    v: np.ndarray   # columns x components
    s: np.ndarray   # singular values


def _blocks(batch: pa.RecordBatch):
    """(first row, last row, used columns, dense block) of runs of rows."""
    cols, vals = batch.column("cols"), batch.column("vals")
    ends = np.asarray(cols.offsets)
    c, x = np.asarray(cols.values)[ends[0]:ends[-1]], np.asarray(vals.values)[vals.offsets[0].as_py():vals.offsets[-1].as_py()]
    ends = ends - ends[0]
    for lo in range(0, len(ends) - 1, BLOCK_ROWS):
        hi = min(lo + BLOCK_ROWS, len(ends) - 1)
        used, at = np.unique(c[ends[lo]:ends[hi]], return_inverse=True)
        dense = np.zeros((hi - lo, len(used)))
        dense[np.repeat(np.arange(hi - lo), np.diff(ends[lo:hi + 1])), at] = x[ends[lo]:ends[hi]]
        yield lo, hi, used, dense


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.vstack(parts), mode="r")


def sum_up(pieces: DataFrame, keys: list[str], tasks: int, op) -> DataFrame:
    """One piece per ``keys``: at most FAN of a group are combined in a task, and what that leaves is combined again."""
    while tasks > 1:
        tasks = -(-tasks // FAN)
        groups = pieces.withColumn("task", F.expr(f"task div {FAN}"))

        def combine(t: pa.Table) -> pa.Table:
            data = op([np.frombuffer(x.as_buffer()) for x in t.column("data")])
            one = {c: t.column(c)[0].as_py() for c in [*keys, "task"]}
            return pa.table({**{c: pa.array([one[c]], pa.int32()) for c in one}, "data": pa.array([data.tobytes()], pa.binary())})
        pieces = groups.groupBy(*keys, "task").applyInArrow(combine, ", ".join(f"{c} int" for c in [*keys, "task"]) + ", data binary")
    return pieces


def _pass(rows: DataFrame, basis: np.ndarray, factor: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(X'(X basis), R of X basis if ``factor``)."""
    from relevo.session import materialize

    sent = rows.sparkSession.sparkContext.broadcast(basis)
    m, width = basis.shape

    def run(batches):
        from pyspark import TaskContext
        task, q = TaskContext.get().partitionId(), sent.value
        z, held, r = np.zeros((m, width)), [], None
        for batch in batches:
            for _, _, used, dense in _blocks(batch):
                y = dense @ q[used]
                z[used] += dense.T @ y
                if factor:
                    held.append(y)
                    if sum(map(len, held)) >= 4 * width:
                        r, held = _triangle(held if r is None else [r, *held]), []
        if factor and (held or r is not None):
            r = _triangle(held if r is None else [r, *held])
            yield pa.record_batch([pa.array([1], pa.int32()), pa.array([0], pa.int32()), pa.array([task], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["kind", "part", "task", "data"])
        for part in range(0, m, SLICE):
            if z[part:part + SLICE].any():
                yield pa.record_batch([pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([task], pa.int32()), pa.array([z[part:part + SLICE].tobytes()], pa.binary())],
                                      names=["kind", "part", "task", "data"])

    pieces, tasks = rows.select("cols", "vals").mapInArrow(run, "kind int, part int, task int, data binary"), rows.rdd.getNumPartitions()
    pieces = materialize(pieces, "svd-pass") if factor else pieces  # read twice
    z = np.zeros((m, width))
    sums = sum_up(pieces.where("kind = 0").select("part", "task", "data"), ["part"], tasks, lambda xs: np.sum(xs, axis=0))
    for x in sums.collect():                      # as many numbers as the basis has
        piece = np.frombuffer(x["data"]).reshape(-1, width)
        z[x["part"]:x["part"] + len(piece)] = piece
    r = None
    if factor:
        last = sum_up(pieces.where("kind = 1").select("task", "data"), [], tasks, lambda xs: _triangle([x.reshape(-1, width) for x in xs])).collect()
        r = np.frombuffer(last[0]["data"]).reshape(-1, width) if last else np.zeros((0, width))
    sent.destroy()
    return z, r


def fit(rows: DataFrame, columns: int, k: int, power: int = POWER, seed: int = 122) -> Svd:
    """The ``k`` largest singular values of ``rows`` and their right vectors; fewer if the rank is lower."""
    # every task of a pass sends a matrix of columns x width, so tasks must not grow with the rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.coalesce(cores) if rows.rdd.getNumPartitions() > cores else rows
    width = max(1, min(columns, rows.count(), k + OVERSAMPLE))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(columns, width)))[0]
    for _ in range(power):
        q = np.linalg.qr(_pass(rows, q, factor=False)[0])[0]
    z, r = _pass(rows, q, factor=True)
    # Y = X q = U R with R = a s b; then (U a)'X = s^-1 b Z'
    _, s, b = np.linalg.svd(r, full_matrices=False)
    real = s > (s.max(initial=0.0) * 1e-12)
    if not real.any():
        return Svd(np.zeros((columns, 0)), np.zeros(0))
    _, s, vt = np.linalg.svd((b[real] @ z.T) / s[real][:, None], full_matrices=False)
    keep = min(k, int((s > s[0] * 1e-9).sum()))
    return Svd(vt[:keep].T.copy(), s[:keep].copy())


def project(rows: DataFrame, key: str, svd: Svd, out: str = "x") -> DataFrame:
    """V4: (key, out array<double>): X V of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(svd.v)
    kind = dict(rows.dtypes)[key]

    def run(batches):
        for batch in batches:
            x = np.zeros((batch.num_rows, sent.value.shape[1]))
            for lo, hi, used, dense in _blocks(batch):
                x[lo:hi] = dense @ sent.value[used]
            ends = pa.array(np.arange(batch.num_rows + 1) * x.shape[1], pa.int32())
            yield pa.record_batch([batch.column(key), pa.ListArray.from_arrays(ends, pa.array(x.reshape(-1)))], names=[key, out])
    return rows.select(key, "cols", "vals").mapInArrow(run, f"{key} {kind}, {out} array<double>")


def explained_variance_ratio(rows: DataFrame, latent: DataFrame, n_rows: int, out: str = "x") -> float:
    """V6: summed variance of the projected columns over the total column variance of X (population
    variances over all ``n_rows`` rows; absent entries are zeros)."""
    def total(entries: DataFrame) -> float:
        s = entries.groupBy("c").agg(F.sum("v").alias("s1"), F.sum(F.col("v") * F.col("v")).alias("s2"))
        return s.agg(F.sum(F.col("s2") / n_rows - (F.col("s1") / n_rows) ** 2)).first()[0] or 0.0
    entry = F.explode(F.arrays_zip(F.col("cols").alias("c"), F.col("vals").alias("v"))).alias("e")
    all_ = total(rows.select(entry).select("e.c", "e.v"))
    return total(latent.select(F.posexplode(out).alias("c", "v"))) / all_ if all_ else 0.0
