"""Toxicity as severity grades, by cumulative-link (proportional-odds) ordinal regression.

P(grade <= k) = logistic(threshold_k - w.x): one weight vector for all grades, and ordered thresholds. The result
is the expected severity (sum over k of P(grade > k)) and P(grade > 0).

Grades come from the labels: 0 for rows labelled not toxic; toxic rows are graded 1 to GRADES - 1 by how much
they hold of the features that mark the toxic class (quantiles over the toxic rows of the sample), as the labels only say
yes or no.

Features are sparse: words (runs of letters and digits, A-Z lower-cased) and their first PREFIXES bytes, by 64-bit
hash, as inflected forms share their beginning. Of the sample, a feature is used if its document frequencies in the two classes differ by at least MIN_Z standard
errors, at most MAX_FEATURES of them by that measure. A feature's value is log(1 + occurrences).

The sample has at most about SAMPLE_ROWS labelled rows, those with the smallest hash of their id; fitting needs only
their selected features on the driver (SAMPLE_ROWS x MAX_FEATURES counts at the very most, in practice a few a row). Every
text is then scored in full.

Defined cases: null or wordless text has no features and gets the grade odds of the thresholds alone; null labels or ids are
not learned; an id that is labelled several times counts once per label; without toxic or without clean rows everything has
severity 0; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm import words as W
from relevo.session import bounded_batches

SAMPLE_ROWS = 20_000
MAX_FEATURES = 4096
MIN_Z = 5.0
MIN_DOCS = 5
PREFIXES = (4, 5, 6)
GRADES = 4
STEPS = 600
RIDGE = 1e-4
FILTER_BITS = 22
CUTS = (0.5, 0.4, 0.3, 0.2)

#: Bytes between words: all ASCII but letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(col: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(document, feature hash) of every word, and of the beginnings of longer words; per document its words."""
    ws = W.words_of(col, lower=True, between=_BETWEEN)
    doc, out = ws.doc, []
    out.append((doc, ws.hashes(1)))
    for n in PREFIXES:
        long = ws.ends - ws.starts > n
        short = W.Words(ws.data, ws.starts[long], ws.starts[long] + n, ws.first)
        out.append((doc[long], W.mix(short.hashes(1) + np.uint64(n))))
    return out, np.diff(ws.first)


def _distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    cut = np.flatnonzero(new)
    return doc[cut], h[cut], np.diff(np.append(cut, len(doc)))


def _frequencies(batches):
    """(feature, documents, toxic documents) of each task's rows."""
    held: list = []

    def flush():
        if held:
            h, t = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, t = h[order], t[order]
            cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            yield pa.record_batch([W.int64(h[cut]), pa.array(np.diff(np.append(cut, len(h)))), pa.array(np.add.reduceat(t, cut))], names=["feature", "n", "n_toxic"])
            held.clear()

    for batch in batches:
        for part in W.slices(batch):
            found, _ = features(part.column("text"))
            toxic = np.asarray(part.column("toxic")).astype(np.int64)
            d, h, _ = _distinct(*(np.concatenate(x) for x in zip(*found, strict=True)))
            if len(d):
                held.append((h, toxic[d]))
            if sum(len(x[0]) for x in held) > 4_000_000:
                yield from flush()
    yield from flush()


class Selected:
    """Counts of selected features; a small bit table rules most words out before the exact look-up."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes.view(np.uint64))
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[self.hashes & np.uint64((1 << FILTER_BITS) - 1)] = True

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature number, count) sorted by document, and words per document."""
        found, n = features(col)
        docs, hs = [], []
        for doc, h in found:
            hit = self.maybe[h & np.uint64((1 << FILTER_BITS) - 1)]
            docs.append(doc[hit])
            hs.append(h[hit])
        d, h, c = _distinct(np.concatenate(docs), np.concatenate(hs))
        at = np.minimum(np.searchsorted(self.hashes, h), max(0, len(self.hashes) - 1))
        ok = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), dtype=bool)
        return d[ok], at[ok], c[ok], n


def _counts(selected):
    def run(batches):
        pick = Selected(selected.value)
        for batch in batches:
            for part in W.slices(batch):
                d, f, c, n = pick(part.column("text"))
                first = np.searchsorted(d, np.arange(len(n) + 1))
                feats = [f[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:], strict=False)]
                counts = [c[a:b].astype("<i4").tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.record_batch([part.column("toxic"), pa.array(feats, pa.binary()), pa.array(counts, pa.binary()), pa.array(n)], names=["toxic", "f", "c", "n"])

    return run


def fit_cumulative(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, grade: np.ndarray, n_features: int, grades: int, steps: int = STEPS, ridge: float = RIDGE):
    """Weights and ordered thresholds by gradient steps (Adam) on the mean log-likelihood.

    P(grade > k) = logistic(w.x - t_k); the probability of a grade is the difference of two neighbours."""
    share = np.array([(grade > k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    t0 = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(n_features), t0[:1], np.log(np.maximum(np.diff(t0), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = len(grade)
    logistic = lambda x: 1 / (1 + np.exp(-np.clip(x, -35, 35)))
    for step in range(1, steps + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1:])
        t = p[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=vals * w[cols], minlength=n)
        above = np.concatenate([np.ones((n, 1)), logistic(score[:, None] - t), np.zeros((n, 1))], axis=1)
        prob = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-12)
        slope = above * (1 - above)
        low, high = slope[np.arange(n), grade] / prob, slope[np.arange(n), grade + 1] / prob
        g_score = -(low - high) / n
        g_t = np.array([(low[grade == k + 1].sum() - high[grade == k].sum()) / n for k in range(grades - 1)])
        g_w = np.bincount(cols, weights=vals * g_score[rows], minlength=n_features) + ridge * w
        later = np.cumsum(g_t[::-1])[::-1]
        g = np.concatenate([g_w, later[:1], later[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return p[:n_features], p[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(p[n_features + 1:]))])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(feature hashes, weights, thresholds, cut) from a bounded sample of labelled rows; None if a class is missing.

    The cut on P(grade > 0), above which a text counts as toxic, is the one of CUTS with the best F1 on the sample."""
    spark = docs.sparkSession
    bounded_batches(spark)
    lab = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = lab.count()
    if n > sample_rows:  # the expected size of the sample is the bound
        lab = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * sample_rows / n))
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(lab), "doc_id").select("text", "toxic")
    freq = rows.mapInArrow(_frequencies, "feature long, n long, n_toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).where(f"n >= {MIN_DOCS}")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not total.n or not total.t or total.t == total.n:
        return None
    share = total.t / total.n
    z = (F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    picked = freq.withColumn("z", z).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "feature").limit(MAX_FEATURES).select("feature", "z").collect()
    if not picked:
        return None
    hashes = np.sort(np.array([r.feature for r in picked], dtype=np.int64).view(np.uint64))
    sign = {np.int64(r.feature).view(np.uint64): r.z for r in picked}
    marks = np.array([sign[h] > 0 for h in hashes])
    got = rows.mapInArrow(_counts(spark.sparkContext.broadcast(hashes)), "toxic int, f binary, c binary, n long").collect()
    toxic = np.array([r.toxic for r in got])
    sizes = np.array([len(r.f) // 4 for r in got])
    row = np.repeat(np.arange(len(got)), sizes)
    col = np.frombuffer(b"".join(bytes(r.f) for r in got), dtype="<i4").astype(np.int64)
    cnt = np.frombuffer(b"".join(bytes(r.c) for r in got), dtype="<i4")
    amount = np.bincount(row, weights=np.log1p(cnt) * marks[col], minlength=len(got))
    cuts = np.quantile(amount[toxic > 0], np.arange(1, GRADES - 1) / (GRADES - 1))
    grade = np.where(toxic > 0, 1 + np.searchsorted(cuts, amount, side="right"), 0)
    weights, thresholds = fit_cumulative(row, col, np.log1p(cnt), grade, len(hashes), GRADES)
    p = 1 / (1 + np.exp(thresholds[0] - np.bincount(row, weights=np.log1p(cnt) * weights[col], minlength=len(got))))
    f1 = [2 * ((p >= c) & (toxic > 0)).sum() / ((p >= c).sum() + toxic.sum()) for c in CUTS]
    return hashes, weights, thresholds, CUTS[int(np.argmax(f1))]


def _score(model):
    def run(batches):
        hashes, weights, thresholds, cut = model.value
        pick = Selected(hashes)
        for batch in batches:
            for part in W.slices(batch):
                d, f, c, n = pick(part.column("text"))
                x = np.bincount(d, weights=weights[f] * np.log1p(c), minlength=len(n))
                above = 1 / (1 + np.exp(-np.clip(x[:, None] - thresholds, -35, 35)))
                prob = -np.diff(np.concatenate([np.ones((len(n), 1)), above, np.zeros((len(n), 1))], axis=1), axis=1)
                yield pa.record_batch([part.column("doc_id"), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(prob.argmax(axis=1)), pa.array(above[:, 0] >= cut)], names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return run


def severity(docs: DataFrame, model) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic): expected severity, the probability of any, the likeliest grade,
    and whether that probability reaches the model's cut."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("severity"), F.lit(0.0).alias("p_toxic"), F.lit(0).cast("long").alias("grade"), F.lit(False).alias("toxic"))
    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, severity double, p_toxic double, grade long, toxic boolean")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return severity(docs, model)
