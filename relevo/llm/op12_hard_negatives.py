"""Hard negatives by coordinate pruning of length buckets.

Rows are dealt to buckets of nearly equal vector length, and each bucket is cut into blocks of at most BLOCK_ROWS
rows. A block is one row of a table: the ids, labels and components of its vectors, and for every coordinate the order of
its vectors by their unit value there. Anchors are packed likewise, ANCHOR_ROWS at a time.

Each pack of anchors meets each block of the buckets that are long enough for one of its anchors to reach its least
wanted score there. In a task, for an anchor q and a block, that score gives the least cosine t, and t gives for each of
the FOCUS coordinates where q is largest the range of unit values that a vector within arccos(t) of q can have. A range is a
stretch of a sorted list; the shortest one gives the candidates, the others thin them out, and what is left is scored
exactly in integers.

First search: the best rows of the anchor's label; a few exact scores in each block bound what is wanted there. Second search: rows of other
labels that score between RATIO times the positive and the positive, for all positives of the anchor at once. A task returns at most
``n`` rows per block, anchor and positive, so hot vectors and labels add nothing; windows over salted groups keep the first of those.
Packs of anchors and blocks meet in a join on bucket and block group; neither side is broadcast or collected.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; a null id is neither an anchor nor
divisible by anything, and comes after all ids; rows that repeat an anchor's id are not its positives, and an anchor id that occurs
with several vectors or labels answers for each of them; missing components of shorter vectors are 0, an empty vector is zero; ties go to the
smaller id; a negative positive score has no negatives, as the range is empty; scores are exact while 64-bit integers hold them;
other columns are ignored; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.operators.topn import top_n_per_group
from relevo.session import bounded_batches, materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: Least score of a negative, in hundredths of the positive's.
RATIO = 80
ANCHOR_STEP = 100
BLOCK_ROWS = 4096
ANCHOR_ROWS = 512
#: Coordinates whose ranges are intersected.
FOCUS = 4
#: Lengths in a bucket differ by at most this factor.
BUCKET_RATIO = 1.1
#: Blocks of a bucket that one key of the join holds.
GROUP_BLOCKS = 16
#: Rows of an anchor's label in a block that are scored before ranges are taken.
FIRST_ROWS = 64
NO_ID = (1 << 63) - 1

BLOCK_SCHEMA = "block long, bucket int, longest double, n int, dim int, ids binary, labels binary, data binary, orders binary"


def prepare(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v, bucket) of the rows that take part; ``v`` holds whole numbers as doubles."""
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("double"))
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    df = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(finite, F.lit(True)))
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    return df.withColumn("bucket", F.when(length > 0, F.floor(F.log(length) / math.log(BUCKET_RATIO))).otherwise(-1).cast("int"))


def _matrix(col: pa.Array) -> np.ndarray:
    """The rows of a list column as a matrix; shorter rows end in zeros."""
    sizes = np.diff(np.asarray(col.offsets))
    flat = np.asarray(col.flatten(), dtype=np.float64)
    out = np.zeros((len(col), max(1, int(sizes.max(initial=0)))))
    out[np.repeat(np.arange(len(col)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.sqrt((data * data).sum(axis=1))
    return data / np.where(length == 0, 1.0, length)[:, None], length


def _pack(limit: int):
    """Packs of at most ``limit`` rows of one bucket; rows come sorted by bucket."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("longest", pa.float64()), ("n", pa.int32()), ("dim", pa.int32()),
                        *[(c, pa.binary()) for c in ("ids", "labels", "data", "orders")]])

    def run(batches):
        from pyspark import TaskContext
        made = 0

        def block(bucket, parts):
            nonlocal made
            ids, labels = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            data = np.zeros((len(ids), max(p[2].shape[1] for p in parts)))
            at = 0
            for p in parts:
                data[at:at + len(p[0]), :p[2].shape[1]] = p[2]
                at += len(p[0])
            order = np.argsort(labels, kind="stable")  # a label is one stretch of a block
            ids, labels, data = ids[order], labels[order], data[order]
            unit, length = _units(data)
            orders = np.argsort(unit, axis=0, kind="stable").T.astype(np.uint16)
            number = (TaskContext.get().partitionId() << 32) + made
            made += 1
            cols = (number, bucket, float(length.max()), len(ids), data.shape[1], ids.tobytes(), labels.tobytes(), data.tobytes(), orders.tobytes())
            return pa.record_batch([pa.array([c], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        held, have, bucket = [], 0, None
        for batch in batches:
            ids = np.asarray(batch.column("vec_id").fill_null(NO_ID))
            labels, buckets, data = np.asarray(batch.column("label")), np.asarray(batch.column("bucket")), _matrix(batch.column("v"))
            at = 0
            while at < len(ids):
                if buckets[at] != bucket:
                    if held:
                        yield block(bucket, held)
                    held, have, bucket = [], 0, int(buckets[at])
                stop = min(len(ids), at + limit - have)
                other = np.flatnonzero(buckets[at:stop] != bucket)
                stop = at + int(other[0]) if len(other) else stop
                held.append((ids[at:stop], labels[at:stop], data[at:stop]))
                have, at = have + stop - at, stop
                if have == limit:
                    yield block(bucket, held)
                    held, have = [], 0
        if held:
            yield block(bucket, held)
    return run


def blocks(rows: DataFrame, limit: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` of ``prepare`` in packs of one bucket; rows of one label lie together. ``limit`` is below 65,536."""
    dealt = rows.repartitionByRange("bucket", "label", F.xxhash64("vec_id")).sortWithinPartitions("bucket", "label")
    return dealt.select("vec_id", "label", "v", "bucket").mapInArrow(_pack(limit), BLOCK_SCHEMA)


class _Block:
    """A pack, read without copying."""

    def __init__(self, row: dict):
        n, d = row["n"], row["dim"]
        self.ids, self.labels = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels"))
        self.data = np.frombuffer(row["data"], dtype=np.float64).reshape(n, d)
        self.orders = np.frombuffer(row["orders"], dtype=np.uint16).reshape(d, n)
        self.unit, self.length = _units(self.data)
        self.longest = float(self.length.max())
        self.sorted = np.take_along_axis(self.unit.T, self.orders.astype(np.int64), axis=1)
        exact = float(np.abs(self.data).max(initial=0)) ** 2 * d
        self.whole = None if exact < 2 ** 50 else self.data.astype(np.int64)

    def scores(self, at, q: np.ndarray, fits: bool) -> np.ndarray:
        """Inner products of the rows ``at`` with ``q``: doubles while they hold the sums exactly, else 64-bit integers."""
        d = min(self.data.shape[1], len(q))
        if self.whole is None and fits:
            return (self.data[at, :d] @ q[:d]).astype(np.int64)
        return self.data[at, :d].astype(np.int64) @ q[:d].astype(np.int64)

    def candidates(self, unit: np.ndarray, length: float, wanted: float, focus: np.ndarray) -> np.ndarray | None:
        """Rows whose score with the anchor can reach ``wanted``; None: all rows."""
        if wanted <= 0:
            return None
        if length * self.longest <= 0:
            return self.ids[:0].astype(np.int64)
        t = wanted / (length * self.longest) - 1e-9
        if t > 1:
            return self.ids[:0].astype(np.int64)
        focus = focus[focus < self.data.shape[1]]
        if t <= 0 or not len(focus):
            return None
        a, tau = np.arccos(np.clip(unit[focus], -1, 1)), math.acos(t)
        low, high = np.cos(np.minimum(a + tau, math.pi)) - 1e-9, np.cos(np.maximum(a - tau, 0.0)) + 1e-9
        first = np.array([np.searchsorted(self.sorted[f], x, side="left") for f, x in zip(focus, low, strict=True)])
        last = np.array([np.searchsorted(self.sorted[f], x, side="right") for f, x in zip(focus, high, strict=True)])
        best = int(np.argmin(last - first))
        rows = self.orders[focus[best], first[best]:last[best]].astype(np.int64)
        for i, f in enumerate(focus):
            if i != best and len(rows):
                u = self.unit[rows, f]
                rows = rows[(u >= low[i]) & (u <= high[i])]
        return rows


def _first(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties by smaller id."""
    if len(rows) > 4 * n:  # only rows at or above the n-th score are sorted
        least = np.partition(score, len(score) - n)[len(score) - n]
        keep = np.flatnonzero(score >= least)
    else:
        keep = np.arange(len(rows))
    return keep[np.lexsort((ids[rows[keep]], -score[keep]))[:n]]


def _anchors_of(pack: _Block):
    """(i, vector, unit, length, focus coordinates, whether doubles are exact) of each anchor."""
    focus = np.argsort(-np.abs(pack.unit), axis=1, kind="stable")[:, :FOCUS]
    for i in range(len(pack.ids)):
        yield i, pack.data[i], pack.unit[i], float(pack.length[i]), focus[i], pack.whole is None


def _pairs(batches):
    """(pack of anchors with its other columns, block) of each row of the join; a block or pack that follows itself is read once."""
    held = {}

    def read(side: str, row: dict) -> _Block:
        if held.get(side, (None,))[0] != row[f"{side}_block"]:
            held[side] = (row[f"{side}_block"], _Block({k.removeprefix(f"{side}_"): v for k, v in row.items() if k.startswith(side)}))
        return held[side][1]

    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            yield row, read("a", row), read("b", row)


def _batch(schema: pa.Schema, columns: list[list]):
    return pa.record_batch([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _search_positives(n: int):
    schema = pa.schema([("a_block", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        for row, pack, block in _pairs(batches):
            out = [[] for _ in schema]
            lo, hi = np.searchsorted(block.labels, pack.labels, side="left"), np.searchsorted(block.labels, pack.labels, side="right")
            for i, q, unit, length, focus, fits in _anchors_of(pack):
                if lo[i] == hi[i]:
                    continue
                own = pack.ids[i]
                first = np.arange(lo[i], min(hi[i], lo[i] + FIRST_ROWS))
                score = block.scores(first, q, fits)
                known = np.sort(score[block.ids[first] != own])
                rows = None
                if hi[i] - lo[i] > len(first) and len(known) >= n:
                    rows = block.candidates(unit, length, float(known[-n]), focus)
                rows = np.arange(lo[i], hi[i]) if rows is None else rows[(rows >= lo[i]) & (rows < hi[i])]
                rows = rows[block.ids[rows] != own]
                score = block.scores(rows, q, fits)
                top = _first(rows, score, block.ids, n)
                for c, x in zip(out, (np.full(len(top), row["a_block"]), np.full(len(top), i), np.full(len(top), own), block.ids[rows[top]], score[top]), strict=True):
                    c.append(x)
            yield _batch(schema, out)
    return run, "a_block long, slot int, anchor_id long, positive_id long, score long"


def _search_negatives(n: int, ratio: int):
    schema = pa.schema([("a_block", pa.int64()), ("slot", pa.int32()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()),
                        ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])

    def run(batches):
        for row, pack, block in _pairs(batches):
            out = [[] for _ in schema]
            anchors = {p["slot"]: p["positives"] for p in row["positives"]}
            for i, q, unit, length, focus, fits in _anchors_of(pack):
                positives = [p for p in anchors.get(i, ()) if p["score"] >= 0]
                if not positives:
                    continue
                least = min(-(-ratio * p["score"] // 100) for p in positives)
                most = max(p["score"] for p in positives)
                rows = block.candidates(unit, length, float(least), focus)
                rows = np.arange(len(block.ids)) if rows is None else rows
                rows = rows[block.labels[rows] != pack.labels[i]]
                score = block.scores(rows, q, fits)
                keep = (score >= least) & (score <= most)
                rows, score = rows[keep], score[keep]
                for p in positives:
                    near = np.flatnonzero((score <= p["score"]) & (score >= -(-ratio * p["score"] // 100)))
                    top = near[_first(rows[near], score[near], block.ids, n)]
                    cols = (row["a_block"], i, pack.ids[i], p["rank"], NO_ID if p["positive_id"] is None else p["positive_id"], p["score"])
                    for c, x in zip(out, (*[np.full(len(top), v) for v in cols], block.ids[rows[top]], score[top]), strict=True):
                        c.append(x)
            yield _batch(schema, out)
    return run, "a_block long, slot int, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _meet(anchors: DataFrame, index: DataFrame, least: Column | None) -> DataFrame:
    """Packs of anchors with the blocks of the buckets that they may need, joined on (bucket, group of blocks).

    ``least``, if given, is the least score that is of any use to a pack: buckets whose longest vector can't reach it are left out."""
    stats = index.groupBy("bucket").agg(F.max("longest").alias("longest"), F.count("*").alias("n"))
    stats = {r["bucket"]: (r["longest"], -(-r["n"] // GROUP_BLOCKS)) for r in stats.collect()}  # as many as a length has powers: a few thousand at most
    parts = F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(x).alias("longest"), F.lit(g).cast("long").alias("groups")) for k, (x, g) in stats.items()])
    groups = F.create_map(*[x for k, (_, g) in stats.items() for x in (F.lit(k), F.lit(g).cast("long"))])
    b = index.select(F.col("bucket"), F.pmod(F.xxhash64("block"), F.element_at(groups, F.col("bucket"))).alias("part"), *[F.col(c).alias(f"b_{c}") for c in index.columns])
    a = anchors.withColumn("s", F.explode(parts))
    a = a if least is None else a.where(F.col("s.longest") * F.col("a_longest") * (1 + 1e-9) >= least)
    a = a.withColumn("bucket", F.col("s.bucket")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("s.groups") - 1))).drop("s")
    return a.join(b.hint("merge"), ["bucket", "part"]).drop("bucket", "part")


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, ratio: int = RATIO,
                   block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (vec_id, embedding, label).

    ``is_anchor`` is a condition on the columns of ``prepare``."""
    spark = rows.sparkSession
    bounded_batches(spark)
    vectors = materialize(prepare(rows), "neg-vectors")
    index = materialize(blocks(vectors, block_rows), "neg-blocks")
    if index.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packs = blocks(vectors.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]), anchor_rows)
    packs = materialize(packs.select(*[F.col(c).alias(f"a_{c}") for c in index.columns]), "neg-anchors")

    run, schema = _search_positives(positives)
    found = _meet(packs, index, None).mapInArrow(run, schema)
    found = found.withColumn("_id", F.nullif("positive_id", F.lit(NO_ID)))
    found = top_n_per_group(found, ["a_block", "slot"], [F.desc("score"), F.asc("positive_id")], positives, salt_cols=["positive_id"])
    found = materialize(found, "neg-positives")

    # a pack carries the positives of its anchors: at most anchor_rows * positives small rows
    own = found.groupBy("a_block", "slot").agg(F.collect_list(F.struct("rank", F.col("_id").alias("positive_id"), "score")).alias("positives"))
    own = own.groupBy("a_block").agg(F.collect_list(F.struct("slot", "positives")).alias("positives"),
                                     F.min(F.array_min(F.transform(F.filter("positives", lambda p: p["score"] >= 0), lambda p: p["score"]))).alias("least"))
    both = packs.join(own, "a_block").where("least IS NOT NULL")
    run, schema = _search_negatives(negatives, ratio)
    met = _meet(both, index, F.col("least") * (ratio / 100.0)).drop("least").mapInArrow(run, schema)
    top = top_n_per_group(met, ["a_block", "slot", "place"], [F.desc("negative_score"), F.asc("negative_id")], negatives, salt_cols=["negative_id"])
    no_id = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    return top.select("anchor_id", no_id("positive_id"), F.col("rank").cast("int").alias("rank"), no_id("negative_id"), "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % ANCHOR_STEP == 0)


ORACLE = """
WITH t AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM t a, t b WHERE a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
