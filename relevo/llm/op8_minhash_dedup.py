"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star edges.

A document's set is its distinct 2-word shingles (A-Z lower-cased; a shorter text is one shingle).
Documents with 100 * |A n B| >= 80 * |A u B| are linked, and a component is what links connect.

1. One pass hashes each shingle once. The hash picks one of ``BINS`` bins and each bin keeps its least
   hash; an empty bin takes the value of the first filled bin on its own random walk (optimal
   densification). ``BANDS`` bands of ``ROWS`` bins give the bucket keys. At a likeness of 0.8 one band
   agrees with probability 0.8**6 = 0.26, so 40 bands miss a link with probability 5e-6.
2. Equal sets (by a 128-bit hash) form a class; only its smallest document goes on, so copies never
   meet in a bucket.
3. Every member of a bucket is paired with the centre of the bucket only: its smallest document, which is the same
   one in most buckets of a group of near copies, so that a member has few pairs. Pairs are confirmed on the full
   sets, and components follow from the confirmed links.
4. A link between two leaves can still be missing, but matters only if they are in different components. If bucket
   mates of different components make more than FEW_PAIRS pairs, a second round of stars with MORE_CENTRES centres
   that a hash picks, other ones in each bucket, first joins what it can. Then all that is left is compared: bucket
   mates one by one where they make at most FEW_PAIRS pairs, else by an exact prefix-filter join over the documents
   of such buckets. Pairs of one component are left out. FEW_PAIRS picks the plan, not the links. Documents that are nearly alike in thousands (a likeness just under 0.8) are compared in pairs.

Defined cases: null or wordless text has an empty set, is linked with nothing and is kept; a null
``doc_id`` takes no part and is its own (null) component; rows that repeat a ``doc_id`` with one text are
one document, and with different texts they are one node with the links of each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm import held
from relevo.llm import words as W
from relevo.llm.components import components, labels, stars
from relevo.session import bounded_batches, materialize

SHINGLE = 2
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
PERCENT = 80
#: Ids of documents that may be broadcast to pick their texts: 16 MB of longs. Beyond it Spark shuffles.
MAX_BROADCAST_IDS = 2_000_000
#: So many pairs of bucket mates in different components are compared one by one; more go through the prefix-filter join.
FEW_PAIRS = 100_000
#: Documents of a block, in the prefix-filter join: a shingle with more is split into pairs of blocks.
BLOCK = 256
#: Centres of a bucket that a hash picks, in the second round.
MORE_CENTRES = 5


def shingle_sets(col: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document in ascending order, and where each document starts."""
    ws = W.words_of(col, lower=True)
    h = ws.hashes(1)
    at = W.whole(ws.first, shingle)
    value = W.window_hashes(h, shingle, 7)[at]
    n = np.diff(ws.first)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - shingle + 1, 0))
    for short in range(1, shingle):  # a shorter text is one shingle of all its words
        d = np.flatnonzero(n == short)
        if len(d):
            own = np.zeros(len(d), dtype=np.uint64)
            for i in range(short):
                own = W.mix(own * np.uint64(31) + h[ws.first[d] + i] + np.uint64(short))
            value, doc = np.concatenate([value, own]), np.concatenate([doc, d])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


_walks: dict[tuple[int, int], np.ndarray] = {}


def _walk(bins: int, step: int) -> np.ndarray:
    """The bin that each bin visits at ``step`` of its random walk."""
    if (bins, step) not in _walks:
        _walks[bins, step] = (W.mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step * 2654435761 + 1)) % np.uint64(bins)).astype(np.int64)
    return _walks[bins, step]


def signatures(value: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One-permutation signature of each set (rows x bins); rows of empty sets hold the highest value."""
    rows = len(first) - 1
    empty = np.uint64((1 << 64) - 1)
    sig = np.full(rows * bins, empty, dtype=np.uint64)
    doc = np.repeat(np.arange(rows), np.diff(first))
    spot = ((value >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(sig, doc * bins + spot, value)
    sig = sig.reshape(rows, bins)
    r, c = np.nonzero((sig == empty) & (np.diff(first) > 0)[:, None])
    filled = sig.copy()
    step = 1
    while len(r):
        got = sig[r, _walk(bins, step)[c]]
        ok = got != empty
        filled[r[ok], c[ok]] = got[ok]
        r, c, step = r[~ok], c[~ok], step + 1
    return filled


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.zeros((len(sig), bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    parts = sig.reshape(len(sig), bands, rows)
    for i in range(rows):
        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _sketch(shingle: int, bands: int, rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                value, first = shingle_sets(part.column("text"), shingle)
                n = np.diff(first)
                key = band_keys(signatures(value, first, bands * rows), bands, rows)
                sums = []
                for salt in (11, 13):
                    total = np.zeros(len(value) + 1, dtype=np.uint64)
                    np.cumsum(W.mix(value + np.uint64(salt)), out=total[1:])
                    sums.append(W.int64(total[first[1:]] - total[first[:-1]]))
                size = np.where(n > 0, bands, 0)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), W.int64(key[n > 0].reshape(-1)))
                yield pa.record_batch([part.column("doc_id"), pa.array(n.astype(np.int64)), *sums, keys], schema=schema)

    return held.tidy(run)


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                value, first = shingle_sets(part.column("text"), shingle)
                blobs = [value[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.record_batch([part.column("doc_id"), pa.array(blobs, pa.binary())], names=["doc_id", "shingles"])

    return held.tidy(run)


def _exploded(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("component", pa.int64()), ("set_id", pa.int64()), ("n", pa.int64()), ("shingle", pa.int64())])
    for batch in batches:
        blobs = batch.column("shingles")
        n = np.array([len(x.as_buffer()) // 8 for x in blobs], dtype=np.int64)
        value = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in blobs]) if len(blobs) else np.empty(0, dtype=np.int64)
        own = [np.repeat(np.asarray(batch.column(c)), n) for c in ("doc_id", "component", "set_id")]
        yield pa.record_batch([*map(pa.array, own), pa.array(np.repeat(n, n)), pa.array(value)], schema=schema)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = len(a) + len(b)
                inter = both - len(np.unique(np.concatenate([a, b])))
                keep.append(100 * inter >= percent * (both - inter) and inter > 0)
            yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(keep, pa.bool_())], names=["a", "b", "linked"])

    return held.tidy(run)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The links among ``pairs`` (a, b; a stored table), judged on the full sets. Only sets that a pair needs
    move, and each pair moves with one set; Spark splits hot keys."""
    few = pairs.count() <= MAX_BROADCAST_IDS  # so many ids need no distinct table of their own

    def of(side: str) -> DataFrame:
        ids = pairs.select(F.col(side).alias("doc_id"))
        return (sets.join(F.broadcast(ids), "doc_id", "left_semi") if few else pick(sets, materialize(ids.distinct(), "minhash-ends"))).select(F.col("doc_id").alias(side), F.col("shingles").alias(f"set_{side}"))

    both = pairs.join(of("b").hint("merge"), "b").join(of("a").hint("merge"), "a")
    return both.mapInArrow(_confirm(percent), "a long, b long, linked boolean").where("linked").select("a", "b")


def pick(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in ``ids`` (a stored table): ids are broadcast if few, else shuffled."""
    few = ids.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, c_doc): every pair of ``nodes`` (doc_id, component; a stored table) of different components that can be a link.

    Sets that are alike enough share one of the first shingles of each, in any one order of all shingles; shingles that
    occur in one component come first, then rare ones. Where the shared one stands in both bounds what can still agree.
    """
    few = nodes.count() <= MAX_BROADCAST_IDS
    of = (sets.join(F.broadcast(nodes), "doc_id") if few else pick(sets, nodes.select("doc_id")).join(nodes.hint("merge"), "doc_id")).where("length(shingles) > 0")
    each = (of.select("doc_id", "component", F.xxhash64("shingles").alias("set_id"), "shingles")
            .mapInArrow(held.tidy(_exploded), "doc_id long, component long, set_id long, n long, shingle long"))

    def spread(rows: DataFrame) -> DataFrame:
        return rows.groupBy("shingle").agg(F.count("*").alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))

    common = spread(each).where("lo < hi").select("shingle", F.col("m").alias("seen"))
    ranked = (each.join(common.hint("merge"), "shingle").groupBy("doc_id", "component", "set_id", "n")
              .agg(F.sort_array(F.collect_list(F.struct("seen", "shingle"))).alias("s")))
    own = F.col("n") - F.size("s")  # shingles of one component: first in the order, and in no pair
    prefix = (ranked.withColumn("own", own).select("doc_id", "component", "n", "own", F.posexplode("s").alias("at", "x"))
              .select("doc_id", "component", "n", (F.col("own") + F.col("at")).alias("pos"), "x.shingle").where(f"pos <= n - ({percent} * n + 99) div 100"))
    prefix = materialize(prefix, "minhash-prefix")
    blocks = spread(prefix).where("lo < hi").select("shingle", F.ceil(F.col("m") / BLOCK).alias("k"))
    rows = prefix.join(blocks.hint("merge"), "shingle").withColumn("block", F.expr("pmod(xxhash64(doc_id), k)"))
    ours = rows.withColumn("i", F.col("block")).withColumn("j", F.explode(F.expr("sequence(block, k - 1)")))
    theirs = (rows.withColumn("j", F.col("block")).withColumn("i", F.explode(F.expr("sequence(0L, block)")))
              .select("shingle", "i", "j", F.col("doc_id").alias("c_doc"), F.col("component").alias("c_comp"), F.col("n").alias("c_n"), F.col("pos").alias("c_pos")))
    can = f"component <> c_comp and (i < j or doc_id < c_doc) and {100 + percent} * least(n - pos, c_n - c_pos) >= {percent} * (n + c_n)"
    sides = ours.withColumnsRenamed({"shingle": "_s", "i": "_i", "j": "_j"})
    return (sides.join(theirs.hint("merge"), (F.col("_s") == F.col("shingle")) & (F.col("_i") == F.col("i")) & (F.col("_j") == F.col("j")) & F.expr(can))
            .select("doc_id", "c_doc"))


def near_links(docs: DataFrame, sketch: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b) links that give the components of all links among classes of equal sets."""
    likely = f"100 * least(n_shingles, c_n) >= {percent} * greatest(n_shingles, c_n)"  # else sizes alone rule a link out

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("doc_id", "c_doc").alias("a"), F.greatest("doc_id", "c_doc").alias("b")).distinct()

    bucket = sketch.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    star = (bucket.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "n_shingles")).alias("c")).where("members > 1")
            .select("key", F.col("c.doc_id").alias("c_doc"), F.col("c.n_shingles").alias("c_n")))
    open_ = materialize(bucket.join(star.hint("merge"), "key"), "minhash-buckets")
    ids = materialize(open_.select("doc_id").distinct(), "minhash-ids")
    sets = materialize(pick(docs, ids).mapInArrow(_sets(shingle), "doc_id long, shingles binary").dropDuplicates(["doc_id", "shingles"]), "minhash-sets")
    tested = materialize(ordered(open_.where("doc_id <> c_doc").where(likely)), "minhash-pairs")
    links = materialize(confirmed(tested, sets, percent), "minhash-links")

    def labelled(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """One link of each node to its component, buckets with components, those that hold several, and their pairs of different components."""
        star = stars(links)
        own = materialize(open_.select("key", "doc_id", "n_shingles").join(labels(star).withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left")
                          .withColumn("component", F.coalesce("component", "doc_id")), "minhash-open")
        parts = own.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"))
        left = parts.agg(F.sum((F.col("n") * F.col("n") - F.col("nn")) / 2)).first()[0] or 0
        return star.select(F.col("u").alias("a"), F.col("v").alias("b")), own, parts.where("n * n > nn").select("key"), left

    def untested(pairs: DataFrame) -> DataFrame:
        return materialize(ordered(pairs).join(tested.hint("merge"), ["a", "b"], "left_anti"), "minhash-pairs")

    apart = F.expr("component <> c_comp and " + likely)
    links, own, mixed, left = labelled(links)
    if left > FEW_PAIRS:
        mates = F.array_distinct(F.array(*[F.struct(F.min_by(F.struct("doc_id", "component", "n_shingles"), F.xxhash64("doc_id", "key", F.lit(i))).alias("m"))
                                           for i in range(MORE_CENTRES)]))
        star = own.groupBy("key").agg(mates.alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
        star = star.select("key", F.explode("c").alias("c")).select("key", F.col("c.m.doc_id").alias("c_doc"), F.col("c.m.component").alias("c_comp"), F.col("c.m.n_shingles").alias("c_n"))
        new = untested(own.join(star.hint("merge"), "key").where(apart))
        links = links.unionByName(materialize(confirmed(new, sets, percent), "minhash-links"))
        tested = tested.unionByName(new)
        links, own, mixed, left = labelled(links)
    if not left:
        return links
    rest = own.join(mixed.hint("merge"), "key", "left_semi")
    if left <= FEW_PAIRS:
        rest = materialize(rest, "minhash-mixed")
        other = rest.select("key", F.col("doc_id").alias("c_doc"), F.col("component").alias("c_comp"), F.col("n_shingles").alias("c_n"))
        pairs = rest.join(other.hint("merge"), "key").where("doc_id < c_doc").where(apart)
    else:
        pairs = prefix_pairs(materialize(rest.select("doc_id", "component").distinct(), "minhash-rest"), sets, percent)
    return links.unionByName(materialize(confirmed(untested(pairs), sets, percent), "minhash-links"))


def minhash_components(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``."""
    bounded_batches(docs.sparkSession)
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = materialize(rows_in.mapInArrow(_sketch(shingle, bands, rows), "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>"), "minhash-sketch")
    full = sketch.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    member = materialize(full.drop("keys").join(first.hint("merge"), ["s1", "s2", "n_shingles"]).select("doc_id", "class_id").distinct(), "minhash-classes")
    alone = full.join(member.where("doc_id = class_id").select("doc_id").hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "s1", "s2"])
    links = near_links(rows_in, alone, shingle, percent).unionByName(
        # a doc_id with several texts ties their classes together
        member.where("doc_id <> class_id").join(member.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
        .select(F.col("doc_id").alias("a"), F.col("class_id").alias("b")))
    label = components(links)
    of = (member.join(label.withColumnRenamed("node", "class_id").hint("merge"), "class_id", "left")
          .groupBy("doc_id").agg(F.min(F.coalesce("component", "class_id")).alias("component_id")))
    return (sketch.select("doc_id", "n_shingles").join(of.hint("merge"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return minhash_components(docs).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the smallest of their component, with all their columns. A row with a null
    doc_id stays; of rows that repeat a kept doc_id each stays."""
    gone = minhash_components(docs, shingle=5).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
