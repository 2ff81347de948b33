"""BM25 retrieval and BM25 pair features as DataFrame jobs.

Two scorers exist in the source system:

* ``Bm25Okapi`` (R3): the index behind candidate retrieval. Documents are split on
  single blanks; ``idf = ln(N - df + .5) - ln(df + .5)``, and a negative idf is
  replaced by ``eps * mean(idf)``; ``k1 = 1.5, b = .75``. A query scores every
  document containing one of its words, each repeated query word counting again.
* ``bm25_pair_score`` (R2): a feature for given (search term, text) pairs, with
  per-field parameters (R1): ``idf = ln(N/df) + 1`` over ``\\b\\w+\\b`` tokens,
  ``avgdl`` over whitespace tokens, tf = substring count, missing idf ``ln(N+1)``,
  ``k = 1.2, b = .75`` and the length term ``b * dl / avgdl`` not scaled by k.

The index is an inverted file of blocks of documents. A row ``(term, block, n, max_tf, min_dl, docs)`` holds the postings
of a term in a block of at most BLOCK_DOCS documents, by slot, with the largest count and the least length among them, which
bound every weight in the row. The file is written to a folder, partitioned by a bucket of the term's
hash and sorted by term, and can be opened again by later sessions. A query reads the buckets of its words
only (partition pruning), and in them the row groups whose terms may match.

``top_n`` deals the rows of the queries' words by block and gives a block to a task as a whole. There each query adds up its words'
weights over the block's documents, the words with the largest bounds first. As soon as the bounds of the words left
sum up to less than the n-th best score so far, no document without one of the words seen can be among the n best, and of
those seen only the ones that can still get there are looked up in the postings of the words left. So frequent words
are not scored everywhere, and nothing is lost. A block returns n rows per query at most.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.functions import text as tx
from relevo.operators.topn import fits, top_n_per_group
from relevo.session import bounded_batches, checkpoint_dir, materialize

# Query-word tables up to this many rows are broadcast to the postings scan; beyond
# it the join shuffles on ``term`` and AQE splits skewed (frequent-word) partitions.
BROADCAST_QUERY_TERMS = 200_000

#: Documents of a block (a power of two), and queries that meet a block at a time.
BLOCK_DOCS = 4096
QUERY_BLOCK = 512
#: Words at which a block ends before it has so many documents: a task holds one block.
BLOCK_WORDS = 2_000_000
#: Block rows per bucket aimed at, and the bounds of the number of buckets.
BUCKET_ROWS = 500_000
MIN_BUCKETS, MAX_BUCKETS = 32, 4096
#: What sums of doubles and the rounding of scores may differ by.
SLACK = 1e-5

POSTINGS = ("term string, block long, n int, max_tf long, min_dl int, "
            "docs array<struct<slot:int,product_uid:long,tf:long,dl:int>>, bucket int")
TERMS = "term string, df long, idf double, bucket int"


@dataclass
class Bm25Index:
    postings: DataFrame      # POSTINGS
    idf: DataFrame           # TERMS
    n_docs: int
    avgdl: float
    k1: float
    b: float
    buckets: int
    path: str

    def part(self, tf, dl):
        """The weight of a posting without its idf, as a column or an array; grows with tf, shrinks with dl."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / self.avgdl))


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _block_rows(block_docs: int, block_words: int):
    """Rows of blocks of documents (product_uid, dl, toks), in the order in which they come; a block ends at ``block_docs`` documents or
    with the one that reaches ``block_words`` words."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    def listed(starts, values):
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values)

    def rows(parts, block):
        t = pa.Table.from_batches(parts).combine_chunks()
        toks = t.column("toks").chunk(0)
        words = toks.flatten().dictionary_encode(null_encoding="encode")
        slot = np.repeat(np.arange(len(t)), np.diff(np.asarray(toks.offsets)))
        key, tf = np.unique(np.asarray(words.indices).astype(np.int64) * block_docs + slot, return_counts=True)
        term, slot = key // block_docs, key % block_docs
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, dtype=np.int64)
        own, dl = t.column("dl").chunk(0), np.asarray(t.column("dl").chunk(0).fill_null(0))
        least = np.minimum.reduceat(dl[slot], starts)
        unknown = np.minimum.reduceat(np.asarray(own.is_null())[slot], starts)  # documents without a text have no length, and no word but null
        at = pa.array(slot)
        return pa.record_batch([words.dictionary.take(pa.array(term[starts])), pa.array(np.full(len(starts), block)), pa.array(np.diff(np.append(starts, len(term))), pa.int32()),
                                pa.array(np.maximum.reduceat(tf, starts), pa.int64()), pa.array(least, pa.int32(), mask=unknown), listed(starts, pa.array(slot, pa.int16())),
                                listed(starts, t.column("product_uid").chunk(0).take(at)), listed(starts, pa.array(tf, pa.int32())), listed(starts, own.take(at))],
                               names=["term", "block", "n", "max_tf", "min_dl", "slots", "uids", "tfs", "dls"])

    def run(batches):
        block = TaskContext.get().partitionId() << 21
        parts, docs, words = [], 0, 0
        for batch in batches:
            size, at = np.diff(np.asarray(batch.column("toks").offsets)), 0
            while at < batch.num_rows:
                ends = words + np.cumsum(size[at:at + block_docs - docs])
                n = min(len(ends), int(np.searchsorted(ends, block_words)) + 1)
                parts.append(batch.slice(at, n))
                docs, words, at = docs + n, int(ends[n - 1]), at + n
                if docs == block_docs or words >= block_words:
                    yield rows(parts, block)
                    parts, docs, words, block = [], 0, 0, block + 1
        if parts:
            yield rows(parts, block)
    return run


def posting_rows(docs: DataFrame, uid: str, text: str, buckets: int, files: int) -> DataFrame:
    """The rows of POSTINGS, dealt by bucket and file and sorted. Documents lie in blocks by length, where they are; only block rows
    move, as short lists of numbers."""
    bounded_batches(docs.sparkSession)
    toks = F.split(F.col("text"), " ")
    d = docs.select(F.col(uid).cast("long").alias("product_uid"), F.col(text).alias("text"))
    d = d.withColumn("dl", F.size(toks)).sortWithinPartitions("dl", "product_uid")
    d = d.select("product_uid", "dl", F.coalesce(toks, F.array(F.lit(None).cast("string"))).alias("toks"))
    rows = d.mapInArrow(_block_rows(BLOCK_DOCS, BLOCK_WORDS), "term string, block long, n int, max_tf long, min_dl int, "
                        "slots array<smallint>, uids array<long>, tfs array<int>, dls array<int>")
    rows = rows.withColumn("bucket", _bucket("term", buckets)).withColumn("file", F.pmod("block", F.lit(files)))
    rows = rows.repartition("bucket", "file").sortWithinPartitions("bucket", "term", "block")
    zipped = F.arrays_zip("slots", "uids", "tfs", "dls").cast("array<struct<slot:int,product_uid:long,tf:long,dl:int>>")
    return rows.select("term", "block", "n", "max_tf", "min_dl", zipped.alias("docs"), "bucket")


def build_okapi(docs: DataFrame, uid: str = "product_uid", text: str = "text",
                k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, path: str | None = None) -> Bm25Index:
    """R3 index over ``docs(uid, text)``, written under ``path`` (default: a new folder of the
    checkpoint folder); ``text`` is already cleaned and ``uid`` unique.

    The text is cleaned and tokenized once. Tasks count the words of a block of documents where they are read, and
    the block rows move once, to lie by bucket; a frequent term is one row per block of documents, dealt over the
    files of its bucket. Every statistic is an aggregate of the block rows.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/bm25-{uuid.uuid4().hex[:12]}"
    n_docs = docs.count()
    # a bucket's number comes before any count is known: one per BUCKET_ROWS at about 8 block rows a document
    buckets = max(MIN_BUCKETS, min(MAX_BUCKETS, n_docs * 8 // BUCKET_ROWS))
    files = max(1, n_docs * 8 // (buckets * BUCKET_ROWS))
    rows = posting_rows(docs, uid, text, buckets, files)
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    blocks = spark.read.schema(POSTINGS).parquet(f"{path}/postings")

    cf = F.aggregate("docs", F.lit(0).cast("long"), lambda s, d: s + d["tf"])
    df = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum(cf).alias("cf"))
    raw = materialize(df.withColumn("idf", F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "bm25-idf")
    st = raw.agg(F.sum("cf").alias("tot"), F.avg("idf").alias("mean")).first()
    avgdl, mean_idf = float(st["tot"] or 0) / max(n_docs, 1), st["mean"] or 0.0
    idf = raw.withColumn("idf", F.when(F.col("idf") < 0, F.lit(epsilon * mean_idf)).otherwise(F.col("idf")))
    idf = idf.select("term", "df", "idf", _bucket("term", buckets).alias("bucket"))
    (idf.repartition("bucket").sortWithinPartitions("bucket", "term")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/idf"))
    meta = spark.createDataFrame([(n_docs, avgdl, k1, b, buckets)], "n_docs long, avgdl double, k1 double, b double, buckets int")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return open_okapi(spark, path)


def open_okapi(spark: SparkSession, path: str) -> Bm25Index:
    """An index written by ``build_okapi``."""
    m = spark.read.parquet(f"{path}/meta").first()
    return Bm25Index(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), spark.read.schema(TERMS).parquet(f"{path}/idf"),
                     m["n_docs"], m["avgdl"], m["k1"], m["b"], m["buckets"], path)


def query_terms(queries: DataFrame, qid: str = "query_id", text: str = "text") -> DataFrame:
    """Query words with their multiplicity (a repeated word scores again)."""
    return (queries.select(F.col(qid).alias("query_id"),
                           F.explode(F.split(F.col(text), " ")).alias("term"))
                   .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _known_terms(index: Bm25Index, queries: DataFrame, qid: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """(query_id, term, bucket, w) of the words of the queries that occur in the index, the postings of their buckets, and whether
    the words may be broadcast; ``w`` is the idf times the word's count in the query."""
    qt = materialize(query_terms(queries, qid, text).withColumn("bucket", _bucket("term", index.buckets)), "query-words")
    need = sorted(r[0] for r in qt.select("bucket").distinct().collect())  # MAX_BUCKETS numbers at most
    pruned = lambda df: df.where(F.col("bucket").isin(need)) if need else df.where("false")
    few = fits(qt, BROADCAST_QUERY_TERMS)
    known = pruned(index.idf).join(F.broadcast(qt) if few else qt, ["bucket", "term"])
    return known.select("query_id", "term", "bucket", (F.col("qtf") * F.col("idf")).alias("w")), pruned(index.postings), few


def score(index: Bm25Index, queries: DataFrame, qid: str = "query_id", text: str = "text") -> DataFrame:
    """(query_id, product_uid, score) for every document sharing a word with the query."""
    terms, postings, few = _known_terms(index, queries, qid, text)
    hits = postings.join(F.broadcast(terms) if few else terms, ["bucket", "term"]).select("query_id", "w", F.explode("docs").alias("d"))
    return (hits.groupBy("query_id", F.col("d.product_uid").alias("product_uid"))
                .agg(F.sum(F.col("w") * index.part(F.col("d.tf"), F.col("d.dl"))).alias("score")))


def best_of_block(weights, bounds, slots, part, size: int, n: int):
    """(slots, scores, postings read) of documents of a block that hold its ``n`` best for one query, with their whole scores.

    For each word of the query: its weight, the most that it adds, its documents' slots in order, and a function that gives the weights without idf
    of some of them (None: all). Bounds prune only while all weights are above 0."""
    import numpy as np

    order = np.argsort(-bounds, kind="stable")
    left = np.append(np.cumsum(bounds[order][::-1])[::-1], 0.0)   # left[j]: what words j and later add at most
    if len(weights) and weights.min() <= 0:
        left[:] = np.inf
    score, seen = np.zeros(size), np.zeros(size, dtype=bool)
    least, read, j = -np.inf, 0, 0

    def nth(x):
        return np.partition(x, len(x) - n)[len(x) - n] - SLACK if len(x) >= n else -np.inf

    while j < len(order) and not left[j] < least:
        t = order[j]
        score[slots[t]] += weights[t] * part(t, None)
        seen[slots[t]] = True
        read += len(slots[t])
        j += 1
        if j < len(order) and np.isfinite(left[j]):
            least = max(least, nth(score))
            least = least if least > 0 else -np.inf               # slots without a word of the query score 0
    found = np.flatnonzero(seen & (score + left[j] >= least))
    while j < len(order) and len(found):
        t = order[j]
        at = np.minimum(np.searchsorted(slots[t], found), len(slots[t]) - 1)
        hit = slots[t][at] == found
        score[found[hit]] += weights[t] * part(t, at[hit])
        read += int(hit.sum())
        j += 1
        least = max(least, nth(score[found]))
        found = found[score[found] + left[j] >= least]
    return found, score[found], read


def _search_blocks(index: Bm25Index, n: int, digits: int, count: bool):
    """Top n rows of one block and one block of queries; rows are (docs, bound, queries) per term."""
    import numpy as np
    import pyarrow as pa

    part_of = Bm25Index(None, None, index.n_docs, index.avgdl, index.k1, index.b, index.buckets, "").part

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        lists = [table.column(c).chunk(0) for c in ("docs", "queries")]
        ends = [np.asarray(x.offsets) for x in lists]
        flat = {f: np.asarray(lists[0].values.field(f)) for f in ("slot", "product_uid", "tf", "dl")}
        asked = {f: lists[1].values.field(f) for f in ("query_id", "w")}
        top = part_of(np.asarray(table.column("max_tf")), np.asarray(table.column("min_dl")))
        uid = np.zeros(BLOCK_DOCS, dtype=np.int64)
        known: dict[int, np.ndarray] = {}

        def part(row, at):
            lo, hi = ends[0][row], ends[0][row + 1]
            if at is None:
                if row not in known:
                    known[row] = part_of(flat["tf"][lo:hi], flat["dl"][lo:hi])
                return known[row]
            return part_of(flat["tf"][lo + at], flat["dl"][lo + at])

        lo, hi = ends[0][0], ends[0][-1]
        uid[flat["slot"][lo:hi]] = flat["product_uid"][lo:hi]
        lo, hi = ends[1][0], ends[1][-1]
        ids = asked["query_id"].slice(lo, hi - lo).dictionary_encode()
        of, w = np.asarray(ids.indices), np.asarray(asked["w"])[lo:hi]
        row = np.repeat(np.arange(len(table)), np.diff(ends[1]))
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(ids.dictionary) + 1))
        out = []
        for q in range(len(ids.dictionary)):
            mine = order[starts[q]:starts[q + 1]]
            rows = row[mine]
            slots = [flat["slot"][ends[0][r]:ends[0][r + 1]] for r in rows]
            found, score, read = best_of_block(w[mine], w[mine] * top[rows], slots, lambda t, at, rows=rows: part(rows[t], at), BLOCK_DOCS, n)
            score = np.round(score, digits)
            best = np.lexsort((uid[found], -score))[:n]
            held = sum(map(len, slots))
            out.append((np.full(len(best), q), uid[found[best]], score[best], np.full(len(best), read), np.full(len(best), held)))
        cols = [np.concatenate([o[i] for o in out]) for i in range(5)]
        names = ["query_id", "product_uid", "score", "read", "held"]
        arrays = [ids.dictionary.take(pa.array(cols[0], pa.int64())), *[pa.array(c) for c in cols[1:]]]
        return pa.table(arrays if count else arrays[:3], names=names if count else names[:3])
    return run


def top_n(index: Bm25Index, queries: DataFrame, n: int = 100, qid: str = "query_id",
          text: str = "text", digits: int = 6, count: bool = False) -> DataFrame:
    """R3 + W4: the n best documents per query (score desc, product_uid asc).

    Scores are rounded to ``digits`` before ranking so the order does not depend
    on the summation order of floating point terms. ``count`` adds how many postings of its block a row's query has read, of how many.
    A task holds the postings that one block has of the words of QUERY_BLOCK queries: at most the block's own words.
    """
    terms, postings, few = _known_terms(index, queries, qid, text)
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = (terms.groupBy("bucket", "term", F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("queries_of"))
             .agg(F.collect_list(F.struct("query_id", "w")).alias("queries")))
    asked = F.broadcast(asked) if few else asked
    hits = postings.join(asked, ["bucket", "term"]).select("queries_of", "block", "max_tf", "min_dl", "docs", "queries")
    kind = dict(terms.dtypes)["query_id"]
    found = hits.groupBy("queries_of", "block").applyInArrow(_search_blocks(index, n, digits, count), f"query_id {kind}, product_uid long, score double" + (
        ", read long, held long" if count else ""))
    return top_n_per_group(found, "query_id", [F.desc("score"), F.asc("product_uid")], n,
                           salt_cols=["product_uid"])


# ---------------------------------------------------------------------------------
# BM25 pair feature with per-field parameters
# ---------------------------------------------------------------------------------

@dataclass
class Bm25Params:
    idf: DataFrame   # term, idf
    n_docs: int
    avgdl: float


def fit_params_many(corpus: DataFrame, fields, weight: str | None = None) -> dict:
    """R1 for several text columns: idf = ln(N/df) + 1 over lower-cased ``\\b\\w+\\b`` tokens; avgdl over whitespace tokens.

    ``weight`` names a column that says how many documents a row stands for. N and every avgdl come from one aggregation; the idf tables are
    written once, as they are read by size checks and joins."""
    c = corpus.withColumn("_n", F.col(weight) if weight else F.lit(1))
    lengths = [(F.sum(F.size(tx.split_ws(f)) * F.col("_n")) / F.sum(F.when(F.col(f).isNotNull(), F.col("_n")))).alias(f"avgdl_{f}") for f in fields]
    st = c.agg(F.sum("_n").alias("n"), *lengths).first()
    n_docs = int(st["n"] or 0)

    def one(f: str) -> Bm25Params:
        df = c.select("_n", F.explode(F.array_distinct(tx.word_tokens(f))).alias("term")).groupBy("term").agg(F.sum("_n").alias("df"))
        idf = materialize(df.select("term", (F.log(F.lit(n_docs) / F.col("df")) + 1).alias("idf")), f"bm25-params-{f}")
        return Bm25Params(idf, n_docs, float(st[f"avgdl_{f}"] or 0.0))
    return {f: one(f) for f in fields}


def query_word_idf(pairs: DataFrame, key: str, query: str, idf: DataFrame, n_docs: int,
                   out: str = "qw") -> DataFrame:
    """(key, out ARRAY<STRUCT<pos, term, idf>>): each query word with its idf.

    Only the short query side is exploded and joined; long document texts are
    never copied per word. A word missing from the vocabulary gets ``ln(N+1)``.
    """
    words = pairs.select(key, F.posexplode(tx.split_ws(query)).alias("pos", "term"))
    if fits(idf, 2_000_000):
        idf = F.broadcast(idf)
    j = words.join(idf.select("term", "idf"), "term", "left").select(
        key, "pos", "term", F.coalesce(F.col("idf"), F.lit(math.log(n_docs + 1))).alias("idf"))
    return j.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "term", "idf"))).alias(out))


def bm25_expr(qw, doc, dl, avgdl: float, k: float = 1.2, b: float = 0.75, tf=None):
    """R2 score of one pair from its query-word array, document text and the stored column of its number of words (in-row).
    ``tf`` has the counts of the words in the text, if they are taken already."""
    d, dl = (F.col(c) if isinstance(c, str) else c for c in (doc, dl))

    if tf is None:
        counts = F.transform(qw, lambda x: F.struct(tx.substring_count(d, x["term"]).alias("tf"), x["idf"].alias("idf")))  # each word is counted once
    else:
        counts = F.zip_with(qw, tf, lambda x, n: F.struct(n.alias("tf"), x["idf"].alias("idf")))

    def one(x):
        return x["idf"] * (x["tf"] * (k + 1)) / (x["tf"] + k * (1 - b) + b * dl / F.lit(avgdl))

    return F.coalesce(F.aggregate(F.transform(counts, one), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))


def pad_zero_scores(top: DataFrame, queries: DataFrame, doc_ids: DataFrame, n: int,
                    qid: str = "query_id") -> DataFrame:
    """O2: complete every query's top n with zero-score documents (smallest product ids first),
    as the source's top-n returns n documents even when fewer share a word with the query.

    Only the 2n smallest document ids can be needed (at most n of them are already matched);
    that bounded list is exploded per query that falls short, so no query is ever paired
    with the document table.
    """
    first = [r[0] for r in doc_ids.select("product_uid").distinct().orderBy("product_uid").limit(2 * n).collect()]
    if not first:
        return top
    top = materialize(top, "padded-top")  # read three times
    have = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("m"))
    short = (queries.select(F.col(qid).alias("query_id")).distinct().join(have, "query_id", "left")
                    .select("query_id", F.coalesce("m", F.lit(0)).alias("m")).where(F.col("m") < n))
    cand = short.select("query_id", "m", F.explode(F.array(*[F.lit(u) for u in first])).alias("product_uid"))
    cand = cand.join(top.select("query_id", "product_uid"), ["query_id", "product_uid"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("product_uid")
    pad = (cand.withColumn("rank", F.col("m") + F.row_number().over(w)).where(F.col("rank") <= n)
               .select("query_id", "product_uid", F.lit(0.0).alias("score"), "rank"))
    return top.select("query_id", "product_uid", "score", "rank").unionByName(pad)
