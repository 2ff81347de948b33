"""Word-vector and latent-vector operators.

Vectors are ``ARRAY<DOUBLE>`` columns. Element-wise means are relational
(``posexplode`` + ``groupBy(key, dim)``), so a group of any size aggregates with
map-side partial sums; only the fixed-length result is re-assembled.

"Sentences" here are short word lists (a search term, a title). The pairwise
word-cosine feature compares the words of two sentences, so its work is the
product of two short lengths per sentence pair, never quadratic in a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevo.operators.topn import top_n_per_group


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """V5: cosine of two vectors; 0 when a norm is 0 (zero vectors are orthogonal to all)."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)


def mse(a: Column, b: Column) -> Column:
    """mean squared difference of two vectors (named RMSE in the source, not rooted)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda s, v: s + v) / F.size(a)


def centroid(df: DataFrame, key: str, vec: str = "vector", out: str = "centroid") -> DataFrame:
    """Element-wise mean vector per key (partial aggregation per dimension)."""
    e = df.select(key, F.posexplode(vec).alias("dim", "x"))
    m = e.groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return m.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))),
                                          lambda s: s["x"]).alias(out))


def sentence_pairs(words: DataFrame, size: int = 8) -> DataFrame:
    """Group word vectors into consecutive sentences of ``size`` words and pair sentence s
    with sentence s+1 (as a search term with a title): (pair_id, side, word_id, vector)."""
    s = words.withColumn("sentence", F.floor(F.col("word_id") / size).cast("bigint"))
    a = s.select(F.col("sentence").alias("pair_id"), F.lit("a").alias("side"), "word_id", "vector")
    b = s.select((F.col("sentence") - 1).alias("pair_id"), F.lit("b").alias("side"), "word_id", "vector")
    both = a.unionByName(b)
    complete = both.groupBy("pair_id").agg(F.countDistinct("side").alias("n")).where("n = 2").select("pair_id")
    return both.join(complete, "pair_id", "left_semi")


def max_cosine_per_word(pairs: DataFrame, out: str = "max_cosine_sim_per_word") -> DataFrame:
    """mean over side-a words of the maximum cosine to any side-b word of the same pair."""
    a = pairs.where("side = 'a'").select("pair_id", F.col("word_id").alias("wa"), F.col("vector").alias("va"))
    b = pairs.where("side = 'b'").select("pair_id", F.col("word_id").alias("wb"), F.col("vector").alias("vb"))
    best = (a.join(b, "pair_id").groupBy("pair_id", "wa")
             .agg(F.max(cosine(F.col("va"), F.col("vb"))).alias("m")))
    return best.groupBy("pair_id").agg(F.avg("m").alias(out))


def centroid_features(pairs: DataFrame) -> DataFrame:
    """Cosine and mean squared difference of the two sides' mean vectors."""
    c = centroid(pairs.withColumn("k", F.concat_ws(":", F.col("pair_id").cast("string"), "side")), "k")
    c = c.select(F.split("k", ":")[0].cast("bigint").alias("pair_id"), F.split("k", ":")[1].alias("side"), "centroid")
    a = c.where("side = 'a'").select("pair_id", F.col("centroid").alias("ca"))
    b = c.where("side = 'b'").select("pair_id", F.col("centroid").alias("cb"))
    j = a.join(b, "pair_id")
    return j.select("pair_id", cosine(F.col("ca"), F.col("cb")).alias("w2v_n_similarity"),
                    mse(F.col("ca"), F.col("cb")).alias("w2v_centroid_rmse"))


def word_id_rule(word: Column, n: int) -> Column:
    """A vector for every word: the md5 of the word modulo the size of the vector table."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % n


def pair_vector_features(pairs: DataFrame, products: DataFrame, vectors: DataFrame, n: int, field: str, suffix: str, q: str = "q") -> DataFrame:
    """F43-F48 of search words against the words of one field: mean over search words of the largest cosine to a
    word of the field, cosine of the two mean vectors, and their mean squared difference; 0 if a side has no words.

    ``vectors`` = (word_id, vector), ids below ``n``; only those of a word of the texts take part. A pair is one row with the
    words of its search and the distinct words of its field, and its cosines one product of unit vectors.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from relevo.functions import text as tx
    from relevo.session import materialize

    words = lambda df, c: df.select(F.explode(F.array_distinct(tx.split_ws(c))).alias("w"))
    used = words(pairs, q).unionByName(words(products, field)).distinct().select(word_id_rule(F.col("w"), n).alias("word_id"))
    known = vectors.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))
    known = materialize(known.join(used.distinct(), "word_id", "left_semi").select("word_id", "vector"), "used-vectors")
    qw = pairs.select("pair_id", "product_uid", F.transform(tx.split_ws(q), lambda w: word_id_rule(w, n)).alias("ids"))
    fw = products.select("product_uid", F.transform(tx.split_ws(field), lambda w: word_id_rule(w, n)).alias("ids"))

    def mean(df, key):
        m = Summarizer.sum(array_to_vector("total"))
        c = df.where("cnt > 0").groupBy(key).agg(m.alias("m"), F.sum("cnt").alias("cnt"))
        return c.select(key, F.transform(vector_to_array("m"), lambda x: x / F.col("cnt")).alias(f"c_{key}"))

    q_side, f_side = _dense_sides(qw, fw, known) if _held(known) else _chunked_sides(qw, fw, known)
    top = q_side.where("n > 0").groupBy("pair_id", "product_uid").agg((F.sum("s") / F.sum("n")).alias("best"))
    both = (pairs.select("pair_id", "product_uid").join(top.drop("product_uid"), "pair_id", "left")
            .join(mean(q_side, "pair_id"), "pair_id", "left").join(mean(f_side, "product_uid"), "product_uid", "left"))
    a, b = F.col("c_pair_id"), F.col("c_product_uid")
    zero = F.lit(0.0)
    return both.select("pair_id", F.coalesce("best", zero).alias(f"max_cosine_sim_per_word_{suffix}"),
                       F.coalesce(cosine(a, b), zero).alias(f"w2v_n_similarity_{suffix}"), F.coalesce(mse(a, b), zero).alias(f"w2v_centroid_rmse_{suffix}"))


#: Vectors of 64 numbers that every task may hold (410 MB); of longer ones fewer. More are brought to chunks of rows.
MAX_VECTORS = 800_000

#: Rows of a chunk that has its vectors sent.
CHUNK_ROWS = 1024


def _held(known: DataFrame) -> bool:
    """Whether every task may hold the vectors ``known``."""
    from relevo.operators.topn import fits
    first = known.first()
    return first is None or fits(known, MAX_VECTORS * 64 // max(64, len(first["vector"])))


def _dense_sides(qw: DataFrame, fw: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``qw`` (pair_id, product_uid, ids) and ``fw`` (product_uid, ids), with vectors ``known`` that a task may hold:
    (pair_id, product_uid, s, n, total, cnt): the summed largest cosines of the n words of a search, and the sum of their cnt vectors;
    (product_uid, words, total, cnt): the distinct words of a field and the sum of its vectors. A pair is one row and one matrix product."""
    sent = known.sparkSession.sparkContext.broadcast(_unit_vectors(known.toArrow()))

    def with_vectors(rows, of, schema):
        return rows.mapInArrow(lambda batches: (of(batch, *sent.value) for batch in batches), schema)
    return _sides(qw, fw, with_vectors)


def _chunked_sides(qw: DataFrame, fw: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sides of ``_dense_sides`` for any number of vectors: rows are dealt to chunks, and a chunk's task is sent the vectors of its words."""
    from relevo.session import materialize

    def with_vectors(rows, of, schema):
        rows = materialize(rows.withColumn("chunk", F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}")), "vector-chunks")
        lists = [F.coalesce(c, F.array().cast("array<long>")) for c in ("ids", "words") if c in rows.columns]
        need = rows.select("chunk", F.explode(F.array_distinct(F.concat(*lists))).alias("word_id")).distinct()
        need = need.join(known.hint("merge"), "word_id").select(F.col("chunk").alias("of_chunk"), "word_id", "vector")

        def chunk(left, right):
            import pyarrow as pa
            vectors = _unit_vectors(right)
            return pa.Table.from_batches([of(batch, *vectors) for batch in left.combine_chunks().to_batches()])
        return rows.groupBy("chunk").cogroup(need.groupBy("of_chunk")).applyInArrow(chunk, schema)
    return _sides(qw, fw, with_vectors)


def _unit_vectors(t):
    """Sorted word ids of a table (word_id, vector), their unit vectors and the vectors' lengths."""
    import numpy as np

    ids = t.column("word_id").to_numpy().astype(np.int64)
    vecs = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    vecs = vecs.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    order = np.argsort(ids, kind="stable")
    ids, vecs = ids[order], vecs[order]
    length = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
    vecs /= np.where(length == 0, 1.0, length)
    return ids, vecs, length


def _sides(qw: DataFrame, fw: DataFrame, with_vectors) -> tuple[DataFrame, DataFrame]:
    """The sides of ``_dense_sides``; ``with_vectors(rows, of, schema)`` hands batches of ``rows`` to ``of(batch, ids, unit, size)`` with the vectors of their words."""
    from relevo.session import materialize

    def lists(col):
        import numpy as np
        return np.asarray(col.offsets), np.asarray(col.values.fill_null(-1), dtype=np.int64)

    def rows_of(word, ids):
        """Rows of the vectors of words, and how many each has (a word_id may have several)."""
        import numpy as np
        lo, hi = np.searchsorted(ids, word, "left"), np.searchsorted(ids, word, "right")
        n = hi - lo
        return np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), n

    def listed(parts, kind):
        import numpy as np
        import pyarrow as pa
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, dtype=np.int64 if kind == pa.int64() else float)]), kind))

    def field(batch, ids, unit, size):
        import numpy as np
        import pyarrow as pa
        at, word = lists(batch.column("ids"))
        words, totals, cnt = [], [], []
        for i in range(batch.num_rows):
            own, times = np.unique(word[at[i]:at[i + 1]], return_counts=True)
            r, n = rows_of(own, ids)
            words.append(own[n > 0])
            each = np.repeat(times, n)
            totals.append((each * size[r, 0]) @ unit[r])
            cnt.append(int(each.sum()))
        return pa.record_batch([batch.column("product_uid"), listed(words, pa.int64()), listed(totals, pa.float64()), pa.array(cnt, pa.int64())], names=["product_uid", "words", "total", "cnt"])

    def search(batch, ids, unit, size):
        import numpy as np
        import pyarrow as pa
        at, word = lists(batch.column("ids"))
        f_at, f_word = lists(batch.column("words"))
        s, totals, cnt = np.zeros(batch.num_rows), [], []
        for i in range(batch.num_rows):
            r, n = rows_of(word[at[i]:at[i + 1]], ids)
            totals.append(size[r, 0] @ unit[r])
            cnt.append(len(r))
            f, _ = rows_of(f_word[f_at[i]:f_at[i + 1]], ids)
            if len(r) and len(f):
                most = (unit[r] @ unit[f].T).max(axis=1)
                s[i] = np.maximum.reduceat(most, (np.cumsum(n) - n)[n > 0]).sum()  # words without a vector add 0
        return pa.record_batch([batch.column("pair_id"), batch.column("product_uid"), pa.array(s), pa.array(np.diff(at).astype(np.int64)), listed(totals, pa.float64()), pa.array(cnt, pa.int64())],
                               names=["pair_id", "product_uid", "s", "n", "total", "cnt"])

    uid, pid = dict(qw.dtypes)["product_uid"], dict(qw.dtypes)["pair_id"]
    f_side = materialize(with_vectors(fw, field, f"product_uid {dict(fw.dtypes)['product_uid']}, words array<long>, total array<double>, cnt long"), "field-vectors")
    words = f_side.groupBy("product_uid").agg(F.flatten(F.collect_list("words")).alias("words"))  # a product's rows, one as a rule
    q_side = qw.join(words, "product_uid", "left").select("pair_id", "product_uid", "ids", "words")
    return materialize(with_vectors(q_side, search, f"pair_id {pid}, product_uid {uid}, s double, n long, total array<double>, cnt long"), "search-vectors"), f_side


#: Cosines that a task of ``nearest`` holds at a time: 32 MB in single precision, and a quarter of it to mark those wanted.
MAX_CELLS = 8_000_000

#: Vectors whose cosines to all queries begin the search of a task; after them, as many at a time as it has seen.
FIRST_ROWS = 1024

#: Pairs whose exact cosines are taken at a time.
MAX_EXACT = 50_000


def _ranked(of, cos, keys, k: int):
    """The rows (query, cosine, key) that are among the ``k`` of their query with the largest cosines, ties by key; sorted by query."""
    import numpy as np

    order = np.lexsort((-cos, of))
    of, cos, keys = of[order], cos[order], keys[order]
    same = (of[1:] == of[:-1]) & (cos[1:] == cos[:-1])
    if same.any():  # only keys of equal cosines are compared
        at = np.flatnonzero(np.append(same, False) | np.append(False, same))
        run = np.cumsum(np.concatenate([[True], ~same]))[at]
        keys[at] = keys[at][np.lexsort((np.unique(keys[at], return_inverse=True)[1], run))]
    keep = np.arange(len(of)) - np.searchsorted(of, of) < k
    return of[keep], cos[keep], keys[keep]


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, qkey: str = "query_id",
            qvec: str = "qvec", key: str = "word_id", vec: str = "vector",
            max_broadcast: int = 20_000, cells: int = MAX_CELLS) -> DataFrame:
    """O3: the k vectors most similar (cosine, rounded to 9 places; ties by key) to each query vector (exact).

    A stated query set against all vectors, in blocks: at most ``max_broadcast`` query vectors are broadcast at a
    time, and each task multiplies them with a batch of vectors, at most ``cells`` products at a time, in single precision. Pairs
    that by its error bound may be among the k best of what the task has seen are taken again in double precision, and a task brings k rows
    per query. No pair becomes a row, the vector table is read once per block, and the final k come from a salted two-step window.
    """
    import numpy as np
    import pyarrow as pa

    from relevo.session import bounded_batches, materialize

    q = materialize(queries.select(qkey, qvec), "nearest-queries")
    n = q.count()
    blocks = max(1, -(-n // max_broadcast))
    types = dict(queries.dtypes) | {"_key": dict(vectors.dtypes)[key]}
    spark = queries.sparkSession
    bounded_batches(spark)

    def unit(col):
        col = col.combine_chunks() if hasattr(col, "chunks") else col
        if col.null_count:
            raise ValueError("a vector is null")
        m = col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return m / np.where(length == 0, 1.0, length)

    def search(block):
        def run(batches):
            ids, mat = block.value
            best = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
            if not len(ids):
                return
            single, seen, kind = mat.astype(np.float32), 0, None
            # single precision: as many roundings as numbers and a few more, of products that add up to 1 at most
            slack = (mat.shape[1] + 8) * 2.0 ** -23 + 1e-9
            for batch in batches:
                if not batch.num_rows:
                    continue
                all_keys, vecs, kind = batch.column(key), unit(batch.column(vec)), batch.column(key).type
                all_keys, lo = np.array(all_keys.to_pylist(), dtype=object), 0
                while lo < len(vecs):
                    part, keys = vecs[lo:lo + max(FIRST_ROWS, seen)], all_keys[lo:lo + max(FIRST_ROWS, seen)]
                    lo, seen = lo + len(part), seen + len(part)
                    least = np.full(len(ids), -np.inf)
                    full = np.bincount(best[0], minlength=len(ids)) >= k
                    least[full] = best[1][np.searchsorted(best[0], np.flatnonzero(full), side="right") - 1] - slack
                    low, found = part.astype(np.float32), [best]
                    width = max(1, cells // len(part))
                    for at in range(0, len(ids), width):
                        cos, bound = low @ single[at:at + width].T, least[at:at + width]
                        if not full[at:at + width].all() and len(part) > k:
                            bound = np.maximum(bound, np.partition(cos, -k, axis=0)[-k] - 2 * slack)
                        row, of = np.divmod(np.flatnonzero(cos >= bound.astype(np.float32)), cos.shape[1])
                        for i in range(0, len(row), MAX_EXACT):
                            r, o = row[i:i + MAX_EXACT], of[i:i + MAX_EXACT] + at
                            found.append(_ranked(o, np.round(np.einsum("ij,ij->i", part[r], mat[o]), 9), keys[r], k))
                    best = _ranked(*map(np.concatenate, zip(*found, strict=True)), k)
            for i in range(0, len(best[0]), MAX_EXACT):
                of, cos, keys = (x[i:i + MAX_EXACT] for x in best)
                yield pa.record_batch([ids.take(pa.array(of)), pa.array(keys, kind), pa.array(cos)], names=[qkey, key, "cosine"])
        return run

    out = None
    for b in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64(qkey), F.lit(blocks)) == b)).toArrow()  # about max_broadcast rows
        block = spark.sparkContext.broadcast((rows.column(qkey).combine_chunks(), unit(rows.column(qvec)) if len(rows) else None))
        s = vectors.select(key, vec).mapInArrow(search(block), f"{qkey} {types[qkey]}, {key} {types['_key']}, cosine double")
        part = top_n_per_group(s, qkey, [F.desc("cosine"), F.asc(key)], k, salt_cols=[key])
        out = part if out is None else out.unionByName(part)
    return out


#: Words that count as context: the most frequent ones. They bound the columns of the word matrix, not its rows.
MAX_CONTEXTS = 20_000


#: Word positions whose neighbours a task counts at a time.
MAX_PLACES = 500_000


def _flat(col):
    """Codes of the words of a list column, the words, and for each place where its text begins and ends."""
    import numpy as np
    col = col.combine_chunks() if hasattr(col, "chunks") else col
    col = col.drop_null()
    words = col.flatten().dictionary_encode()
    n = np.diff(np.asarray(col.offsets))
    ends = np.cumsum(n)
    return np.asarray(words.indices).astype(np.int64), words.dictionary, np.repeat(ends - n, n), np.repeat(ends, n)


def _neighbours(window: int):
    """(word, n): how many words stand at most ``window`` words away from a word of a batch."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            code, words, lo, hi = _flat(batch.column("w"))
            at = np.arange(len(code))
            n = np.bincount(code, weights=np.minimum(at - lo, window) + np.minimum(hi - 1 - at, window), minlength=len(words)).astype(np.int64)
            yield pa.record_batch([words.filter(pa.array(n > 0)), pa.array(n[n > 0])], names=["word", "n"])
    return run


def _context_counts(window: int, known):
    """(word, col, n): how often the contexts ``known`` (word, col) stand at most ``window`` words away from a word of a batch."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def run(batches):
        names = pa.array([w for w, _ in known.value], pa.string())
        cols = np.array([c for _, c in known.value] + [-1], dtype=np.int64)
        m = max(len(names), 1)
        for batch in batches:
            code, words, _, hi = _flat(batch.column("w"))
            col = cols[np.asarray(pc.index_in(words, value_set=names).fill_null(-1))][code]
            for start in range(0, len(code), MAX_PLACES):
                at = np.arange(start, min(start + MAX_PLACES, len(code)))
                keys = []
                for d in range(1, window + 1):
                    a = at[at + d < hi[at]]
                    for x, y in ((a, a + d), (a + d, a)):
                        x, y = x[col[y] >= 0], y[col[y] >= 0]
                        keys.append(code[x] * m + col[y])
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.record_batch([words.take(pa.array(key // m)), pa.array(key % m, pa.int32()), pa.array(n, pa.int64())], names=["word", "col", "n"])
    return run


def context_weights(texts: DataFrame, col: str = "text", window: int = 5, max_contexts: int = MAX_CONTEXTS, shift: float = 1.0,
                    smooth: float = 0.75) -> tuple[DataFrame, int]:
    """((word, cols, vals), number of contexts): for every word of the distinct texts its positive weights log(p(word, context) / (p(word) p'(context))) -
    log(shift), where context words stand at most ``window`` words away and p' flattens their shares by the power ``smooth``.

    How many neighbours a word has follows from where it stands, so only neighbours that are contexts are counted: in numpy, over
    slices of the words of a batch, and added before and after one shuffle by (word, context)."""
    from relevo.session import bounded_batches, materialize

    rows = texts.select(F.sha2(F.col(col), 256).alias("h"), F.split(F.trim(F.col(col)), r"\s+").alias("w")).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "words")
    first = rows.groupBy("h").agg(F.min("row").alias("row")).select("row")
    docs = materialize(rows.join(first, "row", "left_semi").select(F.filter("w", lambda x: x != "").alias("w")), "distinct-words")
    bounded_batches(docs.sparkSession)
    per_word = docs.mapInArrow(_neighbours(window), "word string, n long").groupBy("word").agg(F.sum("n").alias("of_word"))
    per_word = materialize(per_word, "word-counts")
    by = per_word.orderBy(F.desc("of_word"), "word").limit(max_contexts)
    contexts = by.agg(F.array_sort(F.collect_list("word")).alias("w")).select(F.posexplode("w").alias("col", "context"))  # at most max_contexts words
    contexts = materialize(contexts.join(per_word.withColumnRenamed("word", "context"), "context").withColumnRenamed("of_word", "of_context"), "word-contexts")
    sums = contexts.agg(F.sum(F.pow(F.col("of_context").cast("double"), smooth)).alias("flat"), F.count("*").alias("n")).first()
    of = sorted(((r["context"], r["col"], r["of_context"]) for r in contexts.collect()), key=lambda r: r[1])
    send = docs.sparkSession.sparkContext.broadcast
    known, flat = send([r[:2] for r in of]), send([r[2] for r in of])
    counts = docs.mapInArrow(_context_counts(window, known), "word string, col int, n long").groupBy("word", "col").agg(F.sum("n").alias("n"))
    # what a word has of neighbours comes as one more entry, so counts are not joined to words
    both = counts.unionByName(per_word.select("word", F.lit(-1).alias("col"), F.col("of_word").alias("n")))
    lists = both.groupBy("word").agg(F.collect_list(F.struct("col", "n")).alias("x"))  # a word's contexts are bounded
    weights = lists.mapInArrow(_weights(flat, float(sums["flat"] or 1.0), smooth, shift), "word string, cols array<int>, vals array<double>")
    return materialize(weights, "word-rows"), sums["n"]


def _weights(of_context, total: float, smooth: float, shift: float):
    """(word, cols, vals): the positive weights, by context, of words with the lists ``x`` (col, n) of their contexts and, as col -1, of all their neighbours."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        flat = np.array(of_context.value, dtype=float) ** smooth
        for batch in batches:
            x = batch.column("x")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(x.offsets)))
            entry = x.flatten()
            col, n = np.asarray(entry.field("col")).astype(np.int64), np.asarray(entry.field("n"))
            of_word = np.zeros(batch.num_rows)
            of_word[row[col < 0]] = n[col < 0]
            row, col, n = row[col >= 0], col[col >= 0], n[col >= 0]
            v = np.log(n / of_word[row] * total / flat[col]) - math.log(shift)
            row, col, v = row[v > 0], col[v > 0], v[v > 0]
            order = np.lexsort((col, row))
            row, col, v = row[order], col[order], v[order]
            words, count = np.unique(row, return_counts=True)
            ends = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
            yield pa.record_batch([batch.column("word").take(pa.array(words)), pa.ListArray.from_arrays(ends, pa.array(col, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(v))],
                                  names=["word", "cols", "vals"])
    return run


def fit_word_vectors(texts: DataFrame, col: str = "text", size: int = 100, window: int = 5, power: int = 5, **weights) -> DataFrame:
    """V7: (word, vector) of every word that has a context, by factoring the words' context weights: neighbours are words of like contexts, as with
    the source's trained vectors, but values differ. Words are rows of a distributed matrix; only the contexts are ever collected."""
    from relevo.operators import svd

    rows, n = context_weights(texts, col, window, **weights)
    basis = svd.fit(rows, max(n, 1), size, power)
    # U sqrt(S) = X V / sqrt(S)
    return svd.project(rows, "word", svd.Svd(basis.v / basis.s ** 0.5, basis.s), "vector")


def word_cosine(pairs: DataFrame, vectors: DataFrame, a: str = "a", b: str = "b", out: str = "cosine") -> DataFrame:
    """V8: ``pairs`` with the cosine of the vectors of their two words; null if one has none."""
    va = vectors.select(F.col("word").alias(a), F.col("vector").alias("_a"))
    vb = vectors.select(F.col("word").alias(b), F.col("vector").alias("_b"))
    return pairs.join(va, a, "left").join(vb, b, "left").withColumn(out, cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
