"""Pairwise (search term x product) features F1-F27, F30-F41 as DataFrame jobs.

Layout of the work:

* product side, once per distinct product: token arrays, distinct token sets,
  digit-token sets and n-gram counts of title / description / attributes;
* pair side: the search term's own tokens; the pair row joins its product once
  (``product_uid``) and every feature is a built-in expression on that row;
* character sets are 64-bit masks: a distance is two bit counts. The minima over long
  fields (F22, F26, F27) are taken per pair against the product's distinct character
  sets, and the text itself is never shuffled by pair.

Semantics follow the source, including its quirks (documented per feature).
Empty search terms, which raise in the source, give 0 / NULL here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relevo.functions import text as tx

BIG = 99999.0  # the source's "no word" sentinel for minima


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard distance of two sets (arrays of distinct values); NULL when both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(None).cast("double")).otherwise(
        (u - F.size(F.array_intersect(a, b))).cast("double") / u)


def prepare_products(products: DataFrame, fields=("title", "description", "attributes")) -> DataFrame:
    """Per-product token structures for every field (computed once per product)."""
    cols = [F.col("product_uid")]
    for f in fields:
        sp = tx.split_blank(f)                    # str.split(' ')
        ws = tx.split_ws(f)                       # str.split()
        cols += [
            F.col(f),
            ws.alias(f"{f}_ws"),
            F.array_distinct(ws).alias(f"{f}_wset"),
            F.array_distinct(tx.digit_tokens(f)).alias(f"{f}_digits"),
            F.size(F.array_distinct(sp)).alias(f"{f}_n1"),
            F.size(F.array_distinct(tx.bigrams(sp))).alias(f"{f}_n2"),
            F.array_distinct(tx.split_blank(F.trim(F.col(f)))).alias(f"{f}_jset"),
            F.size(ws).alias(f"{f}_len"),
        ]
    for f in ("title", "brand"):  # an expression inside a lambda would be computed again for every word of the search
        sp, trimmed = tx.split_blank(f), tx.split_blank(F.trim(F.col(f)))
        cols += [F.array_distinct(sp).alias(f"{f}_words"), F.array_distinct(trimmed).alias(f"{f}_trimmed"), _sets(trimmed).alias(f"{f}_sets")]
    cols += [F.col("brand"), tx.split_blank("brand").alias("brand_split"), F.size(tx.split_ws("brand")).alias("brand_len")]
    return products.select(*cols)


def prepare_queries(pairs: DataFrame, q: str = "q") -> DataFrame:
    sp = tx.split_blank(q)
    ws = tx.split_ws(q)
    return pairs.select(
        "*",
        ws.alias("q_ws"), F.array_distinct(ws).alias("q_wset"),
        F.array_distinct(tx.digit_tokens(q)).alias("q_digits"),
        F.size(F.array_distinct(sp)).alias("q_n1"),
        F.size(F.array_distinct(tx.bigrams(sp))).alias("q_n2"),
        F.array_distinct(tx.split_blank(F.trim(F.col(q)))).alias("q_jset"),
        F.array_distinct(sp).alias("q_words"), _sets(tx.split_blank(F.trim(F.col(q)))).alias("q_sets"),
    )


def _last_word_in(f: str) -> Column:
    last = F.element_at(F.col("q_ws"), -1)
    return F.when(F.size("q_ws") == 0, F.lit(0)).otherwise(
        F.array_contains(F.col(f"{f}_ws"), last).cast("int"))


def _set_cosine(f: str) -> Column:
    den = F.sqrt(F.size("q_wset").cast("double")) * F.sqrt(F.size(f"{f}_wset").cast("double"))
    return F.when(den == 0, F.lit(0.0)).otherwise(
        F.size(F.array_intersect("q_wset", f"{f}_wset")).cast("double") / den)


def _pairwise_min(q: Column, f: Column, fn) -> Column:
    """min over all (query word, field word) pairs; small arrays only (title, brand)."""
    return F.array_min(F.flatten(F.transform(q, lambda x: F.transform(f, lambda y: fn(x, y)))))


def _no_distance(q: Column, f: Column) -> Column:
    """A word occurs on both sides, so the least distance is 0 and no pair has to be measured."""
    some = lambda ws: F.filter(ws, lambda w: w != "")
    return F.arrays_overlap(some(q), some(f))


def min_edit(q: Column, f: Column) -> Column:
    """The least edit distance of a word of ``q`` and one of ``f`` (stored columns of distinct words); no pair is measured if a word is common."""
    return F.when(_no_distance(q, f), 0).otherwise(_pairwise_min(q, f, F.levenshtein))


def min_jaccard(q: Column, f: Column, q_sets: Column, f_sets: Column) -> Column:
    """The least Jaccard distance of the character sets of a word of ``q`` and one of ``f``; as ``min_edit``.
    ``q_sets`` and ``f_sets`` are stored columns with the ``_sets`` of both."""
    return F.when(_no_distance(q, f), 0.0).otherwise(_pairwise_min(q_sets, f_sets, mask_jaccard))


#: Characters that have a bit of a 64-bit mask; cleaned texts hold few others.
_MASKED = "abcdefghijklmnopqrstuvwxyz0123456789 .,-/_'\"&+#%()"


def char_mask(w: Column) -> Column:
    """The character set of a word as a BIGINT, or NULL if it holds a character without a bit."""
    bits = F.aggregate(F.split(w, ""), F.lit(0).cast("long"),
                       lambda m, c: m.bitwiseOR(F.when(c == "", F.lit(0).cast("long")).otherwise(
                           F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(_MASKED), c) - 1))))
    return F.when(F.translate(w, _MASKED, "") == "", bits)


def _mask_chars(m: Column) -> Column:
    """The characters of a mask."""
    on = F.filter(F.sequence(F.lit(0), F.lit(len(_MASKED) - 1)),
                  lambda i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.transform(on, lambda i: F.substring(F.lit(_MASKED), i + 1, F.lit(1)))


def _sets(words: Column) -> Column:
    """Distinct character sets of words, as structs of mask and character array (the array only where there is no mask)."""
    return F.array_distinct(F.transform(F.array_distinct(words), _char_set))


def _char_set(w: Column) -> Column:
    m = char_mask(w)
    return F.struct(m.alias("m"), F.when(m.isNull(), F.array_sort(tx.char_set(w))).alias("cs"))


def mask_jaccard(x: Column, y: Column) -> Column:
    """Jaccard distance of two structs of ``_sets``: bit counts, or character arrays where a mask is missing."""
    both = x["m"].bitwiseOR(y["m"])
    fast = F.when(both == 0, F.lit(None).cast("double")).otherwise(
        (F.bit_count(both) - F.bit_count(x["m"].bitwiseAND(y["m"]))) / F.bit_count(both))
    cs = lambda s: F.coalesce(s["cs"], _mask_chars(s["m"]))
    return F.when(both.isNotNull(), fast).otherwise(set_jaccard(cs(x), cs(y)))


def basic_features(j: DataFrame, q: str = "q") -> DataFrame:
    """F1-F14 (``j`` = prepared queries joined with prepared products)."""
    return j.select("pair_id", *basic_columns(q))


def basic_columns(q: str = "q") -> list:
    return [
        F.length(q).alias("search_term_length"),
        _last_word_in("title").alias("last_word_in_title"),
        _last_word_in("description").alias("last_word_in_desc"),
        (F.col("brand") != "NoBrand").cast("int").alias("have_brand_or_not"),
        (F.col("attributes") != "noattribute").cast("int").alias("have_attr_or_not"),
        F.size(F.array_intersect("q_digits", "attributes_digits")).alias("numbers_in_attr"),
        F.size(F.array_intersect("q_digits", "title_digits")).alias("numbers_in_title"),
        F.size(F.array_intersect("q_digits", "description_digits")).alias("numbers_in_desc"),
        # n-gram "edit distance" in the source compares word tuples, so with thresholds 1 (unigrams)
        # and 4 (bigrams) every pair of distinct n-grams counts: the product of the set sizes.
        (F.col("q_n1") * F.col("title_n1")).alias("title_common_word_count"),
        (F.col("q_n1") * F.col("description_n1")).alias("desc_common_word_count"),
        (F.col("q_n1") * F.col("attributes_n1")).alias("attr_common_words_count"),
        (F.col("q_n2") * F.col("title_n2")).alias("title_common_word_count_bigram"),
        (F.col("q_n2") * F.col("description_n2")).alias("desc_common_word_count_bigram"),
        (F.col("q_n2") * F.col("attributes_n2")).alias("attr_common_word_count_bigram"),
    ]


def similarity_features(j: DataFrame, q: str = "q") -> DataFrame:
    """F15-F21, F23-F25 (everything of part 2 except the mean Jaccard features)."""
    return j.select("pair_id", *similarity_columns(q))


def similarity_columns(q: str = "q") -> list:
    qb = tx.split_blank(q)
    q_words, q_trimmed, q_sets = F.col("q_words"), F.col("q_jset"), F.col("q_sets")
    return [
        _set_cosine("title").alias("cosine_search_term_Title"),
        _set_cosine("description").alias("cosine_search_term_desc"),
        F.aggregate(qb, F.lit(0), lambda acc, x: acc + F.size(F.filter("brand_split", lambda y: y == x)))
         .alias("search_term_contains_brand"),
        min_jaccard(q_trimmed, F.col("brand_trimmed"), q_sets, F.col("brand_sets")).alias("min_jcc_brand_with_search_term"),
        min_edit(q_words, F.col("brand_words")).alias("min_edit_brand_with_search_term"),
        min_jaccard(q_trimmed, F.col("title_trimmed"), q_sets, F.col("title_sets")).alias("min_jcc_title_with_search_term"),
        min_edit(q_words, F.col("title_words")).alias("min_edit_title_with_search_term"),
        set_jaccard(F.col("q_jset"), F.col("title_jset")).alias("sum_jaccard_product_title_with_search_term"),
        F.levenshtein(q, "title").alias("sum_edit_product_title_with_search_term"),
        set_jaccard(F.col("q_jset"), F.col("description_jset")).alias("sum_jcc_prod_desc_with_search_term"),
    ]


def mean_char_jaccard(pairs: DataFrame, products: DataFrame, field: str, out: str, q: str = "q") -> DataFrame:
    """mean over query words of the minimum character-set Jaccard distance to
    any word of the field; empty query words add 0 but count in the denominator, a field
    without words gives 99999 per query word.

    A pair is one row with the masks of its words and those of the product's distinct character sets, both taken from the
    texts' bytes; a task takes the distances of all of them as bit counts of a matrix.
    """
    words = tx.split_blank(F.trim(F.col(q)))
    qw = char_sets(pairs.select("pair_id", "product_uid", q), q, "xs", distinct=False)
    # one row per product with the character sets of its words: words with equal sets count once
    fw = char_sets(products.select("product_uid", field), field, "ys").where(F.size("ys_m") > 0)
    j = qw.join(fw, "product_uid", "left").drop("product_uid")
    kind = dict(pairs.dtypes)["pair_id"]
    per_pair = j.mapInArrow(_distances, f"pair_id {kind}, s double").groupBy("pair_id").agg(F.sum("s").alias("s"))
    return (pairs.select("pair_id", F.size(words).alias("n")).join(per_pair, "pair_id", "left")
            .select("pair_id", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias(out)))


#: Bytes of text whose words are masked at a time.
MASK_BYTES = 1 << 20


def char_sets(df: DataFrame, text: str, name: str, distinct: bool = True) -> DataFrame:
    """``df`` with ``text`` replaced by the character sets of its blank-separated words: ``{name}_m`` has their masks, null where a word holds a
    character without a bit, whose characters are then in ``{name}_cs``; ``distinct``: each set once. A null text has null lists."""
    rest = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)
    return df.select(*rest, F.col(text).alias("_text")).mapInArrow(
        _char_sets(rest, name, distinct), ", ".join(f"`{c}` {kinds[c]}" for c in rest) + f", {name}_m array<long>, {name}_cs array<string>")


def _char_sets(rest: list, name: str, distinct: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        other = np.int64(1) << 62
        bits = np.full(256, other)
        for i, c in enumerate(_MASKED):
            bits[ord(c)] = np.int64(1) << i
        bits[32] = 0  # a blank is in no word

        def sets(texts):
            """Ends of the lists of the rows of ``texts``, their masks, and the characters of words without a mask."""
            ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]]
            ends = ends - ends[0]
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[ends] = True
            word = data != 32
            before = np.concatenate([[False], word[:-1]])[:len(word)]
            start = np.flatnonzero(word & (~before | edge[:-1]))
            stop = np.flatnonzero(word & (~np.concatenate([word[1:], [False]])[:len(word)] | edge[1:])) + 1
            mask = np.bitwise_or.reduceat(bits[data], start) if len(start) else np.zeros(0, np.int64)
            row = np.searchsorted(ends, start, side="right") - 1
            plain = mask < other
            odd = {i: "".join(sorted(set(data[start[i]:stop[i]].tobytes().decode(errors="replace")))) for i in np.flatnonzero(~plain)}
            chars = np.full(len(mask), None, dtype=object)
            for i, cs in odd.items():
                chars[i] = cs
            if distinct:
                number = {cs: k for k, cs in enumerate(dict.fromkeys(odd.values()))}
                told = mask.copy()
                for i, cs in odd.items():
                    told[i] = other + number[cs]
                order = np.lexsort((told, row))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (told[order][1:] != told[order][:-1]) | (row[order][1:] != row[order][:-1])
                keep = order[new]
                row, mask, plain, chars = row[keep], mask[keep], plain[keep], chars[keep]
            return np.searchsorted(row, np.arange(len(texts) + 1)), pa.array(mask, mask=~plain), pa.array(chars, pa.string())

        for batch in batches:
            texts = batch.column("_text").cast(pa.string())
            size = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(size, size[lo] + MASK_BYTES, side="right")) - 1)
                part = texts.slice(lo, hi - lo)
                ends, mask, chars = sets(part)
                at = pa.array(ends, pa.int32(), mask=np.append(~np.asarray(part.is_valid()), False)) if part.null_count else pa.array(ends, pa.int32())
                yield pa.record_batch([*[batch.column(c).slice(lo, hi - lo) for c in rest], pa.ListArray.from_arrays(at, mask), pa.ListArray.from_arrays(at, chars)],
                                      names=[*rest, f"{name}_m", f"{name}_cs"])
                lo = hi
    return run


def _distances(batches):
    """(pair_id, s): the summed least distances of batches of (pair_id, masks and character sets of both sides)."""
    import numpy as np
    import pyarrow as pa

    def flat(col):
        """Where the lists of a column end, their numbers (0: none), and which rows hold one without a number."""
        ends = np.asarray(col.offsets)
        none = np.concatenate([[0], np.cumsum(np.asarray(col.values.is_null()))])
        return ends, np.asarray(col.values.fill_null(0)), none[ends[1:]] > none[ends[:-1]], np.asarray(col.is_valid())

    def sets(masks, chars):
        return [frozenset(c) if m is None else frozenset(x for i, x in enumerate(_MASKED) if m >> i & 1) for m, c in zip(masks, chars, strict=True)]

    for batch in batches:
        (x_at, x_all, x_odd, x_is), (y_at, y_all, y_odd, y_is) = flat(batch.column("xs_m")), flat(batch.column("ys_m"))
        x_n, y_n = np.bitwise_count(x_all).astype(np.int8), np.bitwise_count(y_all).astype(np.int8)
        sums = []
        for i in range(batch.num_rows):
            a, b = slice(x_at[i], x_at[i + 1]), slice(y_at[i], y_at[i + 1])
            if not x_is[i]:
                sums.append(None)
            elif not y_is[i]:
                sums.append(BIG * (a.stop - a.start))
            elif x_odd[i] or y_odd[i]:  # a character without a bit
                x, y = (sets(batch.column(f"{c}_m")[i].as_py(), batch.column(f"{c}_cs")[i].as_py()) for c in ("xs", "ys"))
                sums.append(sum((min((len(u | v) - len(u & v)) / len(u | v) for v in y) for u in x), 0.0))
            else:
                both = np.bitwise_count(x_all[a, None] | y_all[b]).astype(np.int8)
                apart = 2 * both - x_n[a, None] - y_n[b]  # of two sets: their union without what they share
                sums.append(float((apart / both).min(axis=1).sum()))
        yield pa.record_batch([batch.column("pair_id"), pa.array(sums, pa.float64())], names=["pair_id", "s"])


def with_word_counts(j: DataFrame, words: str, fields) -> DataFrame:
    """``j`` with each text of ``fields`` replaced by ``tf_{field}``: how often each term of the structs ``words`` occurs in it."""
    rest, kinds = [c for c in j.columns if c not in fields], dict(j.dtypes)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            terms = batch.column(words)
            ends = np.asarray(terms.offsets)
            flat = terms.values.field("term").to_pylist()
            out = []
            for f in fields:
                texts = batch.column(f).to_pylist()
                counts = [None if t is None else t.count(w) for i, t in enumerate(texts) for w in flat[ends[i]:ends[i + 1]]]
                out.append(pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(counts, pa.int32())))
            yield pa.record_batch([*[batch.column(c) for c in rest], *out], names=[*rest, *[f"tf_{f}" for f in fields]])
    return j.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], *[f"tf_{f} array<int>" for f in fields]]))


def tf_idf_stats(pairs: DataFrame, qw: DataFrame, title: str = "title") -> DataFrame:
    """F33-F41 for ``pairs``; ``qw`` = (pair_id, qw ARRAY<STRUCT<pos, term, idf>>) from ``bm25.query_word_idf``."""
    j = pairs.select("pair_id", title).join(qw, "pair_id", "left")
    words = F.coalesce(F.col("qw"), F.array().cast("array<struct<pos:int,term:string,idf:double>>"))
    return j.select("pair_id", *tf_idf_columns(words, title))


def tf_idf_columns(words: Column, title: str = "title", tf: Column | None = None) -> list[Column]:
    """Max / min / sum over query words of tf (substring count in the title), idf (TF-IDF vocabulary,
    ``ln(N+1)`` when missing) and tf*idf; ``words`` is an array of structs with term and idf, ``tf`` their counts if taken already."""
    if tf is None:
        tf = F.transform(words, lambda x: tx.substring_count(F.col(title), x["term"]))
    vals = F.zip_with(words, tf, lambda x, n: F.struct(n.cast("double").alias("tf"), x["idf"].alias("idf")))
    parts = {"tf": F.transform(vals, lambda x: x["tf"]), "idf": F.transform(vals, lambda x: x["idf"]), "tfidf": F.transform(vals, lambda x: x["tf"] * x["idf"])}

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    return [fn(a).alias(f"{name}_{k}_ST") for name, fn in (("max", F.array_max), ("min", F.array_min), ("sum", total)) for k, a in parts.items()]


# --- fixed values: names and order of the 41-feature vector (F28/F29 are the latent cosine features) ---
FEATURE_ORDER = [
    "search_term_length", "last_word_in_title", "last_word_in_desc", "have_brand_or_not", "have_attr_or_not",
    "numbers_in_attr", "numbers_in_title", "numbers_in_desc", "title_common_word_count",
    "desc_common_word_count", "attr_common_words_count", "title_common_word_count_bigram",
    "desc_common_word_count_bigram", "attr_common_word_count_bigram",
    "cosine_search_term_Title", "cosine_search_term_desc", "search_term_contains_brand",
    "min_jcc_brand_with_search_term", "min_edit_brand_with_search_term", "min_jcc_title_with_search_term",
    "min_edit_title_with_search_term", "mean_jcc_product_title_with_search_term",
    "sum_jaccard_product_title_with_search_term", "sum_edit_product_title_with_search_term",
    "sum_jcc_prod_desc_with_search_term", "mean_jcc_product_desc_with_search_term", "mean_jcc_attr_with_search_term",
    "cosine_similarity_tfidf_search_title_des", "cosine_similarity_tfidf_search_des",
    "bm25_ST", "bm25_SD", "bm25_SB",
    "max_tf_ST", "max_idf_ST", "max_tfidf_ST", "min_tf_ST", "min_idf_ST", "min_tfidf_ST",
    "sum_tf_ST", "sum_idf_ST", "sum_tfidf_ST",
]
# ---------------------------------------------------------------------------------------------------------
