"""Document fingerprints: SimHash over weighted 2-word terms, searched through permuted block tables.

A term is two neighbouring words (the last word stands alone); its weight is its length in code points.
Each term's 64-bit hash votes with its weight for or against every bit, and a bit is set if more than
half of the weight voted for it. The votes for bits i and i + 32 travel in one long: their sums stay
below 2**32, since all weights together are at most twice the length of the text.

Search: the 64 bits are cut into BLOCKS blocks. Within a radius of BLOCKS - 2 at least two blocks agree
exactly, so there is one table per pair of blocks, keyed by their bits; a pair of fingerprints is counted
in the first table that holds it. Equal fingerprints are one class and meet once, with their number.

All of it is DataFrame expressions. The next document comes from a window over ranges of ``doc_id``
(quantiles of the ids, at most MAX_RANGES), to each of which the first text of the next range is appended.

Defined cases: null text is empty; a text without words has fingerprint 0; null ids come first, equal ids
are ordered by text; one document is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.session import materialize

BITS = 64
RADIUS = 3
BLOCKS = RADIUS + 2
#: Documents in a range of ids, and the most ranges.
RANGE_ROWS = 1000
MAX_RANGES = 4096
#: Searches: ids divisible by this look among all rows.
QUERY_STEP = 50


def _block_masks() -> list[int]:
    edge = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    return [sum(1 << b for b in range(a, z)) for a, z in zip(edge, edge[1:], strict=False)]


#: One mask per table: the bits of two blocks.
TABLES = [a | b for a, b in combinations(_block_masks(), 2)]


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _votes() -> list[Column]:
    """For each i < 32: the weight for bit i (low half) and for bit i + 32 (high half)."""
    both = _long((1 << 32) + 1)
    return [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(both) * F.col("weight")).alias(f"v{i}") for i in range(32)]


def _bits() -> Column:
    parts = []
    for i in range(32):
        low, high = F.col(f"v{i}").bitwiseAND(_long((1 << 32) - 1)), F.shiftrightunsigned(f"v{i}", 32)
        parts.append(F.when(low * 2 > F.col("weight"), _long(1 << i)).otherwise(_long(0)))
        parts.append(F.when(high * 2 > F.col("weight"), _long(1 << (i + 32))).otherwise(_long(0)))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _pairs(words: str) -> Column:
    """Neighbouring words; the last one has none."""
    after = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.arrays_zip(F.col(words).alias("a"), after.alias("b"))


def _term(x: str) -> list[Column]:
    chars = lambda c: F.coalesce(F.length(f"{x}.{c}"), F.lit(0))
    return [F.xxhash64(f"{x}.a", f"{x}.b").alias("h"), (chars("a") + chars("b")).cast("long").alias("weight")]


def fingerprints(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp): a 64-bit fingerprint for each key that has words. ``keys`` must name one text each."""
    terms = rows.select(*keys, _words(F.col(text)).alias("w")).select(*keys, F.explode(_pairs("w")).alias("x")).select(*keys, *_term("x"))
    return terms.groupBy(*keys).agg(F.sum("weight").alias("weight"), *_votes()).select(*keys, _bits().alias("fp"))


def likeness(a: str, b: str) -> Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / BITS


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, near): for each distinct query fingerprint the rows of ``fps`` within ``radius`` bits, itself included."""
    if radius > BLOCKS - 2:
        raise ValueError(f"the block tables find a radius of {BLOCKS - 2} at most")
    classes = fps.groupBy("fp").agg(F.count("*").alias("n"))
    table = F.posexplode(F.array(*[F.col("fp").bitwiseAND(_long(m)) for m in TABLES])).alias("tab", "key")
    left = queries.select("fp").distinct().select(F.col("fp").alias("q"), table)
    right = classes.select("fp", "n", table)
    away = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.array_position(F.array(*[away.bitwiseAND(_long(m)) for m in TABLES]), F.lit(0).cast("long")) - 1
    hits = left.join(right, ["tab", "key"]).where((F.bit_count(away) <= radius) & (first == F.col("tab")))
    return hits.groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("near"))


def _ranges(docs: DataFrame, order: Column) -> Column:
    """The number of the id range that a row falls in; two levels of 64 quantiles each."""
    n = docs.count()
    parts = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    if parts == 1:
        return F.lit(0)
    bounds = sorted(set(docs.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 100_000)).first()[0]))
    groups = [bounds[i:i + 64] for i in range(0, len(bounds), 64)]
    tops = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    inner = F.array(F.array(F.lit(None).cast("long")), *[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    g = F.size(F.filter(tops, lambda b: b <= order))
    return F.when(g == 0, 0).otherwise((g - 1) * 64 + F.size(F.filter(F.get(inner, g), lambda b: b <= order)))


def with_next(docs: DataFrame) -> DataFrame:
    """(range, rn, doc_id, text, next_text, next_id): every row with the row that follows it in ascending
    ``doc_id``; the first row follows the last. (range, rn) is unique."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = ids.withColumn("ord", order).withColumn("range", _ranges(ids, order).cast("long"))
    heads = rows.groupBy("range").agg(F.min("ord").alias("ord"))  # MAX_RANGES rows at most
    first = rows.join(F.broadcast(heads.withColumnRenamed("range", "_r")), "ord", "left_semi").groupBy("range", "ord").agg(F.min("text").alias("text"))
    w = Window.orderBy("range")
    turn = heads.select("range", F.coalesce(F.lag("range").over(w), F.max("range").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    tails = first.join(F.broadcast(turn), "range").select(F.lit(None).cast("long").alias("doc_id"), "text", "ord", F.col("before").alias("range"), F.lit(1).alias("tail"))
    every = rows.withColumn("tail", F.lit(0)).unionByName(tails)
    by = Window.partitionBy("range").orderBy("tail", "ord", "text")
    return (every.withColumn("next_text", F.lead("text").over(by)).withColumn("next_hash", F.xxhash64(F.lead("ord").over(by), F.lead("text").over(by)))
            .withColumn("rn", F.row_number().over(by)).where("tail = 0")
            .select("range", "rn", "doc_id", "text", F.xxhash64("ord", "text").alias("own_hash"), "next_text", "next_hash"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return fingerprint_report(docs)


def fingerprint_report(docs: DataFrame, radius: int = RADIUS, query_step: int = QUERY_STEP) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    n_near: for ids divisible by ``query_step`` the other rows within ``radius`` bits, else null."""
    n = F.length("text")
    k = F.floor(n / 4).cast("int")
    rows = (with_next(docs).withColumn("n_chars", n.cast("long"))
            .withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"), F.substring("next_text", F.lit(1), k))))
    # the digest travels as four longs: aggregates of numbers stay in hash maps
    sha = F.sha2("edited", 256)
    part = [F.conv(F.substring(sha, 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    carried = ["doc_id", "n_chars", "own_hash", "next_hash", *[f"sha{i}" for i in range(4)]]
    rows = rows.select("range", "rn", *carried[:4], *part,
                       F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("v"))
    # a null term keeps a text without words; it has no weight
    keys = ["range", "rn", "which"]
    terms = (rows.select("range", "rn", "v.which", *carried, _words(F.col("v.t")).alias("w"))
             .select(*keys, *carried, F.explode_outer(_pairs("w")).alias("x")).select(*keys, *carried, *_term("x")))
    one = (terms.groupBy(*keys).agg(F.sum("weight").alias("weight"), *[F.max(c).alias(c) for c in carried], *_votes())
           .select(*keys, *carried, _bits().alias("fp")))
    fps = materialize(one, "simhash")
    own = fps.where("which = 0")
    edited = fps.where("which = 1").select("range", "rn", F.col("fp").alias("edited_fp"))
    after = own.select(F.col("own_hash").alias("next_hash"), F.col("fp").alias("next_fp")).dropDuplicates(["next_hash"])
    near = within_radius(own, own.where(F.col("doc_id") % query_step == 0), radius)
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return (own.join(edited.hint("merge"), ["range", "rn"]).join(after.hint("merge"), "next_hash", "left").join(near.hint("merge"), "fp", "left")
            .select("doc_id", "n_chars", F.lower(F.concat(*[F.lpad(F.hex(f"sha{i}"), 16, "0") for i in range(4)])).alias("edited_sha256"), text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"),
                    likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
                    F.when(F.col("doc_id") % query_step == 0, F.col("near") - 1).alias("n_near")))
