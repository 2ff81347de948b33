"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its weight's share of all words, at most MAX_COPIES times what it has; what a full source
leaves goes to the others by weight. Every document of a source should then be taken ``target / source_size``
times. The whole part is settled at once. The fractions are rounded in pairs: of two documents one gains as many
words as the other loses, so the source's expected words never change; chance picks the direction so that
neither document's expectation changes; and the step is as large as keeps both fractions within 0 and 1, so one of
them becomes whole. The other meets the next document.

The pairs form a reduction tree. A leaf folds about FAN documents of a source into one that is still
fractional, an inner node FAN such residuals, and so on; a source that holds most rows only has more leaves.

What is left of a source is one document, and it would tend to be a large one. So the larger documents, which hold half of the
source's words at most, have a tree of their own, and its residual trades with all smaller documents of the source as one
partner: their fractions all move by the same amount. Then the smaller ones have their tree. Only its residual is
rounded to the nearer side, and a source misses its target by half of a smaller document (or of the document that all
smaller ones together couldn't settle).

All chance comes from hashes of the documents, so reruns agree. All of it is DataFrame expressions; the folds are
``aggregate`` over arrays of about FAN structs.

Defined cases: null text and a text without words have size 0 and are taken 0 times; a null source is a source of
its own, the last one; rows of equal id, source and size share their probabilities: together they are taken as often as their
sum says, to the last copy, which alone takes part in the tree; null ids are such rows; other columns are ignored; if no text has
words every target is 0; an empty table gives no rows. Targets come from a sort of one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relevo.operators.topn import fits
from relevo.session import materialize

MAX_COPIES = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (1, 2, 3)
#: Documents that a node of the tree folds.
FAN = 64
#: Fractions this near to 0 or 1 are whole: what sums of doubles may leave.
NEARLY = 1e-9
#: Sources whose table may be broadcast (about 100 bytes each).
MAX_BROADCAST_SOURCES = 100_000
#: Equal rows that are written out at once.
EXPAND_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) of ``sizes`` (source, size, rows): the words that each source should give.

    With sources in ascending order of ``most / weight``, a prefix of them is full; the first that is not, and all
    after it, share the rest by weight."""
    every = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = every.withColumn("weight", w).withColumn("most", max_copies * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    whole, before = Window.partitionBy(), fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("place", F.row_number().over(fill))
         .withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0)))
         .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         # full: its part of what is left is no less than the most that it gives (integers: no rounding)
         .withColumn("full", F.col("most") * F.col("left_weight") <= F.col("left") * F.col("weight"))
         .withColumn("rest", F.min(F.when(~F.col("full"), F.struct("place", "left", "left_weight"))).over(whole)))
    target = F.when(F.col("rest").isNull() | (F.col("place") < F.col("rest.place")), F.col("most").cast("double")) \
              .otherwise(F.col("rest.left").cast("double") * F.col("weight") / F.col("rest.left_weight"))
    return s.select("source", "source_size", target.alias("target"))


def _chance(*cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _trade(r: Column, x: Column, level: int) -> Column:
    """(the item that stays fractional, the one that became whole) after ``r`` and ``x`` have traded words.

    Which of them becomes whole follows from comparisons, not from sums of fractions, so whole is exactly 0 or 1."""
    room = lambda i: (1 - i["p"]) * i["size"]
    has = lambda i: i["p"] * i["size"]

    def moved(a: Column, b: Column) -> Column:
        """``a`` wins what it can from ``b``: a is full or b is empty."""
        full, empty = room(a) <= has(b), has(b) <= room(a)
        a2 = a.withField("p", F.when(full, 1.0).otherwise(a["p"] + has(b) / a["size"]))
        b2 = b.withField("p", F.when(empty, 0.0).otherwise(b["p"] - room(a) / b["size"]))
        return F.when(full, F.struct(b2.alias("r"), a2.alias("whole"))).otherwise(F.struct(a2.alias("r"), b2.alias("whole")))

    gain, loss = F.least(room(r), has(x)), F.least(has(r), room(x))
    return F.when(_chance(r["order"], x["order"], F.lit(level)) * (gain + loss) < loss, moved(r, x)).otherwise(moved(x, r))


def _fold(items: Column, level: int) -> Column:
    """One residual ``r`` and the settled items ``done`` of an array of ITEM structs."""
    def step(acc: Column, x: Column) -> Column:
        r = acc["r"]
        # both may become whole at once: the residual is then whole already, and the next item takes its place
        pair = F.when((r["p"] <= 0) | (r["p"] >= 1), F.struct(x.alias("r"), r.alias("whole"))).otherwise(_trade(r, x, level))
        return F.transform(F.array(pair), lambda t: F.struct(t["r"].alias("r"), F.concat(acc["done"], F.array(t["whole"])).alias("done")))[0]

    start = F.struct(F.element_at(items, 1).alias("r"), F.slice(items, 1, 0).alias("done"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


ITEM = ("order", "doc_id", "size", "rows", "sure", "p")


def settle(items: DataFrame, fan: int = FAN, name: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(settled items, one residual per source) of ``items`` (source, ITEM columns) by the reduction tree; 0 < p < 1 and
    size > 0. ``order`` is a hash that tells the items of a source apart."""
    counts = materialize(items.groupBy("source").agg(F.count("*").alias("n")), f"{name}-counts")
    most = counts.agg(F.max("n")).first()[0] or 0
    each = F.broadcast(counts) if fits(counts, MAX_BROADCAST_SOURCES) else counts
    part = items.join(each.withColumnRenamed("source", "_s"), items["source"].eqNullSafe(F.col("_s")))
    leaves = F.ceil(F.col("n") / fan).cast("long")
    part = part.select("source", F.pmod(F.xxhash64("order", F.lit("leaf")), leaves).alias("node"), F.struct(*ITEM).alias("x"))
    done, level, nodes = None, 0, -(-most // fan)
    while True:
        # sorted by the hash, so the fold doesn't depend on how rows arrive
        folded = part.groupBy("source", "node").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("source", "node", _fold(F.col("xs"), level).alias("f"))
        folded = materialize(folded, f"{name}-level{level}")
        out = folded.select("source", F.explode("f.done").alias("x")).select("source", "x.*")
        done = out if done is None else done.unionByName(out)
        part = folded.select("source", F.floor(F.col("node") / fan).cast("long").alias("node"), F.col("f.r").alias("x"))
        if nodes <= 1:
            return done, part.select("source", "x.*")
        nodes, level = -(-nodes // fan), level + 1


def _with_rest(residual: DataFrame, rest: DataFrame) -> DataFrame:
    """``residual`` after it has traded with all smaller documents of its source, and ``delta``: how far their
    fractions move. ``rest`` has (source, words, lo, hi): their words, least and greatest fraction."""
    r = residual.join(rest.withColumnRenamed("source", "_s"), residual["source"].eqNullSafe(F.col("_s")), "left").fillna(0.0, ["words", "lo", "hi"])
    room, has = (1 - F.col("p")) * F.col("size"), F.col("p") * F.col("size")
    give, take = F.col("words") * F.col("lo"), F.col("words") * (1 - F.col("hi"))
    gain, loss = F.least(room, give), F.least(has, take)
    up = _chance("order", F.lit("rest")) * (gain + loss) < loss
    # nothing to trade with: it stays as it is
    p = F.when(gain + loss <= 0, F.col("p")).when(up, F.when(room <= give, 1.0).otherwise(F.col("p") + gain / F.col("size"))) \
         .otherwise(F.when(has <= take, 0.0).otherwise(F.col("p") - loss / F.col("size")))
    delta = F.when(gain + loss <= 0, 0.0).when(up, -gain / F.col("words")).otherwise(loss / F.col("words"))
    return r.select("source", *[p.alias("p") if c == "p" else c for c in ITEM], delta.alias("delta"))


def round_copies(items: DataFrame, fan: int = FAN) -> DataFrame:
    """``items`` (source, ITEM columns) with p rounded to 0 or 1; 0 <= p <= 1, and 0 where size is 0."""
    items = items.withColumn("cls", F.when((F.col("p") > 0) & (F.col("p") < 1), F.length(F.bin("size"))))
    by = Window.partitionBy("source").orderBy("cls")  # 64 classes of sizes a source at most
    stats = (items.where("cls IS NOT NULL").groupBy("source", "cls").agg(F.sum("size").alias("words"), F.min("p").alias("lo"), F.max("p").alias("hi"))
             .withColumn("below", F.sum("words").over(by) - F.col("words")).withColumn("all", F.sum("words").over(Window.partitionBy("source")))
             .withColumn("small", F.col("below") * 2 < F.col("all")))
    rest = materialize(stats.where("small").groupBy("source").agg(F.sum("words").alias("words"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("cls").alias("top")), "mix-rest")
    small = fits(rest, MAX_BROADCAST_SOURCES)

    def per_source(df: DataFrame, table: DataFrame) -> DataFrame:
        t = table.withColumnRenamed("source", "_s")
        return df.join(F.broadcast(t) if small else t, df["source"].eqNullSafe(F.col("_s")), "left").drop("_s")

    items = per_source(items, rest.select("source", "top")).withColumn("large", F.col("cls") > F.col("top"))
    out, residual = settle(items.where("large").select("source", *ITEM), fan, "mix-large")
    traded = materialize(_with_rest(residual, rest), "mix-traded")
    p = F.col("p") + F.coalesce("delta", F.lit(0.0))
    moved = (per_source(items.where("NOT large").select("source", *ITEM), traded.select("source", "delta"))
             .withColumn("p", F.when(p < NEARLY, 0.0).when(p > 1 - NEARLY, 1.0).otherwise(p)).select("source", *ITEM))
    moved = moved.unionByName(traded.drop("delta"))
    done, residual = settle(moved.where("p > 0 AND p < 1"), fan, "mix-small")
    for part in (done, residual.withColumn("p", F.round("p")), moved.where("p <= 0 OR p >= 1"), items.where("cls IS NULL").select("source", *ITEM)):
        out = out.unionByName(part)
    return out


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, fan: int = FAN, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each document of ``docs`` (doc_id, text,
    source) the mix takes; ``seed`` picks another mix."""
    words = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"))
    rows = materialize(sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "mix-sizes")
    targets = materialize(source_targets(rows, weights, max_copies), "mix-targets")
    small = fits(targets, MAX_BROADCAST_SOURCES)

    def with_targets(df: DataFrame) -> DataFrame:
        t = targets.select(F.col("source").alias("_s"), "source_size", "target")
        return df.join(F.broadcast(t) if small else t, df["source"].eqNullSafe(F.col("_s"))).drop("_s")

    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # of equal rows, all but one copy are settled at once: together they have rows * (the fraction) copies
    many = F.col("rows") * (F.col("times") - F.floor("times"))
    cut = (with_targets(rows).withColumn("times", times).withColumn("extra", F.floor(many)).withColumn("p", F.when(F.col("size") > 0, many - F.col("extra")).otherwise(F.lit(0.0)))
           .withColumn("sure", (F.floor("times") * F.col("rows") + F.col("extra")).cast("long"))
           .withColumn("order", F.xxhash64("doc_id", "size", F.lit(seed))).select("source", *ITEM))
    cut = materialize(cut, "mix-items")
    settled = round_copies(cut, fan)
    # copies of equal rows: the first ones take one more than the others
    copies = F.col("sure") + (F.col("p") >= 1).cast("long")
    blocks = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(EXPAND_ROWS).cast("long")))
    each = settled.withColumn("copies", copies).withColumn("i", blocks)
    each = each.withColumn("i", F.explode(F.sequence("i", F.least(F.col("rows"), F.col("i") + EXPAND_ROWS - 1))))
    share = F.expr("copies div rows") + (F.col("i") <= F.expr("copies % rows")).cast("long")
    return with_targets(each).select("doc_id", "source", "size", "source_size", "target", (share * F.col("size")).cast("long").alias("taken"))


def op13_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
