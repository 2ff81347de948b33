"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question asked again with other values has the same
template. An item's windows are its runs of WINDOW template words; a window needs MIN_LITERALS ordinary words.

1. Every window of every document meets the items' windows in a hash join. The items' side is broadcast while
   it is small (checked), otherwise Spark shuffles both sides.
2. A document that holds at least SHARE of an item's distinct windows is a candidate for that item.
3. Slot check, on the candidates only: where windows agree, the value in each slot of the item faces a value of
   the document. In a re-parameterised copy equal values of the item face equal values of the document; the share of
   slots that face the most frequent partner of their value must reach CONSISTENT. No slots: 1. A template that occurs
   more than once faces itself at other places, so the best of several frames counts: all matches; all, each window of
   the item on its diagonal (place in the document less place in the item) with the most matches; and the same within
   each diagonal and each range of diagonals that holds SHARE of the item's windows. A verbatim copy has 1.

What counts as a name: a capitalised word after a word, number or comma and one space, so not the first word of
a sentence or line. All of it is DataFrame expressions.

Defined cases: null text has no words and is clean; items with fewer than WINDOW words can't be told from
ordinary prose and match nothing; null or repeated item ids count as items of that id (a null id is shown as
``null``); rows that repeat a doc_id are judged each by its text; no items: every document is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.session import materialize

WINDOW = 5
SHARE = 0.8
CONSISTENT = 0.8
MIN_LITERALS = 3
#: Windows of all items that are broadcast (about 50 bytes each), and documents whose keys are.
MAX_BROADCAST_WINDOWS = 1_000_000
MAX_BROADCAST_KEYS = 1_000_000

NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
SLOTS = f"{NUMBER}-{UNIT}"

# Fixed value: units that may follow a number.
UNITS = ("mm cm km m kg mg g lb lbs oz ml l ft feet inch inches in yd yards miles mile mph hours hour minutes minute min seconds second sec "
         "days day weeks week months month years year % percent dollars dollar cents cent euros euro usd eur gb mb kb hz watts volts degrees").split()


def _marked(text: Column, values: bool) -> Column:
    """``text`` with placeholders; ``values``: each followed by the value that it stands for, up to a space."""
    keep = "$0" if values else ""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), f"{NUMBER}{NAME}{UNIT}", "   ")
    unit = "|".join(sorted((u.replace("%", r"\x25") for u in UNITS), key=len, reverse=True))
    with_units = F.regexp_replace(t, rf"(?<=[0-9])\x20?((?i:{unit}))(?![\p{{L}}\p{{N}}])", f" {UNIT}{'$1' if values else ''} ")
    numbers = F.regexp_replace(with_units, r"[0-9]+(?:[.,:/][0-9]+)*", f" {NUMBER}{keep} ")
    t = F.when(t.rlike("[0-9]"), numbers).otherwise(t)
    return F.regexp_replace(t, rf"(?<=[\p{{L}}\p{{N}},;:'{SLOTS}]\x20)\p{{Lu}}[\p{{L}}'-]*", f"{NAME}{keep} ")


def template_words(text: Column) -> Column:
    """Lower-case words and placeholders, in order."""
    return F.filter(F.split(F.lower(_marked(text, False)), rf"[^\p{{L}}{SLOTS}]+"), lambda w: w != "")


def _windows(words: str, window: int) -> Column:
    """array<struct> of the window's words c0, c1, ...; null words where it would run past the end."""
    from_ = [F.slice(words, F.lit(i + 1), F.greatest(F.size(words) - i, F.lit(0))) for i in range(window)]
    return F.slice(F.arrays_zip(*[f.alias(f"c{i}") for i, f in enumerate(from_)]), F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(0)))


def _hash(x: str, window: int) -> Column:
    return F.xxhash64(*[F.col(f"{x}.c{i}") for i in range(window)])


def _literals(x: str, window: int) -> Column:
    return sum((F.when(F.col(f"{x}.c{i}").between(NUMBER, UNIT), 0).otherwise(1) for i in range(window)), F.lit(0))


def _few(df: DataFrame, limit: int) -> bool:
    return df.count() <= limit


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, h, total): distinct windows of each item with enough ordinary words, and their number."""
    one = (items.select("item_id", template_words(F.col("text")).alias("w")).select("item_id", F.explode(_windows("w", window)).alias("x"))
           .where(_literals("x", window) >= MIN_LITERALS).select("item_id", _hash("x", window).alias("h")).distinct())
    return one.join(one.groupBy("item_id").agg(F.count("*").alias("total")).withColumnRenamed("item_id", "_i"), F.col("item_id").eqNullSafe(F.col("_i"))).drop("_i")


def candidates(docs: DataFrame, wins: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, containment) of documents that hold ``share`` of an item's windows."""
    pos = (docs.select("doc_id", "text_hash", template_words(F.col("text")).alias("w"))
           .select("doc_id", "text_hash", F.explode(_windows("w", window)).alias("x")).select("doc_id", "text_hash", _hash("x", window).alias("h")))
    side = F.broadcast(wins) if _few(wins, MAX_BROADCAST_WINDOWS) else wins.hint("merge")
    keys = ["doc_id", "text_hash", "item_id"]
    hits = pos.join(side, "h").groupBy(*keys, "h").agg(F.first("total").alias("total"))
    return (hits.groupBy(*keys).agg(F.count("*").alias("n"), F.first("total").alias("total"))
            .select(*keys, (F.col("n") / F.col("total")).alias("containment"), "total").where(F.col("containment") >= share))


def _placed(rows: DataFrame, keys: list[str], window: int, out: str, at: str) -> DataFrame:
    """(keys, h, out, at, literals, size): each window, its raw words, its place, its ordinary words, and the words of the text."""
    raw = F.regexp_extract_all(_marked(F.col("text"), True), F.lit(rf"[{SLOTS}][^ ]*|\p{{L}}+"), F.lit(0))
    typed = F.transform("r", lambda t: F.when(t.between(NUMBER, UNIT + "\uffff"), F.substring(t, 1, 1)).otherwise(F.lower(t)))
    return (rows.select(*keys, raw.alias("r")).select(*keys, "r", typed.alias("w"))
            .select(*keys, F.size("w").alias("size"), F.posexplode(F.arrays_zip(_windows("w", window).alias("x"), _windows("r", window).alias("y"))).alias(at, "z"))
            .select(*keys, _hash("z.x", window).alias("h"), F.array(*[F.col(f"z.y.c{i}") for i in range(window)]).alias(out), at, _literals("z.x", window).alias("literals"), "size"))


def slot_consistency(docs: DataFrame, items: DataFrame, cand: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, text_hash, item_id, consistency) for the candidates that have slots in common with the item."""
    keys = cand.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct()
    side = F.broadcast(keys) if _few(keys, MAX_BROADCAST_KEYS) else keys.hint("merge")
    own = docs.join(side, docs["doc_id"].eqNullSafe(F.col("_d")) & (docs["text_hash"] == F.col("_t")), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    of_doc = _placed(own, ["doc_id", "text_hash"], window, "theirs", "there").drop("literals", "size")
    picked = cand.select("doc_id", "text_hash", "item_id", "total").withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    both = of_doc.join(picked, of_doc["doc_id"].eqNullSafe(F.col("_d")) & (of_doc["text_hash"] == F.col("_t")))
    texts = items.where("text is not null").dropDuplicates(["item_id", "text"]).withColumn("of", F.xxhash64("text"))  # an id may have several texts
    of_item = _placed(texts, ["item_id", "of"], window, "ours", "here").withColumnsRenamed({"item_id": "_i", "h": "_h"})
    key = ["doc_id", "text_hash", "item_id"]
    met = (both.join(of_item, (F.col("h") == F.col("_h")) & F.col("item_id").eqNullSafe(F.col("_i")))
           .select(*key, "total", "of", "here", (F.col("there") - F.col("here")).alias("diagonal"), "ours", "theirs", "size", F.when(F.col("literals") >= MIN_LITERALS, F.col("h")).alias("h")))

    half = F.greatest(F.lit(window), F.expr("cast(size div 4 as int)"))

    def ranges(shift) -> Column:
        return F.floor((F.col("diagonal") + shift) / (2 * half))

    def frame(kind: str, place: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind not in ("all", "best")), F.col("of")).alias("of"), place.cast("long").alias("place"))

    frames = F.array(frame("all", F.lit(0)), frame("best", F.lit(0)), frame("diagonal", F.col("diagonal")), frame("even", ranges(F.lit(0))), frame("odd", ranges(half)))
    framed = met.withColumn("frame", F.explode(frames))
    line = [*key, "frame", "of", "diagonal"]
    held = framed.groupBy(*line).agg(F.count("*").alias("held")).withColumnsRenamed({c: f"_{c}" for c in line})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in line]
    # in "all" each match stands for itself; else each window of the item keeps one match
    spot = F.when(F.col("frame.kind") == "all", F.col("diagonal"))
    kept = (framed.join(held, same).groupBy(*key, "frame", "of", "here", spot.alias("spot"))
            .agg(F.max_by(F.struct("ours", "theirs"), F.struct("held", -F.col("diagonal"))).alias("m"), F.first("total").alias("total"), F.first("h").alias("h")))
    slots = F.filter(F.arrays_zip(F.col("m.ours").alias("ours"), F.col("m.theirs").alias("theirs")), lambda x: x["ours"].between(NUMBER, UNIT + "\uffff"))
    kept = kept.withColumn("s", slots)
    whole = kept.groupBy(*key, "frame").agg((F.count_distinct("h") / F.first("total")).alias("part"))
    whole = whole.where((F.col("part") >= share) | F.col("frame.kind").isin("all", "best")).select(*[F.col(c).alias(f"_{c}") for c in [*key, "frame"]])
    faced = kept.select(*key, "frame", F.explode("s").alias("s")).groupBy(*key, "frame", "s.ours", "s.theirs").agg(F.count("*").alias("n"))
    best = faced.groupBy(*key, "frame", "ours").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    one = best.groupBy(*key, "frame").agg((F.sum("most") / F.sum("n")).alias("consistency"))
    return (one.join(whole, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*key, "frame"]], "left_semi").groupBy(*key).agg(F.max("consistency").alias("consistency")))


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: float = SHARE, consistent: float = CONSISTENT) -> DataFrame:
    """(doc_id, text_hash, item_id, containment, consistency): one row per document text and item that it repeats."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    own = items.select("item_id", "text")
    cand = materialize(candidates(rows, materialize(item_windows(own, window), "item-windows"), window, share), "leak-candidates")
    slots = slot_consistency(rows, own, cand, window, share).withColumnsRenamed({"doc_id": "_d", "text_hash": "_t", "item_id": "_i"})
    on = cand["doc_id"].eqNullSafe(F.col("_d")) & (cand["text_hash"] == F.col("_t")) & cand["item_id"].eqNullSafe(F.col("_i"))
    return (cand.join(slots, on, "left").select("doc_id", "text_hash", "item_id", "containment", F.coalesce("consistency", F.lit(1.0)).alias("consistency"))
            .where(F.col("consistency") >= consistent))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined), containment and consistency of the best item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    best = F.max(F.struct("containment", "consistency"))
    one = (found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.coalesce(F.lpad(F.col("item_id").cast("string"), 20, "0"), F.lit("null")))).alias("i"), best.alias("b"))
           .withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"}))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    ids = F.array_join(F.transform("i", lambda x: F.regexp_replace(x, "^0+(?=.)", "")), ",")
    return (rows.join(one, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
            .select("doc_id", F.col("_t").isNotNull().alias("contaminated"), F.coalesce(F.size("i"), F.lit(0)).cast("long").alias("n_items"),
                    F.coalesce(ids, F.lit("")).alias("item_ids"), F.coalesce("b.containment", F.lit(0.0)).alias("containment"), F.col("b.consistency").alias("consistency")))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that repeat no benchmark item, with all their columns."""
    found = materialize(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), "leaks")
    side = F.broadcast(found) if _few(found, MAX_BROADCAST_KEYS) else found.hint("merge")
    return docs.join(side, docs["doc_id"].cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_t")), "left_anti")
