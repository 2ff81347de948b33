"""Exact substring dedup with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document. A word goes if a window covers it whose
word sequence also starts in a document with a smaller ``doc_id``.

1. *Sketch.* A window's key is the least hash of its ``GRAM``-word grams, so neighbouring windows
   mostly share a key and equal windows always do. Each task counts its keys in a count-min sketch of
   ``DEPTH`` rows and sends the touched cells by block; one reducer per block merges them (counts stop
   at 2). What comes back is one bit per cell: counted twice or more. The width follows the corpus up to
   ``MAX_CELLS``, so the broadcast bits are at most DEPTH * MAX_CELLS / 8 = 64 MB. Beyond that width the
   sketch fills up and lets more windows through; it never loses one, since counts are overestimates.
   Whole copies of a smaller document are found first, by digest; all their windows lose, and they
   bring nothing new, so they take no part in the next steps.
2. *Exact pass.* Windows whose key is estimated repeated are grouped by a 128-bit hash of their words.
   Inside a run of SETTLE_ROWS all but the window of the smallest document are settled at once, so a window
   that a third of all documents share sends one row per run, not one per document. The rest meet the
   smallest ``doc_id`` of their group in a join that Spark can split.
3. Removed windows go back to their documents, and words outside them are kept.

Defined cases: null or empty text has no words and keeps the SHA-256 of the empty string; rows with a
null ``doc_id`` neither lose words nor make others lose them; rows that repeat a ``doc_id`` are judged
each by itself, and neither is smaller than the other; other columns are ignored.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relevo.llm import words as W
from relevo.session import bounded_batches, materialize

WINDOW = 13
GRAM = 5
DEPTH = 2
MIN_CELLS = 1 << 20
MAX_CELLS = 1 << 28
BLOCK = 1 << 16
#: Windows that a task settles among themselves before it sends the rest.
SETTLE_ROWS = 500_000
#: Copies whose ids are broadcast to leave them out: 32 MB. Beyond it Spark shuffles the texts once more.
MAX_BROADCAST_COPIES = 2_000_000


def window_keys(ws: W.Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the windows, and the key of each."""
    at = W.whole(ws.first, window)
    least = W.sliding_min(W.window_hashes(h, gram, 3), window - gram + 1)
    return at, least[at]


def cells_of(keys: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (W.mix(keys + np.uint64(0x9E3779B97F4A7C15 * (row + 1) & (1 << 64) - 1)) & np.uint64(cells - 1)).astype(np.int64)


def n_cells(chars: int) -> int:
    """Width for about four cells a key: some 6 characters a word, one key in 5 words."""
    return min(MAX_CELLS, max(MIN_CELLS, 1 << int(4 * chars / 30).bit_length()))


def _sketch_parts(cells: int, window: int, gram: int):
    """Per task: (row, block, cells seen once, cells seen twice or more), cells as 16-bit offsets."""
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])

    def flush(found):
        keys = np.concatenate(found) if found else np.empty(0, dtype=np.uint64)
        for row in range(DEPTH):
            cell, n = np.unique(cells_of(keys, row, cells), return_counts=True)
            if not len(cell):
                continue
            block, offset = cell // BLOCK, (cell % BLOCK).astype("<u2")
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            bounds = [*cut.tolist(), len(cell)]
            once = [offset[a:b][n[a:b] == 1].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            twice = [offset[a:b][n[a:b] > 1].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.record_batch([pa.array(np.full(len(cut), row, dtype=np.int32)), pa.array(block[cut].astype(np.int32)),
                                   pa.array(once, pa.binary()), pa.array(twice, pa.binary())], schema=schema)

    def run(batches):
        found, n = [], 0
        for batch in batches:
            for part in W.slices(batch):
                ws = W.words_of(part.column("text"))
                _, key = window_keys(ws, ws.hashes(1), window, gram)
                if not len(key):
                    continue
                doc = np.repeat(np.arange(len(ws.first) - 1), np.maximum(np.diff(ws.first) - window + 1, 0))
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                found.append(key[new])
                n += int(new.sum())
                if n > 4_000_000:
                    yield from flush(found)
                    found, n = [], 0
        yield from flush(found)

    return run


def _merge_parts(batches):
    """Counts of each block, stopping at 2; then a bit per cell that was counted twice."""
    counts: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, block, once, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = counts.setdefault((row, block), np.zeros(BLOCK, dtype=np.uint8))
            one = np.frombuffer(once, dtype="<u2")
            c[one] = np.minimum(c[one] + 1, 2)
            c[np.frombuffer(twice, dtype="<u2")] = 2
    for (row, block), c in counts.items():
        yield pa.record_batch([pa.array([row], pa.int32()), pa.array([block], pa.int32()), pa.array([np.packbits(c > 1).tobytes()], pa.binary())],
                              names=["row", "block", "bits"])


def repeated_cells(docs: DataFrame, cells: int, window: int, gram: int) -> list[np.ndarray]:
    """One bit per cell and sketch row; DEPTH * cells / 8 bytes in all, MAX_CELLS bounding them."""
    parts = docs.select("text").mapInArrow(_sketch_parts(cells, window, gram), "row int, block int, once binary, twice binary")
    merged = (parts.repartition(max(12, cells // BLOCK // 64), "row", "block")
              .mapInArrow(_merge_parts, "row int, block int, bits binary"))
    out = [np.zeros(cells // 8, dtype=np.uint8) for _ in range(DEPTH)]
    for r in merged.toLocalIterator(prefetchPartitions=True):
        out[r.row][r.block * BLOCK // 8:(r.block + 1) * BLOCK // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out


def _candidates(bits, cells: int, window: int, gram: int):
    """Windows estimated repeated. Rows with ``h1``: the smallest document at hand that has the window;
    rows with ``settled``: start positions that already lose to another document at hand."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
                        ("pos", pa.int32()), ("settled", pa.binary())])

    def settle(found):
        h1, h2, doc, text, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((doc, h2, h1))
        h1, h2, doc, text, pos = h1[order], h2[order], doc[order], text[order], pos[order]
        group = np.ones(len(h1), dtype=bool)
        group[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        least = doc[np.maximum.accumulate(np.where(group, np.arange(len(group)), 0))]
        lost = doc > least
        k = ~lost
        n = int(k.sum())
        yield pa.record_batch([W.int64(h1[k]), W.int64(h2[k]), pa.array(doc[k]), pa.array(text[k]), pa.array(pos[k]), pa.nulls(n, pa.binary())], schema=schema)
        doc, text, blobs = gathered(doc[lost], text[lost], pos[lost])
        none = pa.nulls(len(doc), pa.int64())
        yield pa.record_batch([none, none, pa.array(doc), pa.array(text), pa.nulls(len(doc), pa.int32()), blobs], schema=schema)

    def run(batches):
        table, found, n = bits.value, [], 0
        for batch in batches:
            for part in W.slices(batch):
                ws = W.words_of(part.column("text"))
                h = ws.hashes(1)
                at, key = window_keys(ws, h, window, gram)
                hit = np.ones(len(key), dtype=bool)
                for row in range(DEPTH):
                    c = cells_of(key, row, cells)
                    hit &= (table[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8) & 1).astype(bool)
                at = at[hit]
                if not len(at):
                    continue
                row = np.searchsorted(ws.first, at, side="right") - 1
                found.append((W.window_hashes(h, window, 5)[at], W.window_hashes(ws.hashes(2), window, 6)[at],
                              np.asarray(part.column("doc_id"))[row], np.asarray(part.column("text_hash"))[row], (at - ws.first[row]).astype(np.int32)))
                n += len(at)
                if n >= SETTLE_ROWS:
                    yield from settle(found)
                    found, n = [], 0
        if found:
            yield from settle(found)

    return run


def gathered(doc: np.ndarray, text: np.ndarray, pos: np.ndarray):
    """Positions by document: (doc_id, text_hash, one binary of 32-bit positions)."""
    order = np.lexsort((text, doc))
    doc, text, pos = doc[order], text[order], pos[order].astype("<i4")
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])
    cut = np.flatnonzero(new)
    ends = np.append(cut, len(doc))
    return doc[cut], text[cut], pa.array([pos[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)], pa.binary())


def copies(known: DataFrame) -> DataFrame:
    """(doc_id, text_hash) of documents whose whole text a smaller document has, and no own smaller row."""
    digest = known.select("doc_id", "text_hash", F.md5("text").alias("digest"))
    least = digest.groupBy("digest").agg(F.min("doc_id").alias("least"))
    return digest.join(least.hint("merge"), "digest").where("doc_id > least").select("doc_id", "text_hash").distinct()


def with_text_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash): the hash tells rows of one doc_id apart and is 0 where an id has one row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    many = materialize(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_many")), "repeated-ids")
    side = F.broadcast(many) if many.count() <= MAX_BROADCAST_COPIES else many.hint("merge")
    return (rows.join(side, F.col("doc_id") == F.col("_many"), "left")
            .select("doc_id", "text", F.when(F.col("_many").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("text")).alias("text_hash")))


def removed_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` as of ``with_text_hash``. (doc_id, text_hash, open, settled, copy): start positions of windows
    that also start in a smaller document, as a list or as a binary; ``copy``: a smaller document has the whole text."""
    spark = docs.sparkSession
    known = docs.where("doc_id is not null and text is not null")
    again = materialize(copies(known), "copies")
    few = again.count() <= MAX_BROADCAST_COPIES
    fresh = known.join(F.broadcast(again) if few else again.hint("merge"), ["doc_id", "text_hash"], "left_anti")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    cells = n_cells(chars)
    bits = spark.sparkContext.broadcast(repeated_cells(fresh, cells, window, gram))
    found = fresh.mapInArrow(_candidates(bits, cells, window, gram),
                             "h1 long, h2 long, doc_id long, text_hash long, pos int, settled binary")
    open_ = found.where("h1 is not null").drop("settled")
    least = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"))
    lost = open_.join(least.hint("merge"), ["h1", "h2"]).where("doc_id > least").select("doc_id", "text_hash", "pos")
    lists = (lost.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("open"))
             .unionByName(found.where("h1 is null").select("doc_id", "text_hash", "settled").withColumn("open", F.lit(None).cast("array<int>")), allowMissingColumns=True))
    return lists.withColumn("copy", F.lit(False)).unionByName(again.withColumn("copy", F.lit(True)), allowMissingColumns=True)


def _keep(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in W.slices(batch):
                kept, n_words, n_removed = [], [], []
                for text, blobs, open_, copy in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("settled").to_pylist(), part.column("open"), part.column("copy").to_pylist(), strict=True):
                    ws = (text or b"").split()  # bytes.split() cuts at \x20 and \x09-\x0D
                    gone = 0
                    if copy and len(ws) >= window:
                        gone, stay = len(ws), np.zeros(len(ws), dtype=bool)
                    elif blobs or open_.is_valid and len(open_):
                        edge = np.zeros(len(ws) + 1, dtype=np.int32)
                        more = [open_.values.to_numpy()] if open_.is_valid else []
                        pos = np.unique(np.concatenate([np.frombuffer(b"".join(blobs or []), dtype="<i4"), *more]))
                        np.add.at(edge, pos, 1)
                        np.add.at(edge, pos + window, -1)
                        stay = np.cumsum(edge[:-1]) == 0
                        gone = len(ws) - int(stay.sum())
                    kept.append(b" ".join(compress(ws, stay.tolist())) if gone else b" ".join(ws))
                    n_words.append(len(ws))
                    n_removed.append(gone)
                yield pa.record_batch([part.column("doc_id"), part.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_text): one row per input row. ``kept_text`` is the UTF-8 of
    the words that stay, joined by one space."""
    bounded_batches(docs.sparkSession)
    rows = with_text_hash(docs)
    gone = (removed_windows(rows, window, gram).groupBy("doc_id", "text_hash")
            .agg(F.collect_list("settled").alias("settled"), F.flatten(F.collect_list("open")).alias("open"), F.max("copy").alias("copy")))
    both = rows.join(gone, ["doc_id", "text_hash"], "left").select("doc_id", "text", "settled", "open", "copy")
    return both.mapInArrow(_keep(window), "doc_id long, text string, n_words long, n_removed long, kept_text binary")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# windows as joined words: the same rows from DuckDB
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 11, 1))) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM p),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
lost AS (SELECT g.doc_id, g.i FROM g JOIN m USING (win) WHERE g.doc_id > m.least),
gone AS (SELECT DISTINCT doc_id, i + d AS j FROM lost, (SELECT unnest(range(0, 13)) AS d)),
k AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN js IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(js, i)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
